"""Near copies with some words changed: planted ones, and every pair of a brute-force comparison."""

import random
from itertools import combinations

import corpus_pipeline
from trialflow.llm import nearcopies, simhash

VOCABULARY = [f"w{i}" for i in range(3000)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    rng = random.Random(5)
    rows, doc = [], 0
    for n in (60, 200, 200, 800, 2000):
        base = [rng.choice(VOCABULARY) for _ in range(n)]
        rows.append((doc := doc + 1, " ".join(base)))
        for share in (0, 0.002, 0.01, 0.02, 0.06, 0.3):
            words = [rng.choice(VOCABULARY) if rng.random() < share else w for w in base]
            rows.append((doc := doc + 1, " ".join(words)))
    group = [rng.choice(VOCABULARY) for _ in range(150)]
    for _ in range(60):
        words = list(group)
        words[rng.randrange(150)] = rng.choice(VOCABULARY)
        rows.append((doc := doc + 1, " ".join(words)))
    return rows + [(doc + 1, "a b c"), (doc + 2, "A B c"), (doc + 3, "a b d"), (doc + 4, ""), (doc + 5, None)]


def components_of(rows):
    sets, root = {i: shingles(t or "") for i, t in rows}, {i: i for i, _ in rows}
    for a, b in combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    rows = planted()
    root = components_of(rows)
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == root
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(root.values())) and kept.count(None) == 1
    assert 1 < len(set(root.values())) < len(rows) - 60


def test_pairs_within_a_family_of_one_template_are_all_found(spark):
    """80 texts share a template; two each share more: Jaccard 0.807 in a pair, 0.787 across pairs."""
    rng = random.Random(3)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    template, rows = fresh(396), []
    for pair in range(40):
        both = fresh(5)
        rows += [(2 * pair + k, " ".join(template + both + fresh(45))) for k in (0, 1)]
    sets = {i: shingles(t) for i, t in rows}
    assert jaccard(sets[0], sets[1]) >= 0.8 > jaccard(sets[0], sets[2]) > 0.78
    assert components_of(rows) == {i: i - i % 2 for i, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == components_of(rows)


def test_rare_shingles_lose_no_similar_pair(spark):
    """Sets of few shingles, so that many pairs are similar and few shingles are rare."""
    rng = random.Random(6)
    sets = {}
    for i in range(260):
        base = set(rng.sample(range(40), rng.randrange(1, 14))) if i % 3 == 0 or not sets else set(sets[rng.choice(list(sets))])
        for _ in range(rng.randrange(3)):
            base ^= {rng.randrange(40)}
        if base:
            sets[i] = sorted(base)
    roots = {i: i % 7 if rng.random() < 0.3 else i for i in sets}
    frame = spark.createDataFrame([(i, roots[i], s) for i, s in sets.items()], "node long, root long, shingles array<long>")
    got = {tuple(r) for r in nearcopies.rare_shingle_pairs(frame).collect()}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if roots[a] != roots[b] and jaccard(set(sets[a]), set(sets[b])) >= 0.8}
    assert want <= got and len(want) > 50


def test_empty_table(spark):
    assert nearcopies.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_drops_what_fingerprints_link_too(spark):
    """Repeated shingles decide a fingerprint: texts of one refrain are 0 bits apart, with Jaccard far below 0.8."""
    rng = random.Random(9)
    refrain = "la di da " * 400
    rows = [(i, refrain + " ".join(rng.sample(VOCABULARY, 8))) for i in (5, 3, 8)] + [(i, " ".join(rng.sample(VOCABULARY, 40))) for i in (1, 2)]
    rows += [(9, rows[0][1] + " " + rows[0][1].split()[-1]), (None, refrain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs.filter("doc_id IS NOT NULL")).collect()}
    assert fps[5] == fps[8] == 3 and fps[1] == 1 and fps[2] == 2
    assert components_of([r for r in rows if r[0] is not None])[8] == 8
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, None], key=str)
