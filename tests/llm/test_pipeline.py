"""The corpus pipeline beside plain Python: which ids each stage keeps of planted documents, and odd rows."""

import hashlib
import math
import random
import re
import zlib

import pytest
from test_decontamination import brute_force as overlaps
from test_near_copies import components_of
from test_sharding import gapless

import corpus_pipeline
from trialflow.llm import mixing, toxicity

INSULTS = ["idiot", "scumbag", "worthless", "pathetic"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(seed=12):
    """(documents, labels, items): clean, toxic, copied, nearly copied and benchmark texts, and their mixtures."""
    rng = random.Random(seed)
    pool = [f"{a}{b}{c}" for a in "btrs" for b in ("a", "o", "ei", "u") for c in ("n", "st", "ll", "mer", "k", "ta", "vi", "x")]
    prose = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(i, prose(rng.choice((14, 25, 60)))) for i in range(8)]
    docs, labels = [], []

    def add(words, toxic=0):
        i = len(docs)
        docs.append((i, " ".join(words), rng.choice(["en", "en", "de"]), rng.choice("aab"), 0))
        labels.append((i, 1, toxic))
        return words

    for _ in range(520):
        kind, words = rng.random(), prose(rng.choice((30, 60, 150, 1100)))
        if kind < 0.2:
            for term in rng.sample(INSULTS, 3):
                words[rng.randrange(len(words))] = term
            add(words, 1)
        elif kind < 0.3:
            item, at = rng.choice(items)[1], rng.randrange(len(words))
            part = list(item)
            for k in range(0, len(part), 6):
                part[k] = "zzz"
            add(words[:at] + part + words[at:])
        elif kind < 0.4:
            add(words)
            add(words)
        elif kind < 0.5:
            add(words)
            for _ in range(rng.randrange(1, 4)):
                near = list(words)
                near[rng.randrange(len(near))] = "yyy"
                add(near)
        else:
            add(words)
    return docs, labels, [(i, " ".join(w)) for i, w in items]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels, items = planted()
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, labels, items


def not_toxic(docs, labels):
    toxic = {i for i, _, y in labels if y}
    return [d for d in docs if d[0] not in toxic]


def one_of_each(docs):
    root = components_of([d[:2] for d in docs])
    return [d for d in docs if root[d[0]] == d[0]]


def without_items(docs, items):
    found = {d for d, _, _ in overlaps([d[:2] for d in docs], items)}
    return [d for d in docs if d[0] not in found]


def mixed(docs):
    """Raking in plain Python until nothing moves, the budget by trying how many cells are sampled whole."""
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    genre = lambda n: "note" if n < 100 else "article" if n < 1000 else "book"
    cell_of = {d[0]: (d[3], d[2], genre(words(d[1]))) for d in docs}
    tokens = {}
    for d in docs:
        tokens[cell_of[d[0]]] = tokens.get(cell_of[d[0]], 0) + words(d[1])
    total, weight, wanted = sum(tokens.values()), dict(tokens), []
    for k in range(3):
        sums = {}
        for c, n in tokens.items():
            sums[c[k]] = sums.get(c[k], 0) + n
        powers = {v: n**mixing.SMOOTHING for v, n in sums.items()}
        wanted.append({v: p / sum(powers.values()) * total for v, p in powers.items()})
    for _ in range(mixing.ROUNDS):
        for k in range(3):
            sums = {}
            for c, w in weight.items():
                sums[c[k]] = sums.get(c[k], 0) + w
            weight = {c: w * wanted[k][c[k]] / sums[c[k]] for c, w in weight.items()}
    cells = sorted(tokens, key=lambda c: -weight[c] / tokens[c])
    for whole in range(len(cells)):
        factor = (mixing.KEEP * total - sum(tokens[c] for c in cells[:whole])) / sum(weight[c] for c in cells[whole:])
        if weight[cells[whole]] / tokens[cells[whole]] * factor < 1:
            break
    chance = {c: min(1.0, round(weight[c] / tokens[c] * factor, mixing.DIGITS)) for c in cells}
    draw = lambda d: int(hashlib.md5(f"11|{d[0]}|{d[1]}".encode()).hexdigest()[:13], 16) / mixing.DRAWS
    return [d for d in docs if words(d[1]) and draw(d) < chance[cell_of[d[0]]]]


def ids(rows):
    return sorted((r[0] for r in rows), key=str)


def test_each_stage_keeps_what_plain_python_keeps_of_its_input(spark, tables):
    folder, docs, labels, items = tables
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "near_copies", "benchmark", "mixing", "sharding"]
    plain = [not_toxic(docs, labels)]
    for step in (one_of_each, lambda d: without_items(d, items), mixed):
        plain.append(step(plain[-1]))
    assert len(docs) > len(plain[0]) > len(plain[1]) > len(plain[2]) > len(plain[3]) > 50
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, before, after in zip(steps, [docs, *plain], plain):
        given = spark.createDataFrame(before, COLUMNS)
        out = steps[name](spark, given, folder)
        assert out.columns == frame.columns, name
        assert ids(out.collect()) == ids(after), name
    out = steps["sharding"](spark, spark.createDataFrame(plain[3], COLUMNS), folder).collect()
    assert ids(out) == ids(plain[3]) and gapless(out, corpus_pipeline.N_SHARDS)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert ids(whole) == ids(plain[3]) and gapless(whole, corpus_pipeline.N_SHARDS)


def test_labels_of_the_held_out_fold_are_not_learned_from(spark, tables):
    folder, docs, labels, _ = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    other = spark.createDataFrame([(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in labels], "doc_id long, quality int, toxic int")
    one, two = (toxicity.fit(frame, rows) for rows in (spark.read.parquet(f"{folder}/labels.parquet"), other))
    assert one.lexicon == two.lexicon and (one.weights == two.weights).all()


def test_stages_take_odd_rows_and_columns_that_clash(spark, tables):
    """Rows without text and repeats stay as each stage says; columns of any name come through."""
    folder = tables[0]
    names = "bucket positions probability c_lang c_source c_topic __hash __draw __tokens __copy root node key shingles".split()
    rows = [(None, None), (None, "brick " * 40), (1, None), (2, ""), (3, " \t"), (4, "solo"), (5, "long " * 60000), (6, "same words in both rows here"), (6, "same words in both rows here")]
    wide = spark.createDataFrame([(i, t, "en", "a", 0, *names) for i, t in rows], f"{COLUMNS}, " + ", ".join(f"{n} string" for n in names))
    steps, kept = dict(corpus_pipeline.STAGES), {}
    for name, step in steps.items():
        out = step(spark, wide, folder)
        assert out.columns[: len(wide.columns)] == wide.columns, name
        kept[name] = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert step(spark, wide.limit(0), folder).count() == 0, name
    assert sorted(kept["toxicity"], key=str) == sorted(kept["benchmark"], key=str) == sorted(kept["sharding"], key=str) == sorted(rows, key=str)
    # Blank texts are one group, and a repeated row stays once; rows without id stay.
    assert ids(kept["near_copies"]) == sorted([None, None, 1, 4, 5, 6], key=str)
    assert all(t and t.strip() for _, t in kept["mixing"])
    assert math.isclose(len(kept["sharding"]), len(rows))
