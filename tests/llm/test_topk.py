"""BM25 by every term of a query text, beside a brute-force scan of all documents."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from frames import shuffle_files

from trialflow.llm import registry, topk


def brute_force(rows, queries, k=10):
    """(query, rank, doc, score); rows that repeat an id are documents of their own."""
    counts = [(i, Counter((t or "").lower().split())) for i, t in rows]
    df = Counter(w for _, c in counts for w in c)
    words = sum(sum(c.values()) for _, c in counts)
    average = words / len(rows) if words else 1
    idf = {w: math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for w, n in df.items() if n >= 2}
    out = []
    for q, text in queries:
        own, found = Counter((text or "").lower().split()), []
        for i, c in counts:
            norm = topk.K1 * (1 - topk.B + topk.B * sum(c.values()) / average)
            score = sum(idf[w] * c[w] * (topk.K1 + 1) / (c[w] + norm) for w in own if w in idf and w in c)
            if score and i is not None:
                found.append((-round(score, 6), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def same(got, want):
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect())
    assert [g[:3] for g in got] == sorted(w[:3] for w in want)
    assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want)], abs=2e-6)


def texts(n=150, seed=8):
    """Two vocabularies, of which the first words are in most texts, so that blocks differ and terms are common and rare."""
    rng = random.Random(seed)
    words = [[f"{side}{i}" for i in range(300)] for side in "ab"]
    rows = []
    for i in range(n):
        own = words[rng.random() < 0.4]
        rows.append((i, " ".join(own[min(int(rng.expovariate(0.02)), 299)] for _ in range(rng.choice((0, 5, 40, 300))))))
    return rows


@pytest.mark.parametrize("block_terms, shard_postings, block, common", [(topk.BLOCK_TERMS, topk.SHARD_POSTINGS, 64, 1 / 64), (100, 400, 4, 0.1), (100, 10**6, 3, 0.0), (5000, 1, 64, 2.0)])
def test_search_uses_all_terms_of_a_long_query(spark, monkeypatch, block_terms, shard_postings, block, common):
    for name, value in (("SHARD_POSTINGS", shard_postings), ("BLOCK", block), ("COMMON", common), ("WAVE", 2), ("FIRST_TEXTS", 2)):
        monkeypatch.setattr(topk, name, value)
    monkeypatch.setattr(topk.tx, "PIECE_BYTES", 2000)
    rows = texts() + [(1000, texts()[3][1] + " once"), (7, "b1 b2 b1"), (7, "b1 b2 b1"), (7, "b3 b1"), (None, "b1 b2 b1"), (1001, None), (1002, ""), (1003, "b1 " * 4000)]
    rows += [(2000 - i, "tie tie b0") for i in range(14)]
    docs = spark.createDataFrame([(i, t, 1, 2, b"x") for i, t in rows], "doc_id long, text string, shard long, n int, postings binary").repartition(3)
    queries = [(i, t) for i, t in rows if i is not None and (i % 10 == 0 or i > 999)]
    asked = spark.createDataFrame(queries, "doc_id long, text string")
    same(topk.search(topk.build_index(docs), asked, block_terms=block_terms), brute_force(rows, queries))


def test_blocks_that_cannot_matter_are_not_scored(monkeypatch):
    rng = np.random.default_rng(3)
    n, common = 64 * 40, np.arange(20)
    posts, lengths = [], []
    for t in range(20):
        # Blocks are alike within, and two have much higher counts than others.
        places = np.flatnonzero(rng.random(n) < 0.7)
        tf = 1 + np.isin(places // 64, (7, 20)) * 50
        own = np.zeros(len(places), topk._POSTING)
        own["place"], own["tf"] = places, tf
        posts.append(own)
        lengths.append(len(own))
    shard = topk.Shard(np.arange(n) * 3, np.full(n, 100), common, np.array(lengths), np.concatenate(posts), 100.0, common)
    scored = []
    real = topk.Shard.common_scores
    monkeypatch.setattr(topk.Shard, "common_scores", lambda self, r, w, p: scored.extend(p.tolist()) or real(self, r, w, p))
    weights = rng.random(20)
    got = topk.block_max_wand(shard, np.arange(20), weights, 10)
    total = np.round(real(shard, np.arange(20), weights, np.arange(n)), topk.DIGITS)
    assert [d for _, d in got] == (np.lexsort((np.arange(n), -total))[:10] * 3).tolist()
    assert len(scored) < n / 2 and len(set(scored)) == len(scored)
    assert topk.block_max_wand(shard, np.arange(20), weights, 10, (got[4][0], got[4][1])) == got[:5]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = topk.build_index(none)
    assert topk.search(index, none).count() == 0
    assert topk.search(index, spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert topk.search(topk.build_index(blank), blank).count() == 0


def test_the_query_scores_terms_that_one_text_alone_has(spark, tmp_path):
    """Words of one text only add to its score, and make up a whole query."""
    rows = [(0, "alone solo"), (100, "shared once"), (101, "shared shared other"), (102, "other other")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    idf, norm = math.log(1 + 3.5 / 1.5), topk.K1 * (1 - topk.B + topk.B * 2 / 2.25)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in registry.queries()["op1_topk"](spark, folder).collect()}
    assert got.keys() == {(0, 1), (100, 1), (100, 2)}
    assert got[0, 1] == (0, pytest.approx(2 * idf * 2.2 / (1 + norm), abs=2e-6))
    assert got[100, 1] == (100, pytest.approx((idf + math.log(2)) * 2.2 / (1 + norm), abs=2e-6))
    assert got[100, 2][0] == 101


def like_blocks(n=64 * 12, n_terms=30, seed=5):
    """Common terms in half of all texts each, alike in all blocks, and two rare ones."""
    rng = np.random.default_rng(seed)
    sizes, posts, lengths = rng.integers(40, 200, n), [], []
    for t in range(n_terms + 2):
        places = np.flatnonzero(rng.random(n) < (0.5 if t < n_terms else 0.02))
        own = np.zeros(len(places), topk._POSTING)
        own["place"], own["tf"] = places, rng.integers(1, 4, len(places))
        posts.append(own)
        lengths.append(len(own))
    return np.arange(n) * 3, sizes, np.arange(n_terms + 2), np.array(lengths), np.concatenate(posts), np.arange(n_terms)


def test_texts_of_blocks_that_are_not_ruled_out_get_closer_bounds(monkeypatch):
    """The bounds of the blocks rule nothing out here; still only texts near the k-th best are scored exactly."""
    *table, common = like_blocks()
    shard = topk.Shard(*table, 100.0, common)
    scored, real = [], topk.Shard.common_scores
    monkeypatch.setattr(topk.Shard, "common_scores", lambda self, r, w, p: scored.extend(p.tolist()) or real(self, r, w, p))
    weights = np.random.default_rng(6).random(32) + 0.5
    got = topk.block_max_wand(shard, np.arange(32), weights, 10)
    everything = topk.Shard(*table, 100.0, np.arange(32))
    total = np.round(real(everything, np.arange(32), weights, np.arange(len(table[0]))), topk.DIGITS)
    best = np.lexsort((np.arange(len(total)), -total))[:10]
    assert [d for _, d in got] == (best * 3).tolist() and [s for s, _ in got] == pytest.approx(total[best])
    assert len(scored) <= topk.FIRST_TEXTS + 20


@pytest.mark.parametrize("batch, cells", [(256, 1 << 24), (3, 1 << 24), (256, 1), (2, 30 * 64 * 5)])
def test_batches_of_queries_and_parts_of_a_shard_change_no_answer(monkeypatch, batch, cells):
    *table, common = like_blocks()
    rng = np.random.default_rng(7)
    terms = [np.sort(rng.choice(34, n, replace=False)) for n in (1, 5, 20, 32, 2, 7, 0)]
    first = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
    asked = topk.Queries.of(np.arange(len(terms)), first, np.concatenate(terms), (rng.random(34) + 0.2)[np.concatenate(terms)], common)
    whole = topk.Shard(*table, 100.0, common)
    want = {}
    for q, (i, j) in enumerate(zip(first[:-1], first[1:])):
        own = asked.numbers[i:j]
        rows = whole.rows_of(asked.terms[own])
        found = topk.block_max_wand(whole, rows[rows >= 0], asked.weights[own][rows >= 0], 10)
        want |= {q: found} if found else {}
    monkeypatch.setattr(topk, "BATCH", batch)
    monkeypatch.setattr(topk, "DENSE_CELLS", cells)
    parts = list(topk._cut(*table, common))
    assert (len(parts) > 1) == (cells < 1 << 24) and sum(len(p[0]) for p in parts) == len(table[0])
    got = {}
    for part in parts:
        for q, found in topk.search_shard(topk.Shard(*part, 100.0, common), asked, 10, [topk._NO_FLOOR] * len(terms)):
            got[q] = sorted(got.get(q, []) + found, key=lambda x: (-x[0], x[1]))[:10]
    assert {q: [d for _, d in f] for q, f in got.items()} == {q: [d for _, d in f] for q, f in want.items()}
    assert {q: [s for s, _ in f] for q, f in got.items()} == {q: pytest.approx([s for s, _ in f], abs=2e-6) for q, f in want.items()}


def test_a_search_leaves_no_shuffle_files(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    index = topk.build_index(docs)
    before = shuffle_files(spark)
    found = topk.search(index, docs.filter("doc_id % 10 = 0"))
    assert shuffle_files(spark, before) <= before
    assert found.count() > 0
