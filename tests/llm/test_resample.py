"""Weights, draws and ranks beside a plain recomputation, with sketches so coarse that brackets are widened."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialflow.llm import crc, resample


def features(text):
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    return len(words), [zlib.crc32(f.encode()) for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute_force(docs, target, buckets=10000, percent=25, min_words=20):
    own, aim = Counter(), Counter()
    for _, t in docs:
        own.update(h % buckets for h in features(t)[1])
    for t in target:
        aim.update(h % buckets for h in features(t)[1])
    s, t = sum(own.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows, able = [], []
    for i, text in docs:
        n, found = features(text)
        weight = sum(gain[h % buckets] for h in found) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= min_words:
                able.append((-score, i, len(rows)))
        rows.append([i, len(found), weight, score, None])
    for rank, (_, _, place) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        rows[place][4] = rank
    return sorted(map(tuple, rows), key=str)


POOL = ["The", "the", "model", "data", "Zürich", "x1", "naïve", "ÉCOLE", "日本語", "don't", "a-b", "w" * 70, "v" * 200, "α" * 90, "", "\n", "end.", "_", "{}"]


def texts(n, seed=2):
    rng = random.Random(seed)
    rows = [(i, rng.choice([" ", ", ", "\t"]).join(rng.choice(POOL) for _ in range(rng.choice([0, 1, 5, 19, 25, 60, 300])))) for i in range(n)]
    return rows + [(None, "the data " * 30), (n, None), (n + 1, ""), (n + 2, "é" * 5000 + " x" * 30), (n + 3, "The model " * 20000), (n + 4, "\x00 a\x00b " * 15)]


TARGET = ["the model of data", "Zürich data, naïve data", None, ""]
COLUMNS = "doc_id long, text string, score double, rank int, row string, bucket int, n int"


def framed(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, "r", 2, 3) for i, t in rows], COLUMNS)


@pytest.mark.parametrize("options", [{}, {"accuracy": 20, "sorted_rows": 7}, {"accuracy": 4000, "sorted_rows": 40}])
def test_ranks_equal_brute_force(spark, options):
    rows = texts(400)
    got = resample.resample(framed(spark, rows), spark.createDataFrame([(t, 1) for t in TARGET], "text string, n int"), **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows, TARGET)


@pytest.mark.parametrize("percent, min_words", [(0, 20), (100, 1), (37, 0)])
def test_shares_and_thresholds(spark, percent, min_words):
    rows = texts(60, 4)
    got = resample.resample(framed(spark, rows), spark.createDataFrame([(t,) for t in TARGET], "text string"), percent=percent, min_words=min_words)
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows, TARGET, percent=percent, min_words=min_words)


def test_repeated_rows_tie_and_are_drawn_as_rows(spark):
    rows = texts(40, 6) + [(7, "the model of data " * 10)] * 50
    got = resample.resample(framed(spark, rows), spark.createDataFrame([(t,) for t in TARGET], "text string"), sorted_rows=9).collect()
    drawn = sorted(r["rank"] for r in got if r["rank"])
    n = sum(i is not None and features(t)[0] >= 20 for i, t in rows)
    assert len(got) == len(rows) and drawn == list(range(1, n * 25 // 100 + 1))
    by_rank = sorted((r["rank"], r["score"], r["doc_id"]) for r in got if r["rank"])
    assert [(-s, i) for _, s, i in by_rank] == sorted((-s, i) for _, s, i in by_rank)


def test_bracket_is_widened_until_it_holds_the_cutoff(spark, monkeypatch):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 10).alias("score"), F.col("id").alias("row"))
    tried = []
    real = F.percentile_approx

    def wrong(column, ends, accuracy):
        tried.append(ends)
        return real(column, [0.9, 0.95], accuracy) if len(tried) == 1 else real(column, ends, accuracy)

    monkeypatch.setattr(resample.F, "percentile_approx", wrong)
    kept = rows.filter(resample.cutoff(rows, 1000, 333)).collect()
    want = sorted((-(i % 10), i) for i in range(1000))[:333]
    assert sorted((-r["score"], r["doc_id"]) for r in kept) == want and len(tried) == 2


def test_empty_tables(spark):
    none, target = framed(spark, []), spark.createDataFrame([], "text string")
    assert resample.resample(none, target).count() == 0
    rows = texts(10)
    assert sorted(map(tuple, resample.resample(framed(spark, rows), target).collect()), key=str) == brute_force(rows, [])


def test_drawn_documents_keep_their_columns(spark):
    docs = framed(spark, texts(50))
    kept = resample.drawn_documents(docs, spark.createDataFrame([(t,) for t in TARGET], "text string"))
    assert kept.columns == docs.columns and 0 < kept.count() < 50


def test_crc_of_strings_and_of_joined_strings():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    cuts = np.unique(np.concatenate(([0, 4000, 500, 570, 900], rng.integers(0, 4000, 200))))
    start, end = cuts[:-1], cuts[1:]
    one = crc.crc_of(data, start, end)
    assert one.tolist() == [zlib.crc32(data[i:j].tobytes()) for i, j in zip(start, end)]
    two = crc.joined(crc.followed_by(one[:-1], 32), one[1:], (end - start)[1:])
    assert two.tolist() == [zlib.crc32(data[i:j].tobytes() + b" " + data[j:k].tobytes()) for i, j, k in zip(cuts, cuts[1:], cuts[2:])]
