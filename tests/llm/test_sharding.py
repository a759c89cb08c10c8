"""Laws of the two-pass shuffle on rows that repeat, clash and are odd, and of its query."""

import zlib
from collections import Counter

import pytest

from trialflow.llm import registry, sharding

COLUMNS = "doc_id long, text string, bucket int, positions string, n long, shard string, __id int, __hash string, slot int, __salt int"


def framed(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p", 2, "old", 3, "h", 4, 5) for i, t in rows], COLUMNS)


def gapless(rows, n_shards):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by_shard.get(k, [])) for k in range(n_shards)]
    return all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and max(sizes) - min(sizes) <= 1


def test_rows_keep_their_columns_whatever_their_names(spark):
    rows = [(1, "a"), (None, None), (None, None), (2, ""), (3, "x" * 500000), (1, "a"), (1, "b")] * 3
    got = sharding.shuffle_into_shards(framed(spark, rows), 5)
    assert got.columns == ["doc_id", "text", "bucket", "positions", "n", "__id", "__hash", "__salt", "shard", "slot"]
    out = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows) and gapless(out, 5)
    assert {(r["bucket"], r["positions"], r["n"], r["__id"], r["__hash"], r["__salt"]) for r in out} == {(1, "p", 2, 3, "h", 5)}
    assert sharding.shuffle_into_shards(framed(spark, []), 5).count() == 0


def test_rows_that_repeat_are_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CROWDED_ROWS", 40)
    seen = []
    real = sharding.bucket_positions
    monkeypatch.setattr(sharding, "bucket_positions", lambda counts, seed: seen.append([r["n"] for r in counts.collect()]) or real(counts, seed))
    rows = [(i, f"t{i}") for i in range(1200)] + [(None, None)] * 500 + [(7, "same")] * 300
    out = sharding.shuffle_into_shards(framed(spark, rows).repartition(6), 40).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows) and gapless(out, 40)
    assert sum(seen[0]) == 2000 and max(seen[0]) < 70
    # Repeats lie all over the shards.
    assert len({r["shard"] for r in out if r["text"] == "same"}) > 35


def test_order_is_shuffled_and_fixed_by_the_seed(spark):
    docs = framed(spark, [(i, f"t{i % 50}") for i in range(300)])
    one, same, other = ([(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(docs, 3, seed=s).orderBy("doc_id").collect()] for s in (7, 7, 8))
    assert one == same != other
    ids = [i for i, *_ in sorted(one, key=lambda r: (r[1], r[2]))]
    assert sum(abs(a - b) == 3 for a, b in zip(ids, ids[1:])) < 10


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_keeps_its_law(spark, sf):
    folder = f"/root/testdata/{sf}"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = registry.op7_sharding(spark, folder).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts) and gapless(out, 40)
    for r in out:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
