"""Fingerprints and components beside plain Python, with shards large enough for trees and some dealt again."""

import random
import re
from itertools import combinations

import pytest
import xxhash

from trialflow.llm import registry, simhash


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(fps, radius=2):
    """fp -> the smallest fp (as found) of its component, by all pairs."""
    values = sorted(set(fps))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(values, 2):
        if (a ^ b).bit_count() <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


@pytest.mark.parametrize("n, parts", [(1, 3), (256, 3), (10**6, 3), (256 << 21, 3), (256 << 22, 4), (256 << 33, 5), (10**18, 8)])
def test_near_fingerprints_agree_on_a_mask(n, parts):
    masks = simhash.agreeing_masks(n, 2)
    assert len(masks) == parts * (parts - 1) // 2
    for flips in combinations(range(64), 2):
        changed = sum(1 << f for f in flips)
        assert any(m & changed == 0 for m in masks)
    if n < 10**15:
        assert n / 2 ** min(m.bit_count() for m in masks) <= 256


@pytest.mark.parametrize("shard, large", [(256, 20_000), (8, 20_000), (40, 30), (10**6, 10)])
def test_links_within_shards_give_the_components_of_all_pairs(spark, shard, large):
    rng = random.Random(shard)
    fps = {rng.getrandbits(64) for _ in range(120)}
    family = rng.getrandbits(64)
    for _ in range(300):
        base = rng.choice(sorted(fps)) if rng.random() < 0.6 else family
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    edges = simhash.fingerprint_links(frame, 2, shard, large).collect()
    want = components_of(fps)
    root = {v: v for v in signed.values()}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[find(a)] = find(b)
    groups = lambda of: sorted(sorted(f for f in fps if of(f) == r) for r in {of(f) for f in fps})
    assert groups(lambda f: find(signed[f])) == groups(want.get)
    assert len(set(want.values())) > 60


def test_query_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    fps = {i: fingerprint(t) for i, t in docs}
    root = components_of(fps.values())
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    want = {(i, f"{f:016x}", least[root[f]]) for i, f in fps.items()}
    assert {tuple(r) for r in registry.op3_simhash(spark, folder).collect()} == want
    assert len({w[2] for w in want}) < len(want)


def test_rows_that_repeat_and_names_that_clash(spark):
    rows = [(1, "a b c d", 9, 9), (1, "a b c d", 9, 9), (None, "A b  c d", 9, 9), (3, None, 9, 9), (4, "", 9, 9), (5, "x " * 200000, 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (3, 3), (4, 3), (5, 5)], key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, None, 3, 5], key=str)
