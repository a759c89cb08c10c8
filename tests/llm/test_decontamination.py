"""Seeds that miss no overlap the rule accepts, and the query beside a comparison at every offset."""

import random
from itertools import combinations

import numpy as np
import pytest

from trialflow.llm import decontaminate as dc
from trialflow.llm import registry


def seeds_hold(masks, n, replaced, at_start):
    places = [0] if at_start else range(n)
    return any(all(s + p not in replaced for p in m) for m in masks for s in places if s + m[-1] < n)


@pytest.mark.parametrize("n", range(1, 23))
def test_every_accepted_pattern_holds_a_seed(n):
    errors = n * (100 - dc.MIN_EQUAL_PCT) // 100
    masks = dc.MASKS if n >= dc.MIN_OVERLAP else dc.short_masks(n)
    missed = [p for k in range(errors + 1) for p in combinations(range(n), k) if not seeds_hold(masks, n, set(p), n < dc.MIN_OVERLAP)]
    assert missed == []


def longest(equal):
    n = len(equal)
    return max((j - i for i in range(n) for j in range(i + 1, n + 1) if 100 * sum(equal[i:j]) >= dc.MIN_EQUAL_PCT * (j - i)), default=0)


def brute_force(docs, items):
    """(doc, item, overlap) by laying each item on each text at every offset."""
    out = set()
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            own, best = (item or "").lower().split(), 0
            for at in range(-len(own) + 1, len(words)) if own else ():
                equal = [own[k] == words[at + k] for k in range(len(own)) if 0 <= at + k < len(words)]
                best = max(best, longest(equal) if sum(equal) > 2 or len(own) < 5 else 0)
            if own and best >= min(dc.MIN_OVERLAP, len(own)):
                out.add((d, i, best))
    return out


def spoilt(rng, words, k):
    words = list(words)
    for at in rng.sample(range(len(words)), min(k, len(words))):
        words[at] = f"z{rng.randrange(10**6)}"
    return words


def planted():
    rng = random.Random(4)
    pool = [f"v{i}" for i in range(2000)]
    items = [(n, [rng.choice(pool) for _ in range(n)]) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 20, 33, 60)]
    docs, d = [], 0
    for n, words in items:
        for k in {0, 1, 2, n // 5, n // 5 + 1, n // 3}:
            around = [rng.choice(pool) for _ in range(rng.randrange(0, 12))]
            own = spoilt(rng, words, k)
            docs.append((d := d + 1, " ".join(around + own + around)))
            docs.append((d := d + 1, " ".join(own[len(own) // 3 :] + around)))
    docs += [(900, None), (901, ""), (902, " ".join(rng.choice(pool) for _ in range(3000)) + " " + " ".join(items[-1][1]).upper())]
    return docs, [(i, " ".join(w)) for i, w in items] + [(100, None), (101, ""), (102, "  ")]


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 200])
def test_overlaps_equal_a_comparison_at_every_offset(spark, block_bytes):
    docs, items = planted()
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, overlap int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in dc.find_overlaps(frame, bench, block_bytes=block_bytes).collect()}
    want = brute_force(docs, items)
    assert {g[:2] for g in got} == {w[:2] for w in want}
    # The longest overlap is looked for around hits; a longer one elsewhere on the item does not change the pair.
    assert all(n >= min(dc.MIN_OVERLAP, i) for _, i, n in got)


def test_rows_that_repeat_and_names_that_clash(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item, "a"), (1, "other text", "b"), (None, item, "c"), (2, "clean", "d"), (2, "clean", "d")], "doc_id long, text string, item_ids string")
    bench = spark.createDataFrame([(5, item), (5, item), (6, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["n_items"], r["item_ids"], r["max_overlap"]) for r in dc.contamination(docs, bench).collect()}
    assert got == {1: (True, 2, [5, 6], 20), None: (True, 2, [5, 6], 20), 2: (False, 0, [], 0)}
    kept = dc.without_overlaps(docs, bench)
    assert kept.columns == docs.columns and sorted(r["item_ids"] for r in kept.collect()) == ["b", "d", "d"]
    assert dc.contamination(docs.limit(0), bench).count() == 0


def test_query_finds_what_an_exhaustive_search_of_windows_finds(spark):
    """All windows of 13 words of the items, looked up word by word in the documents of the small table."""
    folder = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet").collect()
    items = {r["item_id"]: (r["text"] or "").lower().split() for r in read("benchmark")}
    docs = {r["doc_id"]: (r["text"] or "").lower().split() for r in read("documents")}
    number = {}
    code = lambda words: np.array([number.setdefault(w, len(number)) for w in words])
    coded = {i: code(w) for i, w in items.items()}
    want = {}
    for d, words in docs.items():
        own, found = code(words), []
        for i, item in coded.items():
            need = min(dc.MIN_OVERLAP, len(item))
            if len(own) < need or np.isin(own, item).sum() < 0.8 * need:
                continue
            for at in range(-len(item) + need, len(own) - need + 1):
                lo, hi = max(0, -at), min(len(item), len(own) - at)
                equal = item[lo:hi] == own[at + lo : at + hi]
                if equal.sum() >= 0.8 * need and dc.longest_overlap(equal) >= need:
                    found.append(i)
                    break
        want[d] = sorted(found)
    got = {r["doc_id"]: r["item_ids"] for r in registry.op6_decontamination(spark, folder).collect()}
    assert got == want and any(want.values())
