"""Benchmark decontamination: spaced-seed hashes of token windows, verified around each hit."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialflow.llm import text as tx

#: Token positions that a seed keeps. Every pattern of replaced tokens that the rule below accepts
#: leaves at least one seed whole: tried out for 13 to 25 tokens, and of a longer stretch one half or
#: the other is accepted as well.
MASKS = ((0, 1, 3, 5, 7, 8), (0, 1, 2, 8, 9, 10), (0, 1, 7, 9, 10, 11), (0, 1, 2, 3, 5, 6))
#: An overlap has so many tokens at least (a shorter item: all of its tokens) ...
MIN_OVERLAP = 13
#: ... of which so many in a hundred are equal.
MIN_EQUAL_PCT = 80
#: Bytes of benchmark text whose seeds one broadcast holds; a larger benchmark goes in blocks.
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 22
_KEEP = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks for an item of ``n`` < MIN_OVERLAP tokens, of which all count.

    The item is cut into two more parts than tokens may be replaced; each mask leaves out as many
    parts, so one of them holds no replaced token.
    """
    errors = n * (100 - MIN_EQUAL_PCT) // 100
    cuts = [n * k // (errors + 2) for k in range(errors + 3)]
    parts = [range(i, j) for i, j in zip(cuts, cuts[1:])]
    kept = combinations(parts, len(parts) - errors) if errors else [[range(n)]]
    return [tuple(at for part in some for at in part) for some in kept]


def seed_hashes(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """One hash for each placement of ``mask``; what a mask skips does not count."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.bitwise_xor.reduce(_KEEP[list(mask)] * np.uint64(len(mask))))
    for k, at in enumerate(mask):
        total += tokens[at : at + n] * _KEEP[k]
    return tx.mix64(total)


@dataclass
class Block:
    """Seeds of some benchmark items, sorted by hash, and the items' tokens."""

    items: list
    tokens: list[np.ndarray]
    masks: list[tuple[int, ...]]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray


def _tokens(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    start, end, _ = tx.words(data, np.array([0, len(data)]))
    return tx.word_hashes(data, start, end, lower=True)


def build_block(rows: list[tuple]) -> Block:
    """Seeds of (item_id, text) rows; an item of fewer tokens than an overlap has seeds of its own, at its start."""
    items, tokens = [r[0] for r in rows], [_tokens(r[1]) for r in rows]
    used: dict[tuple[int, ...], None] = {}
    found = []
    for i, t in enumerate(tokens):
        for mask in MASKS if len(t) >= MIN_OVERLAP else short_masks(len(t)) if len(t) else []:
            used[mask] = None
            h = seed_hashes(t, mask) if len(t) >= MIN_OVERLAP else seed_hashes(t, mask)[:1]
            found.append((h, np.full(len(h), i), np.arange(len(h))))
    masks = list(used)
    hashes, item, place = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))
    order = np.argsort(hashes, kind="stable")
    maybe = np.zeros(1 << _FILTER_BITS, bool)
    maybe[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Block(items, tokens, masks, hashes[order], item[order], place[order], maybe)


def longest_overlap(equal: np.ndarray) -> int:
    """Length of the longest run of positions of which MIN_EQUAL_PCT are equal."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 100 - MIN_EQUAL_PCT, -MIN_EQUAL_PCT))))
    least, most = np.minimum.accumulate(sums), np.maximum.accumulate(sums[::-1])[::-1]
    # For each start, the last end whose sum is not below it; only new minima can start the longest run.
    starts = np.flatnonzero(np.concatenate(([True], sums[1:] < least[:-1])))
    ends = len(most) - np.searchsorted(most[::-1], sums[starts], "left") - 1
    return int(max(0, np.max(ends - starts)))


def overlaps(block: Block, tokens: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, item, tokens of the longest verified overlap) of all texts of a piece."""
    seen: dict[tuple[int, int], int] = {}
    for mask in block.masks:
        h = seed_hashes(tokens, mask)
        at = np.flatnonzero(block.maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        left, right = np.searchsorted(block.hashes, h[at], "left"), np.searchsorted(block.hashes, h[at], "right")
        at, left, n = at[right > left], left[right > left], (right - left)[right > left]
        row = np.searchsorted(first, at, "right") - 1
        inside = at + mask[-1] < first[row + 1]
        at, left, n, row = at[inside], left[inside], n[inside], row[inside]
        where = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        diagonal = np.repeat(at, n) - block.place[where]
        hits = np.unique(np.stack([np.repeat(row, n), block.item[where], diagonal]), axis=1)
        for r, i, d in hits.T.tolist():
            item = block.tokens[i]
            need = min(MIN_OVERLAP, len(item))
            if seen.get((r, i), 0) == len(item):
                continue
            lo, hi = max(0, int(first[r]) - d), min(len(item), int(first[r + 1]) - d)
            found = longest_overlap(tokens[d + lo : d + hi] == item[lo:hi])
            if found >= need:
                seen[r, i] = max(seen.get((r, i), 0), found)
    for (r, i), n in seen.items():
        yield r, i, n


def _scan(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, block: Block) -> list[tuple[int, int, int]]:
    start, end, first = tx.words(data, offsets)
    return list(overlaps(block, tx.word_hashes(data, start, end, lower=True), first))


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark's seeds in blocks of about ``block_bytes`` of text, so that each broadcast is bounded."""
    rows = benchmark.select(F.col("item_id").alias("item"), "text").filter(F.octet_length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    for k in range(n_blocks):
        own = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        yield build_block([tuple(r) for r in own.collect()])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, overlap): the pairs whose texts share an overlap, and its length in tokens.

    Tokens are lower-case words. A pair meets where both hold an equal spaced seed; around each
    hit the texts are laid on each other at the seed's offset, and the longest stretch of which
    MIN_EQUAL_PCT of the tokens are equal is the overlap if it has MIN_OVERLAP tokens (an item of
    fewer: all of them). Substituted tokens are tolerated, inserted ones end a stretch.

    NULL and empty texts meet nothing; NULL ids are kept; rows that repeat give a pair each;
    a text of any length is one piece; columns other than the named are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for block in benchmark_blocks(benchmark, block_bytes=block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                for piece, data, offsets in tx.pieces(batch):
                    if found := _scan(piece, data, offsets, own):
                        ids = piece.column("doc_id").take(pa.array([r for r, _, _ in found]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([own.items[i] for _, i, _ in found]), pa.array([n for _, _, n in found], pa.int32())], ["doc_id", "item_id", "overlap"])

        part = rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {item_type}, overlap int")
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document id: doc_id, contaminated, n_items, item_ids (sorted), max_overlap."""
    pairs = find_overlaps(docs, benchmark)
    none = docs.select("doc_id", F.lit(None).cast(pairs.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("overlap"))
    return pairs.unionByName(none).groupBy("doc_id").agg(
        (F.max("overlap") > 0).alias("contaminated"), F.count_distinct("item_id").cast("int").alias("n_items"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("overlap").alias("max_overlap"),
    )


def without_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that share no overlap with the benchmark, all columns kept; nothing is shuffled."""
    for block in benchmark_blocks(benchmark, block_bytes=block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece, data, offsets in tx.pieces(batch, text_col):
                    keep = np.ones(piece.num_rows, bool)
                    keep[[r for r, _, _ in _scan(piece, data, offsets, shared.value)]] = False
                    yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
