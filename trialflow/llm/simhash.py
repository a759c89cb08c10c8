"""SimHash near-duplicates: fingerprints linked by BK-trees within shards of agreeing bits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialflow.llm import text as tx
from trialflow.llm.graph import components
from trialflow.session import stage

SHINGLE_WORDS = 3
#: Fingerprints that differ in so many bits at most are linked.
RADIUS = 2
#: Fingerprints of a shard, about; a shard of more than LARGE is dealt again by whole bytes.
SHARD, LARGE = 256, 20_000
_FLAT = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b" " * 5)


def _piece_fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    start, end, first = tx.words(data, offsets)
    flat = data.tobytes().translate(_FLAT)
    n = np.diff(first)
    count = np.where(n >= SHINGLE_WORDS, n - SHINGLE_WORDS + 1, (n > 0).astype(n.dtype))
    row = np.repeat(np.arange(len(n)), count)
    begin = first[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    last = begin + np.minimum(n[row], SHINGLE_WORDS) - 1
    a, b = start[begin], end[last]
    # Words before each gap that is wider than one byte, to find the shingles that hold one.
    wide = np.concatenate(([0, 0], np.cumsum(start[1:] - end[:-1] != 1))) if len(start) else np.zeros(1, np.int64)
    odd = wide[last + 1] != wide[begin + 1]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(flat[i:j], 42) for i, j in zip(a.tolist(), b.tolist())], np.uint64)
    for k in np.flatnonzero(odd).tolist():
        hashes[k] = one(b" ".join(flat[a[k] : b[k]].split()), 42)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(ones * 2 > count[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each text's 3-word shingles, ASCII letters lower-cased.

    A text of fewer words is one shingle; NULL, empty and blank texts have fingerprint 0.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in tx.pieces(batch):
                fp = _piece_fingerprints(data, offsets).view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        if self.values:
            while True:
                d = (self.values[at] ^ value).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = len(self.values)
                    break
                at = below
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Numbers of the nodes at most ``radius`` away; only edges that can lead to one are followed."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            todo += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Star edges that join what is linked within a shard: (fingerprint, smallest of its local group)."""
    tree, root = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        tree.add(value)
    return [(v, values[find(i)]) for i, v in enumerate(values) if find(i) != i]


def agreeing_masks(n: int, radius: int, shard: int = SHARD) -> list[int]:
    """Masks of which two fingerprints within ``radius`` agree on one at least, for shards of about ``shard`` of ``n``.

    The 64 bits are cut into p > radius parts; at most radius of them differ, so the pair agrees on
    some choice of p - radius parts. Of each chosen part as many bits are taken as ``n`` needs; p is
    the smallest that has them.
    """
    wanted = max(0, math.ceil(math.log2(max(n, 1) / shard)))
    for parts in range(radius + 1, 65):
        width, chosen = 64 // parts, parts - radius
        bits = min(width, -(-wanted // chosen))
        if bits * chosen >= wanted or parts >= 4 * radius:
            break
    low = [((1 << bits) - 1) << width * k for k in range(parts)]
    return [sum(some) for some in combinations(low, chosen)]


def _keys(masks: list[int]) -> Column:
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, large: int = LARGE) -> DataFrame:
    """Edges (a, b) that connect exactly what links within ``radius`` connect, over distinct fps (fp).

    A shard is a mask and a value of its bits, so each link falls within a shard. Its tree travels with
    its rows: one tree of all fingerprints grows with the data and may not be broadcast. Shards
    are counted first; the members of one that is too large, as families of like texts make it, go to
    shards by all choices of 8 - radius bytes instead, which have at most 256 ** radius members
    however skewed the texts are.
    """
    dealt = fps.select(F.explode(_keys(agreeing_masks(fps.count(), radius, shard))).alias("shard"), "fp")
    crowded = stage(dealt.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > large).select(F.col("shard").alias("__large")), "simhash-large")
    if crowded.isEmpty():
        return _tree_links(dealt, radius)
    few = dealt.join(crowded, F.col("shard") == F.col("__large"), "left_anti")
    again = dealt.join(crowded, F.col("shard") == F.col("__large"), "left_semi").select("fp").distinct()
    by_byte = [sum(0xFF << 8 * k for k in range(8) if k not in out) for out in combinations(range(8), radius)]
    return _tree_links(few, radius).unionByName(_tree_links(again.select(F.explode(_keys(by_byte)).alias("shard"), "fp"), radius))


def _tree_links(dealt: DataFrame, radius: int) -> DataFrame:
    """Edges that connect what is linked within the shards of (shard, fp)."""
    shards = dealt.repartition("shard").sortWithinPartitions("shard", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
            found = list(zip(fp[two][near].tolist(), fp[two + 1][near].tolist()))
            for at, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
                own = fp[at : at + n].view(np.uint64).tolist()
                found += [(np.uint64(a).astype(np.int64).item(), np.uint64(b).astype(np.int64).item()) for a, b in shard_links(own, radius)]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            key = np.concatenate((held_key, batch.column("shard").to_numpy()))
            fp = np.concatenate((held_fp, batch.column("fp").to_numpy()))
            done = int(np.searchsorted(key, key[-1], "left"))
            yield edges(key[:done], fp[:done])
            held_key, held_fp = key[done:], fp[done:]
        if len(held_key):
            yield edges(held_key, held_fp)

    return shards.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links).

    Documents with equal fingerprints are linked; different ones within ``radius`` bits are linked by
    ``fingerprint_links`` over distinct fingerprints, so copies are never paired with each other.
    NULL ids never name a component (one of NULL ids only has NULL); repeated rows stay; blank texts
    link to each other; an empty table gives an empty result; other columns are not read.
    """
    own = stage(fingerprints(docs, id_col, text_col), "simhash-fps")
    least = stage(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(fingerprint_links(least.select("fp"), radius))
    placed = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = stage(placed.join(named, "root").select("fp", "component_id"), "simhash-components")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document with the smallest id.

    Rows without an id are in no group that could be decided by id, and stay; of rows that repeat
    an id one stays. All columns are kept.
    """
    found = near_duplicates(docs.filter(F.col(id_col).isNotNull()), id_col, text_col)
    copies = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__copy")).distinct()
    # Packed rows, so that no column of theirs can clash.
    packed = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"))
    rest = packed.filter("__id IS NOT NULL").join(copies, F.col("__id") == F.col("__copy"), "left_anti")
    return rest.dropDuplicates(["__id"]).unionByName(packed.filter("__id IS NULL")).select("__row.*")
