"""Near copies by words: MinHash bands give candidates, exact 5-word Jaccard confirms them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialflow.llm import text as tx
from trialflow.llm.graph import components
from trialflow.session import stage

SHINGLE_WORDS = 5
#: Texts whose sets of shingles have this Jaccard similarity or more are linked.
SIMILARITY = 0.8
#: Two texts meet if all minima of one band agree: of pairs at 0.8 about 1 in 14,000 never meets, nearer ones less.
BANDS, BAND_ROWS = 24, 5
#: Members of a bucket of which all pairs are compared; those of larger ones are compared where they share a rare shingle.
ALL_PAIRS = 20
#: Rounds in which members of crowded buckets that are still apart are compared with a leader of the bucket.
LEADER_ROUNDS = 2
#: What two sets must share to be linked, as a part of their sizes' sum.
_SHARED = SIMILARITY / (1 + SIMILARITY)
_random = np.random.default_rng(11)
_TURN = _random.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
_TIMES = _random.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_PLACE = _random.integers(1, 1 << 63, max(SHINGLE_WORDS, BAND_ROWS) + 1, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the different shingles of each text, ASCII letters lower-cased.

    A text of fewer words is one shingle; a blank one has none.
    """
    start, end, first = tx.words(data, offsets)
    word = tx.word_hashes(data, start, end, lower=True)
    n = np.diff(first)
    count = np.where(n >= SHINGLE_WORDS, n - SHINGLE_WORDS + 1, (n > 0).astype(n.dtype))
    row = np.repeat(np.arange(len(n)), count)
    begin = first[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    length = np.minimum(n[row], SHINGLE_WORDS)
    total = length.astype(np.uint64) * _PLACE[-1]
    for k in range(SHINGLE_WORDS):
        has = np.flatnonzero(length > k)
        total[has] += word[begin[has] + k] * _PLACE[k]
    shingle = tx.mix64(total)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    return shingle[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def set_names(shingles: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 for the empty one."""
    out = np.zeros(len(cuts) - 1, np.uint64)
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        out[some] = tx.mix64(np.add.reduceat(tx.mix64(shingles * _PLACE[0]), cuts[some]))
    return out


def band_keys(shingles: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a shingle, their BANDS keys): a key hashes the band's number and BAND_ROWS minima."""
    some = np.flatnonzero(np.diff(cuts))
    keys = np.empty((len(some), BANDS), np.uint64)
    for band in range(BANDS if len(some) else 0):
        total = np.full(len(some), np.uint64(band) * _PLACE[-1])
        for k in range(BAND_ROWS):
            i = band * BAND_ROWS + k
            total += np.minimum.reduceat((shingles ^ _TURN[i]) * _TIMES[i], cuts[some]) * _PLACE[k]
        keys[:, band] = tx.mix64(total)
    return some, keys


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands) of (doc_id, text): the name of each text's set, and its band keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in tx.pieces(batch):
                shingles, cuts = shingle_sets(data, offsets)
                some, keys = band_keys(shingles, cuts)
                n = np.zeros(piece.num_rows, np.int64)
                n[some] = BANDS
                bands = _lists(keys.ravel(), np.concatenate(([0], np.cumsum(n))))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(set_names(shingles, cuts).view(np.int64)), bands], ["doc_id", "node", "bands"])

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) of (doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in tx.pieces(batch):
                shingles, cuts = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(set_names(shingles, cuts).view(np.int64)), _lists(shingles, cuts)], ["node", "shingles"])

    return docs.mapInArrow(scan, "node long, shingles array<long>")


def _edge(a: Column | str, b: Column | str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have the SIMILARITY, as a written table."""
    of = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"of_{end}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    near = both >= SIMILARITY * (F.size("of_a") + F.size("of_b") - both)
    return stage(pairs.join(of("a"), "a").join(of("b"), "b").filter(near).select("a", "b"), "nearcopies-links")


def rare_shingle_pairs(sets: DataFrame) -> DataFrame:
    """All pairs (a, b) of (node, root, shingles) that may have the SIMILARITY and differ in root.

    Shingles of each set are put in order, those in the fewest sets first. Two sets of n <= m shingles
    that share n' = _SHARED (n + m) of them share one among the first n - n' + 1 of the smaller
    and the first m - n' + 1 of the larger. The least n' is 8/9 n for the smaller and 4/5 m for
    the larger, so few shingles of a set are keys, and what a family of texts has in common is none:
    no such pair is missed, and a family is not paired with itself.
    """
    each = sets.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    spread = each.groupBy("key").agg(F.count("*").alias("in_sets"), (F.min("root") != F.max("root")).alias("mixed"))
    entry = F.struct("in_sets", "key", "mixed")
    ordered = each.join(spread, "key").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    longest = F.floor(F.col("n") * (1 - SIMILARITY) + 1e-9).cast("int") + 1
    keys = ordered.select("node", "root", "n", F.posexplode(F.slice("entries", F.lit(1), longest)).alias("at", "entry"))
    keys = stage(keys.filter("entry.mixed").select("node", "root", "n", "at", F.col("entry.key").alias("key")), "nearcopies-keys")
    side = lambda end: keys.select("key", *[F.col(c).alias(f"{c}_{end}") for c in ("node", "root", "n", "at")])
    small = side("a").filter(F.col("n_a") - F.col("at_a") >= 2 * _SHARED * F.col("n_a") - 1e-9)
    shared = _SHARED * (F.col("n_a") + F.col("n_b")) - 1e-9
    met = small.join(side("b"), "key").filter("root_a <> root_b AND (n_a < n_b OR n_a = n_b AND node_a < node_b)")
    met = met.filter((F.col("n_a") >= shared) & (F.col("n_a") - F.col("at_a") >= shared) & (F.col("n_b") - F.col("at_b") >= shared))
    return met.select(*_edge("node_a", "node_b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): the smallest doc_id reachable over links of SIMILARITY.

    Texts with the same set of shingles are one node. A first round compares each node with one
    leader of each of its buckets, and what is still apart in crowded ones with further leaders;
    components of what this confirms drop out, so that a large group of near copies is never paired
    with itself. A last round compares what is still apart: all
    pairs of buckets of up to ALL_PAIRS members, and of the members of larger ones all pairs that
    can be similar (see ``rare_shingle_pairs``). Leaders are minima, so that a hot bucket is
    aggregated before it is shuffled.

    Rows without id are left out; blank texts link to each other; repeated rows stay.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    own = stage(signatures(rows), "nearcopies-signatures")
    nodes = stage(own.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands")), "nearcopies-nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    buckets = stage(members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n >= 2"), "nearcopies-buckets")
    placed = stage(members.join(buckets, "key"), "nearcopies-members")
    needed = placed.select("node").distinct().join(nodes.select("node", "least"), "node").select(F.col("least").alias("doc_id"))
    sets = stage(_sets(rows.join(needed, "doc_id", "left_semi")).dropDuplicates(["node"]), "nearcopies-sets")

    tried = stage(placed.filter("node <> leader").select(*_edge("node", "leader")).distinct(), "nearcopies-tried")
    links = confirmed(tried, sets)
    roots = components(links)
    crowded = stage(placed.filter(F.col("n") > ALL_PAIRS).select("node", "key"), "nearcopies-crowded")
    for turn in range(LEADER_ROUNDS):
        held = crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # The leader is the member that this turn's hash picks.
        one = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "root")).alias("one")
        leaders = held.groupBy("key").agg(one, (F.min("root") != F.max("root")).alias("mixed")).filter("mixed")
        met = held.join(leaders, "key").filter("root <> one.root").select(*_edge("node", F.col("one.node"))).distinct()
        met = stage(met.join(tried, ["a", "b"], "left_anti"), "nearcopies-tried")
        more = confirmed(met, sets)
        if more.isEmpty():
            break
        tried, links = tried.unionByName(met), links.unionByName(more)
        roots = components(links)
    apart = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    few = placed.filter(F.col("n") <= ALL_PAIRS).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("all"))
    pairs = F.expr("flatten(transform(all, (x, i) -> transform(slice(all, i + 2, size(all)), y -> struct(x AS a, y AS b))))")
    small = few.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b")
    named = sets.join(crowded.select("node").distinct(), "node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "shingles")
    large = rare_shingle_pairs(named)
    rest = small.unionByName(large).distinct().join(tried, ["a", "b"], "left_anti")
    rest = rest.join(apart("a"), "a", "left").join(apart("b"), "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    roots = components(links.unionByName(confirmed(rest.select("a", "b"), sets)))

    named = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = stage(named.join(component, "root").select("node", "component_id"), "nearcopies-components")
    return own.select("doc_id", "node").join(by_node, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", further: Sequence[DataFrame] = ()) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document with the smallest id.

    ``further`` are components (doc_id, component_id) by other measures, each named by its smallest id; what
    links of any measure connect is one component. Rows without an id stay; of rows that repeat an id
    one stays. All columns are kept.
    """
    placed = [each.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).filter("a <> b") for each in (near_copies(docs, id_col, text_col), *further)]
    # Components joined: the root is the smallest id.
    joined = components(reduce(DataFrame.unionByName, placed)) if further else placed[0].select(F.col("a").alias("node"), F.col("b").alias("root"))
    copies = joined.filter("node <> root").select(F.col("node").alias("__copy")).distinct()
    # Packed rows, so that no column of theirs can clash.
    packed = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"))
    rest = packed.filter("__id IS NOT NULL").join(copies, F.col("__id") == F.col("__copy"), "left_anti")
    return rest.dropDuplicates(["__id"]).unionByName(packed.filter("__id IS NULL")).select("__row.*")
