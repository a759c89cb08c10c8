"""Embedding near-dedup by an epsilon grid order join.

Unit vectors whose cosine is at least t are at most sqrt(2 - 2t) apart, and so are their
projections on any orthonormal axes. Vectors are sorted by grid cells of that side on the leading
principal axes and cut into sequences; two sequences whose boxes are further apart than the radius
hold no link. The others are joined by halving them until they are small or provably distant.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialflow.llm.graph import components
from trialflow.session import stage

#: Vectors of one label whose cosine is so large are linked.
COSINE = 0.98
#: Principal axes that order the vectors and bound their sequences.
LEADING = 16
#: Of these, axes whose cells are the sort key; the first KEYED also find the pairs of sequences.
CELLS, KEYED = 8, 2
#: Vectors of a sequence, which is what a task receives, at most.
SEQUENCE = 2048
#: Vectors on either side of a dense comparison.
LEAF = 256
#: Sequences that one task compares with a sequence.
PARTNERS = 8
#: Numbers in the sample that the axes are fitted on, about. Axes steer the order only: any give the same links.
SAMPLE_NUMBERS = 1_000_000
#: Side of a grid cell at least, whatever the radius.
LEAST_SIDE = 0.01
#: What rounding may add to a distance.
SLACK = 1e-9


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so that squares stay finite."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def usable() -> Column:
    """Whether a row (label, id, vec) can be compared: label and id known, all components finite and one not zero."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    return F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(finite & some, F.lit(False))


def principal_axes(reps: DataFrame, sample_numbers: int = SAMPLE_NUMBERS) -> np.ndarray:
    """(longest vector, up to LEADING) orthonormal columns fitted on a bounded sample of ``reps`` (node, vec, dim)."""
    n, dim = reps.agg(F.count("*"), F.max("dim")).first()
    if not n:
        return np.eye(1)
    wanted = max(2 * LEADING, sample_numbers // dim)
    share = min(1.0, wanted / n)
    sampled = reps.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * wanted)
    held = sampled.select("vec").toArrow().column("vec").to_pylist()
    if not held:
        return np.eye(dim, min(dim, LEADING))
    rows = np.zeros((len(held), dim))
    for i, v in enumerate(held):
        rows[i, : len(v)] = v
    rows = unit_rows(rows)
    rows -= rows.mean(axis=0)
    _, axes = np.linalg.eigh(rows.T @ rows)
    return np.ascontiguousarray(axes[:, ::-1][:, :LEADING])


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one length as doubles."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _project(vectors: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return unit_rows(vectors) @ axes[: vectors.shape[1]]


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of each length of vector in the batch."""
    lengths = np.diff(column.offsets.to_numpy())
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def with_cells(reps: DataFrame, axes: np.ndarray, side: float) -> DataFrame:
    """``reps`` with ``cells``: the numbers of their grid cells on the leading axes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            for rows in _by_length(column):
                part = batch.take(pa.array(rows))
                at = np.floor(_project(_matrix(part.column("vec")), axes)[:, :CELLS] / side).astype(np.int32)
                cells = pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), at.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, cells], [*part.schema.names, "cells"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema)
    return reps.mapInArrow(place, f"{kinds}, cells array<int>")


def sequences(celled: DataFrame, n_ranges: int, limit: int) -> DataFrame:
    """``celled`` in epsilon grid order, as a written table, cut into numbered sequences of one label and length.

    A range of the order is one task's; a sequence's number is its task's and its place there.
    """
    kind = celled.schema["label"].dataType.simpleString()
    ordered = celled.repartitionByRange(n_ranges, "label", "dim", "cells", "node").sortWithinPartitions("label", "dim", "cells", "node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        last, held = None, 0
        for batch in batches:
            numbers = np.empty(batch.num_rows, np.int64)
            for i, group in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist())):
                if group != last or held == limit:
                    first, last, held = first + 1, group, 0
                numbers[i] = first
                held += 1
            yield pa.RecordBatch.from_arrays([pa.array(numbers), *[batch.column(c) for c in ("label", "dim", "node", "copies", "vec")]], ["seq", "label", "dim", "node", "copies", "vec"])

    vec = celled.schema["vec"].dataType.simpleString()
    return stage(ordered.mapInArrow(cut, f"seq long, label {kind}, dim int, node long, copies long, vec {vec}"), "embeddings-sequences")


def sequence_boxes(placed: DataFrame, axes: np.ndarray) -> DataFrame:
    """(seq, label, dim, low, high): the box of each sequence's projections, as a written table."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("seq").to_numpy()
            for rows in _by_length(batch.column("vec")):
                at = _project(_matrix(batch.column("vec").take(pa.array(rows))), axes)
                own = names[rows]
                order = np.argsort(own, kind="stable")
                own, at = own[order], at[order]
                starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                low, high = np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)
                yield pa.RecordBatch.from_arrays([pa.array(own[starts]), pa.array(low.tolist(), pa.list_(pa.float64())), pa.array(high.tolist(), pa.list_(pa.float64()))], ["seq", "low", "high"])

    n = axes.shape[1]
    parts = placed.select("seq", "vec").mapInArrow(bound, "seq long, low array<double>, high array<double>")
    bounds = [f(F.col(c)[k]).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(n)]
    whole = parts.groupBy("seq").agg(*bounds)
    named = placed.groupBy("seq").agg(F.first("label").alias("label"), F.first("dim").alias("dim"))
    box = [F.array(*[F.col(f"{c}{k}") for k in range(n)]).alias(c) for c in ("low", "high")]
    return stage(whole.select("seq", *box).join(named, "seq"), "embeddings-boxes")


def sequence_pairs(boxes: DataFrame, radius: float, side: float, n_axes: int) -> DataFrame:
    """(a, b), a <= b: sequences of one label and length whose boxes are within ``radius``.

    A sequence stands in all cells of the first KEYED axes that its box meets, and beside them in
    their neighbours; sequences meet where they share a cell, and only in the first such cell.
    """
    keyed = min(KEYED, n_axes)
    cell = lambda end, k: F.floor(F.col(end)[k] / side)

    def spread(end: str, more: int) -> DataFrame:
        out = boxes.select(
            F.col("seq").alias(end), "label", "dim", F.col("low").alias(f"low_{end}"), F.col("high").alias(f"high_{end}"),
            *[(cell("low", k) - more).alias(f"from_{end}{k}") for k in range(keyed)],
            *[(cell("high", k) + more).alias(f"to_{end}{k}") for k in range(keyed)],
        )
        for k in range(keyed):
            out = out.withColumn(f"cell{k}", F.explode(F.sequence(f"from_{end}{k}", f"to_{end}{k}")))
        return out

    gap = lambda k: F.greatest(F.lit(0.0), F.col("low_a")[k] - F.col("high_b")[k], F.col("low_b")[k] - F.col("high_a")[k])
    apart = sum((gap(k) * gap(k) for k in range(n_axes)), F.lit(0.0))
    first = [F.col(f"cell{k}") == F.greatest(f"from_a{k}", f"from_b{k}") for k in range(keyed)]
    met = spread("a", 1).join(spread("b", 0), ["label", "dim", *[f"cell{k}" for k in range(keyed)]])
    for one in first:
        met = met.filter(one)
    return met.filter(F.col("a") <= F.col("b")).filter(apart <= (radius + SLACK) ** 2).select("a", "b")


class Sequence:
    """A sequence's vectors in grid order, with the boxes of its halves, their halves, and so on."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray, axes: np.ndarray) -> None:
        self.nodes, self.copies = nodes, copies
        self.units = unit_rows(vectors)
        self.at = self.units @ axes[: vectors.shape[1]]
        self._boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if (i, j) not in self._boxes:
            self._boxes[i, j] = self.at[i:j].min(axis=0), self.at[i:j].max(axis=0)
        return self._boxes[i, j]


def join_sequences(a: Sequence, b: Sequence, cosine: float, radius: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(places in a, places in b, dense comparisons): all links between two sequences, each once.

    ``b`` may be ``a``: then places in a are smaller. Halves that are provably distant are skipped.
    """
    left, right, dense = [], [], 0
    todo = [(0, len(a.nodes), 0, len(b.nodes))]
    while todo:
        i, j, k, m = todo.pop()
        same = a is b and (i, j) == (k, m)
        if not same:
            (low, high), (low2, high2) = a.box(i, j), b.box(k, m)
            gap = np.maximum(0.0, np.maximum(low - high2, low2 - high))
            if gap @ gap > (radius + SLACK) ** 2:
                continue
        if j - i <= LEAF and m - k <= LEAF:
            dense += 1
            near = a.units[i:j] @ b.units[k:m].T >= cosine
            if same:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            left.append(x + i)
            right.append(y + k)
        elif same:
            h = (i + j) // 2
            todo += [(i, h, i, h), (i, h, h, j), (h, j, h, j)]
        elif j - i >= m - k:
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), dense


def _roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of ``n`` places is linked to over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(placed: DataFrame, pairs: DataFrame, axes: np.ndarray, cosine: float, radius: float, side: float) -> DataFrame:
    """(node, links, peer): how many vectors a node is linked to, in parts, and edges that connect what is linked.

    A task gets one sequence and up to PARTNERS others at a time, and gives at most one row for each
    vector and comparison, however many links there are.
    """
    numbered = pairs.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1) / PARTNERS))
    numbered = stage(numbered, "embeddings-pairs")
    own = numbered.select(F.col("a").alias("seq"), "a", "chunk").distinct().withColumn("partner", F.lit(-1).cast("long"))
    wanted = own.unionByName(numbered.select(F.col("b").alias("seq"), "a", "chunk", F.col("b").alias("partner")))
    sent = wanted.join(placed.select("seq", "node", "copies", "vec"), "seq").select("a", "chunk", "partner", "node", "copies", "vec")
    n_tasks = numbered.select("a", "chunk").distinct().count()
    n_parts = max(1, n_tasks, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = sent.repartition(min(n_parts, 20_000), "a", "chunk").sortWithinPartitions("a", "chunk", "partner")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, held = None, None, []

        def read() -> Sequence:
            nodes, copies, vectors = (np.concatenate(c) for c in zip(*held))
            at = _project(vectors, axes)
            order = np.lexsort(np.floor(at[:, :CELLS] / side).T[::-1])
            return Sequence(nodes[order], copies[order], vectors[order], axes)

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal base
            if key[2] < 0:
                base = read()
                return
            other = base if key[2] == key[0] else read()
            x, y, _ = join_sequences(base, other, cosine, radius)
            if len(x) == 0:
                return
            n = len(base.nodes)
            nodes, copies = (base.nodes, base.copies) if other is base else (np.append(base.nodes, other.nodes), np.append(base.copies, other.copies))
            y = y if other is base else y + n
            count = np.bincount(x, copies[y], len(nodes)) + np.bincount(y, copies[x], len(nodes))
            root = _roots(x, y, len(nodes))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(count[some].astype(np.int64)), pa.array(nodes[root[some]])], ["node", "links", "peer"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("a", "chunk", "partner")], axis=1)
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else []
            for i, j in zip(cuts, [*cuts[1:], len(keys)]):
                now = tuple(keys[i].tolist())
                if key is not None and now != key:
                    yield from finish()
                    held = []
                key = now
                part = batch.slice(i, j - i)
                held.append((part.column("node").to_numpy(), part.column("copies").to_numpy(), _matrix(part.column("vec"))))
        if key is not None:
            yield from finish()

    return dealt.mapInArrow(compare, "node long, links long, peer long")


def near_duplicates(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    sequence: int = SEQUENCE,
) -> DataFrame:
    """One row per vector: id, n_links (other vectors with ``cosine`` or more under the same label),
    component_id (the smallest id reachable over links, its own included), kept (id = component_id).

    Equal vectors of a label are one node that counts its copies, so copies are never paired with
    each other; links of different vectors are counted where they are found and never listed.

    Vectors that are NULL, empty, zero or hold NULL, NaN or infinity, and rows whose label or id is
    NULL, link with nothing; a row without id has no component and is kept. Vectors of different
    lengths are never linked. Rows that repeat an id are vectors of their own; an empty table
    gives an empty result; other columns are not read, so their names cannot clash.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    side = max(radius, LEAST_SIDE)
    own = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    compared = own.filter(usable())
    grouped = compared.groupBy("label", "vec").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    reps = stage(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "embeddings-reps")
    axes = principal_axes(reps)
    n_ranges = max(1, math.ceil(reps.count() / (4 * sequence)))
    placed = sequences(with_cells(reps.select("label", "dim", "node", "copies", "vec"), axes, side), n_ranges, sequence)
    pairs = sequence_pairs(sequence_boxes(placed, axes), radius, side, axes.shape[1])
    found = stage(links(placed, pairs, axes, cosine, radius, side), "embeddings-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    named = reps.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = named.groupBy("root").agg(F.min("least").alias("component"))
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    by_node = stage(named.join(component, "root").select("label", "vec", n_links.alias("n_links"), "component"), "embeddings-nodes")
    linked = compared.join(by_node, ["label", "vec"]).select("id", "n_links", "component")
    rest = own.filter(~usable()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return linked.unionByName(rest).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))
