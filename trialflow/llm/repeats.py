"""Which stretches of texts also stand in a document with a smaller id: a sorted, split suffix order.

Suffixes are taken where a text's anchors are (see ``anchors``): equal windows share theirs, so no
match is lost, and there are about twenty times fewer than tokens. A suffix sorts by its leading
tokens, then by a hash of the block of text that its windows cover, then by document. Sampled splitters
cut this order into ranges of like size, in the middle of frequent leading tokens or a frequent block
too; each range is sorted by multikey quicksort, and its first entries are compared with the splitter
before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialflow.llm import text as tx
from trialflow.llm.anchors import Anchors, Sums, find_anchors
from trialflow.session import stage

#: Bytes of text whose suffixes make up one range on average.
RANGE_BYTES = 16 << 20
#: Ranges at least, so that small inputs use all cores.
MIN_RANGES = 64
#: Documents that splitters are sampled from at least, and for each range, and suffixes for each range.
SAMPLED_DOCS, SAMPLED_DOCS_PER_RANGE, SAMPLED_PER_RANGE = 4000, 4, 50
REPEATED, OPEN = 0, 1
#: Tells the second hash of a window from the first.
_OTHER = np.uint64(0x5851F42D4C957F2D)
#: Columns of records: one or more leading ones, a hash of what is compared, the document.
Records = tuple[np.ndarray, ...]


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several columns: each next column sorts only within ties of those before."""
    order = np.argsort(columns[0], kind="stable")
    group = np.zeros(len(order), np.int64)
    last = columns[0][order]
    for column in columns[1:]:
        group[1:] = np.cumsum((last[1:] != last[:-1]) | (group[1:] != group[:-1]))
        same = np.zeros(len(order), bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        at = np.flatnonzero(same)
        if len(at) == 0:
            break
        order[at] = order[at][np.lexsort((column[order[at]], group[at]))]
        last = column[order]
    return order


def _row_type(n_columns: int) -> np.dtype:
    return np.dtype([(f"c{k}", ">u8") for k in range(n_columns)])


def _sortable(records: Records) -> np.ndarray:
    """Rows as byte strings in the order of the columns; ids keep their sign's order."""
    out = np.empty(len(records[0]), _row_type(len(records)))
    for k, column in enumerate(records[:-1]):
        out[f"c{k}"] = column
    out[f"c{len(records) - 1}"] = records[-1].astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view(f"S{8 * len(records)}").reshape(-1)


def _changes(columns: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where a row differs from the one before it in some column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _sorted_records(records: Records) -> Records:
    """In order, each record once."""
    order = multikey_order(list(records))
    records = tuple(c[order] for c in records)
    new = _changes(records)
    return tuple(c[new] for c in records)


def _pack(records: Records) -> tuple[int, bytes, bytes]:
    """(least id, leading columns, the others): sorted leading tokens shrink well byte by byte of their place."""
    *lead, key, doc = records
    planes = np.stack(lead, axis=1).astype(">u8").view(np.uint8).reshape(len(doc), -1).T.tobytes()
    base = int(doc.min())
    away = (doc - base).astype(np.uint64)
    away = away.astype("<u4") if int(away.max()) < 1 << 32 else away.astype("<u8")
    return base, pa.compress(planes, codec="zstd", asbytes=True), key.astype("<u8").tobytes() + away.tobytes()


def _unpack(n: int, base: int, lead: bytes, blob: bytes, n_lead: int) -> Records:
    planes = np.frombuffer(pa.decompress(lead, 8 * n_lead * n, codec="zstd", asbytes=True), np.uint8).reshape(-1, n).T
    columns = np.ascontiguousarray(planes).view(">u8").reshape(n, n_lead).astype(np.uint64)
    kind = "<u4" if len(blob) == 12 * n else "<u8"
    return *columns.T, np.frombuffer(blob, "<u8", n), np.frombuffer(blob, kind, n, 8 * n).astype(np.int64) + base


def judge(records: Records, below: np.ndarray | None, above: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, key, kind) of a range's records that repeat a smaller document's, or might in part.

    ``below`` and ``above`` are the splitters next to the range, each a record that exists: the one
    below belongs to the range before, so an entry of its key here repeats it.
    """
    records = _sorted_records(records)
    *lead, key, doc = records
    if len(doc) == 0:
        return doc, key, np.zeros(0, np.int8)
    new_group = _changes(tuple(lead))
    new_key = new_group.copy()
    new_key[1:] |= key[1:] != key[:-1]
    group, run = np.cumsum(new_group) - 1, np.cumsum(new_key) - 1
    repeated = doc > doc[np.flatnonzero(new_key)][run]
    several = np.bincount(group[np.flatnonzero(new_key)])[group] > 1
    for edge, lower in ((below, True), (above, False)):
        if edge is not None:
            at = np.frombuffer(edge.ljust(8 * len(records), b"\0"), _row_type(len(records)))[0]
            like = np.all([c == np.uint64(at[f"c{k}"]) for k, c in enumerate(lead)], axis=0)
            several |= like
            if lower:
                repeated |= like & (key == np.uint64(at[f"c{len(lead)}"]))
    told = repeated | several
    return doc[told], key[told], np.where(repeated[told], REPEATED, OPEN).astype(np.int8)


def flag_repeats(
    rows: DataFrame, sampled: DataFrame, emit: Callable[[pa.RecordBatch], Iterator[Records]], n_lead: int, n_ranges: int, stride: int, kinds: tuple[int, ...], label: str
) -> DataFrame:
    """(doc, key, kind) for the records that ``emit`` makes of ``rows``, as a written table.

    ``sampled`` is the part of ``rows`` that splitters are taken from, every ``stride``-th record.
    Records have ``n_lead`` leading columns.
    """
    names = ["part", "n", "base", "lead", "records"]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for records in emit(batch):
                yield pa.RecordBatch.from_arrays([pa.array(_sortable(tuple(c[::stride] for c in records)).tolist(), pa.binary())], ["record"])

    found = sorted(sampled.mapInArrow(sample, "record binary").toArrow().column("record").to_pylist())
    cuts = sorted({found[len(found) * i // n_ranges] for i in range(1, n_ranges)}) if found else []
    splitters = rows.sparkSession.sparkContext.broadcast(np.array(cuts, f"S{8 * (n_lead + 2)}"))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for records in emit(batch):
                if len(records[0]) == 0:
                    continue
                records = _sorted_records(records)
                ends = np.append(np.searchsorted(_sortable(records), splitters.value, "right"), len(records[0]))
                starts = np.concatenate(([0], ends[:-1]))
                out = [(k, int(j - i), *_pack(tuple(c[i:j] for c in records))) for k, (i, j) in enumerate(zip(starts, ends)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = splitters.value
        part, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            records = tuple(np.concatenate(c) for c in zip(*held))
            doc, key, kind = judge(records, edges[part - 1] if part > 0 else None, edges[part] if part < len(edges) else None)
            wanted = np.isin(kind, kinds)
            doc, key, kind = doc[wanted], key[wanted].view(np.int64), kind[wanted]
            for i in range(0, len(doc), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in (doc, key, kind)], ["doc", "key", "kind"])

        for batch in batches:
            for k, n, base, lead, blob in zip(*[batch.column(c).to_pylist() for c in names]):
                if part is not None and k != part:
                    yield from told()
                    held = []
                part = k
                held.append(_unpack(n, base, lead, blob, n_lead))
        if held:
            yield from told()

    ranges = rows.mapInArrow(scatter, "part int, n int, base long, lead binary, records binary").repartition(len(cuts) + 1, "part").sortWithinPartitions("part")
    return stage(ranges.mapInArrow(settle, "doc long, key long, kind byte"), label)


@dataclass(frozen=True)
class Tokens:
    """What a window counts, and how its suffixes are ordered and found again.

    ``codes`` gives (code per token, first token of each text) of a piece; ``lead`` the leading columns of
    the suffixes at some anchors. ``spell`` gives the k-grams at some tokens as strings, and ``locate``
    where such strings stand in some stretches of the tokens; without them all anchors are taken.
    """

    codes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    window: int
    k: int
    lead: Callable[[np.ndarray, np.ndarray, Anchors], list[np.ndarray]]
    n_lead: int
    spell: Callable[[np.ndarray, np.ndarray], list[str]] | None = None
    locate: Callable[[np.ndarray, np.ndarray, list[str]], np.ndarray] | None = None


def _marked(rows: np.ndarray, keys: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each key is in its row's list."""
    counts = np.asarray(lists.value_lengths().fill_null(0))
    listed = lists.flatten().to_numpy().view(np.uint64)
    own = np.repeat(np.arange(len(counts)), counts)
    salt = np.uint64(0x9E3779B97F4A7C15)
    return np.isin(tx.mix64(keys + rows.astype(np.uint64) * salt), tx.mix64(listed + own.astype(np.uint64) * salt))


def _lists(flags: DataFrame, *more: Column, **kinds: int) -> DataFrame:
    return flags.groupBy("doc").agg(*more, *[F.collect_list(F.when(F.col("kind") == kind, F.col("key"))).alias(name) for name, kind in kinds.items()])


def _open_windows(found: Anchors, sums: Sums, first: np.ndarray, is_open: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in the piece, hash) of all windows of the open runs."""
    n = found.n[is_open]
    row = np.repeat(found.row[is_open], n)
    at = np.repeat(found.start[is_open] + first[found.row[is_open]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, at, sums.hash(at, at + window)


def _located(piece: pa.RecordBatch, codes: np.ndarray, first: np.ndarray, tokens: Tokens) -> Anchors:
    """The runs of windows around the places where the piece's confirmed phrases are located."""
    lists = piece.column("phrases")
    phrases = sorted(set(lists.flatten().to_pylist())) if len(lists) else []
    marked = np.asarray(lists.value_lengths().fill_null(0)) > 0
    hits = tokens.locate(codes, np.stack((first[:-1][marked], first[1:][marked]), axis=1), phrases) if phrases else np.zeros(0, np.int64)
    # All windows that hold a hit, and nothing beyond the hit's text.
    row = np.searchsorted(first, hits, "right") - 1
    begin, end = np.maximum(first[row], hits + tokens.k - tokens.window), np.minimum(first[row + 1], hits + tokens.window)
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    near = np.cumsum(edge)[:-1] > 0
    starts = near & ~np.concatenate(([False], near[:-1]))
    starts[first[:-1][first[:-1] < len(codes)]] |= near[first[:-1][first[:-1] < len(codes)]]
    at, begin = np.flatnonzero(near), np.flatnonzero(starts)
    cuts = np.append(np.searchsorted(at, begin), len(at))
    found = find_anchors(codes[at], cuts, tokens.window, tokens.k)
    if len(found.row) == 0:
        return found
    row = np.searchsorted(first, begin[found.row], "right") - 1
    shift = begin[found.row] - first[row]
    return found._replace(row=row, start=found.start + shift, place=found.place + shift)


def _runs(piece: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, tokens: Tokens):
    """Anchors of a piece with which runs are repeated and which open."""
    codes, first = tokens.codes(data, offsets)
    sums = Sums(codes)
    found = find_anchors(codes, first, tokens.window, tokens.k, sums) if tokens.locate is None else _located(piece, codes, first, tokens)
    repeated = _marked(found.row, found.block, piece.column("repeated"))
    is_open = _marked(found.row, found.block, piece.column("open"))
    return codes, first, sums, found, repeated, is_open


def covered(piece: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(first token of each text, whether each token of the piece is covered by a repeated window)."""
    _, first, sums, found, repeated, is_open = _runs(piece, data, offsets, tokens)
    row, at, hashes = _open_windows(found, sums, first, is_open, tokens.window)
    again = _marked(row, hashes, piece.column("windows"))
    edge = np.zeros(first[-1] + 1, np.int64)
    begin = found.start[repeated] + first[found.row[repeated]]
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + found.n[repeated] - 1 + tokens.window, -1)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + tokens.window, -1)
    return first, np.cumsum(edge)[:-1] > 0


def confirmed_phrases(docs: DataFrame, flags: DataFrame, tokens: Tokens) -> DataFrame:
    """(key, phrase): the k-gram of each flagged block, spelled by the smallest document that has the flag."""
    owned = flags.groupBy("key").agg(F.min("doc").alias("owner")).groupBy("owner").agg(F.collect_list("key").alias("keys"))
    asked = docs.join(owned, F.col("doc_id") == F.col("owner")).select("text", "keys")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in tx.pieces(batch):
                codes, first = tokens.codes(data, offsets)
                found = find_anchors(codes, first, tokens.window, tokens.k)
                mine = _marked(found.row, found.block, piece.column("keys"))
                at = found.place[mine] + first[found.row[mine]]
                yield pa.RecordBatch.from_arrays([pa.array(found.block[mine].view(np.int64)), pa.array(tokens.spell(codes, at), pa.string())], ["key", "phrase"])

    return stage(asked.mapInArrow(spell, "key long, phrase string").dropDuplicates(["key"]), "repeats-phrases")


def with_repeats(docs: DataFrame, tokens: Tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, repeated, open, phrases, windows): each text with the marks that ``covered`` reads.

    First whole blocks are compared; only where equal leading tokens have several different blocks their
    single windows are compared too, by two hashes, each in a split and sorted order. Both rounds are
    written tables.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_docs, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_ranges = max(MIN_RANGES, math.ceil(size / RANGE_BYTES))
    every = max(1, n_docs // max(SAMPLED_DOCS, SAMPLED_DOCS_PER_RANGE * n_ranges))
    stride = max(1, size // every // 15 // (SAMPLED_PER_RANGE * n_ranges))
    some = lambda frame, name: frame.filter(F.pmod(F.xxhash64(name), F.lit(every)) == 0)
    named = rows.filter(F.col("doc_id").isNotNull())

    def blocks(batch: pa.RecordBatch) -> Iterator[Records]:
        for piece, data, offsets in tx.pieces(batch):
            codes, first = tokens.codes(data, offsets)
            found = find_anchors(codes, first, tokens.window, tokens.k)
            yield *tokens.lead(data, first, found), found.block, piece.column("doc_id").to_numpy()[found.row]

    def windows(batch: pa.RecordBatch) -> Iterator[Records]:
        for piece, data, offsets in tx.pieces(batch):
            codes, first, sums, found, _, is_open = _runs(piece, data, offsets, tokens)
            row, at, hashes = _open_windows(found, sums, first, is_open, tokens.window)
            other = Sums(tx.mix64(codes ^ _OTHER)).hash(at, at + tokens.window) if len(at) else hashes
            yield other, hashes, piece.column("doc_id").to_numpy()[row]

    flags = flag_repeats(named, some(named, "doc_id"), blocks, tokens.n_lead, n_ranges, stride, (REPEATED, OPEN), "repeats-blocks")
    phrase = F.lit(None).cast("string").alias("phrase")
    told = flags.join(confirmed_phrases(named, flags, tokens), "key", "left") if tokens.spell else flags.select("*", phrase)
    if tokens.spell:
        told = stage(told.select("doc", "key", "kind", "phrase"), "repeats-told")
    lists = lambda frame: _lists(frame, F.collect_set("phrase").alias("phrases"), repeated=REPEATED, open=OPEN)
    marks = lambda left, right: left.join(lists(right), F.col("doc_id") == F.col("doc"))
    open_ones = flags.filter(F.col("kind") == OPEN).select(F.col("doc").alias("__open")).distinct()
    asked = marks(named, told.join(open_ones, F.col("doc") == F.col("__open"), "left_semi"))
    again = flag_repeats(asked, marks(some(named, "doc_id"), some(told, "doc")), windows, 1, n_ranges, max(1, stride // 4), (REPEATED,), "repeats-windows")
    both = lists(told).join(_lists(again, windows=REPEATED), "doc", "left")
    return rows.join(both, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "repeated", "open", "phrases", "windows")
