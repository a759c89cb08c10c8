"""Exact BM25 top-k: an inverted index in shards, searched by block-max WAND with global statistics."""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialflow.llm import text as tx
from trialflow.session import shuffles_dropped, stage

K1, B = 1.2, 0.75
#: Postings after which a shard is closed; a task holds the postings of one shard.
SHARD_POSTINGS = 1_000_000
#: Texts of a shard, next to each other in its order, that share one bound per term.
BLOCK = 64
#: Texts, those with the highest bounds, that are scored before the others are compared with the k-th best.
FIRST_TEXTS = 64
#: Terms of distinct queries that one broadcast holds, about (64 MB); more go in blocks of whole queries, each of which
#: reads the index again.
BLOCK_TERMS = 4_000_000
#: Shards are searched in waves; each makes the number of searched shards so many times as large.
WAVE = 8
#: A term that this share of all texts has is common: its blocks are bounded first. Rarer terms are scored as a whole.
COMMON = 1 / 20
#: Queries that a shard answers at a time, and the cells that their scores may take.
BATCH, BATCH_CELLS = 256, 1 << 20
#: Texts, at least, that one product of matrices bounds; and cells of a matrix of common terms, beyond which a shard is cut.
GROUP, DENSE_CELLS = 256, 1 << 24
#: Bits of a shard's random name.
_NAME_BITS = 62
#: Scores are compared after rounding, so that equal texts tie in every shard.
DIGITS = 6
#: A posting names its document by the place in the shard's table of ids and sizes.
_POSTING = np.dtype([("place", "<u4"), ("tf", "<u4")])
_NO_ID = np.iinfo(np.int64).max
#: A bound is not rounded and may fall short of a rounded score by this much.
_SLACK = 2 * 10.0**-DIGITS
_NO_FLOOR = (-math.inf, _NO_ID)
INDEX = "shard long, term long, n long, postings binary, sizes binary, n_docs long, n_words long"
RESULT = "query long, doc_id long, score double"


def _counts(piece: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf, position of one occurrence, words per text) of a piece, sorted by row and term."""
    start, end, first = tx.words(data, offsets)
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    term = tx.word_hashes(data, start, end, lower=True).view(np.int64)
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])))) if len(row) else np.zeros(0, np.int64)
    return row[new], term[new], np.diff(np.append(new, len(row))), order[new], size


def _slices(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """``values`` cut at ``starts`` (and its end) into one binary value each."""
    offsets = (np.append(starts, len(values)) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _bytes(values: pa.Array) -> pa.Buffer:
    """The bytes of all binary values, one value after the other."""
    offsets = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_binary(values.type) else np.int32)
    first, last = int(offsets[values.offset]), int(offsets[values.offset + len(values)])
    return values.buffers()[2].slice(first, last - first)


def _leading_terms(row: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> list[np.ndarray]:
    """The three most frequent terms of each text, which tell languages and kinds of text apart."""
    order = np.lexsort((term, -tf, row))
    at = np.arange(len(order)) - np.searchsorted(row[order], np.arange(n))[row[order]]
    out = []
    for k in range(3):
        own = np.zeros(n, np.int64)
        some = order[at == k]
        own[row[some]] = term[some]
        out.append(own)
    return out


def _shard(name: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Index rows of one shard: its table of ids and sizes, and a list per term.

    Texts with the same leading terms stand next to each other, so that blocks of them share terms
    and the bounds of other blocks are low.
    """
    term, row, tf, ids, sizes = (np.concatenate(c) for c in list(zip(*held))[:5])
    n_docs, n_words = sum(h[5] for h in held), sum(h[6] for h in held)
    order = np.lexsort([ids, sizes, *_leading_terms(row, term, tf, len(ids))[::-1]])
    ids, sizes = ids[order], sizes[order]
    place = np.empty(len(ids), np.uint32)
    place[order] = np.arange(len(ids))
    row = place[row]
    order = np.lexsort((row, term))
    term = term[order]
    posts = np.empty(len(term), _POSTING)
    posts["place"], posts["tf"] = row[order], tf[order]
    starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
    n = np.diff(np.append(starts, len(term)))
    columns = [c.split()[0] for c in INDEX.split(", ")]
    step = 50_000
    for i in range(0, len(starts), step):
        j = min(i + step, len(starts))
        last = starts[j] if j < len(starts) else len(posts)
        none = pa.nulls(j - i, pa.int64())
        lists = _slices(posts[starts[i] : last], starts[i:j] - starts[i])
        yield pa.RecordBatch.from_arrays([pa.array([name] * (j - i)), pa.array(term[starts[i:j]]), pa.array(n[i:j]), lists, pa.nulls(j - i, pa.binary()), none, none], columns)
    table = {"shard": name, "postings": ids.astype("<i8").tobytes(), "sizes": sizes.astype("<i4").tobytes(), "n_docs": n_docs, "n_words": n_words}
    kinds = {"postings": pa.binary(), "sizes": pa.binary()}
    yield pa.RecordBatch.from_pylist([table], pa.schema([(c, kinds.get(c, pa.int64())) for c in columns]))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows, as a written table: a row per shard and term, and one per shard that
    holds the ids and lengths of its texts with words, in the shard's order.

    A term is a 64-bit hash of a lower-case word. NULL and empty texts count as documents without
    words; a row without id counts in the statistics but cannot be an answer; rows that repeat an id
    are documents of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, n_rows = [], 0, 0
        for batch in batches:
            for piece, data, offsets in tx.pieces(batch):
                row, term, tf, _, size = _counts(piece, data, offsets)
                ids = piece.column("doc_id")
                # Rows without id stay in the lists and their lengths; they are never returned.
                doc = np.where(np.array(ids.is_valid()), ids.fill_null(0).to_numpy(), _NO_ID)
                worded = size > 0
                row = (np.cumsum(worded) - 1)[row] + n_rows
                held.append((term, row, tf, doc[worded], size[worded], len(size), int(size.sum())))
                n, n_rows = n + len(term), n_rows + int(worded.sum())
                if n >= SHARD_POSTINGS:
                    yield from _shard(secrets.randbits(_NAME_BITS), held)
                    held, n, n_rows = [], 0, 0
        if held:
            yield from _shard(secrets.randbits(_NAME_BITS), held)

    return stage(rows.mapInArrow(build, INDEX), "topk-index")


def _query_words(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, term, word, qtf) of the queries' whole texts."""
    rows = queries.select(F.col(id_col).cast("long").alias("query"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in tx.pieces(batch):
                row, term, tf, at, _ = _counts(piece, data, offsets)
                start, end, _ = tx.words(data, offsets)
                flat = data.tobytes().lower()
                yield pa.RecordBatch.from_arrays(
                    [piece.column("query").take(pa.array(row)), pa.array(term), pa.array([flat[i:j].decode() for i, j in zip(start[at].tolist(), end[at].tolist())], pa.string()), pa.array(tf.astype(np.int64))],
                    ["query", "term", "word", "qtf"],
                )

    return rows.mapInArrow(scan, "query long, term long, word string, qtf long")


def _tf_part(tf, size, average: float):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))


class Shard:
    """A shard's lists for the terms asked for, with the bound of each block of texts for each common term.

    Common terms also stand in a matrix of single precision, from which texts of blocks that the
    bounds do not rule out get bounds of their own, many queries at a time.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, lengths: np.ndarray, posts: np.ndarray, average: float, common: np.ndarray) -> None:
        self.ids, self.terms = ids, terms
        self.n_blocks = max(1, -(-len(ids) // BLOCK))
        self.places = posts["place"].astype(np.int64)
        self.parts = _tf_part(posts["tf"].astype(np.float64), sizes[self.places], average)
        self.first = np.concatenate(([0], np.cumsum(lengths)))
        #: Row of the bounds for each list, -1 for rare terms.
        self.bounded = np.full(len(terms), -1)
        some = np.flatnonzero(np.isin(terms, common))
        self.bounded[some] = np.arange(len(some))
        at = _ranges(self.first[some], lengths[some])
        row, place = np.repeat(np.arange(len(some)), lengths[some]), self.places[at]
        bounds = np.zeros(len(some) * self.n_blocks)
        cell = row * self.n_blocks + place // BLOCK
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        if len(starts):
            bounds[cell[starts]] = np.maximum.reduceat(self.parts[at], starts)
        self.bounds = bounds.reshape(len(some), self.n_blocks)
        self.dense = np.zeros((len(some), len(ids)), np.float32)
        self.dense[row, place] = self.parts[at]
        #: What a sum of products in single precision may fall short of the exact one: every factor is positive.
        self.single = 1 + (len(some) + 8) * 2.0**-22
        #: The common terms of each text, one text after the other.
        by_text = np.argsort(place.astype(np.uint16) if len(ids) <= 1 << 16 else place, kind="stable")
        self.text_first = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(ids)))))
        self.text_rows, self.text_parts = row[by_text], self.parts[at][by_text]

    def rows_of(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of the terms' lists; -1 for terms that the shard lacks."""
        if len(self.terms) == 0:
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def rare_scores(self, rows: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What the lists of some terms add to the score of (query, text); ``first`` tells each query's terms."""
        n = self.first[rows + 1] - self.first[rows]
        end = np.concatenate(([0], np.cumsum(n)))
        postings = np.diff(end[first])
        number = np.arange(postings.max(initial=0))
        # Where a list begins, less the number of the query's postings before it.
        shift = self.first[rows] - end[:-1] + np.repeat(end[first[:-1]], np.diff(first))
        out = np.empty((len(postings), len(self.ids)))
        for q, (i, j, size) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), postings.tolist())):
            at = shift[i:j].repeat(n[i:j])
            at += number[:size]
            part = self.parts.take(at)
            part *= weights[i:j].repeat(n[i:j])
            out[q] = np.bincount(self.places.take(at), part, len(self.ids))
        return out

    def common_scores(self, rows: np.ndarray, weights: np.ndarray, places: np.ndarray) -> np.ndarray:
        """What common terms (rows of the bounds) add to the scores of some texts."""
        weight = np.zeros(len(self.bounds))
        weight[rows] = weights
        n = self.text_first[places + 1] - self.text_first[places]
        at = _ranges(self.text_first[places], n)
        return np.bincount(np.repeat(np.arange(len(places)), n), weight[self.text_rows[at]] * self.text_parts[at], len(places))

    def text_bounds(self, base: np.ndarray, weights: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """What each text can score at most for each query, -inf if the bound of its blocks rules it out.

        ``base`` has what rare terms add to (query, text), ``weights`` the query's weights of the common
        terms (rows of the bounds).
        """
        ceiling = weights @ self.bounds
        best = np.maximum.reduceat(base, np.arange(self.n_blocks) * BLOCK, axis=1) + ceiling
        able = (best + _SLACK > floors[:, None]) & (best > 0)
        single, bound = (weights * self.single).astype(np.float32), np.full(base.shape, -math.inf)
        step = max(1, GROUP // BLOCK)
        for b in range(0, self.n_blocks, step):
            some = np.flatnonzero(able[:, b : b + step].any(axis=1))
            if len(some):
                some = slice(None) if len(some) == len(base) else some
                texts = slice(b * BLOCK, (b + step) * BLOCK)
                bound[some, texts] = base[some, texts] + single[some] @ self.dense[:, texts]
        return bound


def _cut(ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, lengths: np.ndarray, posts: np.ndarray, common: np.ndarray) -> Iterator[tuple]:
    """A shard's texts in parts, one after the other, so that no matrix of its common terms exceeds DENSE_CELLS."""
    n = max(1, DENSE_CELLS // max(1, np.isin(terms, common).sum() * BLOCK)) * BLOCK
    if len(ids) <= n:
        yield ids, sizes, terms, lengths, posts
        return
    row = np.repeat(np.arange(len(terms)), lengths)
    for i in range(0, len(ids), n):
        own = (posts["place"] >= i) & (posts["place"] < i + n)
        held, some = np.bincount(row[own], minlength=len(terms)), posts[own]
        some["place"] -= i
        yield ids[i : i + n], sizes[i : i + n], terms[held > 0], held[held > 0], some


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one range after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def block_max_wand(shard: Shard, rows: np.ndarray, weights: np.ndarray, k: int, floor: tuple[float, int] = _NO_FLOOR) -> list[tuple[float, int]]:
    """The k best (score, id) of a shard, higher scores and then smaller ids first.

    ``floor`` is the k-th best answer of other shards; what comes after it is left out. Rare terms are
    scored for all texts. What a text can score at most is that and what the common terms' bounds
    of its block add up to. Blocks in which no text can reach the k-th best score are skipped; texts
    of the others get closer bounds, and are skipped by these; those with the highest bounds are scored first, to raise the k-th best.
    """
    return next(_block_max_wand(shard, rows, weights, np.array([0, len(rows)]), k, [floor]))


def _block_max_wand(shard: Shard, rows: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int, floors: list[tuple[float, int]]) -> Iterator[list[tuple[float, int]]]:
    """The k best of a shard for each of some queries, whose terms stand one after the other; -1 for terms that the shard lacks."""
    query = np.repeat(np.arange(len(floors)), np.diff(first))
    bounded = np.where(rows >= 0, shard.bounded[rows], -2)
    rare, known = np.flatnonzero(bounded == -1), np.flatnonzero(bounded >= 0)
    base = shard.rare_scores(rows[rare], weights[rare], np.searchsorted(query[rare], np.arange(len(floors) + 1)))
    common = np.zeros((len(floors), len(shard.bounds)))
    common[query[known], bounded[known]] = weights[known]
    least = np.array([f[0] for f in floors])
    bound = shard.text_bounds(base, common, least)
    who, place = np.nonzero(bound > np.maximum(least - _SLACK, 0)[:, None])
    cuts = np.searchsorted(who, np.arange(len(floors) + 1)).tolist()
    for q, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
        if i == j:
            yield []
            continue
        places, used = place[i:j], np.flatnonzero(common[q])
        yield _best_texts(shard, places, base[q, places], bound[q, places], used, common[q, used], k, floors[q])


def _best_texts(shard: Shard, places: np.ndarray, base: np.ndarray, bound: np.ndarray, common: np.ndarray, own: np.ndarray, k: int, floor: tuple[float, int]) -> list[tuple[float, int]]:
    """The k best of some texts for one query, given what rare terms add to each and what it can score at most."""
    ids, scores = np.zeros(0, np.int64), np.zeros(0)
    for last in (False, True):
        able = bound + _SLACK > (scores[-1] if len(ids) == k else floor[0])
        places, base, bound = places[able], base[able], bound[able]
        if len(places) == 0:
            break
        taken = np.arange(len(places))
        if not last and len(places) > FIRST_TEXTS:
            taken = np.argpartition(-bound, FIRST_TEXTS)[:FIRST_TEXTS]
        total = base[taken] + shard.common_scores(common, own, places[taken])
        more, who = np.round(total, DIGITS), shard.ids[places[taken]]
        good = (who != _NO_ID) & (total > 0) & ((more > floor[0]) | ((more == floor[0]) & (who <= floor[1])))
        ids, scores = np.concatenate((ids, who[good])), np.concatenate((scores, more[good]))
        if len(scores) > k:
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            ids, scores = ids[some], scores[some]
        order = np.lexsort((ids, -scores))[:k]
        ids, scores = ids[order], scores[order]
        rest = np.ones(len(places), bool)
        rest[taken] = False
        places, base, bound = places[rest], base[rest], bound[rest]
    return list(zip(scores.tolist(), ids.tolist()))


@dataclass
class Queries:
    """A block of distinct queries: their names, and the places of their terms in a sorted table of terms, one after the other.

    The table has a weight for each term; ``common`` are all common terms.
    """

    names: np.ndarray
    first: np.ndarray
    numbers: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    common: np.ndarray

    @classmethod
    def of(cls, names: np.ndarray, first: np.ndarray, terms: np.ndarray, weights: np.ndarray, common: np.ndarray) -> Queries:
        """From the queries' terms and weights, one after the other; a term has one weight wherever it stands."""
        table, at, numbers = np.unique(terms, return_index=True, return_inverse=True)
        return cls(names, first, numbers.astype(np.int32), table, weights[at], common)

    @classmethod
    def read(cls, rows: DataFrame) -> Queries:
        """Of (same, terms): one Arrow table of numbers on the driver."""
        table = rows.select("same", F.col("terms.term").alias("term"), F.col("terms.idf").alias("idf"), F.col("terms.common").alias("common")).toArrow()
        if table.num_rows == 0:
            none = np.zeros(0, np.int64)
            return cls.of(none, np.zeros(1, np.int64), none, np.zeros(0), none)
        term, idf, common = (table.column(c).combine_chunks() for c in ("term", "idf", "common"))
        first = np.concatenate(([0], np.cumsum(np.array(term.value_lengths(), np.int64))))
        terms, weights = (c.flatten().to_numpy(zero_copy_only=False) for c in (term, idf))
        return cls.of(table.column("same").to_numpy(), first, terms, weights, np.unique(terms[common.flatten().to_numpy(zero_copy_only=False)]))


def search_shard(shard: Shard, asked: Queries, k: int, floors: list[tuple[float, int]]) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """(number of the query, its answers) of all queries that the shard has answers to."""
    if len(shard.ids) == 0 or len(shard.terms) == 0:
        return
    row = shard.rows_of(asked.terms)
    step = max(1, min(BATCH, BATCH_CELLS // len(shard.ids)))
    for q in range(0, len(asked.names), step):
        first = asked.first[q : q + step + 1]
        own = asked.numbers[first[0] : first[-1]]
        for n, found in enumerate(_block_max_wand(shard, row[own], asked.weights[own], first - first[0], k, floors[q : q + step]), q):
            if found:
                yield n, found


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS, min_df: int = 2) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best rows of the index for each query text, exactly.

    A query is all terms of its whole text that at least ``min_df`` indexed texts have; with 1 it is every
    term that the index holds. Document counts
    and lengths are summed over all shards before any is searched, so scores do not depend on the
    sharding and the shards' answers merge exactly. Queries with equal terms are searched once. About
    ``block_terms`` terms of queries at a time are broadcast; a shard gets the lists of these terms, each once, and only the
    blocks of texts that the bounds do not rule out are scored. Shards are searched in waves, and a
    shard answers only what beats the k-th best of the waves before, so a query's answers grow with
    the logarithm of the number of shards.

    Queries without such a term have no answer; NULL query ids are left out; repeated query ids
    must hold one text; ties of score go to the smaller doc_id; rows that repeat a doc_id are
    scored each by itself and answered each with a rank of its own.
    """
    with shuffles_dropped(index.sparkSession):
        terms, best = _search(index, queries, k, id_col, text_col, block_terms, min_df)
    return terms.select(F.col("query").alias("query_id"), "same").join(best, F.col("same") == F.col("query")).select("query_id", "rank", "doc_id", "score")


def _search(index: DataFrame, queries: DataFrame, k: int, id_col: str, text_col: str, block_terms: int, min_df: int) -> tuple[DataFrame, DataFrame]:
    """Each query's terms and the name of its distinct query, and the answers of these, as written tables."""
    sizes = index.filter("term IS NULL").agg(F.sum("n_docs"), F.sum("n_words"), F.count("*")).first()
    n_docs, n_words = sizes[0] or 0, sizes[1] or 0
    average = n_words / n_docs if n_words else 1.0
    asked = stage(_query_words(queries.filter(F.col(id_col).isNotNull()), id_col, text_col).dropDuplicates(["query", "term"]), "topk-query-words")
    lists = index.filter("term IS NOT NULL")
    asked_terms = asked.select("term").distinct()
    df = lists.select("term", "n").join(asked_terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")).filter(F.col("df") >= min_df)
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    chosen = asked.join(df.select("term", idf.alias("idf"), (F.col("df") >= COMMON * n_docs).alias("common")), "term")
    terms = stage(chosen.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("common", "word", "term", "idf"))).alias("terms")).withColumn("same", F.xxhash64("terms.word")), "topk-terms")
    distinct = stage(terms.groupBy("same").agg(F.first("terms").alias("terms")), "topk-distinct")
    n_blocks = max(1, math.ceil((distinct.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    best = None
    for b in range(n_blocks):
        own = distinct.filter(F.pmod("same", F.lit(n_blocks)) == b)
        part = _search_block(index, own, k, average, sizes[2])
        best = part if best is None else best.unionByName(part)
    return terms, best


def _waves(n_shards: int) -> list[tuple[int, int, int]]:
    """Ranges of shard names and about how many shards each has: WAVE, and then each time as many that the total grows WAVE times."""
    cuts, counts, searched = [0], [min(WAVE, n_shards)], WAVE
    while searched < n_shards:
        cuts.append(2**_NAME_BITS * searched // n_shards)
        counts.append(min(searched * WAVE, n_shards) - searched)
        searched *= WAVE
    return list(zip(cuts, [*cuts[1:], 2**_NAME_BITS], counts))


def _search_block(index: DataFrame, queries: DataFrame, k: int, average: float, n_shards: int) -> DataFrame:
    """RESULT with ranks for a bounded block of distinct queries (same, terms), as a written table."""
    context = index.sparkSession.sparkContext
    asked = Queries.read(queries)
    shared = context.broadcast(asked)
    wanted = queries.select(F.explode("terms.term").alias("term")).distinct()
    merged = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
    best = None
    for low, high, n in _waves(n_shards):
        floors = {} if best is None else {r["query"]: (r["score"], r["doc_id"]) for r in best.filter(F.col("rank") == k).collect()}
        limits = context.broadcast([floors.get(name, _NO_FLOOR) for name in asked.names.tolist()])
        wave = index.filter((F.col("shard") >= low) & (F.col("shard") < high)).select("shard", "term", "postings", "sizes")
        own = wave.join(F.broadcast(wanted), "term", "left_semi").unionByName(wave.filter("term IS NULL"))
        found = _search_wave(own, shared, limits, k, average, n)
        both = found if best is None else best.drop("rank").unionByName(found)
        best = stage(both.withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= k), "topk-best")
        limits.destroy()
    shared.destroy()
    return best


def _search_wave(lists: DataFrame, shared: Broadcast, limits: Broadcast, k: int, average: float, n_shards: int) -> DataFrame:
    """RESULT of each shard of ``lists``: what is not beaten by k answers of the limits or of the task's shards."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, table, held, floors = None, None, [], list(limits.value)

        def finish() -> pa.RecordBatch:
            terms = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.int64)
            posts = np.concatenate([h[1] for h in held]) if held else np.zeros(0, _POSTING)
            lengths = np.concatenate([h[2] for h in held]) if held else np.zeros(0, np.int64)
            common, out = shared.value.common, []
            for part in _cut(*table, terms, lengths, posts, common):
                for q, found in search_shard(Shard(*part, average, common), shared.value, k, floors):
                    out += [(shared.value.names[q], d, s) for s, d in found]
                    if len(found) == k:
                        floors[q] = found[-1]
            return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query", "doc_id", "score"])

        for batch in batches:
            names = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))).tolist() if len(names) else []
            for i, j in zip(cuts, [*cuts[1:], len(names)]):
                part = batch.slice(i, j - i)
                if name is not None and names[i] != name:
                    yield finish()
                    table, held = None, []
                name = names[i]
                if table is None:
                    # A shard's ids and sizes have no term and so come before its lists.
                    table = np.frombuffer(part.column("postings")[0].as_py(), "<i8"), np.frombuffer(part.column("sizes")[0].as_py(), "<i4")
                    part = part.slice(1)
                if part.num_rows:
                    lists_of = part.column("postings")
                    lengths = pc.binary_length(lists_of).to_numpy().astype(np.int64) // _POSTING.itemsize
                    held.append((part.column("term").to_numpy(), np.frombuffer(_bytes(lists_of), _POSTING), lengths))
        if name is not None:
            yield finish()

    columns = lists.select("shard", "term", "postings", "sizes")
    # Names are random: with several partitions for each shard few tasks get two of them.
    return columns.repartition(max(1, 4 * n_shards), "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first()).mapInArrow(rank, RESULT)
