"""Importance resampling towards a target: hashed n-gram gains, and a cutoff found by bracketing.

A document's weight is the mean gain of its words and word pairs, a gain being the log ratio of a
hash bucket's share in the target and in the documents. Weights get Gumbel noise, so that the
highest scores are a sample without replacement in proportion to exp(weight). Of all scores only a
sketch is taken; it brackets the cutoff, exact counts outside the bracket confirm or widen it, and
only rows within are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialflow.llm import crc
from trialflow.llm import text as tx
from trialflow.session import stage

#: Hash buckets of words and word pairs.
BUCKETS = 10_000
#: Percent of the documents of MIN_WORDS words that are drawn.
PERCENT, MIN_WORDS = 25, 20
SEED = 7
#: Of the sketch of scores: a quantile's rank is off by one in so many rows at most.
ACCURACY = 10_000
#: Rows that one task sorts, about.
SORTED_ROWS = 200_000
#: Word bytes lower-cased (digits, letters, all of UTF-8 beyond ASCII), spaces for others.
_FLAT = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FLAT[_low:_high] = np.arange(_low, _high)
_FLAT[0x41:0x5B] = np.arange(0x61, 0x7B)
_NTH_BITS = 33


def piece_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of all words, then of all pairs of consecutive words, as two such pairs of arrays."""
    flat = _FLAT[data]
    start, end, first = tx.words(flat, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    one = crc.crc_of(flat, start, end)
    same = np.flatnonzero(row[1:] == row[:-1])
    two = crc.joined(crc.followed_by(one[same], 32), one[same + 1], (end - start)[same + 1])
    return row, one % np.uint32(buckets), row[same], two % np.uint32(buckets)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many words and word pairs of all texts fall in each bucket; the driver gets ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in tx.pieces(batch):
                _, one, _, two = piece_buckets(data, offsets, buckets)
                total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the log ratio of its smoothed shares in target and own texts, rounded down."""
    ratio = (target + 1.0) * (own.sum() + float(len(own))) / ((own + 1.0) * (target.sum() + float(len(own))))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: str, seed: int = SEED) -> Column:
    """1000 times a Gumbel number, rounded down, fixed by seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, row) of each document, as a written table; row tells repeated rows apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in tx.pieces(batch):
                row, one, row2, two = piece_buckets(data, offsets, len(gain))
                n = np.bincount(row, minlength=piece.num_rows)
                n_features = n + np.bincount(row2, minlength=piece.num_rows)
                # Sums of whole numbers, exact as doubles up to 2 ** 53.
                total = np.bincount(row, gain[one], piece.num_rows) + np.bincount(row2, gain[two], piece.num_rows)
                weight = total.astype(np.int64) // np.maximum(n_features, 1)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    weighed = rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    return stage(weighed.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("row", F.monotonically_increasing_id()), "resample-scores")


ORDER = [F.desc, F.asc, F.asc]
KEYS = ["score", "doc_id", "row"]


def numbered(rows: DataFrame, n_rows: int, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of KEYS, scores falling.

    Ranges of the order are sorted each in its task; a range's first rank is one more than the rows
    in all ranges before it, which is a sum over as many rows as there are ranges.
    """
    order = [f(k) for f, k in zip(ORDER, KEYS)]
    n_ranges = max(1, math.ceil(n_rows / sorted_rows))
    placed = stage(rows.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "resample-sorted")
    part = F.shiftright("__at", _NTH_BITS).alias("__part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    nth = F.col("__at").bitwiseAND(F.lit((1 << _NTH_BITS) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(firsts), "__part").withColumn("rank", F.col("__before") + nth + 1).select(*rows.columns, "rank")


def cutoff(candidates: DataFrame, n: int, k: int, accuracy: int = ACCURACY, sorted_rows: int = SORTED_ROWS) -> Column:
    """Which of the ``n`` candidates (KEYS) are the ``k`` first in the order of KEYS.

    The sketch gives scores on either side of the k-th. Counts of the rows above and within show
    whether the k-th row is between; if not, the bracket is widened, to all rows in the end. Only
    the rows within are sorted.
    """
    if k <= 0:
        return F.lit(False)
    if k >= n:
        return F.lit(True)
    slack = 2 / accuracy
    while True:
        ends = [max(0.0, 1 - k / n - slack), min(1.0, 1 - k / n + slack)]
        low, high = candidates.agg(F.percentile_approx("score", ends, accuracy)).first()[0]
        low, high = (low if ends[0] > 0 else None), (high if ends[1] < 1 else None)
        beyond = F.col("score") > high if high is not None else F.lit(False)
        within = ~beyond & ((F.col("score") >= low) if low is not None else F.lit(True))
        above, inside = candidates.agg(F.count_if(beyond), F.count_if(within)).first()
        if above <= k <= above + inside:
            break
        slack *= 8
    if above == k:
        return beyond
    edge = numbered(candidates.filter(within).select(*KEYS), inside, sorted_rows).filter(F.col("rank") == k - above).first()
    score, doc_id, row = (F.lit(edge[c]) for c in KEYS)
    tied = (F.col("doc_id") < doc_id) | ((F.col("doc_id") == doc_id) & (F.col("row") <= row))
    return (F.col("score") > score) | ((F.col("score") == score) & tied)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    accuracy: int = ACCURACY,
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (1 for the highest score; NULL if not drawn).

    Of the documents with ``min_words`` words, ``percent`` percent, rounded down, are drawn: the
    highest scores, and of equal scores the smaller ids. Words are runs of ASCII letters and digits
    and of all characters beyond ASCII, A-Z lower-cased; features are words and pairs of
    consecutive words, repeats counted, over whole texts.

    NULL, empty and wordless texts have no features, weight 0 and are never drawn; a row without id
    has no score and is never drawn, but counts in the buckets; rows that repeat an id are documents
    of their own; empty tables give no gains, an empty ``docs`` an empty result; columns other than
    the named are not read, so their names cannot clash.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = scored(docs, gain, id_col, text_col, seed)
    able = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    candidates = rows.filter(able)
    n = candidates.count()
    k = percent * n // 100
    drawn = able & cutoff(candidates, n, k, accuracy, sorted_rows)
    shown = ["doc_id", "n_features", "weight", "score"]
    ranked = numbered(rows.filter(drawn), k, sorted_rows).select(*shown, "rank")
    return ranked.unionByName(rows.filter(~drawn).select(*shown, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id ``resample`` draws, all columns kept."""
    ids = resample(docs, target, id_col, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, F.col(id_col) == F.col("__drawn"), "left_semi")
