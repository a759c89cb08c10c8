"""Setting hot keys apart, so that no key's rows have to fit one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialflow.session import stage

# A key with more rows than this is hot. Its rows would make a window task too large.
HOT_ROWS = 2_000_000
# At most this many rows are broadcast; with more, Spark picks the join from their size.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class HotKeys:
    """Key values above the limit, stored, and how many rows they hold together."""

    keys: tuple[str, ...]
    values: DataFrame
    n_keys: int
    n_rows: int
    chunk_rows: int

    @property
    def n_chunks(self) -> int:
        return max(2, -(-self.n_rows // self.chunk_rows))


def if_small(df: DataFrame, n_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if the known number of its rows allows it."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str = "") -> Column:
    """Null-safe equality on every key (``prefix`` being what the right-hand names start with)."""
    return reduce(
        Column.__and__, [left[key].eqNullSafe(right[prefix + key]) for key in keys]
    )


def find_hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    hot_rows: int = HOT_ROWS,
    chunk_rows: int | None = None,
) -> HotKeys:
    """Count rows per key (combined before the shuffle) and store the keys above ``hot_rows``.

    There can be no more than ``rows / hot_rows`` of them. Their rows will be cut into chunks of
    about ``chunk_rows``, by default as many as an ordinary key may have.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    hot = stage(counts.where(F.col("n_rows") > hot_rows), "hot-keys")
    size = hot.agg(
        F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")
    ).first()
    return HotKeys(tuple(keys), hot.select(*keys), size["n_keys"], size["n_rows"], chunk_rows or hot_rows)


def split_by_heat(df: DataFrame, hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys). NULL counts as a key like any other."""
    marked = hot.values.select(
        *[F.col(key).alias(f"_hot_{key}") for key in hot.keys], F.lit(True).alias("_is_hot")
    )
    tagged = df.join(
        if_small(marked, hot.n_keys), same_key(df, marked, hot.keys, "_hot_"), "left"
    ).drop(*[f"_hot_{key}" for key in hot.keys])
    return (
        tagged.where(F.col("_is_hot").isNull()).drop("_is_hot"),
        tagged.where("_is_hot").drop("_is_hot"),
    )


def only_hot(dim: DataFrame, dim_key: str, hot: HotKeys) -> tuple[DataFrame, bool]:
    """The rows of a dimension that match a hot key, stored, and whether they are few."""
    (key,) = hot.keys
    values = hot.values.select(F.col(key).alias("_hot_key"))
    kept = stage(
        dim.join(
            if_small(values, hot.n_keys), dim[dim_key] == values["_hot_key"], "left_semi"
        ),
        "hot-dim",
    )
    return kept, kept.count() <= BROADCAST_ROWS


def in_ordered_chunks(df: DataFrame, order: Sequence[str], hot: HotKeys) -> DataFrame:
    """Number the rows' chunks along ``order``: chunk 0 precedes chunk 1, and so on.

    The range exchange samples the full order, so even a single key is cut. A range has the rows of
    many small chunks, or a task's worth of rows; it is sorted and cut into chunks of up to
    ``hot.chunk_rows``. So tasks, files and exchange blocks do not multiply with the chunks. The result
    is stored: a chunk number is a fact only once the exchange that gave it will never run again.
    """
    n = _n_ranges(df, hot)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # A chunk's number: its range's in the upper bits, its place in the range in those left of 31.
    room = 1 << (31 - n.bit_length())
    chunk = F.expr(
        f"int(spark_partition_id() * {room} + "
        f"least((monotonically_increasing_id() & {(1 << 33) - 1}) div {hot.chunk_rows}, {room - 1}))"
    )
    return stage(ranged.withColumn("_chunk", chunk), "chunks")


def _n_ranges(df: DataFrame, hot: HotKeys) -> int:
    """As many as an ordinary exchange has, more if a range would exceed HOT_ROWS, at most one a chunk."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(hot.n_chunks, max(usual, -(-hot.n_rows // HOT_ROWS)))
