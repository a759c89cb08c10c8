"""What came before an order: previous time, mean spend so far, nth visit to the restaurant.

Each feature is an ordered window per key. A key whose rows would not fit one task is cut into
ordered chunks instead. Every chunk but a key's first starts with an opening row that holds what
the earlier chunks add up to, so a window inside (key, chunk) sees all that came before. Both
ways add up the same parts of amounts, whose sums do not depend on the order, and so give the same
values to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialflow.functions.context import days_between
from trialflow.functions.stats import exact_parts, mean_of_parts
from trialflow.operators import skew
from trialflow.operators.skew import HOT_ROWS

_START, _PREVIOUS, _CURRENT = Window.unboundedPreceding, -1, Window.currentRow
# Order of the rows of a chunk: openings of visit groups, the opening of the key, orders.
_VISIT_OPENING, _KEY_OPENING, _ORDER = 0, 1, 2


def customer_history(
    df: DataFrame,
    key: str,
    ts: str,
    amount: str,
    tiebreak: Sequence[str],
    hot_rows: int = HOT_ROWS,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add the previous order's time, calendar days since it, and the mean of prior amounts.

    The current order is not part of its own mean, so a first order has NULL for all three.
    ``df`` should be a stored table: hot keys are looked up in it first.
    """
    hot = skew.find_hot_keys(df, [key], hot_rows, chunk_rows)
    if not hot.n_keys:
        return plain_history(df, key, ts, amount, tiebreak)
    ordinary, rest = skew.split_by_heat(df, hot)
    chunked = skew.in_ordered_chunks(rest, [key, ts, *tiebreak], hot)
    return plain_history(ordinary, key, ts, amount, tiebreak).unionByName(
        chunked_features(chunked, ts, tiebreak, key=key, amount=amount)
    )


def visit_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tiebreak: Sequence[str],
    out: str = "restaurant_visit_no",
    hot_rows: int = HOT_ROWS,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add the position of each row among the rows of its ``keys``, oldest first.

    NULL keys form one group. ``df`` should be a stored table, as above.
    """
    hot = skew.find_hot_keys(df, keys, hot_rows, chunk_rows)
    if not hot.n_keys:
        return plain_ordinal(df, keys, ts, tiebreak, out)
    ordinary, rest = skew.split_by_heat(df, hot)
    chunked = skew.in_ordered_chunks(rest, [*keys, ts, *tiebreak], hot)
    return plain_ordinal(ordinary, keys, ts, tiebreak, out).unionByName(
        chunked_features(chunked, ts, tiebreak, visit_keys=keys, visit_no=out)
    )


def plain_history(
    df: DataFrame, key: str, ts: str, amount: str, tiebreak: Sequence[str]
) -> DataFrame:
    by_time = Window.partitionBy(key).orderBy(ts, *tiebreak)
    before = by_time.rowsBetween(_START, _PREVIOUS)
    parts = exact_parts(F.col(amount))
    sums = [F.sum(part).over(before) for part in parts.values()]
    return df.withColumns(
        {
            "previous_order_at": F.lag(ts, 1).over(by_time),
            "prior_mean_spend": mean_of_parts(*sums),
        }
    ).withColumn(
        "days_since_last_order", days_between(F.col("previous_order_at"), F.col(ts))
    )


def plain_ordinal(
    df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str], out: str
) -> DataFrame:
    by_time = Window.partitionBy(*keys).orderBy(ts, *tiebreak)
    return df.withColumn(out, F.row_number().over(by_time))


def chunked_features(
    df: DataFrame,
    ts: str,
    tiebreak: Sequence[str],
    key: str | None = None,
    amount: str | None = None,
    visit_keys: Sequence[str] = (),
    visit_no: str = "restaurant_visit_no",
) -> DataFrame:
    """History by ``key`` and ordinals by ``visit_keys`` of a stored table cut by ``_chunk``.

    If ``key`` leads ``visit_keys``, all windows run on the one exchange by (key, chunk).
    """
    parts = exact_parts(F.col(amount) if amount else F.lit(None).cast("double"))
    rows = df.withColumns(
        {
            "_kind": F.lit(_ORDER),
            "_ts": F.col(ts),
            **{f"_{name}": part for name, part in parts.items()},
            "_visits": F.lit(1).cast("bigint"),
        }
    )
    if key:
        rows = rows.unionByName(_key_openings(df, key, ts, amount), allowMissingColumns=True)
    if visit_keys:
        rows = rows.unionByName(_visit_openings(df, visit_keys), allowMissingColumns=True)
    order = ["_kind", "_ts", *tiebreak]
    added: dict[str, Column] = {}
    if key:
        by_time = Window.partitionBy(key, "_chunk").orderBy(*order)
        before = by_time.rowsBetween(_START, _PREVIOUS)
        rows = rows.withColumns(
            {
                "_previous": F.lag("_ts", 1).over(by_time),
                **{f"_{name}_before": F.sum(f"_{name}").over(before) for name in parts},
            }
        )
        previous = F.col("_previous")
        added["previous_order_at"] = previous
        added["prior_mean_spend"] = mean_of_parts(*[F.col(f"_{name}_before") for name in parts])
        added["days_since_last_order"] = days_between(previous, F.col(ts))
    if visit_keys:
        by_visit = Window.partitionBy(*visit_keys, "_chunk").orderBy(*order)
        so_far = F.sum("_visits").over(by_visit.rowsBetween(_START, _CURRENT))
        rows = rows.withColumn("_so_far", so_far)
        added[visit_no] = F.col("_so_far").cast("int")
    kept = [name for name in df.columns if name != "_chunk"]
    return rows.where(F.col("_kind") == _ORDER).select(
        *kept, *[column.alias(name) for name, column in added.items()]
    )


def _key_openings(df: DataFrame, key: str, ts: str, amount: str) -> DataFrame:
    """Per (key, chunk): last time and the sums of the amounts' parts of all earlier chunks.

    Parts and times are combined per chunk first, so a key has one row per chunk here.
    """
    by_chunk = Window.partitionBy(key).orderBy("_chunk")
    earlier = by_chunk.rowsBetween(_START, _PREVIOUS)
    parts = exact_parts(F.col(amount))
    return (
        df.groupBy(key, "_chunk")
        .agg(F.max(ts).alias("_last"), *[F.sum(part).alias(f"_sum_{name}") for name, part in parts.items()])
        .select(
            key,
            "_chunk",
            F.lag("_last", 1).over(by_chunk).alias("_ts"),
            *[F.sum(f"_sum_{name}").over(earlier).alias(f"_{name}") for name in parts],
        )
        .where(F.col("_amounts").isNotNull())
        .withColumns({"_kind": F.lit(_KEY_OPENING), "_visits": F.lit(0).cast("bigint")})
    )


def _visit_openings(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (keys, chunk): number of visits in all earlier chunks, if any."""
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(_START, _PREVIOUS)
    return (
        df.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_chunk", F.sum("_n").over(earlier).alias("_visits"))
        .where(F.col("_visits").isNotNull())
        .withColumns({"_kind": F.lit(_VISIT_OPENING), "_amounts": F.lit(0).cast("bigint")})
    )
