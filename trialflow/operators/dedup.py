"""Duplicate keys: find them, sample them, keep the newest row of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialflow.operators.skew import if_small


def find_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def duplicate_sample(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    n: int = 10,
    tiebreak: Sequence[str] | None = None,
) -> DataFrame:
    """The first ``n`` rows of duplicated keys: keys ascending, newest first within a key.

    Each duplicated key brings at least two of the rows, so the n smallest such keys hold the
    whole answer. Only they are joined back, and broadcast if n is small.
    """
    first_keys = find_duplicates(df, keys).select(*keys).orderBy(*keys).limit(n)
    same_key = F.lit(True)
    for key in keys:
        same_key = same_key & df[key].eqNullSafe(first_keys[key])
    order = [*keys, F.col(ts).desc(), *_tiebreak(df, [*keys, ts], tiebreak)]
    return df.join(if_small(first_keys, n), same_key, "left_semi").orderBy(*order).limit(n)


def dedup_latest(
    df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str] | None = None
) -> DataFrame:
    """Keep the newest row per key.

    Rows of the same key and time are ordered by ``tiebreak`` (all remaining columns by
    default), so the survivor does not depend on how the input was partitioned. Keeping rank 1
    only lets Spark discard the losers before the shuffle: each map task sends at most one row
    per key, which also bounds what a heavily repeated key can bring to one reducer.
    Project away wide columns first; what is left is what gets shuffled.
    """
    order = [F.col(ts).desc(), *_tiebreak(df, [*keys, ts], tiebreak)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _tiebreak(df: DataFrame, used: Sequence[str], tiebreak: Sequence[str] | None) -> list[str]:
    if tiebreak is not None:
        return list(tiebreak)
    orderable = (f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant"))
    return [name for name in orderable if name not in used]
