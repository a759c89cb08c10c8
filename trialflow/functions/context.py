"""Time and ratio expressions that put an order into context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hour ranges (both ends included) and their labels.
DAY_PERIODS = ((6, 11, "morning"), (12, 17, "afternoon"), (18, 23, "evening"))
NIGHT = "night"


def day_period(
    ts: Column,
    periods: Sequence[tuple[int, int, str]] = DAY_PERIODS,
    default: str = NIGHT,
    tz: Column | str | None = None,
    legacy_null_bucket: bool = False,
) -> Column:
    """Label of the hour of ``ts``, read in zone ``tz`` if given.

    A NULL time has no period; ``legacy_null_bucket`` files it under ``default`` instead.
    """
    hour = F.hour(ts if tz is None else F.from_utc_timestamp(ts, tz))
    (first, last, name), *others = periods
    label = F.when(hour.between(first, last), name)
    for first, last, name in others:
        label = label.when(hour.between(first, last), name)
    label = label.otherwise(default)
    return label if legacy_null_bucket else F.when(ts.isNotNull(), label)


def days_between(start: Column, end: Column) -> Column:
    """Calendar-day boundaries crossed from ``start`` to ``end`` (not 24-hour spans)."""
    return F.date_diff(end, start)


def ticket_ratio(amount: Column, usual: Column) -> Column:
    """Amount relative to the usual ticket; NULL unless that one is positive."""
    return F.when(usual > 0, amount / usual)
