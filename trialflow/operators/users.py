"""Per-user KPIs, retention flags, lifecycle segments and the spine that holds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two arms under comparison.
ARMS = ("target", "control")

# Calendar days within which a second order counts as retention.
WINDOWS = (7, 14)

KPI_COLUMNS = [
    "revenue",
    "order_count",
    "avg_ticket",
    "avg_items",
    "avg_days_to_reorder",
    "new_restaurant_orders",
    "new_restaurant_rate_pct",
]


def experiment_users(assignment: DataFrame, arms: Sequence[str] = ARMS) -> DataFrame:
    """Distinct (customer_id, arm) of the arms under comparison.

    Arms are gathered per customer, at most as many as ``arms`` has, so the rows come out
    partitioned by customer and a join on it needs no second exchange.
    """
    return (
        assignment.where(F.col("is_target").isin(*arms))
        .groupBy("customer_id")
        .agg(F.collect_set("is_target").alias("_arms"))
        .select("customer_id", F.explode("_arms").alias("arm"))
    )


def user_kpis(abt: DataFrame) -> DataFrame:
    """One row per customer with orders; every measure is combined before the shuffle."""
    return _with_rate(abt.groupBy("customer_id").agg(*_kpis()))


def retention_flags(abt: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """First and second order per customer, and whether they lie within N calendar days.

    The first order is the earliest, the second the earliest that has an order before it, which
    the base table's ``days_since_last_order`` tells; both are minima, combined before the
    shuffle. Orders without a time come first, so a customer who has one is never retained.
    """
    return abt.groupBy("customer_id").agg(*_first_two()).select(
        "customer_id", _first().alias("first_order_at"), _second().alias("second_order_at"),
        *_retained(windows),
    )


def lifecycle_segment(
    abt: DataFrame,
    reference_date: str,
    new_days: int = 7,
    active_days: int = 30,
    active_min: int = 2,
    risk: tuple[int, int] = (31, 90),
    bounded: bool = False,
) -> DataFrame:
    """(customer_id, lifecycle_segment); the first matching segment wins.

    Recent activity is bounded on one side only, so an order after ``reference_date`` counts
    as recent; ``bounded`` leaves such orders out of the count.
    """
    today = F.lit(reference_date).cast("date")
    activity = abt.groupBy("customer_id").agg(*_activity(today, active_days, bounded))
    segment = _segment(today, new_days, active_min, risk)
    return activity.select("customer_id", segment.alias("lifecycle_segment"))


def user_profile(
    abt: DataFrame,
    reference_date: str,
    new_days: int = 7,
    active_days: int = 30,
    active_min: int = 2,
    risk: tuple[int, int] = (31, 90),
    bounded: bool = False,
    windows: Sequence[int] = WINDOWS,
) -> DataFrame:
    """KPIs, lifecycle segment and retention flags together, from a single grouping of the orders."""
    today = F.lit(reference_date).cast("date")
    measures = [*_kpis(), *_activity(today, active_days, bounded), *_first_two()]
    segment = _segment(today, new_days, active_min, risk)
    return _with_rate(abt.groupBy("customer_id").agg(*measures)).select(
        "customer_id", *KPI_COLUMNS, segment.alias("lifecycle_segment"), *_retained(windows)
    )


def _kpis() -> list[Column]:
    return [
        F.sum("order_total_amount").alias("revenue"),
        F.count("order_id").alias("order_count"),
        F.avg("order_total_amount").alias("avg_ticket"),
        F.avg("item_quantity").alias("avg_items"),
        F.avg("days_since_last_order").alias("avg_days_to_reorder"),
        F.count_if(F.col("restaurant_visit_no") == 1).alias("new_restaurant_orders"),
    ]


def _with_rate(kpis: DataFrame) -> DataFrame:
    rate = F.try_divide("new_restaurant_orders", "order_count") * F.lit(100.0)
    return kpis.withColumn("new_restaurant_rate_pct", rate)


def _first_two() -> list[Column]:
    time = F.col("order_created_at")
    return [
        F.min(time).alias("_earliest"),
        F.min(F.when(F.col("days_since_last_order").isNotNull(), time)).alias("_next"),
        F.count_if(time.isNull()).alias("_untimed"),
    ]


def _first() -> Column:
    return F.when(F.col("_untimed") == 0, F.col("_earliest"))


def _second() -> Column:
    return F.when(F.col("_untimed") == 0, F.col("_next")).when(
        F.col("_untimed") == 1, F.col("_earliest")
    )


def _retained(windows: Sequence[int]) -> list[Column]:
    gap = F.date_diff(_second(), _first())
    return [F.when(gap <= n, 1).otherwise(0).alias(f"is_retained_{n}d") for n in windows]


def _activity(today: Column, active_days: int, bounded: bool) -> list[Column]:
    age = F.date_diff(today, F.col("order_created_at"))
    recent = (age <= active_days) & (age >= 0) if bounded else age <= active_days
    return [
        F.min("order_created_at").alias("first_order_at"),
        F.max("order_created_at").alias("last_order_at"),
        F.count_if(recent).alias("recent_orders"),
    ]


def _segment(today: Column, new_days: int, active_min: int, risk: tuple[int, int]) -> Column:
    return (
        F.when(F.col("first_order_at") >= F.date_sub(today, new_days), "new")
        .when(F.col("recent_orders") >= active_min, "active")
        .when(F.date_diff(today, "last_order_at").between(*risk), "at_risk")
        .otherwise("other")
    )


def with_zeros(spine: DataFrame) -> DataFrame:
    """Replace NULL measures by 0, as for users who never ordered."""
    measures = [c for c in spine.columns if c in KPI_COLUMNS or c.startswith("is_retained_")]
    return spine.na.fill({name: 0 for name in measures})


def user_spine(
    users: DataFrame, kpis: DataFrame, flags: DataFrame | None = None, zero_fill: bool = True
) -> DataFrame:
    """Every user of ``users`` with KPIs and flags; a ``user_profile`` brings both at once.

    All inputs have one row per customer, so no join key is hot. ``zero_fill`` gives
    users without a measure 0; otherwise it stays NULL and is left out of means.
    """
    spine = users.join(kpis, "customer_id", "left")
    if flags is not None:
        flags = flags.drop("first_order_at", "second_order_at")
        spine = spine.join(flags, "customer_id", "left")
    return with_zeros(spine) if zero_fill else spine


def segment_spine(
    segments: DataFrame,
    users: DataFrame,
    kpis: DataFrame,
    flags: DataFrame,
    zero_fill: bool = True,
) -> DataFrame:
    """Users of the experiment who have a segment (hence orders), with KPIs and flags."""
    return user_spine(segments.join(users, "customer_id", "inner"), kpis, flags, zero_fill)
