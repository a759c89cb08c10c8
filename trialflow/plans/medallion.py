"""Raw feeds -> bronze tables -> silver base table -> gold summaries and tests.

Every stage reads stored tables and writes new ones, so nothing is computed twice and a lost
executor costs at most one stage.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialflow.operators import experiment as ex
from trialflow.operators import quality as q
from trialflow.operators import users as u
from trialflow.operators.abt import abt_projection, build_abt
from trialflow.operators.carts import cart_features
from trialflow.operators.dedup import dedup_latest
from trialflow.operators.skew import HOT_ROWS
from trialflow.plans.naming import legacy_abt, legacy_summary, own_abt, own_names, same_naming
from trialflow.session import pin_utc, run_scope, shuffles_dropped, stage
from trialflow.sources.files import QUARANTINE_SUFFIX, SourceSpec, ingest_all
from trialflow.sources.tables import ensure_schema, write_table

ORDER_COLUMNS = [
    "order_id",
    "customer_id",
    "merchant_id",
    "order_created_at",
    "order_total_amount",
    "origin_platform",
    "items",
]


# Columns of each feed that a text may fail to load into, and share of NULLs that is worth a warning.
LOADED = {
    "orders": ["order_created_at", "order_scheduled", "order_total_amount", "order_scheduled_date"],
    "consumers": ["created_at", "active"],
    "restaurants": ["created_at", "enabled", "price_range", "average_ticket", "delivery_time", "minimum_order_value"],
    "ab_test_users": [],
}
NULL_SHARE = 0.01


@dataclass(frozen=True)
class Layout:
    """Where tables go. The names readers of the stored tables know."""

    bronze: str = "bronze_data"
    silver: str = "silver_analytics"
    gold: str = "gold_analytics"
    abt: str = "orders_abt_final"
    by_arm: str = "abtest_kpi_summary_retention"
    by_segment: str = "abtest_kpi_summary_segmented"


def clean_orders(
    orders: DataFrame, keep: Sequence[str] = (), tiebreak: Sequence[str] | None = None
) -> DataFrame:
    """One row per order, the newest, with its cart features.

    Features are computed before duplicates are dropped: they stand for the cart's JSON in the
    shuffle, which is the widest column of the feed by far.
    """
    features = cart_features(orders.select(*ORDER_COLUMNS, *keep))
    return dedup_latest(features, ["order_id"], "order_created_at", tiebreak)


def bronze(
    spark: SparkSession, registry: Mapping[str, SourceSpec], layout: Layout = Layout()
) -> dict[str, DataFrame]:
    """Raw feeds as tables, unchanged, and beside each the records that did not load whole."""
    return ingest_all(spark, registry, layout.bronze, quarantine=True)


def bronze_checks(orders, consumers, restaurants, assignment) -> list[DataFrame]:
    """What must hold of the raw tables. Repeated orders are only a warning: they get merged."""
    shares = dict.fromkeys(["order_created_at", "order_total_amount"], NULL_SHARE)
    return [
        q.table_checks(
            orders,
            "orders",
            ["order_id"],
            {"order_total_amount": 0},
            ["order_id"],
            unique_severity=q.WARNING,
            null_share=shares,
        ),
        q.table_checks(restaurants, "restaurants", unique=["id"], null_share={"average_ticket": NULL_SHARE}),
        q.participant_checks(orders, consumers, assignment),
    ]


def bronze_load_checks(spark: SparkSession, layout: Layout = Layout(), severity: str = q.WARNING) -> list[DataFrame]:
    """What the feeds lost on their way into the raw tables, for those that have a quarantine."""
    return [
        q.load_checks(spark.table(f"{layout.bronze}.{name}"), spark.table(kept), name, columns, severity)
        for name, columns in LOADED.items()
        if spark.catalog.tableExists(kept := f"{layout.bronze}.{name}{QUARANTINE_SUFFIX}")
    ]


def silver(
    spark: SparkSession,
    layout: Layout = Layout(),
    tz_col: str | None = None,
    enforce: bool = True,
    load_severity: str = q.WARNING,
    hot_rows: int = HOT_ROWS,
    chunk_rows: int | None = None,
    legacy_names: bool = False,
) -> DataFrame:
    """Check the bronze tables, clean the orders and store the base table.

    With ``load_severity`` "error" a feed that lost values stops the run.
    """
    pin_utc(spark)
    with run_scope(spark), shuffles_dropped(spark):
        return _silver(spark, layout, tz_col, enforce, load_severity, hot_rows, chunk_rows, legacy_names)


def _silver(spark, layout, tz_col, enforce, load_severity, hot_rows, chunk_rows, legacy_names) -> DataFrame:
    ensure_schema(spark, layout.silver)
    orders, consumers, restaurants, assignment = (
        spark.table(f"{layout.bronze}.{name}")
        for name in ("orders", "consumers", "restaurants", "ab_test_users")
    )
    cleaned_name = f"{layout.silver}.orders_cleaned"
    report_name = f"{layout.silver}.quality_report"
    checks = bronze_checks(orders, consumers, restaurants, assignment)
    checks += bronze_load_checks(spark, layout, load_severity)
    write_table(q.quality_report(*checks), report_name)
    if enforce:
        q.enforce(spark.table(report_name))
    write_table(clean_orders(orders, [tz_col] if tz_col else []), cleaned_name)
    cleaned = spark.table(cleaned_name)
    checked = q.quality_report(q.table_checks(cleaned, "cleaned orders", unique=["order_id"]))
    checked = stage(checked, "cleaned-checks")
    checked.write.mode("append").saveAsTable(report_name)
    if enforce:
        q.enforce(checked)
    abt = abt_projection(
        build_abt(
            cleaned,
            consumers,
            restaurants,
            assignment,
            tz_col,
            hot_rows=hot_rows,
            chunk_rows=chunk_rows,
            all_columns=False,
        )
    )
    write_table(
        legacy_abt(abt) if legacy_names else abt, f"{layout.silver}.{layout.abt}"
    )
    return stored_abt(spark, layout)


def stored_abt(spark: SparkSession, layout: Layout = Layout()) -> DataFrame:
    return own_abt(spark.table(f"{layout.silver}.{layout.abt}"))


def user_metrics(
    abt: DataFrame, assignment: DataFrame, reference_date: str, zero_fill: bool = True, **rules
) -> DataFrame:
    """The one per-user table both summaries read: arm, KPIs, flags, lifecycle segment.

    All of it comes from one grouping of the base table. Users without orders have no segment.
    ``rules`` are those of ``user_profile``.
    """
    profile = u.user_profile(abt, reference_date, **rules)
    return u.user_spine(u.experiment_users(assignment), profile, zero_fill=zero_fill)


def gold(
    spark: SparkSession,
    reference_date: str,
    layout: Layout = Layout(),
    legacy_n: bool = False,
    legacy_names: bool = False,
) -> dict[str, DataFrame]:
    """Store the per-user table, both summaries, both test tables and the integrity figures."""
    pin_utc(spark)
    ensure_schema(spark, layout.gold)
    abt = stored_abt(spark, layout)
    assignment = spark.table(f"{layout.bronze}.ab_test_users")
    consumers = spark.table(f"{layout.bronze}.consumers")

    def store(df: DataFrame, name: str, summary: bool = False) -> DataFrame:
        df = legacy_summary(df) if summary and legacy_names else df
        table = f"{layout.gold}.{name}"
        merge = (
            summary
            and spark.catalog.tableExists(table)
            and same_naming(spark.table(table).columns, legacy_names)
        )
        write_table(df, table, merge_schema=merge)
        return own_names(spark.table(table))

    per_user = store(user_metrics(abt, assignment, reference_date), "user_metrics")
    by_arm = store(ex.kpi_summary(per_user), layout.by_arm, summary=True)
    by_segment = store(
        ex.kpi_summary(
            per_user.where(F.col("lifecycle_segment").isNotNull()),
            ["lifecycle_segment", "arm"],
            ex.SEGMENT_METRICS,
        ),
        layout.by_segment,
        summary=True,
    )
    by_arm_test = ex.ttest_from_summary(by_arm, ex.ARM_METRICS, legacy_n=legacy_n)
    by_segment_test = ex.ttest_from_summary(
        by_segment, ex.SEGMENT_TESTS, by=["lifecycle_segment"], legacy_n=legacy_n
    )
    integrity = q.experiment_integrity(u.experiment_users(assignment), abt, consumers)
    return {
        "user_metrics": per_user,
        "summary_by_arm": by_arm,
        "summary_by_segment": by_segment,
        "ttest_by_arm": store(by_arm_test, "ttest_by_arm"),
        "ttest_by_segment": store(by_segment_test, "ttest_by_segment"),
        "integrity": store(integrity, "integrity"),
    }


def run(
    spark: SparkSession,
    registry: Mapping[str, SourceSpec],
    reference_date: str,
    layout: Layout = Layout(),
    legacy_names: bool = False,
    legacy_n: bool = False,
    on_bronze: Callable[[], None] | None = None,
    **silver_options,
) -> dict[str, DataFrame]:
    """All three stages. What they stage on the way is removed; the results are stored tables.

    ``on_bronze`` is called once the raw tables and their quarantines are stored; the feeds are
    not read any more then.
    """
    pin_utc(spark)
    with run_scope(spark), shuffles_dropped(spark):
        bronze(spark, registry, layout)
        if on_bronze:
            on_bronze()
        silver(spark, layout, legacy_names=legacy_names, **silver_options)
        return gold(spark, reference_date, layout, legacy_n, legacy_names)
