"""Every operator as a query over the given tables.

Each function takes (spark, sf_dir) and returns a DataFrame; ``workload.oracle`` holds the same
query in SQL. Fractional results are cut to a grid before they are compared, since two engines
add doubles in different orders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialflow.functions.context import day_period
from trialflow.operators import experiment as ex
from trialflow.operators import quality as q
from trialflow.operators import users as u
from trialflow.operators.abt import ABT_COLUMNS, abt_projection, build_abt
from trialflow.operators.carts import CART_FEATURES, cart_features
from trialflow.operators.dedup import dedup_latest, duplicate_sample, find_duplicates
from trialflow.operators.history import customer_history, visit_ordinal
from trialflow.plans import medallion
from trialflow.plans.medallion import bronze_checks, clean_orders
from trialflow.session import at_end_of_run, pin_utc, remove, scratch_path, shuffles_dropped, stage
from trialflow.sources import schemas
from trialflow.sources.files import CSV_OPTIONS, JSON_OPTIONS, SourceSpec, ingest, ingest_all
from trialflow.sources.tables import ensure_schema, read_table, write_table
from workload import feeds
from workload.feeds import table

# The last order date of the tables, and one near their first.
END, LAUNCH, EVENTS_END = "2001-11-04", "1995-03-31", "2024-01-31"
# Low enough that ordinary test data has hot keys: customers and event users respectively.
HOT_CUSTOMER_ROWS, HOT_EVENT_ROWS = 40, 60
CUSTOMER_CHUNK, EVENT_CHUNK = 1000, 1000
# Off every simple fraction, so that no exact mean sits on the edge of a grid cell.
GRID_OFFSET = 0.4142135623


def grid(column: str, digits: int):
    scale = F.lit(float(10**digits))
    return (F.floor(F.col(column) * scale + F.lit(GRID_OFFSET)) / scale).alias(column)


def gridded(df: DataFrame, /, **digits: int) -> DataFrame:
    return df.select(*[grid(c, digits[c]) if c in digits else c for c in df.columns])


# ---------------------------------------------------------------- sources, sinks, catalog


def _new_schema(spark: SparkSession) -> str:
    path = scratch_path(spark, "schema")
    name = "trialflow_" + path.rsplit("-", 1)[1]
    ensure_schema(spark, name, path)
    at_end_of_run(spark.sql, f"DROP SCHEMA IF EXISTS {name} CASCADE")
    return name


def ingest_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders-json")
    raw = feeds.load(spark, sf_dir).orders
    raw.write.options(compression="gzip", **JSON_OPTIONS).json(path)
    spec = SourceSpec("json", path, schemas.ORDERS, JSON_OPTIONS)
    stored = ingest(spark, spec, f"{_new_schema(spark)}.orders")
    rows = stored.select(
        "order_id",
        "customer_id",
        "merchant_id",
        "order_created_at",
        "order_scheduled",
        "order_total_amount",
        "origin_platform",
        "cpf",
        F.col("items").isNull().alias("no_cart"),
        "items",
    )
    return _grid_features(cart_features(rows))


def ingest_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "restaurants-csv")
    raw = feeds.load(spark, sf_dir).restaurants
    raw.write.options(compression="gzip", **CSV_OPTIONS).csv(path)
    spec = SourceSpec("csv", path, schemas.RESTAURANTS, CSV_OPTIONS)
    return ingest(spark, spec, f"{_new_schema(spark)}.restaurants")


def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds with spoilt records, stored with their quarantine, and what the report says of them.

    The order's or restaurant's key decides how its record is spoilt, if at all.
    """
    feed, root, schema = feeds.load(spark, sf_dir), scratch_path(spark, "spoilt"), _new_schema(spark)
    feeds.spoilt_orders(feed.orders).write.option("compression", "gzip").text(f"{root}/orders")
    feeds.spoilt_restaurants(feed.restaurants).write.text(f"{root}/restaurants")
    specs = {
        "orders": SourceSpec("json", f"{root}/orders", schemas.ORDERS, JSON_OPTIONS),
        "restaurants": SourceSpec(
            "csv", f"{root}/restaurants", schemas.RESTAURANTS, {**CSV_OPTIONS, "header": "false"}
        ),
    }
    stored = ingest_all(spark, specs, schema, quarantine=True)
    layout = medallion.Layout(bronze=schema)
    shares = dict.fromkeys(["order_created_at", "order_total_amount"], medallion.NULL_SHARE)
    return q.quality_report(
        *medallion.bronze_load_checks(spark, layout),
        q.table_checks(stored["orders"], "orders", ["order_id"], null_share=shares),
        q.table_checks(stored["restaurants"], "restaurants", ["id"], null_share={"price_range": 0.5}),
    )


def table_write_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write, replace with another schema, then replace while keeping the old columns."""
    name = f"{_new_schema(spark)}.restaurants"
    restaurants = feeds.load(spark, sf_dir).restaurants
    write_table(restaurants.select("id", "merchant_city"), name)
    write_table(restaurants.select("id", "enabled", "price_range"), name)
    write_table(restaurants.select("id", "average_ticket"), name, merge_schema=True)
    return read_table(spark, name).select("id", "average_ticket", "enabled", "price_range")


def sql_view_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.load(spark, sf_dir)
    feed.restaurants.createOrReplaceTempView("trialflow_restaurants")
    feed.consumers.createOrReplaceTempView("trialflow_consumers")
    return spark.sql("""
        SELECT r.id AS restaurant_id, r.enabled AS is_restaurant_active,
               r.price_range AS restaurant_price_range, r.created_at AS restaurant_creation_date,
               c.active AS is_customer_active
        FROM (SELECT * FROM trialflow_restaurants) AS r
        LEFT JOIN trialflow_consumers AS c ON r.id = c.customer_id
    """)


# ---------------------------------------------------------------- quality


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.load(spark, sf_dir)
    cleaned = dedup_latest(
        feed.orders.select("order_id", "order_created_at"), ["order_id"], "order_created_at"
    )
    return q.quality_report(
        *bronze_checks(feed.orders, feed.consumers, feed.restaurants, feed.assignment),
        q.table_checks(cleaned, "cleaned orders", unique=["order_id"]),
    )


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return find_duplicates(lines, ["l_orderkey", "l_linenumber"])


def duplicates_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return duplicate_sample(
        lines, ["l_orderkey", "l_linenumber"], "l_shipdate", 10, ["l_partkey", "l_suppkey"]
    ).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")


def dedup_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return dedup_latest(lines, ["l_orderkey", "l_linenumber"], "l_shipdate")


def orphan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.orphans(
        table(spark, sf_dir, "orders"),
        table(spark, sf_dir, "lineitem"),
        "o_orderkey",
        "l_orderkey",
    )


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.load(spark, sf_dir)
    users = u.experiment_users(feed.assignment)
    pairs = {
        "buyers in the experiment": (feed.orders, users, "customer_id", "customer_id"),
        "users with orders": (users, feed.orders, "customer_id", "customer_id"),
        "consumers in the experiment": (feed.consumers, users, "customer_id", "customer_id"),
        "orders with lines": (
            table(spark, sf_dir, "orders"),
            table(spark, sf_dir, "lineitem"),
            "o_orderkey",
            "l_orderkey",
        ),
    }
    parts = [q.coverage(*pair).withColumn("pair", F.lit(name)) for name, pair in pairs.items()]
    return gridded(reduce(DataFrame.unionByName, parts), matched_pct=6)


def experiment_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.load(spark, sf_dir)
    figures = q.experiment_integrity(
        u.experiment_users(feed.assignment), feed.orders, feed.consumers
    )
    return gridded(figures, users_with_orders_pct=6)


def arm_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.arm_sizes(u.experiment_users(feeds.load(spark, sf_dir).assignment))


def order_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.order_period(feeds.load(spark, sf_dir).orders)


# ---------------------------------------------------------------- carts


def _grid_features(df: DataFrame) -> DataFrame:
    return gridded(df, **{c: 4 for c in _FRACTIONS})


_FRACTIONS = [c for c in CART_FEATURES if c not in ("item_quantity", "had_restaurant_discount")]


def cart_features_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = feeds.load(spark, sf_dir).orders
    return _grid_features(
        cart_features(raw.select("order_id", "merchant_id", "order_created_at", "items"))
    )


def cart_edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = feeds.edge_carts(table(spark, sf_dir, "lineitem"))
    return _grid_features(cart_features(lines, null_as_zero="null_as_zero"))


# ---------------------------------------------------------------- base table

_TIEBREAK = ["merchant_id", "order_total_amount"]
_ABT_GRID = {
    "mean_item_price": 4,
    "max_item_price": 4,
    "item_price_spread": 4,
    "max_item_share_pct": 4,
    "prior_mean_spend": 4,
    "ticket_ratio": 6,
}


def _abt(spark: SparkSession, sf_dir: str, wanted: list[str] = ABT_COLUMNS, **options):
    """The base table from the raw feeds; orders are cleaned and, as far as ``wanted``, stored first."""
    feed = feeds.load(spark, sf_dir)
    cleaned = clean_orders(feed.orders, tiebreak=_TIEBREAK)
    cleaned = cleaned.select(*[c for c in cleaned.columns if c in (*wanted, "merchant_id")])
    return build_abt(
        stage(cleaned, "orders"),
        feed.consumers,
        feed.restaurants,
        feed.assignment,
        all_columns=False,
        **options,
    )


def abt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridded(abt_projection(_abt(spark, sf_dir)), **_ABT_GRID)


def abt_hot_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _abt(spark, sf_dir, hot_rows=HOT_CUSTOMER_ROWS, chunk_rows=CUSTOMER_CHUNK)
    return gridded(abt_projection(rows), **_ABT_GRID)


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History per event user, users above the limit being computed in ordered chunks."""
    pin_utc(spark)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    history = customer_history(
        events, "user_id", "ts", "value", ["event_id"], HOT_EVENT_ROWS, EVENT_CHUNK
    )
    return gridded(history, prior_mean_spend=4)


def event_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_utc(spark)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    keys = ["user_id", "event_type"]
    return visit_ordinal(
        events, keys, "ts", ["event_id"], "nth", HOT_EVENT_ROWS // 4, EVENT_CHUNK
    )


def event_day_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_utc(spark)
    events = table(spark, sf_dir, "events")
    return events.select("event_id", day_period(F.col("ts")).alias("day_period"))


ZONES = {"America/Sao_Paulo": 1, "Asia/Kolkata": 2, "UTC": 0}


def event_day_period_zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day periods in the zone of each user, and unknown times once without, once with a period."""
    pin_utc(spark)
    user, zone = F.col("user_id") % len(ZONES), F.lit("UTC")
    for name, rest in ZONES.items():
        zone = F.when(user == rest, name).otherwise(zone)
    time = F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_id", time.alias("at"), zone.alias("zone"))
    return events.select(
        "event_id",
        "zone",
        day_period(F.col("at"), tz=F.col("zone")).alias("day_period"),
        day_period(F.col("at"), tz=F.col("zone"), legacy_null_bucket=True).alias("legacy_day_period"),
    )


# ---------------------------------------------------------------- users and experiment

_GOLD_INPUT = [
    "order_id",
    "customer_id",
    "order_created_at",
    "order_total_amount",
    "item_quantity",
    "days_since_last_order",
    "restaurant_visit_no",
]


def _gold_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base table's columns that the gold stage reads, stored as the silver stage does."""
    rows = _abt(spark, sf_dir, wanted=_GOLD_INPUT)
    return stage(rows.select(*_GOLD_INPUT), "abt")


_KPI_GRID = {
    "revenue": 2,
    "avg_ticket": 4,
    "avg_items": 6,
    "avg_days_to_reorder": 6,
    "new_restaurant_rate_pct": 6,
}


def user_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridded(u.user_kpis(_gold_input(spark, sf_dir)), **_KPI_GRID)


def retention_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.retention_flags(_gold_input(spark, sf_dir))


def _users(spark: SparkSession, sf_dir: str, zero_fill: bool = True) -> DataFrame:
    """The gold stage's per-user table, not cut to a grid."""
    rows, feed = _gold_input(spark, sf_dir), feeds.load(spark, sf_dir)
    return medallion.user_metrics(rows, feed.assignment, END, zero_fill)


def _spine(spark: SparkSession, sf_dir: str, zero_fill: bool = True) -> DataFrame:
    return _users(spark, sf_dir, zero_fill).drop("lifecycle_segment")


def user_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridded(_spine(spark, sf_dir), **_KPI_GRID)


def segment_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a segment, from the separate tables of segments, users, KPIs and flags."""
    rows, feed = _gold_input(spark, sf_dir), feeds.load(spark, sf_dir)
    spine = u.segment_spine(
        u.lifecycle_segment(rows, END), u.experiment_users(feed.assignment), u.user_kpis(rows), u.retention_flags(rows)
    )
    return gridded(spine, **_KPI_GRID)


def user_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold stage's per-user table."""
    return gridded(_users(spark, sf_dir), **_KPI_GRID)


def _grid_summary(df: DataFrame) -> DataFrame:
    digits = {"revenue_per_user": 1, "avg_ticket": 2}
    digits |= {f"stddev_{name}": n for name, n in digits.items()}
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return gridded(df, **{name: digits.get(name, 6) for name in doubles})


def kpi_summary_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_summary(ex.kpi_summary(_spine(spark, sf_dir)))


def kpi_summary_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = _spine(spark, sf_dir, zero_fill=False)
    return _grid_summary(ex.kpi_summary(spine, conditional=True))


def lifecycle_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.lifecycle_segment(_gold_input(spark, sf_dir), END)


def lifecycle_segments_at_launch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference date long before the last order, bounded and (as by default) not."""
    rows = _gold_input(spark, sf_dir)
    return u.lifecycle_segment(rows, LAUNCH).join(
        u.lifecycle_segment(rows, LAUNCH, bounded=True).withColumnRenamed(
            "lifecycle_segment", "bounded_segment"
        ),
        "customer_id",
    )


def lifecycle_segments_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_utc(spark)
    purchases = (
        table(spark, sf_dir, "events")
        .where("event_type = 'purchase'")
        .select(F.col("user_id").alias("customer_id"), F.col("ts").alias("order_created_at"))
    )
    return u.lifecycle_segment(purchases, EVENTS_END, active_days=7, risk=(8, 20))


def _segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = _users(spark, sf_dir).where(F.col("lifecycle_segment").isNotNull())
    return ex.kpi_summary(buyers, ["lifecycle_segment", "arm"], ex.SEGMENT_METRICS)


def kpi_summary_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_summary(_segment_summary(spark, sf_dir))


_TEST_GRID = {
    "lift_pct": 4,
    "t_stat": 6,
    "df": 4,
    "p_value": 6,
}


def _grid_tests(tests: DataFrame) -> DataFrame:
    """Means keep the digits that their metric has in the summaries."""
    digits = F.when(F.col("metric") == "revenue_per_user", 1).when(
        F.col("metric") == "avg_ticket", 2
    )
    scale = F.pow(F.lit(10.0), F.coalesce(digits, F.lit(6)))
    means = {
        name: F.floor(F.col(name) * scale + F.lit(GRID_OFFSET)) / scale
        for name in ("control_mean", "target_mean")
    }
    return gridded(tests.withColumns(means), **_TEST_GRID)


def _tested(summary: DataFrame, metrics, **options) -> DataFrame:
    return _grid_tests(ex.ttest_from_summary(summary, metrics, **options))


def ttest_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(ex.kpi_summary(_spine(spark, sf_dir)), ex.ARM_METRICS)


def ttest_by_arm_converted_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(ex.kpi_summary(_spine(spark, sf_dir)), ex.ARM_METRICS, legacy_n=True)


def ttest_by_arm_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = _spine(spark, sf_dir, zero_fill=False)
    return _tested(ex.kpi_summary(spine, conditional=True), ex.ARM_METRICS, equal_var=False)


def ttest_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(
        _segment_summary(spark, sf_dir), ex.SEGMENT_TESTS, by=["lifecycle_segment"]
    )


def ttest_by_segment_control_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(
        _segment_summary(spark, sf_dir),
        ex.SEGMENT_TESTS,
        by=["lifecycle_segment"],
        legacy_n=True,
    )


# ---------------------------------------------------------------- the whole job


def run_job(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Feeds written as gzip JSON, gzip CSV and plain CSV, and all stages run from these files.

    The files go once the raw tables hold what is in them.
    """
    feed, root = feeds.load(spark, sf_dir), scratch_path(spark, "feeds")
    unknown = F.lit(None).cast("string")
    consumers = feed.consumers.withColumns(
        {"customer_phone_area": unknown, "customer_phone_number": unknown}
    )
    registry = {
        "orders": SourceSpec("json", f"{root}/orders", schemas.ORDERS, JSON_OPTIONS),
        "consumers": SourceSpec("csv", f"{root}/consumers", schemas.CONSUMERS, CSV_OPTIONS),
        "restaurants": SourceSpec("csv", f"{root}/restaurants", schemas.RESTAURANTS, CSV_OPTIONS),
        "ab_test_users": SourceSpec(
            "csv", f"{root}/assignment", schemas.AB_TEST_USERS, CSV_OPTIONS
        ),
    }

    def drop_feeds() -> None:
        for spec in registry.values():
            remove(spark, spec.path)

    with shuffles_dropped(spark):
        feed.orders.write.options(compression="gzip", **JSON_OPTIONS).json(f"{root}/orders")
        consumers.write.options(compression="gzip", **CSV_OPTIONS).csv(f"{root}/consumers")
        feed.restaurants.write.options(compression="gzip", **CSV_OPTIONS).csv(f"{root}/restaurants")
        feed.assignment.write.options(**CSV_OPTIONS).csv(f"{root}/assignment")
        layout = medallion.Layout(_new_schema(spark), _new_schema(spark), _new_schema(spark))
        return medallion.run(spark, registry, END, layout, on_bronze=drop_feeds)


# Query -> stored result of the whole job, and how it is cut to a grid.
JOB = {
    "pipeline_summary_by_arm": ("summary_by_arm", _grid_summary),
    "pipeline_ttest_by_arm": ("ttest_by_arm", _grid_tests),
    "pipeline_ttest_by_segment": ("ttest_by_segment", _grid_tests),
    "pipeline_integrity": ("integrity", lambda df: gridded(df, users_with_orders_pct=6)),
}


def of_job(results: dict[str, DataFrame], name: str) -> DataFrame:
    """The rows of one pipeline query, from a run of the job."""
    result, cut = JOB[name]
    return cut(results[result])


def job_query(name: str):
    """The whole job, and one of its results."""
    return lambda spark, sf_dir: of_job(run_job(spark, sf_dir), name)


ALL = {
    **{name: job_query(name) for name in JOB},
    "ingest_json_roundtrip": ingest_json_roundtrip,
    "ingest_csv_roundtrip": ingest_csv_roundtrip,
    "ingest_quarantine": ingest_quarantine,
    "table_write_read": table_write_read,
    "sql_view_projection": sql_view_projection,
    "quality_report": quality_report,
    "duplicate_keys": duplicate_keys,
    "duplicate_sample": duplicates_newest_first,
    "dedup_latest": dedup_newest,
    "orphan_orders": orphan_orders,
    "coverage": coverage,
    "experiment_integrity": experiment_integrity,
    "arm_sizes": arm_sizes,
    "order_period": order_period,
    "cart_features": cart_features_of_orders,
    "cart_edge_cases": cart_edge_cases,
    "abt": abt,
    "abt_hot_customers": abt_hot_customers,
    "event_history": event_history,
    "event_ordinal": event_ordinal,
    "event_day_period": event_day_period,
    "event_day_period_zoned": event_day_period_zoned,
    "user_kpis": user_kpis,
    "retention_flags": retention_flags,
    "user_spine": user_spine,
    "segment_spine": segment_spine,
    "user_metrics": user_metrics,
    "kpi_summary_by_arm": kpi_summary_by_arm,
    "kpi_summary_conditional": kpi_summary_conditional,
    "lifecycle_segments": lifecycle_segments,
    "lifecycle_segments_at_launch": lifecycle_segments_at_launch,
    "lifecycle_segments_of_events": lifecycle_segments_of_events,
    "kpi_summary_by_segment": kpi_summary_by_segment,
    "ttest_by_arm": ttest_by_arm,
    "ttest_by_arm_converted_n": ttest_by_arm_converted_n,
    "ttest_by_arm_welch": ttest_by_arm_welch,
    "ttest_by_segment": ttest_by_segment,
    "ttest_by_segment_control_n": ttest_by_segment_control_n,
}
