"""Time this package's way of doing a step beside the obvious other way, on the same rows.

Prints one JSON line: {step: {"ours": sec, "other": sec}}. BENCH_SF_DIR and BENCH_CPUS as in
bench.py. The best of three runs counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trialflow.operators import experiment as ex
from trialflow.operators import quality as q
from trialflow.operators import users as u
from trialflow.operators.abt import abt_projection, build_abt
from trialflow.operators.carts import cart_features
from trialflow.operators.dedup import dedup_latest
from trialflow.plans.medallion import ORDER_COLUMNS, bronze_checks, clean_orders
from trialflow.session import stage
from workload import feeds

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def best(action, runs: int = 3) -> float:
    times = []
    for _ in range(runs):
        started = time.perf_counter()
        action()
        times.append(time.perf_counter() - started)
    return round(min(times), 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    derived = feeds.load(spark, SF_DIR)
    feed = feeds.Feeds(
        stage(derived.orders), derived.consumers, derived.restaurants, derived.assignment
    )
    steps = {}

    # Checks: one pass per table, as one report, against one job per check.
    report = bronze_checks(feed.orders, feed.consumers, feed.restaurants, feed.assignment)
    singles = [
        q.check_not_null(feed.orders, "orders", ["order_id"]),
        q.check_range(feed.orders, "orders", "order_total_amount", 0),
        q.check_unique(feed.orders, "orders", ["order_id"]),
        q.check_not_null(feed.consumers, "consumers", ["customer_id"]),
        q.check_unique(feed.consumers, "consumers", ["customer_id"]),
        q.check_not_null(feed.assignment, "assignment", ["customer_id"]),
        q.check_unique(feed.restaurants, "restaurants", ["id"]),
        q.check_single_arm(feed.assignment),
        q.check_referential(feed.orders, feed.consumers, "buyers are consumers", "customer_id"),
        q.check_referential(feed.orders, feed.assignment, "buyers are assigned", "customer_id"),
    ]
    steps["quality_report"] = {
        "ours": best(lambda: q.quality_report(*report).collect()),
        "other": best(lambda: [single.select("*").collect() for single in singles]),
    }

    # Duplicates: cart text dropped before the shuffle against carried through it.
    raw = feed.orders.select(*ORDER_COLUMNS)
    steps["clean_orders"] = {
        "ours": best(lambda: drain(clean_orders(raw))),
        "other": best(
            lambda: drain(
                cart_features(dedup_latest(raw, ["order_id"], "order_created_at"))
            )
        ),
    }

    # Gold: base table stored once against recomputed by every use.
    cleaned = stage(clean_orders(raw))

    def summaries(abt) -> None:
        users = u.experiment_users(feed.assignment)
        spine = u.user_spine(users, u.user_kpis(abt), u.retention_flags(abt))
        ex.kpi_summary(spine).collect()
        segments = u.segment_spine(
            u.lifecycle_segment(abt, "2001-11-04"), users, u.user_kpis(abt), u.retention_flags(abt)
        )
        ex.kpi_summary(segments, ["lifecycle_segment", "arm"], ex.SEGMENT_METRICS).collect()

    abt = build_abt(cleaned, feed.consumers, feed.restaurants, feed.assignment)
    steps["gold_from_stored_base_table"] = {
        "ours": best(lambda: summaries(stage(abt))),
        "other": best(lambda: summaries(abt)),
    }
    # Hot key: a third of many orders has one customer; ordered chunks against plain windows.
    copies = spark.range(8).withColumnRenamed("id", "copy")
    skewed = stage(
        cleaned.join(F.broadcast(copies)).withColumns(
            {
                "order_id": F.concat_ws("/", "order_id", "copy"),
                "customer_id": F.when(F.rand(5) < 1 / 3, "hot").otherwise(F.col("customer_id")),
            }
        )
    )
    hot = {"hot_rows": 100_000, "chunk_rows": 150_000}
    others = (feed.consumers, feed.restaurants, feed.assignment)
    never = {"hot_rows": 10**9}
    steps["base_table_with_a_hot_customer"] = {
        "ours": best(lambda: drain(abt_projection(build_abt(skewed, *others, **hot, all_columns=False))), 2),
        "other": best(lambda: drain(abt_projection(build_abt(skewed, *others, **never, all_columns=False))), 2),
    }
    spark.stop()
    print(json.dumps(steps))


if __name__ == "__main__":
    main()
