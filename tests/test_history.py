import random
import re
from datetime import datetime, timedelta

import pytest
from frames import plan_of, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialflow.operators import skew
from trialflow.operators.abt import ABT_COLUMNS, abt_projection, build_abt
from trialflow.operators.history import (
    chunked_features,
    customer_history,
    plain_history,
    plain_ordinal,
    visit_ordinal,
)
from trialflow.operators.star import Dim, star_join

SCHEMA = "id int, g string, r string, t timestamp, x double"
DAY0 = datetime(2019, 1, 1)


def brute_force(data):
    """id -> (previous time, days since, mean so far, nth visit), by walking in time order."""
    seen, visits, out = {}, {}, {}
    ordered = sorted(data, key=lambda r: (r[3] is not None, r[3] or DAY0, r[0]))
    for id_, g, r, t, x in ordered:
        past = seen.setdefault(g, [])
        amounts = [a for _, a in past if a is not None]
        previous = past[-1][0] if past else None
        days = (t.date() - previous.date()).days if previous and t else None
        mean = sum(amounts) / len(amounts) if amounts else None
        visits[g, r] = visits.get((g, r), 0) + 1
        out[id_] = (previous, days, mean, visits[g, r])
        past.append((t, x))
    return out


def check(got, data):
    want = brute_force(data)
    assert len(got) == len(data)
    for row in got:
        previous, days, mean, nth = want[row["id"]]
        assert row["previous_order_at"] == previous
        assert row["days_since_last_order"] == days
        assert row["prior_mean_spend"] == pytest.approx(mean)
        assert row["nth"] == nth


def sample(seed, n=300, hot_share=3):
    """A third of the rows has one key, and ties in time are common."""
    rng = random.Random(seed)
    return [
        (
            i,
            "hot" if rng.randrange(hot_share) == 0 else rng.choice(["a", "b", "c", None]),
            rng.choice(["r1", "r2", None]),
            None if rng.random() < 0.03 else DAY0 + timedelta(hours=rng.randrange(200)),
            None if rng.random() < 0.05 else float(rng.randrange(1000)),
        )
        for i in range(n)
    ]


def test_small_window_table(spark):
    data = [(1, "a", None, DAY0 + timedelta(i), x) for i, x in enumerate((5.0, 7.0, 9.0))]
    data += [(1, None, None, DAY0 + timedelta(i), x) for i, x in enumerate((1.0, 3.0))]
    df = plain_history(spark.createDataFrame(data, SCHEMA), "g", "t", "x", ["id"])
    df = plain_ordinal(df, ["g", "r"], "t", ["id"], "nth")
    assert rows_of(df, "g", "prior_mean_spend", "days_since_last_order", "nth") == [
        (None, None, None, 1),
        (None, 1.0, 1, 2),
        ("a", None, None, 1),
        ("a", 5.0, 1, 2),
        ("a", 6.0, 1, 3),
    ]


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6))
def test_plain_windows_equal_brute_force(spark, seed):
    data = sample(seed, 120)
    df = plain_history(spark.createDataFrame(data, SCHEMA), "g", "t", "x", ["id"])
    check(plain_ordinal(df, ["g", "r"], "t", ["id"], "nth").collect(), data)


@pytest.mark.parametrize("seed, hot_rows, chunk_rows", [(1, 60, 10), (2, 30, 7), (3, 5, 300)])
def test_hot_keys_give_the_same_values(spark, seed, hot_rows, chunk_rows):
    data = sample(seed)
    df = spark.createDataFrame(data, SCHEMA)
    out = customer_history(df, "g", "t", "x", ["id"], hot_rows, chunk_rows)
    out = visit_ordinal(out, ["g", "r"], "t", ["id"], "nth", hot_rows // 3, chunk_rows)
    assert out.columns[: len(df.columns)] == df.columns
    check(out.collect(), data)


def test_one_key_with_one_time_is_still_cut(spark):
    data = [(i, "hot", None, DAY0, 1.0 * i) for i in range(400)]
    df = spark.createDataFrame(data, SCHEMA)
    hot = skew.find_hot_keys(df, ["g"], 100, 20)
    chunked = skew.in_ordered_chunks(df, ["g", "t", "id"], hot)
    sizes = [r["count"] for r in chunked.groupBy("_chunk").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 100
    out = chunked_features(chunked, "t", ["id"], "g", "x", ["g", "r"], "nth")
    check(out.collect(), data)
    # One exchange by (key, chunk) for the rows, one for the sums per chunk, and no join.
    plan = plan_of(out.select("*"))
    assert "Join" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(g#\d+, _chunk#\d+, ", plan)) == 2


def test_hot_keys_are_counted_and_split_null_safe(spark):
    data = [(i, None if i < 50 else f"k{i}", None, DAY0, 1.0) for i in range(80)]
    df = spark.createDataFrame(data, SCHEMA)
    hot = skew.find_hot_keys(df, ["g"], 10)
    assert (hot.n_keys, hot.n_rows) == (1, 50)
    cold, rest = skew.split_by_heat(df, hot)
    assert (cold.count(), rest.count()) == (30, 50)
    assert cold.columns == rest.columns == df.columns


def test_broadcast_follows_the_row_count(spark):
    small = skew.if_small(spark.range(3), 3)
    large = skew.if_small(spark.range(3), skew.BROADCAST_ROWS + 1)
    analyzed = [d._jdf.queryExecution().analyzed().toString() for d in (small, large)]
    assert ["ResolvedHint" in plan for plan in analyzed] == [True, False]


def star(spark):
    rng = random.Random(7)
    orders = [
        (
            f"o{i:04d}",
            "hot" if i % 3 == 0 else (None if i % 17 == 0 else f"c{rng.randrange(12)}"),
            rng.choice(["r1", "r2", "gone", None]),
            DAY0 + timedelta(hours=rng.randrange(500)),
            float(rng.randrange(1, 300)),
        )
        for i in range(240)
    ]
    schema = (
        "order_id string, customer_id string, merchant_id string, order_created_at timestamp, "
        "order_total_amount double"
    )
    orders = spark.createDataFrame(orders, schema).selectExpr(
        "*", "'ANDROID' origin_platform", "1 item_quantity", "1D mean_item_price",
        "1D max_item_price", "0D item_price_spread", "100D max_item_share_pct",
        "false had_restaurant_discount",
    )
    consumers = spark.createDataFrame(
        [(c, DAY0 - timedelta(10), True) for c in ("hot", "c1", "c2", "c3")],
        "customer_id string, created_at timestamp, active boolean",
    )
    restaurants = spark.createDataFrame(
        [("r1", True, 3, DAY0, 50.0, 40.0, 10.0, "SP", "X"), ("r2", True, 1, DAY0, 0.0, 20.0, 5.0, "RJ", "Y")],
        "id string, enabled boolean, price_range int, created_at timestamp, average_ticket double, "
        "delivery_time double, minimum_order_value double, merchant_state string, merchant_city string",
    )
    arms = spark.createDataFrame(
        [("hot", "target"), ("c1", "control"), ("c2", "other")], "customer_id string, is_target string"
    )
    return skew.stage(orders), consumers, restaurants, arms


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(-1e7, 1e7) | st.sampled_from([0.1, 0.7, 1e-9]) | st.none(), min_size=40, max_size=120), st.integers(2, 30))
def test_cut_keys_have_the_same_means_to_the_last_bit(spark, amounts, chunk_rows):
    data = [(i, "hot" if i % 3 else "b", None, DAY0 + timedelta(hours=i * 7 % 41), x) for i, x in enumerate(amounts)]
    df = skew.stage(spark.createDataFrame(data, SCHEMA))
    whole = customer_history(df, "g", "t", "x", ["id"])
    cut = customer_history(df, "g", "t", "x", ["id"], 5, chunk_rows)
    assert rows_of(whole, "id", "prior_mean_spend") == rows_of(cut, "id", "prior_mean_spend")


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 10**6), st.integers(5, 40))
def test_abt_is_the_same_to_the_last_bit_however_keys_are_cut(spark, seed, chunk_rows):
    orders, *dims = star(spark)
    amount = F.xxhash64(F.lit(seed), "order_id") % 10**9 / F.lit(7.0)
    orders = skew.stage(orders.withColumn("order_total_amount", amount))
    plain = abt_projection(build_abt(orders, *dims))
    split = abt_projection(build_abt(orders, *dims, hot_rows=10, chunk_rows=chunk_rows))
    assert rows_of(plain) == rows_of(split)


def test_abt_is_the_same_with_and_without_hot_customers(spark):
    parts = star(spark)
    plain = abt_projection(build_abt(*parts))
    split = abt_projection(build_abt(*parts, hot_rows=50, chunk_rows=9))
    assert plain.columns == split.columns == ABT_COLUMNS
    assert plain.schema.simpleString() == split.schema.simpleString()
    key = {r["order_id"]: r for r in plain.collect()}
    rows = split.collect()
    assert len(rows) == len(key) == 240
    for row in rows:
        assert row == key[row["order_id"]]  # amounts are whole, so their means are exact


def test_abt_keeps_unmatched_orders_and_any_arm(spark):
    abt = abt_projection(build_abt(*star(spark))).collect()
    gone = [r for r in abt if r["restaurant_id"] is None and r["customer_id"] == "hot"]
    # Orders without a restaurant share one group, whatever merchant they name.
    assert sorted(r["restaurant_visit_no"] for r in gone) == list(range(1, len(gone) + 1))
    assert {r["arm"] for r in abt} == {"target", "control", "other", None}
    assert all(r["ticket_ratio"] is None for r in abt if r["restaurant_id"] == "r2")
    assert all(r["customer_age_days"] >= 10 for r in abt if r["customer_id"] == "hot")


def test_one_customer_exchange_serves_joins_and_windows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(abt_projection(build_abt(*star(spark))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 3
    # orders by merchant, orders by customer, and one per dimension
    assert plan.count("Exchange hashpartitioning") == 5
    assert "Python" not in plan


def test_star_join_keeps_fact_rows_and_names(spark):
    fact = spark.createDataFrame([(1, "a"), (2, None), (3, "zz")], "id int, k string")
    dim = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v int")
    out = star_join(fact, [Dim(dim, "k", "k", {"v": "dim_v", "k": "dim_k"})])
    assert out.columns == ["id", "k", "dim_v", "dim_k"]
    assert rows_of(out) == [(1, "a", 10, "a"), (2, None, None, None), (3, "zz", None, None)]


def test_small_chunks_do_not_multiply_tasks(spark):
    data = [(i, f"k{i % 7}", None, DAY0, 1.0 * i) for i in range(900)]
    df = spark.createDataFrame(data, SCHEMA)
    hot = skew.find_hot_keys(df, ["g"], 20, 5)
    assert hot.n_chunks == 180
    chunked = skew.in_ordered_chunks(df, ["g", "t", "id"], hot)
    assert len(chunked.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sorted((r["g"], r["id"], r["_chunk"]) for r in chunked.collect())
    numbers = [c for _, _, c in rows]
    assert numbers == sorted(numbers) and max(numbers.count(c) for c in set(numbers)) <= 5
    check(chunked_features(chunked, "t", ["id"], "g", "x", ["g", "r"], "nth").collect(), data)
