from datetime import datetime, timedelta

import pytest
from frames import plan_of
from hypothesis import given, settings
from hypothesis import strategies as st

from trialflow.operators import users as u

REF = "2019-01-31"
TODAY = datetime(2019, 1, 31)
SCHEMA = (
    "customer_id string, order_id string, order_created_at timestamp, order_total_amount double, "
    "item_quantity int, days_since_last_order int, restaurant_visit_no int"
)


def order(customer, days_ago, amount=10.0, items=1, gap=None, nth=1, hour=12):
    ts = TODAY - timedelta(days=days_ago) + timedelta(hours=hour)
    return (customer, f"{customer}-{days_ago}-{hour}", ts, amount, items, gap, nth)


@pytest.fixture(scope="module")
def abt(spark):
    return spark.createDataFrame(
        [
            order("two", 20, 10.0, 2),
            order("two", 13, 30.0, 4, gap=7, nth=2),
            order("one", 5, 50.0, None),
            order("late", 60, 1.0),
            order("late", 45, 1.0, gap=15),
            order("tie", 90, 1.0),
            order("tie", 90, 2.0, gap=0),
            order("new", 24, 1.0),
            order("new", 10, 1.0, gap=14),
            order(None, 3, 7.0),
        ],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def people(spark):
    rows = [("two", "target"), ("one", "control"), ("never", "target"), ("late", "x")]
    return u.experiment_users(spark.createDataFrame(rows, "customer_id string, is_target string"))


def by_customer(df):
    return {r["customer_id"]: r for r in df.collect()}


def test_kpis(abt):
    rows = by_customer(u.user_kpis(abt))
    assert tuple(rows["two"]) == ("two", 40.0, 2, 20.0, 3.0, 7.0, 1, 50.0)
    assert tuple(rows["one"]) == ("one", 50.0, 1, 50.0, None, None, 1, 100.0)
    assert rows[None]["revenue"] == 7.0
    assert u.user_kpis(abt).columns == ["customer_id", *u.KPI_COLUMNS]


def test_kpis_of_uncounted_orders_do_not_fail(spark):
    row = (("c", None, TODAY, 1.0, 1, None, 1))
    assert u.user_kpis(spark.createDataFrame([row], SCHEMA)).first()["new_restaurant_rate_pct"] is None


def test_retention_counts_calendar_days(abt):
    rows = by_customer(u.retention_flags(abt))
    flags = {k: (r["is_retained_7d"], r["is_retained_14d"]) for k, r in rows.items()}
    assert flags == {
        "two": (1, 1), "one": (0, 0), "late": (0, 0), "tie": (1, 1), "new": (0, 1), None: (0, 0)
    }
    assert rows["one"]["second_order_at"] is None
    assert rows["tie"]["first_order_at"] == rows["tie"]["second_order_at"]


def test_retention_windows_are_a_parameter(abt):
    assert u.retention_flags(abt, (15,)).columns[-1] == "is_retained_15d"
    assert by_customer(u.retention_flags(abt, (15,)))["late"]["is_retained_15d"] == 1


def test_retention_is_one_grouping_combined_before_the_shuffle(abt):
    plan = plan_of(u.retention_flags(abt))
    assert plan.count("Exchange") == 1 and "Window" not in plan and plan.count("HashAggregate") == 2


def test_an_order_without_time_comes_first_and_is_never_retained(spark):
    timeless = [("once", "a", None, 1.0, 1, None, 1), ("twice", "a", None, 1.0, 1, None, 1), ("twice", "b", None, 1.0, 1, None, 1)]
    dated = [order("once", 20), order("once", 18, gap=2), order("twice", 20)]
    rows = by_customer(u.retention_flags(spark.createDataFrame(timeless + dated, SCHEMA)))
    assert rows["once"]["first_order_at"] is None and rows["once"]["second_order_at"] == dated[0][2]
    assert rows["twice"]["second_order_at"] is None
    assert not any(r["is_retained_14d"] for r in rows.values())


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 30)), max_size=20))
def test_retention_equals_ranking_the_orders(spark, pairs):
    days = {}
    for c, d in sorted(pairs, key=lambda p: -p[1]):
        days.setdefault(c, []).append(d)
    rows = [
        order(c, d, gap=ds[i - 1] - d if i else None)
        for c, ds in days.items() for i, d in enumerate(ds)
    ]
    got = by_customer(u.retention_flags(spark.createDataFrame(rows, SCHEMA)))
    assert {c: (r["is_retained_7d"], r["is_retained_14d"]) for c, r in got.items()} == {
        c: tuple(int(len(ds) > 1 and ds[0] - ds[1] <= n) for n in (7, 14)) for c, ds in days.items()
    }


def test_spine_has_every_user_with_zeros(abt, people):
    spine = u.user_spine(people, u.user_kpis(abt), u.retention_flags(abt))
    rows = by_customer(spine)
    assert set(rows) == {"two", "one", "never"}
    assert tuple(rows["never"])[2:] == (0.0, 0, 0.0, 0.0, 0.0, 0, 0.0, 0, 0)
    assert rows["one"]["avg_days_to_reorder"] == 0.0
    assert dict(spine.dtypes)["revenue"] == "double" and dict(spine.dtypes)["order_count"] == "bigint"


def test_spine_without_zeros(abt, people):
    rows = by_customer(u.user_spine(people, u.user_kpis(abt), u.retention_flags(abt), zero_fill=False))
    assert rows["never"]["revenue"] is None and rows["one"]["avg_days_to_reorder"] is None


def test_lifecycle(spark):
    data = [
        order("new", 7, hour=0), order("newer", 2), order("active", 50), order("active", 30),
        order("active", 1), order("risk31", 31), order("risk90", 90), order("gone", 91),
        order("single", 20), order("before_new", 8, hour=23),
        order("future", -5), order("future", 200), order("future", -9),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r[0]: r[1] for r in u.lifecycle_segment(df, REF).collect()}
    assert got == {
        "new": "new", "newer": "new", "active": "active", "risk31": "at_risk", "risk90": "at_risk",
        "gone": "other", "single": "other", "before_new": "other", "future": "active",
    }
    bounded = {r[0]: r[1] for r in u.lifecycle_segment(df, REF, bounded=True).collect()}
    assert bounded["future"] == "other" and bounded["active"] == "active"


def test_profile_is_kpis_segment_and_flags_from_one_grouping(abt):
    profile = u.user_profile(abt, REF)
    kpis, segments, flags = (
        by_customer(df) for df in (u.user_kpis(abt), u.lifecycle_segment(abt, REF), u.retention_flags(abt))
    )
    for customer, row in by_customer(profile).items():
        assert tuple(row) == (
            *kpis[customer], segments[customer]["lifecycle_segment"], *flags[customer][3:]
        )
    assert plan_of(u.user_profile(abt, REF)).count("Exchange") == 1


def test_users_and_profile_meet_on_one_exchange_each(spark, abt):
    assignment = spark.createDataFrame([("two", "target")] * 3, "customer_id string, is_target string")
    spine = u.user_spine(u.experiment_users(assignment), u.user_profile(abt, REF).hint("merge"))
    assert plan_of(spine).count("Exchange") == 2
    assert spine.count() == 1


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(-20, 200)), max_size=40))
def test_every_buyer_is_in_one_segment(spark, pairs):
    df = spark.createDataFrame([order(c, d) for c, d in pairs], SCHEMA)
    rows = u.lifecycle_segment(df, REF).collect()
    assert sorted(r[0] for r in rows) == sorted({c for c, _ in pairs})
    assert {r[1] for r in rows} <= {"new", "active", "at_risk", "other"}


def test_segment_spine_holds_assigned_buyers_only(abt, people):
    spine = u.segment_spine(
        u.lifecycle_segment(abt, REF), people, u.user_kpis(abt), u.retention_flags(abt)
    )
    rows = by_customer(spine)
    assert {k: r["lifecycle_segment"] for k, r in rows.items()} == {"two": "active", "one": "new"}
