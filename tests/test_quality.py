import pytest
from frames import plan_of, rows_of

from trialflow.operators import quality as q
from trialflow.operators.users import experiment_users


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(
        [("o1", "c1", 5.0), ("o1", "c1", 5.0), ("o2", "c2", -1.0), (None, None, None), ("o4", "c9", 0.0)],
        "order_id string, customer_id string, amount double",
    )


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("c1",), ("c2",), ("c3",)], "customer_id string")


@pytest.fixture(scope="module")
def arms(spark):
    return spark.createDataFrame(
        [("c1", "target"), ("c1", "control"), ("c2", "control"), ("c2", "control"), ("c4", "x"), ("c5", "target")],
        "customer_id string, is_target string",
    )


def summary(report):
    return {r["check"]: (r["violations"], r["total"], r["passed"]) for r in report.collect()}


def test_all_checks_of_a_table_share_one_pass(orders):
    report = q.table_checks(orders, "orders", ["order_id", "amount"], {"amount": 0}, ["order_id"])
    assert summary(report) == {
        "orders: order_id is not null": (1, 5, False),
        "orders: amount is not null": (1, 5, False),
        "orders: amount >= 0": (1, 5, False),
        "orders: (order_id) is unique": (1, 5, False),
    }
    assert plan_of(report.select("*")).count("Scan") == 1


def test_single_purpose_checks(orders, people):
    assert summary(q.check_not_null(people, "p", ["customer_id"])) == {
        "p: customer_id is not null": (0, 3, True)
    }
    assert summary(q.check_unique(people, "p", ["customer_id"])) == {
        "p: (customer_id) is unique": (0, 3, True)
    }
    assert summary(q.check_range(orders, "o", "amount", 0)) == {"o: amount >= 0": (1, 5, False)}


def test_checks_of_an_empty_table_pass(spark):
    empty = spark.createDataFrame([], "a string")
    assert summary(q.table_checks(empty, "e", ["a"], unique=["a"])) == {
        "e: a is not null": (0, 0, True),
        "e: (a) is unique": (0, 0, True),
    }


def test_single_arm_sees_repeats_and_torn_users(arms):
    assert summary(q.check_single_arm(arms)) == {
        "assignment: one row per user": (2, 4, False),
        "assignment: one arm per user": (1, 4, False),
    }


def test_orphans_include_null(orders, people):
    assert rows_of(q.orphans(orders, people, "customer_id")) == [(None,), ("c9",)]
    report = q.check_referential(orders, people, "known", "customer_id")
    assert summary(report) == {"known": (2, 4, False)}
    assert report.first()["severity"] == q.WARNING


def test_participant_checks_equal_the_single_checks_in_one_grouping(spark, orders, people, arms):
    nobody = spark.createDataFrame([(None, "target")], "customer_id string, is_target string")
    more, known = arms.union(nobody), people.union(people.limit(1)).union(nobody.select("customer_id"))
    for three in ((orders, known, more), (orders.limit(0), people.limit(0), arms.limit(0))):
        feed, consumers, assignment = three
        single = q.quality_report(
            q.table_checks(consumers, "consumers", ["customer_id"], unique=["customer_id"]),
            q.table_checks(assignment, "assignment", ["customer_id"]),
            q.check_single_arm(assignment),
            q.check_referential(feed, consumers, "buyers are consumers", "customer_id"),
            q.check_referential(feed, assignment, "buyers are assigned", "customer_id"),
        )
        together = q.participant_checks(*three)
        assert rows_of(together) == rows_of(single)
    plan = plan_of(q.participant_checks(orders, people, arms))
    assert plan.count("hashpartitioning") == 1 and "SortAggregate" not in plan


def test_coverage(spark, orders, people):
    row = q.coverage(orders, people, "customer_id").first()
    assert tuple(row) == (4, 2, 2, 50.0)
    assert tuple(q.coverage(orders.limit(0), people, "customer_id").first()) == (0, 0, 0, None)


def test_integrity_figures(orders, people, arms):
    row = q.experiment_integrity(experiment_users(arms), orders, people).first().asDict()
    assert row == {
        "users": 4,
        "users_with_orders": 3,
        "users_without_orders": 1,
        "users_with_orders_pct": 75.0,
        "consumers_in_experiment": 3,
        "consumers_not_in_experiment": 0,
        "buyers_not_in_consumers": 2,
        "buyers_not_in_experiment": 2,
        "users_in_several_arms": 1,
    }


def test_report_is_enforced_on_errors_only(orders, people):
    warning = q.check_referential(orders, people, "known", "customer_id")
    fine = q.check_unique(people, "people", ["customer_id"])
    assert q.enforce(q.quality_report(fine, warning)).count() == 2
    with pytest.raises(q.QualityError, match=r"o: amount >= 0: 1"):
        q.enforce(q.quality_report(warning, q.check_range(orders, "o", "amount", 0)))
