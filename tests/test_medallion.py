import gzip
import json
import os
import random
from datetime import datetime, timedelta

import pytest
from frames import shuffle_files

from trialflow.operators.quality import QualityError
from trialflow.plans import medallion
from trialflow.plans.medallion import Layout
from trialflow.plans.naming import ABT_NAMES, SUMMARY_NAMES
from trialflow.session import shared_dir
from trialflow.sources.files import default_registry

REF = "2019-01-31"
END = datetime(2019, 1, 31)


def cart(rng):
    price = rng.randrange(500, 5000)
    item = {
        "quantity": rng.randrange(1, 4),
        "unitPrice": {"value": str(price)},
        "totalValue": {"value": str(price)},
        "totalAddition": {"value": "0"},
        "totalDiscount": {"value": str(rng.choice([0, 100]))},
        "garnishItems": [],
    }
    return json.dumps([item] * rng.randrange(1, 4))


def write_feeds(folder, negative=False, spoilt=0):
    rng = random.Random(11)
    customers = [f"c{i:03d}" for i in range(60)]
    orders = []
    for i in range(400):
        ts = END - timedelta(days=rng.randrange(120), seconds=rng.randrange(86400))
        orders.append(
            {
                "order_id": f"o{i:04d}",
                "customer_id": rng.choice(customers[:50]) if i % 3 else "c000",
                "merchant_id": f"r{rng.randrange(6)}",
                "order_created_at": ts.strftime("%Y-%m-%dT%H:%M:%S.000Z"),
                "order_total_amount": "n/a" if i < spoilt else -5.0 if negative and i == 7 else float(rng.randrange(10, 90)),
                "origin_platform": "IOS",
                "merchant_timezone": "America/Sao_Paulo",
                "items": cart(rng),
            }
        )
    again = {**orders[3], "order_created_at": "2019-01-30T10:00:00.000Z", "order_total_amount": 77.0}
    with gzip.open(folder / "order.json.gz", "wt") as out:
        out.writelines(json.dumps(o) + "\n" for o in [*orders, again])
    with gzip.open(folder / "consumer.csv.gz", "wt") as out:
        out.write("customer_id,language,created_at,active,customer_name,customer_phone_area,customer_phone_number\n")
        out.writelines(f"{c},pt-br,2018-01-0{i % 9 + 1}T00:00:00.000Z,true,N,1,2\n" for i, c in enumerate(customers))
    with gzip.open(folder / "restaurant.csv.gz", "wt") as out:
        out.write(
            "id,created_at,enabled,price_range,average_ticket,delivery_time,minimum_order_value,"
            "merchant_zip_code,merchant_city,merchant_state,merchant_country\n"
        )
        out.writelines(f"r{i},2017-01-01T00:00:00.000Z,true,{i},30.0,20,10,1,C,SP,BR\n" for i in range(5))
    arms = "".join(f"{c},{'target' if i % 2 else 'control'}\n" for i, c in enumerate(customers))
    (folder / "ab_test_ref.csv").write_text("customer_id,is_target\n" + arms)
    return default_registry(str(folder))


def layout(tag):
    return Layout(f"bronze_{tag}", f"silver_{tag}", f"gold_{tag}")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    registry = write_feeds(tmp_path_factory.mktemp("feeds"))
    return medallion.run(spark, registry, REF, layout("own")), registry


def test_raw_feeds_to_gold(spark, stored):
    results, _ = stored
    assert spark.table("bronze_own.orders").count() == 401
    abt = spark.table("silver_own.orders_abt_final")
    assert abt.count() == 400 and len(abt.columns) == 22
    assert abt.where("order_id = 'o0003'").first()["order_total_amount"] == 77.0
    by_arm = {r["arm"]: r for r in results["summary_by_arm"].collect()}
    assert {r["users"] for r in by_arm.values()} == {30}
    integrity = results["integrity"].first()
    assert (integrity["users"], integrity["users_with_orders"]) == (60, 50)
    assert results["ttest_by_arm"].count() == 8
    segments = {r["lifecycle_segment"] for r in results["summary_by_segment"].collect()}
    assert segments <= {"new", "active", "at_risk", "other"} and "active" in segments
    assert results["ttest_by_segment"].count() == 5 * len(segments)
    assert results["user_metrics"].count() == 60


def test_quality_report_is_stored(spark, stored):
    report = {r["check"]: r for r in spark.table("silver_own.quality_report").collect()}
    assert report["orders: (order_id) is unique"]["violations"] == 1
    assert report["cleaned orders: (order_id) is unique"]["passed"]


def test_values_that_do_not_load_are_reported(spark, tmp_path):
    registry = write_feeds(tmp_path, spoilt=3)
    medallion.run(spark, registry, REF, layout("spoilt"))
    report = {r["check"]: r for r in spark.table("silver_spoilt.quality_report").collect()}
    loads = report["orders: order_total_amount loads"]
    assert (loads["violations"], loads["total"], loads["passed"], loads["severity"]) == (3, 401, False, "warning")
    assert report["orders: records are well-formed"]["passed"] and report["restaurants: average_ticket loads"]["passed"]
    assert report["orders: at most 1% of order_total_amount is null"]["passed"]
    kept = spark.table("bronze_spoilt.orders_quarantine").collect()
    assert {json.loads(r["record"])["order_id"] for r in kept} == {"o0000", "o0001", "o0002"}
    with pytest.raises(QualityError, match="order_total_amount loads: 3"):
        medallion.silver(spark, layout("spoilt"), load_severity="error")


def test_a_run_leaves_nothing_staged(spark, stored):
    before = set(os.listdir(shared_dir(spark)))
    medallion.run(spark, stored[1], REF, layout("tidy"), hot_rows=60, chunk_rows=10)
    assert set(os.listdir(shared_dir(spark))) == before


def test_gold_may_be_repeated(spark, stored):
    results, registry = stored
    medallion.run(spark, registry, REF, layout("again"))
    again = medallion.gold(spark, REF, layout("again"))
    for name in ("summary_by_arm", "summary_by_segment", "ttest_by_arm"):
        assert sorted(map(str, again[name].collect())) == sorted(
            map(str, results[name].collect())
        )


def test_stored_names_may_be_the_former_ones(spark, stored):
    results, registry = stored
    former = medallion.run(
        spark, registry, REF, layout("former"), legacy_names=True, hot_rows=60, chunk_rows=10
    )
    abt = spark.table("silver_former.orders_abt_final")
    assert set(ABT_NAMES.values()) <= set(abt.columns)
    assert {r[0] for r in abt.select("periodo_do_dia").distinct().collect()} <= {
        "Manhã", "Tarde", "Noite", "Madrugada"
    }
    summary = spark.table("gold_former.abtest_kpi_summary_retention")
    assert set(summary.columns) == set(SUMMARY_NAMES.values())
    assert len(spark.table("gold_former.abtest_kpi_summary_segmented").columns) == 16
    for name in ("summary_by_arm", "ttest_by_arm", "ttest_by_segment", "integrity"):
        own = results[name]
        assert sorted(map(str, former[name].select(*own.columns).collect())) == sorted(
            map(str, own.collect())
        ), name


def test_periods_may_follow_the_merchants_zone(spark, stored):
    medallion.bronze(spark, stored[1], layout("zoned"))
    zoned = medallion.silver(spark, layout("zoned"), tz_col="merchant_timezone")
    zoned = {r["order_id"]: (r["order_created_at"].hour, r["day_period"]) for r in zoned.collect()}
    assert any(hour in (6, 7) and period == "night" for hour, period in zoned.values())


def test_a_failed_check_stops_the_run(spark, tmp_path):
    registry = write_feeds(tmp_path, negative=True)
    with pytest.raises(QualityError, match="order_total_amount >= 0: 1"):
        medallion.run(spark, registry, REF, layout("broken"))
    assert spark.table("silver_broken.quality_report").where("not passed").count() > 0
    assert not spark.catalog.tableExists("silver_broken.orders_abt_final")
    medallion.silver(spark, layout("broken"), enforce=False)
    assert spark.table("silver_broken.orders_abt_final").count() == 400


def test_names_may_change_between_runs_on_one_layout(spark, stored):
    results, registry = stored
    for legacy in (False, True, False):
        again = medallion.run(spark, registry, REF, layout("both"), legacy_names=legacy)
        assert sorted(map(str, again["summary_by_arm"].select(*results["summary_by_arm"].columns).collect())) == sorted(
            map(str, results["summary_by_arm"].collect())
        )
        periods = {r[0] for r in medallion.stored_abt(spark, layout("both")).select("day_period").distinct().collect()}
        assert periods <= {"morning", "afternoon", "evening", "night"}


def test_a_failed_raw_check_leaves_no_cleaned_orders(spark, tmp_path):
    registry = write_feeds(tmp_path, negative=True)
    medallion.bronze(spark, registry, layout("bad"))
    with pytest.raises(Exception):
        medallion.silver(spark, layout("bad"))
    assert not spark.catalog.tableExists("silver_bad.orders_cleaned")


def test_a_run_holds_no_shuffle_files_of_stored_tables(spark, tmp_path, monkeypatch):
    registry, seen = write_feeds(tmp_path), []
    before, real = shuffle_files(spark), medallion.write_table
    monkeypatch.setattr(medallion, "write_table", lambda *a, **b: real(*a, **b) or seen.append(shuffle_files(spark, before)))
    medallion.run(spark, registry, REF, layout("dropped"), hot_rows=60, chunk_rows=10)
    assert seen and max(seen) <= before


def test_feeds_may_go_once_the_raw_tables_are_stored(spark, stored, tmp_path):
    registry = write_feeds(tmp_path, spoilt=3)

    def drop():
        assert spark.table("bronze_gone.orders").count() == 401 and spark.table("bronze_gone.orders_quarantine").count() == 3
        for spec in registry.values():
            os.remove(spec.path)

    results = medallion.run(spark, registry, REF, layout("gone"), on_bronze=drop)
    assert not os.listdir(tmp_path)
    assert results["integrity"].collect() == stored[0]["integrity"].collect()


def test_the_cleaned_orders_are_checked_once(spark, tmp_path, monkeypatch):
    held, real = [], medallion.q.enforce
    monkeypatch.setattr(medallion.q, "enforce", lambda report: held.append(report) or real(report))
    medallion.run(spark, write_feeds(tmp_path), REF, layout("once"))
    assert len(held) == 2 and not any("Aggregate" in r._jdf.queryExecution().executedPlan().toString() for r in held)
