import gzip
from datetime import datetime
from pathlib import Path
from types import SimpleNamespace

import pytest
from frames import plan_of, rows_of, shuffle_files
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from trialflow.operators import quality as q
from trialflow.session import SHUFFLE_CLEANUP_CONF, at_end_of_run, run_scope, scratch_path, shared_dir, shuffles_dropped, stage
from trialflow.sources import schemas
from trialflow.sources import files
from trialflow.sources.files import (
    CSV_OPTIONS,
    JSON_OPTIONS,
    SourceSpec,
    default_registry,
    ingest,
    ingest_all,
    is_uneven,
    read_source,
)
from trialflow.sources.tables import ensure_schema, read_table, write_table


def gz(path, text):
    with gzip.open(path, "wt") as out:
        out.write(text)
    return str(path)


@pytest.fixture
def feeds_folder(tmp_path):
    gz(
        tmp_path / "order.json.gz",
        '{"order_id":"o1","customer_id":"c1","order_created_at":"2019-01-05T22:50:06.000Z",'
        '"order_total_amount":46.0,"items":"[]","order_scheduled":false}\n'
        '{"order_id":"o2","customer_id":"c2","order_created_at":"2019-01-05T22:50:06Z"}\n'
        "{broken\n",
    )
    gz(
        tmp_path / "consumer.csv.gz",
        "customer_id,language,created_at,active,customer_name,customer_phone_area,"
        "customer_phone_number\nc1,pt-br,2018-04-05T14:49:18.165Z,true,ANA,46,816\n",
    )
    gz(
        tmp_path / "restaurant.csv.gz",
        "id,created_at,enabled,price_range,average_ticket,delivery_time,minimum_order_value,"
        "merchant_zip_code,merchant_city,merchant_state,merchant_country\n"
        "r1,2017-01-23T12:52:30.910Z,false,3,60.0,50,30.0,14025,RIBEIRAO PRETO,SP,BR\n",
    )
    (tmp_path / "ab_test_ref.csv").write_text("customer_id,is_target\nc1,target\nc2,control\n")
    return str(tmp_path)


def test_every_feed_lands_in_its_table(spark, feeds_folder):
    tables = ingest_all(spark, default_registry(feeds_folder), "bronze_all")
    assert {name: df.count() for name, df in tables.items()} == {
        "orders": 3,
        "consumers": 1,
        "restaurants": 1,
        "ab_test_users": 2,
    }
    assert len(tables["orders"].columns) == 22
    assert tables["restaurants"].first()["average_ticket"] == 60.0
    assert tables["consumers"].first()["created_at"] == datetime(2018, 4, 5, 14, 49, 18, 165000)


def test_times_are_read_as_utc_and_other_forms_are_null(spark, feeds_folder):
    spec = default_registry(feeds_folder)["orders"]
    rows = {r["order_id"]: r for r in read_source(spark, spec).collect()}
    assert rows["o1"]["order_created_at"] == datetime(2019, 1, 5, 22, 50, 6)
    assert rows["o2"]["order_created_at"] is None
    assert all(v is None for v in rows[None])


def test_schema_is_required(spark, feeds_folder):
    with pytest.raises(ValueError, match="explicit schema"):
        read_source(spark, SourceSpec("csv", f"{feeds_folder}/ab_test_ref.csv", None))


def test_a_failed_load_is_raised(spark, feeds_folder):
    ensure_schema(spark, "bronze_missing")
    spec = SourceSpec("json", f"{feeds_folder}/nothing.json.gz", schemas.ORDERS, JSON_OPTIONS)
    with pytest.raises(AnalysisException):
        ingest(spark, spec, "bronze_missing.orders")
    assert not spark.catalog.tableExists("bronze_missing.orders")


def test_compressed_files_are_spread_before_storing(spark, feeds_folder, tmp_path):
    registry = default_registry(feeds_folder)
    uneven = lambda spec: is_uneven(read_source(spark, spec), spec)
    assert uneven(registry["orders"]) and not uneven(registry["ab_test_users"])
    assert uneven(SourceSpec("csv", f"{feeds_folder}/ab_test_ref.csv", "a int", rebalance=True))
    assert default_registry(feeds_folder, ["orders"]).keys() == {"orders"}
    spark.range(9).selectExpr("id AS a").write.option("compression", "gzip").json(str(tmp_path / "packed"))
    spark.range(9).selectExpr("id AS a").write.json(str(tmp_path / "plain"))
    packed, plain = (SourceSpec("json", str(tmp_path / name), "a long") for name in ("packed", "plain"))
    assert uneven(packed) and not uneven(plain)
    assert uneven(SourceSpec("json", [plain.path, packed.path], "a long"))


def reports(df):
    return {r["check"]: (r["violations"], r["total"], r["passed"]) for r in df.collect()}


def test_records_that_do_not_load_are_kept(spark, tmp_path):
    gz(
        tmp_path / "order.json.gz",
        '{"order_id":"o1","order_created_at":"2019-01-05T22:50:06.000Z","order_total_amount":46.0}\n'
        '{"order_id":"o2","order_created_at":"2019-01-05T22:50:06Z","order_total_amount":"n/a"}\n'
        "{broken\n"
        '{"order_id":"o3","order_total_amount":"12"}\n'
        '{"order_id":"o4","order_total_amount":null}\n',
    )
    (tmp_path / "p.csv").write_text(
        "id,n,at\na,1,2019-01-05T22:50:06.000Z\nb,x,2019-01-05T22:50:06.000Z\nc\nd,1,2019-01-05T22:50:06.000Z,9\ne,,\nf,y,never\n"
    )
    ensure_schema(spark, "bronze_kept")
    orders = SourceSpec("json", f"{tmp_path}/order.json.gz", schemas.ORDERS, JSON_OPTIONS)
    people = SourceSpec("csv", f"{tmp_path}/p.csv", "id string, n int, at timestamp", CSV_OPTIONS)
    tables = ingest_all(spark, {"orders": orders, "people": people}, "bronze_kept", quarantine=True)
    assert tables["orders"].columns == [f.name for f in orders.fields] and tables["orders"].count() == 5
    kept = {r["record"]: (r["malformed"], r["lost"]) for r in spark.table("bronze_kept.orders_quarantine").collect()}
    assert sorted(kept.values(), key=str) == [(False, ["order_created_at", "order_total_amount"]), (False, ["order_total_amount"]), (True, [])]
    assert kept["{broken"] == (True, [])
    got = {r["record"]: (r["malformed"], r["lost"]) for r in spark.table("bronze_kept.people_quarantine").collect()}
    assert got == {
        "b,x,2019-01-05T22:50:06.000Z": (False, ["n"]), "c": (True, []),
        "d,1,2019-01-05T22:50:06.000Z,9": (True, []), "f,y,never": (False, ["n", "at"]),
    }
    report = q.load_checks(tables["people"], spark.table("bronze_kept.people_quarantine"), "people", ["n", "at", "id"])
    assert reports(report) == {
        "people: records are well-formed": (2, 6, False), "people: n loads": (2, 6, False),
        "people: at loads": (1, 6, False), "people: id loads": (0, 6, True),
    }
    whole = q.table_checks(tables["people"], "people", null_share={"n": 0.7, "at": 0.3})
    assert reports(whole) == {"people: at most 70% of n is null": (4, 6, True), "people: at most 30% of at is null": (3, 6, False)}
    (tmp_path / "p.csv").write_text("id,n,at\na,1,2019-01-05T22:50:06.000Z\n")
    ingest(spark, people, "bronze_kept.people", "bronze_kept.people_quarantine")
    assert spark.table("bronze_kept.people_quarantine").count() == 0
    assert reports(q.load_checks(tables["people"].limit(0), spark.table("bronze_kept.people_quarantine"), "p", [])) == {
        "p: records are well-formed": (0, 0, True)
    }


def test_formats_with_types_of_their_own_have_an_empty_quarantine(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "ids"))
    ensure_schema(spark, "bronze_typed")
    ingest(spark, SourceSpec("parquet", str(tmp_path / "ids"), "id long"), "bronze_typed.ids", "bronze_typed.ids_quarantine")
    assert spark.table("bronze_typed.ids").count() == 3 and spark.table("bronze_typed.ids_quarantine").count() == 0


def test_a_run_removes_what_it_staged(spark):
    with run_scope(spark) as outer:
        first = stage(spark.range(3))
        with run_scope(spark) as inner:
            stage(spark.range(4))
            ensure_schema(spark, "t_scoped")
            at_end_of_run(spark.sql, "DROP SCHEMA t_scoped")
            assert Path(inner.folder.removeprefix("file:")).exists()
        assert not Path(inner.folder.removeprefix("file:")).exists() and not spark.catalog.databaseExists("t_scoped")
        assert first.count() == 3
    assert not Path(outer.folder.removeprefix("file:")).exists()
    with pytest.raises(RuntimeError), run_scope(spark) as failed:
        stage(spark.range(3))
        raise RuntimeError
    assert not Path(failed.folder.removeprefix("file:")).exists()
    at_end_of_run(print, "never called")


def test_a_cluster_may_not_stage_on_one_machine(spark):
    def session(master, **named):
        conf = SimpleNamespace(get=lambda name, *default: named.get(name) or (default[0] if default else "spark-warehouse"))
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master), _jvm=spark._jvm, _jsc=spark._jsc)

    assert shared_dir(session("local[4]")) == "spark-warehouse/_staging"
    assert shared_dir(session("yarn", **{"spark.checkpoint.dir": "file:/mnt/all/"})) == "file:/mnt/all"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))


def test_csv_and_json_written_with_the_options_read_back(spark, tmp_path):
    df = spark.sql("select 'c1' customer_id, timestamp'2019-01-01 10:11:12.345' created_at")
    df.write.options(**CSV_OPTIONS).csv(str(tmp_path / "csv"))
    df.write.options(**JSON_OPTIONS).json(str(tmp_path / "json"))
    schema = "customer_id string, created_at timestamp"
    for format_, options in (("csv", CSV_OPTIONS), ("json", JSON_OPTIONS)):
        spec = SourceSpec(format_, str(tmp_path / format_), schema, options)
        assert read_source(spark, spec).collect() == df.collect()


def test_overwrite_replaces_rows_and_schema(spark):
    ensure_schema(spark, "t_replace")
    ensure_schema(spark, "t_replace")
    write_table(spark.sql("select 1 a, 'x' b"), "t_replace.t")
    write_table(spark.sql("select 2 a, true c"), "t_replace.t")
    assert read_table(spark, "t_replace.t").columns == ["a", "c"]
    assert rows_of(read_table(spark, "t_replace.t")) == [(2, True)]


def test_merging_keeps_old_columns_as_nulls(spark):
    ensure_schema(spark, "t_merge")
    write_table(spark.sql("select 1 a, 'x' b"), "t_merge.t", merge_schema=True)
    write_table(spark.sql("select 2 a, true c"), "t_merge.t", merge_schema=True)
    table = read_table(spark, "t_merge.t")
    assert rows_of(table, "a", "b", "c") == [(2, None, True)]
    assert dict(table.dtypes)["b"] == "string"


def test_shared_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named.rstrip("/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_staged_frames_are_read_from_storage(spark):
    staged = stage(spark.range(5).withColumn("x", F.rand(3)))
    assert staged.collect() == staged.collect()
    assert "FileScan parquet" in staged._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sensitive, kept", [("false", 2), ("true", None)])
def test_merging_tells_names_apart_as_the_session_does(spark, sensitive, kept):
    name = f"default.case_{sensitive}"
    write_table(spark.createDataFrame([(1, 5)], "id long, A long"), name)
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", sensitive)
    try:
        write_table(spark.createDataFrame([(1, 2)], "id long, a long"), name, merge_schema=True)
        row = spark.table(name).first().asDict()
        assert row["a"] == 2
        assert row.get("A") is None
        assert ("A" in row) == (kept is None)
    finally:
        spark.sql(f"DROP TABLE {name}")
        spark.conf.set("spark.sql.caseSensitive", before)


def test_many_compressed_files_of_like_sizes_are_not_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILES_PER_CORE", 1)
    few, many, uneven = (SourceSpec("json", str(tmp_path / name), "a long") for name in ("few", "many", "uneven"))
    n = spark.sparkContext.defaultParallelism
    for spec, rows, parts in ((few, n * 100, n - 1), (many, n * 100, n), (uneven, n, n)):
        spark.range(rows, numPartitions=parts).selectExpr("id AS a").write.option("compression", "gzip").json(spec.path)
    spark.range(0, 100000, 1, 1).selectExpr("id AS a").write.mode("append").option("compression", "gzip").json(uneven.path)
    assert [files.is_well_cut(spark, spec) for spec in (few, many, uneven)] == [False, True, False]
    ensure_schema(spark, "bronze_cut")
    assert ingest(spark, many, "bronze_cut.many").count() == n * 100
    assert len(spark.table("bronze_cut.many").inputFiles()) == n


def test_an_empty_quarantine_takes_no_python_workers(spark, tmp_path, monkeypatch):
    stored = {}
    monkeypatch.setattr(files, "write_table", lambda df, name, **options: stored.update({name: df}) or write_table(df, name, **options))
    (tmp_path / "p.csv").write_text("id\na\n")
    ensure_schema(spark, "bronze_whole")
    ingest(spark, SourceSpec("csv", f"{tmp_path}/p.csv", "id string", CSV_OPTIONS), "bronze_whole.p", "bronze_whole.p_quarantine")
    assert "RDD" not in plan_of(stored["bronze_whole.p_quarantine"])
    kinds = [f.dataType.simpleString() for f in spark.table("bronze_whole.p_quarantine").schema]
    assert kinds == ["string", "string", "boolean", "array<string>"]


def test_two_compressed_files_for_each_core_are_enough_unless_one_exceeds_a_share(spark, tmp_path):
    n = 2 * spark.sparkContext.defaultParallelism
    even, uneven = (SourceSpec("json", str(tmp_path / name), "a long") for name in ("even", "uneven"))
    for spec, rows in ((even, n * 100), (uneven, n)):
        spark.range(rows, numPartitions=n).selectExpr("id AS a").write.option("compression", "gzip").json(spec.path)
    spark.range(0, 100000, 1, 1).selectExpr("id AS a").write.mode("append").option("compression", "gzip").json(uneven.path)
    assert [files.is_well_cut(spark, spec) for spec in (even, uneven)] == [True, False]


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    before, set_to = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    with shuffles_dropped(spark):
        kept = stage(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
        assert kept.count() == 7
        twice = kept.groupBy("count").agg(F.max("k").alias("k"))
        assert rows_of(twice) == rows_of(twice) == [(142, 6), (143, 5)]
    assert shuffle_files(spark, before) <= before
    assert spark.conf.get(SHUFFLE_CLEANUP_CONF, None) == set_to


def test_tables_are_compressed_with_zstd_unless_the_session_names_a_codec(spark):
    ensure_schema(spark, "t_codec")
    codecs = lambda: {path.split(".")[-2] for path in spark.table("t_codec.t").inputFiles()}
    write_table(spark.range(5), "t_codec.t")
    assert codecs() == {"zstd"}
    spark.conf.set("spark.sql.parquet.compression.codec", "gzip")
    try:
        write_table(spark.range(5), "t_codec.t")
        assert codecs() == {"gz"} and spark.table("t_codec.t").count() == 5
    finally:
        spark.conf.unset("spark.sql.parquet.compression.codec")
