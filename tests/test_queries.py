from pathlib import Path

import pytest
from frames import plan_of

from __spark_entry__ import entry, oracle_sql, queries
from trialflow.session import run_scope
from workload.compare import connect, difference
from workload.oracle import ORACLE
from workload.queries import ALL, JOB, of_job, run_job

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_its_sql():
    assert ALL.keys() == ORACLE.keys()
    assert ALL.keys() <= queries().keys()
    assert oracle_sql().keys() <= queries().keys()


@pytest.fixture(scope="module")
def job(spark):
    """One run of the whole job, which all pipeline queries read."""
    return run_job(spark, SF)


@pytest.mark.parametrize("name", [name for name in ALL if name not in JOB])
def test_query_equals_its_sql(spark, duck, name):
    with run_scope(spark) as run:
        df = ALL[name](spark, SF)
        assert "Python" not in plan_of(df)
        assert difference(df, duck, ORACLE[name]) is None
    assert not Path(run.folder.removeprefix("file:")).exists()


@pytest.mark.parametrize("name", list(JOB))
def test_result_of_the_job_equals_its_sql(job, duck, name):
    df = of_job(job, name)
    assert "Python" not in plan_of(df)
    assert difference(df, duck, ORACLE[name]) is None


def test_the_job_leaves_only_its_tables_behind(spark):
    with run_scope(spark) as run:
        run_job(spark, SF)
        kept = {p.name.split("-")[0] for p in Path(run.folder.removeprefix("file:")).iterdir()}
        assert kept == {"feeds", "schema"}
    assert not Path(run.folder.removeprefix("file:")).exists()
    assert not any("trialflow_" in r[0] and spark.catalog.listTables(r[0]) == [] for r in spark.sql("SHOW SCHEMAS").collect())


def test_entry_gives_both_arms(spark):
    assert {r["arm"] for r in entry(spark).collect()} == {"control", "target"}


def test_the_jobs_feeds_go_once_they_are_stored(spark):
    with run_scope(spark) as run:
        run_job(spark, SF)
        feeds = [p for p in Path(run.folder.removeprefix("file:")).glob("feeds-*/**/*") if p.is_file()]
        assert feeds == []
