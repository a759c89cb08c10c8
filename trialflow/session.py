"""Session settings the operators rely on, and lineage cuts that survive lost executors."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pin_utc(spark: SparkSession) -> SparkSession:
    """Order times are UTC instants; hours and day counts must not follow the host's zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder.

    It is the one named by ``spark.checkpoint.dir``; where that is unset, a folder in the
    session's own table storage. On a cluster that one may not be a folder of the driver's
    machine, which other machines would neither see nor fill.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    storage = spark.conf.get(WAREHOUSE_CONF).rstrip("/")
    one_machine = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
    if not one_machine and _qualified(spark, storage).startswith("file:"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share; {storage} is local")
    return storage + "/_staging"


@dataclass
class Run:
    """What one run owns: its scratch folder, and what else is to be undone when it ends."""

    folder: str
    undo: ExitStack


_RUN: ContextVar[Run | None] = ContextVar("trialflow_run", default=None)


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[Run]:
    """Everything staged inside goes to one folder, which is removed at the end.

    Results that read staged data must be stored inside the scope. Scopes may be nested: the
    inner one removes what was staged within it, the outer one the rest.
    """
    run = Run(f"{shared_dir(spark)}/run-{uuid.uuid4().hex}", ExitStack())
    token = _RUN.set(run)
    try:
        yield run
    finally:
        _RUN.reset(token)
        run.undo.callback(remove, spark, run.folder)
        run.undo.close()


def at_end_of_run(undo, *args) -> None:
    """Call ``undo(*args)`` when the current run ends; without a run, never."""
    run = _RUN.get()
    if run:
        run.undo.callback(undo, *args)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a write or an action go when it ends.

    Else they stay until the driver happens to collect its garbage, and a run of many stages holds
    the shuffles of all of them on disk. For code that stores what it reads more than once: a
    DataFrame executed a second time makes its shuffle files anew.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_CONF)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_CONF, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _qualified(spark: SparkSession, path: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder, or the current run's, that nothing else uses."""
    run = _RUN.get()
    return f"{run.folder if run else shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, columnar, prunable."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
