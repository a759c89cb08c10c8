"""Catalog tables: create the schema, overwrite, read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARQUET_CODEC_CONF = "spark.sql.parquet.compression.codec"


def ensure_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create schema ``name`` (``schema`` or ``catalog.schema``) unless it is there."""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{place}")


def write_table(df: DataFrame, name: str, merge_schema: bool = False) -> None:
    """Overwrite managed table ``name``.

    The new schema replaces the old one. With ``merge_schema`` the columns only the old table
    has are kept, as NULLs; names are told apart as the session does. The format is the session's default source, and the two schema
    options are what table formats with schema enforcement ask for; others ignore them. Parquet is
    written with zstd unless the session names a codec: a table of carts takes six tenths of the room.
    """
    spark = df.sparkSession
    if merge_schema and spark.catalog.tableExists(name):
        same = str if spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower
        known = {same(column) for column in df.columns}
        df = df.withColumns(
            {
                f.name: F.lit(None).cast(f.dataType)
                for f in spark.table(name).schema
                if same(f.name) not in known
            }
        )
    option = "mergeSchema" if merge_schema else "overwriteSchema"
    writer = df.write.mode("overwrite").option(option, "true")
    if spark.conf.get("spark.sql.sources.default") == "parquet" and spark.conf.get(PARQUET_CODEC_CONF, None) is None:
        writer = writer.option("compression", "zstd")
    writer.saveAsTable(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
