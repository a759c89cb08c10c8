"""Schema-enforced file sources."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trialflow.sources import schemas
from trialflow.sources.tables import ensure_schema, write_table

UNSPLITTABLE = (".gz", ".zst", ".snappy", ".lz4")
#: A feed of this many compressed files for each core, none this many times as large as the mean, is not spread.
#: With both numbers the same no file exceeds a core's share of the bytes.
FILES_PER_CORE, LARGEST_FILE = 2, 2
#: Formats whose records may fail to load under the schema.
TEXT_FORMATS = ("json", "csv")
CORRUPT = "_corrupt_record"
QUARANTINE_SUFFIX = "_quarantine"
QUARANTINE = {"file": "string", "record": "string", "malformed": "boolean", "lost": "array<string>"}

JSON_OPTIONS = {"timestampFormat": schemas.TIMESTAMP_FORMAT}
CSV_OPTIONS = {"header": "true", "sep": ",", "timestampFormat": schemas.TIMESTAMP_FORMAT}


@dataclass(frozen=True)
class SourceSpec:
    """One feed: where it lies, how to read it, and the schema it must have.

    ``rebalance`` says whether rows are spread anew before they are stored; by default that
    depends on whether one of the files found is compressed.
    """

    format: str
    path: str | list[str]
    schema: str | StructType | None
    options: Mapping[str, str] = field(default_factory=dict)
    rebalance: bool | None = None

    @property
    def fields(self) -> list[StructField]:
        schema = self.schema
        return (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields


def read_source(spark: SparkSession, spec: SourceSpec, corrupt: str | None = None) -> DataFrame:
    """The feed as a DataFrame. A missing schema is refused rather than inferred.

    ``corrupt`` names a further column for the text of records that did not load whole.
    """
    if not spec.schema:
        raise ValueError(f"an explicit schema is required to read {spec.path}")
    fields, options = spec.fields, dict(spec.options)
    if corrupt:
        fields = [*fields, StructField(corrupt, StringType())]
        options["columnNameOfCorruptRecord"] = corrupt
    return spark.read.format(spec.format).options(**options).schema(StructType(fields)).load(spec.path)


def is_uneven(df: DataFrame, spec: SourceSpec) -> bool:
    """Whether rows are to be spread: a compressed file is one task however large it is."""
    if spec.rebalance is not None:
        return spec.rebalance
    return any(path.lower().endswith(UNSPLITTABLE) for path in df.inputFiles())


def is_well_cut(spark: SparkSession, spec: SourceSpec) -> bool:
    """Whether the feed's files keep all cores busy as they are: several for each, of like sizes."""
    files = spark.read.format("binaryFile").load(spec.path).select("length")
    n, largest, total = files.agg(F.count("*"), F.max("length"), F.sum("length")).first()
    return n >= FILES_PER_CORE * spark.sparkContext.defaultParallelism and largest * n <= LARGEST_FILE * total


def quarantined(raw: DataFrame, spec: SourceSpec, corrupt: str = CORRUPT) -> DataFrame:
    """(file, record, malformed, lost) of the records in ``raw`` that did not load whole.

    A record is malformed if it is no record of the format at all, or has too many or too few
    fields. ``lost`` names the columns for which the record has a value that became NULL; the
    record is read again as strings to tell these from values that were missing.
    """
    strings = StructType([StructField(f.name, StringType()) for f in spec.fields] + [StructField(corrupt, StringType())])
    options = {**spec.options, "columnNameOfCorruptRecord": corrupt}
    if spec.format == "csv":
        text: Column = F.from_csv(F.col(corrupt), strings.simpleString()[len("struct<") : -1].replace(":", " "), options)
    else:
        text = F.from_json(F.col(corrupt), strings, options)
    parsed = raw.filter(F.col(corrupt).isNotNull()).withColumns({"_file": F.input_file_name(), "_text": text})
    lost = [F.when(F.col(f.name).isNull() & F.col("_text")[f.name].isNotNull(), F.lit(f.name)) for f in spec.fields]
    malformed = F.col("_text").isNull() | F.col("_text")[corrupt].isNotNull()
    return parsed.select(
        F.col("_file").alias("file"), F.col(corrupt).alias("record"), malformed.alias("malformed"), F.array_compact(F.array(*lost)).alias("lost")
    )


def ingest(spark: SparkSession, spec: SourceSpec, table: str, quarantine: str | None = None) -> DataFrame:
    """Load a feed into ``table`` (replacing it) and return the stored table.

    A compressed text file is one task however large it is. Unless there are many of like sizes, rows
    are handed on through a rebalancing exchange, so the table gets files of the advisory size and
    every later stage reads it in parallel. Failures are raised: a stale table must not pass for a fresh one.

    Values that do not load are NULL in ``table``. ``quarantine`` names a second table, replaced
    too, that keeps the records they come from (see ``quarantined``). Whether there are any is
    seen while the rows are stored; only then is the feed read again.
    """
    capture = quarantine is not None and spec.format in TEXT_FORMATS
    raw = read_source(spark, spec, CORRUPT if capture else None)
    rows, seen = raw, Observation()
    if capture:
        rows = raw.observe(seen, F.count_if(F.col(CORRUPT).isNotNull()).alias("corrupt")).drop(CORRUPT)
    if is_uneven(raw, spec) and (spec.rebalance or not is_well_cut(spark, spec)):
        rows = rows.hint("rebalance")
    write_table(rows, table)
    if quarantine is not None:
        if capture and seen.get["corrupt"]:
            kept = quarantined(raw, spec)
        else:
            kept = spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in QUARANTINE.items()])
        write_table(kept, quarantine)
    return spark.table(table)


def ingest_all(
    spark: SparkSession, registry: Mapping[str, SourceSpec], database: str, quarantine: bool = False
) -> dict[str, DataFrame]:
    """Load every feed of ``registry`` into ``database`` under its own name.

    With ``quarantine`` each has a second table for records that did not load whole.
    """
    ensure_schema(spark, database)
    return {
        name: ingest(
            spark, spec, f"{database}.{name}", f"{database}.{name}{QUARANTINE_SUFFIX}" if quarantine else None
        )
        for name, spec in registry.items()
    }


def default_registry(folder: str, names: Iterable[str] | None = None) -> dict[str, SourceSpec]:
    """The four feeds under ``folder``, in their usual file names and formats."""
    registry = {
        "orders": SourceSpec(
            "json", f"{folder}/order.json.gz", schemas.ORDERS, JSON_OPTIONS
        ),
        "consumers": SourceSpec(
            "csv", f"{folder}/consumer.csv.gz", schemas.CONSUMERS, CSV_OPTIONS
        ),
        "restaurants": SourceSpec(
            "csv", f"{folder}/restaurant.csv.gz", schemas.RESTAURANTS, CSV_OPTIONS
        ),
        "ab_test_users": SourceSpec(
            "csv", f"{folder}/ab_test_ref.csv", schemas.AB_TEST_USERS, CSV_OPTIONS
        ),
    }
    return {name: registry[name] for name in names or registry}
