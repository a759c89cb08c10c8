"""Two-pass external shuffle: scatter into memory-sized buckets, then Fisher-Yates within each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialflow.session import stage

#: Bytes of records that one bucket holds on average; a bucket is shuffled in one task.
BUCKET_BYTES = 32 << 20
#: Buckets at least, so that small inputs use all cores.
MIN_BUCKETS = 16
#: Buckets whose offsets are summed up in one task before the groups' own sums.
OFFSET_GROUP = 1024
#: A bucket of so many times the mean number of rows, and so many at least, holds rows that repeat; these are spread.
CROWDED, CROWDED_ROWS = 4, 20_000
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


def record_bytes(text: str) -> Column:
    """UTF-8 bytes of the text (NULL: none) and a fixed share for the record itself."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def bucket_positions(counts: DataFrame, seed: int) -> DataFrame:
    """Per bucket (bucket, n): the global positions of its rows, in Fisher-Yates order.

    A bucket's first position is the number of rows in all buckets before it: a sum within
    groups of OFFSET_GROUP buckets, and a sum over the groups.
    """
    counts = counts.withColumn("part", F.floor(F.col("bucket") / OFFSET_GROUP))
    parts = counts.groupBy("part").agg(F.sum("n").alias("n_part"))
    before_part = parts.select(
        "part",
        F.coalesce(F.sum("n_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_part"),
    )
    within = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before_part") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return (
        counts.join(before_part, "part")
        .select("bucket", first.alias("first"), "n")
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle(F.sequence("first", F.col("first") + F.col("n") - 1), seed).alias("positions"))
    )


def shuffle_into_shards(
    records: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``records`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Pass one scatters rows by a seeded hash of id and text into buckets of about ``bucket_bytes``, or CROWDED_ROWS short rows;
    pass two gives the rows of each bucket, numbered in a fixed order, a Fisher-Yates permutation
    of the positions that belong to the bucket. Position p goes to shard p mod n_shards, slot
    p div n_shards, so that shard sizes are at most one row apart. The permutations are a written
    table: a lost executor cannot change them.

    Rows equal in id and text have one hash. Where they crowd a bucket, they are written once with
    a number each, which then takes part in the choice of the bucket.

    NULL ids and texts are hashed and ordered like values; empty and very long texts only change
    the number of buckets; rows that repeat each get a position of their own; an empty table gives
    an empty result; other columns pass through whatever their names are, and columns named shard or
    slot are replaced.
    """
    records = records.drop("shard", "slot")
    total, n_rows = records.agg(F.sum(record_bytes(text_col)), F.count("*")).first()
    n_buckets = max(MIN_BUCKETS, math.ceil((total or 0) / bucket_bytes), math.ceil(n_rows / CROWDED_ROWS))
    of_hash = F.pmod(F.xxhash64(F.lit(seed + 1), "__hash", "__salt"), F.lit(n_buckets))
    packed = records.select(F.struct("*").alias("__row"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("__hash"), F.col(id_col).alias("__id"))
    scattered = packed.withColumn("__salt", F.lit(0).cast("long")).withColumn("__bucket", of_hash)
    counts = stage(scattered.groupBy(F.col("__bucket").alias("bucket")).agg(F.count("*").alias("n")), "bucket-counts")
    limit = max(CROWDED_ROWS, CROWDED * n_rows // n_buckets)
    crowded = counts.filter(F.col("n") > limit)
    if not crowded.isEmpty():
        among = scattered.join(F.broadcast(crowded.select(F.col("bucket").alias("__bucket"))), "__bucket", "left_semi")
        hot = stage(among.groupBy("__hash").agg(F.count("*").alias("n")).filter(F.col("n") > limit // 2).select(F.col("__hash").alias("__hot")), "hot-hashes")
        # There are at most 2 rows / limit of them, fewer than buckets.
        is_hot = F.col("__hash") == F.col("__hot")
        numbered = stage(packed.join(F.broadcast(hot), is_hot, "left_semi").withColumn("__salt", F.monotonically_increasing_id()), "hot-rows")
        others = packed.join(F.broadcast(hot), is_hot, "left_anti").withColumn("__salt", F.lit(0).cast("long"))
        scattered = others.unionByName(numbered).withColumn("__bucket", of_hash)
        counts = scattered.groupBy(F.col("__bucket").alias("bucket")).agg(F.count("*").alias("n"))
    positions = stage(bucket_positions(counts, seed), "bucket-positions")
    in_order = Window.partitionBy("__bucket").orderBy("__hash", "__id", "__salt")
    return (
        scattered.withColumn("__nth", F.row_number().over(in_order))
        .join(positions, F.col("__bucket") == F.col("bucket"))
        .withColumn("__position", F.element_at("positions", F.col("__nth")))
        .select("__row.*", F.pmod("__position", F.lit(n_shards)).cast("int").alias("shard"), F.floor(F.col("__position") / n_shards).cast("long").alias("slot"))
    )
