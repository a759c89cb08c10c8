"""From raw documents to shuffled training shards: five stages, each a written table for the next.

Every stage takes documents with any further columns, whatever their names, keeps all columns of
the rows that it keeps, and gives an empty table for an empty one. What it does with rows without
id or text, and with repeated rows, stands at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialflow.llm import decontaminate, mixing, nearcopies, sharding, simhash, toxicity
from trialflow.session import stage

N_SHARDS = 40
#: SQL has neither spelling automata nor trees; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half; the labels' held-out fold is never learned from.

    Rows are judged one by one by their whole text: rows without text stay, repeated rows share their fate.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.not_toxic(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the smallest id.

    Texts are linked by op3's SimHash fingerprints (at most 2 bits apart), and by 5-word Jaccard 0.8 or
    more, which reaches copies with more changes. Texts without words are one component; rows without
    id stay; of rows that repeat an id one stays.
    """
    return nearcopies.one_of_each(docs, further=[simhash.near_duplicates(docs.filter("doc_id IS NOT NULL"))])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no verified overlap with a benchmark item.

    Rows are judged one by one; rows without text stay.
    """
    return decontaminate.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to smoothed source, language and topic weights, 60 percent of all tokens on average.

    A draw is fixed by id and text, so repeated rows share it; NULL is a source or language of its own;
    rows without words have no tokens to sample and go.
    """
    return mixing.sample_to_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in shuffled order, with shard and slot; every row is dealt, repeated ones each by itself."""
    return sharding.shuffle_into_shards(docs, N_SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
