import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trialflow.llm import registry
from workload.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert difference(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name]) is None


def test_pipeline_stages_keep_columns_and_rows_of_their_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES:
        after = step(spark, docs, SF)
        assert after.columns[: len(docs.columns)] == docs.columns, name
        docs = after.select(*docs.columns)
    out = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in out.select("doc_id").collect()} <= ids
    assert out.groupBy("doc_id").count().filter(F.col("count") > 1).count() == 0
