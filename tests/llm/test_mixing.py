"""Budgets, capped probabilities, convergence and column names of the mixing operator."""

import random

import pytest
from pyspark.sql import functions as F

from trialflow.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, probability int, c_lang string, tokens string, draw int, __tokens int, __row int, sampled string"


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    return [(i, "w " * rng.choice([30, 150, 400, 1500]), rng.choice(["en", "en", "de", None]), rng.choice("aabc")) for i in range(n)]


def framed(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, 4, "z") for r in rows], COLUMNS)


def test_the_budget_is_met_and_one_rare_cell_changes_little(spark):
    rows = corpus()
    before = mixing.mix(framed(spark, rows)).agg(F.sum(F.col("tokens") * F.col("probability")) / F.sum("tokens"), F.avg("probability")).first()
    assert before[0] == pytest.approx(mixing.KEEP, abs=1e-6)
    more = rows + [(9999, "w " * 20, "xx", "rare")]
    after = mixing.mix(framed(spark, more)).agg(F.sum(F.col("tokens") * F.col("probability")) / F.sum("tokens"), F.avg("probability")).first()
    assert after[0] == pytest.approx(mixing.KEEP, abs=1e-6) and after[1] == pytest.approx(before[1], rel=0.01)


def test_capped_cells_give_their_excess_to_others(spark):
    cells = spark.createDataFrame([("a", 100, 400.0), ("b", 1000, 900.0), ("c", 1000, 700.0), ("d", 0, 0.0)], "cell string, tokens long, weight double")
    got = {r["cell"]: r["probability"] for r in mixing.calibrated(cells, 0.6).collect()}
    # 1260 of 2100 tokens: all 100 of a, the other 1160 in proportion 9 to 7.
    assert got == {"a": 1.0, "b": pytest.approx(1160 * 9 / 16 / 1000, abs=1e-6), "c": pytest.approx(1160 * 7 / 16 / 1000, abs=1e-6), "d": 0.0}
    whole = {r["cell"]: r["probability"] for r in mixing.calibrated(cells, 1.0).collect()}
    assert whole == {"a": 1.0, "b": 1.0, "c": 1.0, "d": 0.0}
    assert {r["probability"] for r in mixing.calibrated(cells.withColumn("weight", F.lit(0.0)), 0.6).collect()} == {0.0}


def test_fitting_ends_when_it_has_converged(spark, monkeypatch):
    rounds = []
    real = mixing.stage
    monkeypatch.setattr(mixing, "stage", lambda df, label: rounds.append(label) or real(df, label))
    cells = spark.createDataFrame([(s, l, 100) for s in "ab" for l in "xyz"], "source string, lang string, tokens long")
    targets = {
        "source": spark.createDataFrame([("a", 0.7), ("b", 0.3)], "value string, share double"),
        "lang": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "value string, share double"),
    }
    got = mixing.rake(cells, targets, rounds=30).collect()
    assert rounds.count("mix-round") < 5
    assert {(r["source"], r["lang"]): round(r["weight"], 6) for r in got} == {
        ("a", "x"): 210, ("a", "y"): 210, ("a", "z"): 0, ("b", "x"): 90, ("b", "y"): 90, ("b", "z"): 0,
    }


def test_rows_of_any_kind_and_clashing_names(spark):
    rows = corpus(200) + [(1, None, "en", "a"), (2, "", None, None), (None, "w w w", "en", "a"), (5, "w " * 50000, "en", "b")] * 2
    docs = framed(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == ["id", "source", "lang", "topic", "tokens", "probability", "sampled"] and mixed.count() == len(rows)
    assert mixed.filter("tokens = 0 AND (sampled OR probability > 0)").count() == 0
    kept = mixing.sample_to_mix(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["id"] for r in mixed.filter("sampled").collect()), key=str)
    by_genre = mixing.mix(docs, topic=F.when(F.col("probability") == 1, "one"))
    assert {r["topic"] for r in by_genre.collect()} == {"one"}
    assert mixing.sample_to_mix(docs.limit(0)).count() == 0
