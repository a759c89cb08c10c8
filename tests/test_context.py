from datetime import datetime

from pyspark.sql import functions as F

from trialflow.functions.context import day_period, days_between, ticket_ratio


def test_day_periods_cover_the_clock(spark):
    df = spark.range(24).select(
        "id", F.make_timestamp(*map(F.lit, (2019, 1, 31)), F.col("id"), F.lit(59), F.lit(59)).alias("ts")
    )
    got = {r["id"]: r["p"] for r in df.select("id", day_period(F.col("ts")).alias("p")).collect()}
    assert [h for h in range(24) if got[h] == "night"] == [0, 1, 2, 3, 4, 5]
    assert [h for h in range(24) if got[h] == "morning"] == [6, 7, 8, 9, 10, 11]
    assert [h for h in range(24) if got[h] == "afternoon"] == [12, 13, 14, 15, 16, 17]
    assert [h for h in range(24) if got[h] == "evening"] == [18, 19, 20, 21, 22, 23]


def test_unknown_time_has_no_period(values):
    null = F.lit(None).cast("timestamp")
    row = values(own=day_period(null), legacy=day_period(null, legacy_null_bucket=True))
    assert (row["own"], row["legacy"]) == (None, "night")


def test_period_in_the_merchants_zone(values):
    ts = F.lit(datetime(2019, 1, 31, 1, 30)).cast("timestamp")
    row = values(utc=day_period(ts), local=day_period(ts, tz=F.lit("America/Sao_Paulo")))
    assert (row["utc"], row["local"]) == ("night", "evening")


def test_days_are_calendar_boundaries(values):
    late, early = F.to_timestamp(F.lit("2019-01-30 23:59:00")), F.to_timestamp(F.lit("2019-01-31 00:01:00"))
    row = values(one=days_between(late, early), back=days_between(early, late))
    assert (row["one"], row["back"]) == (1, -1)


def test_ticket_ratio_needs_a_positive_usual_ticket(spark):
    df = spark.createDataFrame([(30.0, 20.0), (30.0, 0.0), (30.0, -1.0), (30.0, None)], "a double, u double")
    assert [r[0] for r in df.select(ticket_ratio(F.col("a"), F.col("u"))).collect()] == [1.5, None, None, None]
