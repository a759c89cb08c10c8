from frames import plan_of, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from trialflow.operators.dedup import dedup_latest, duplicate_sample, find_duplicates

SCHEMA = "k string, ts timestamp, v int"
rows = st.lists(
    st.tuples(
        st.sampled_from(["a", "b", "c", None]),
        st.datetimes(
            min_value=__import__("datetime").datetime(2019, 1, 1),
            max_value=__import__("datetime").datetime(2019, 1, 2),
        ).map(lambda t: t.replace(minute=0, second=0, microsecond=0)),
        st.integers(0, 3),
    ),
    max_size=40,
)


@settings(max_examples=12, deadline=None)
@given(rows)
def test_keeps_the_newest_row_of_each_key(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    got = rows_of(dedup_latest(df, ["k"], "ts"))
    want = []
    for key in {k for k, _, _ in data}:
        group = [r for r in data if r[0] == key]
        newest = max(ts for _, ts, _ in group)
        want.append(min(r for r in group if r[1] == newest))
    assert got == sorted(want, key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert rows_of(dedup_latest(dedup_latest(df, ["k"], "ts"), ["k"], "ts")) == got


@settings(max_examples=8, deadline=None)
@given(rows)
def test_duplicates_and_their_sample(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    counts = {k: sum(r[0] == k for r in data) for k in {r[0] for r in data}}
    repeated = {k: n for k, n in counts.items() if n > 1}
    assert dict(rows_of(find_duplicates(df, ["k"]))) == repeated
    sample = [tuple(r) for r in duplicate_sample(df, ["k"], "ts", 5, ["v"]).collect()]
    order = lambda r: (r[0] is not None, r[0] or "", -r[1].timestamp(), r[2])
    assert sample == sorted((r for r in data if r[0] in repeated), key=order)[:5]


def test_losers_are_dropped_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 7 as k", "timestamp_seconds(id) as ts", "id as v")
    plan = plan_of(dedup_latest(df, ["k"], "ts"))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_survivor_does_not_depend_on_partitioning(spark):
    df = spark.range(4000).selectExpr("id % 5 as k", "timestamp'2019-01-01' as ts", "id as v")
    kept = [rows_of(dedup_latest(df.repartition(n), ["k"], "ts")) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and [r[2] for r in kept[0]] == [0, 1, 2, 3, 4]
