"""Dated entries beside a look at every interval for every capture; odd rows and names."""

import random
from datetime import datetime, timedelta

from trialflow.llm import urlfilter

START = datetime(2024, 1, 1)


def patterns(url):
    rest = url.split("://", 1)[-1]
    host, _, path = rest.partition("/")
    labels, steps = host.lower().split("."), [s for s in path.split("/") if s]
    return [".".join(labels[i:]) for i in range(len(labels))] + [host.lower() + "/" + "/".join(steps[: i + 1]) for i in range(len(steps))]


def brute_force(captures, entries):
    """(id, url, time) -> (verdict, pattern, list, active entries)."""
    groups = {}
    for name, pattern, action, at in entries:
        if pattern is not None and action is not None and at is not None:
            held = groups.setdefault((name, pattern), {})
            held[at] = max(action, held.get(at, ""))
    out = {}
    for i, url, at in captures:
        found = []
        for (name, pattern), dated in groups.items():
            times = sorted(t for t in dated if at is not None and t <= at)
            if url is not None and times and dated[times[-1]] != "remove" and pattern in patterns(url):
                found.append((-len(pattern), dated[times[-1]] != "allow", name, pattern, dated[times[-1]]))
        best = min(found, default=None)
        out[i, url, at] = (best[4], best[3], best[2], len(found)) if best else ("none", None, None, 0)
    return out


def test_verdicts_equal_every_interval(spark):
    rng = random.Random(2)
    hosts = ["a.com", "x.a.com", "b.org", "y.x.a.com", "com"]
    day = lambda: START + timedelta(days=rng.randrange(400), hours=rng.randrange(24))
    entries = [(rng.choice("lm"), rng.choice([*hosts, "a.com/p", "x.a.com/p/q", None]), rng.choice(["block", "allow", "remove", None]), rng.choice([day(), day(), None])) for _ in range(300)]
    entries += entries[:40]
    captures = [(i, f"http://{rng.choice(hosts)}/" + rng.choice(["", "p", "p/q/r"]), rng.choice([day(), day(), START - timedelta(1), None])) for i in range(200)]
    captures += captures[:30] + [(900, None, day()), (None, "http://a.com/", day()), (901, "http://" + "z" * 5000 + ".com/" + "s/" * 300, day())]
    given = spark.createDataFrame([(*c, "v", "r", 7) for c in captures], "capture_id long, url string, fetched_at timestamp, verdict string, rank string, period int")
    lists = spark.createDataFrame([(*e, "v", 8) for e in entries], "list string, pattern string, action string, listed_at timestamp, valid_to string, period int")
    got = urlfilter.temporal_list_join(given, lists).collect()
    want = brute_force(captures, entries)
    assert {(r["capture_id"], r["url"], r["fetched_at"]): (r["verdict"], r["pattern"], r["list"], r["n_active"]) for r in got} == want
    assert len(got) == len(want) and len({w[0] for w in want.values()}) == 3


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", START)], "capture_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([("l", "a.b", "block", START)], "list string, pattern string, action string, listed_at timestamp")
    assert [r["verdict"] for r in urlfilter.temporal_list_join(captures, entries.limit(0)).collect()] == ["none"]
    assert urlfilter.temporal_list_join(captures.limit(0), entries).count() == 0
    assert [r["verdict"] for r in urlfilter.temporal_list_join(captures, entries).collect()] == ["block"]
