"""Temporal list join: dated list entries become validity intervals, captures meet those then active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The end of an interval that is still open.
FOREVER = "9999-12-31 00:00:00"
#: Intervals and captures meet on pattern and period; a period is so many days.
PERIOD_DAYS = 64
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; NULL if the URL has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def patterns_of(url: Column) -> Column:
    """All patterns that can match a URL: its domains ("a.b"), and host with each path prefix ("a.b/c")."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.slice(labels, i, n)))
    steps = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")
    deep = F.size(steps)
    paths = F.when(deep > 0, F.transform(F.sequence(F.lit(1), deep), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, paths)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (list, pattern, action, listed_at) to intervals (list, pattern, action, valid_from, valid_to).

    An entry holds from its time until the next of the same list and pattern; "remove" ends the
    last one and holds nothing itself. Of entries with the same time the greatest action in the
    alphabet's order counts. Entries without pattern, action or time never hold.
    """
    dated = entries.select("list", "pattern", "action", "listed_at").dropna(subset=["pattern", "action", "listed_at"])
    one = dated.groupBy("list", "pattern", "listed_at").agg(F.max("action").alias("action"))
    ahead = Window.partitionBy("list", "pattern").orderBy("listed_at")
    return (
        one.withColumn("valid_to", F.coalesce(F.lead("listed_at").over(ahead), F.lit(FOREVER).cast("timestamp")))
        .filter(F.col("action") != "remove")
        .select("list", "pattern", "action", F.col("listed_at").alias("valid_from"), "valid_to")
    )


def _period(time: Column) -> Column:
    return F.floor(F.unix_micros(time) / (PERIOD_DAYS * 86_400_000_000))


def temporal_list_join(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (capture_id, url, fetched_at): verdict, the deciding pattern and list, and n_active.

    Every capture meets the entries that were active when it was fetched: valid_from <= fetched_at
    < valid_to. The longest matching pattern decides (a path over its host, a host over its
    domain); among equally long ones "allow" over "block", then the smaller list and pattern.
    Without an active entry the verdict is "none". The join is an equi-join on pattern and period:
    intervals are repeated for each period that they reach into up to the newest capture, so an
    old, often renewed pattern meets only its entries of that time, and adaptive execution splits
    a host that holds many captures.

    A capture without URL, host or time matches nothing; repeated captures are one row each per
    (capture_id, url, fetched_at); empty tables and clashing column names are fine, as only the
    named columns are read.
    """
    seen = captures.select("capture_id", "url", "fetched_at").distinct()
    newest = seen.agg(F.max("fetched_at")).first()[0]
    intervals = validity_intervals(entries)
    if newest is not None:
        intervals = intervals.filter(F.col("valid_from") <= F.lit(newest))
    until = F.least(F.col("valid_to"), F.lit(newest)) if newest is not None else F.col("valid_from")
    spread = intervals.withColumn("period", F.explode(F.sequence(_period(F.col("valid_from")), F.greatest(_period(F.col("valid_from")), _period(until)))))
    asked = (
        seen.withColumn("pattern", F.explode(patterns_of(F.col("url"))))
        .withColumn("period", _period(F.col("fetched_at")))
        .dropna(subset=["period"])
    )
    active = asked.join(spread, ["pattern", "period"]).filter(
        (F.col("valid_from") <= F.col("fetched_at")) & (F.col("fetched_at") < F.col("valid_to"))
    )
    rank = F.struct(
        (-F.length("pattern")).alias("a"), (F.col("action") != "allow").alias("b"), F.col("list").alias("c"), F.col("pattern").alias("d"), F.col("action").alias("e"),
    )
    key = ["capture_id", "url", "fetched_at"]
    nothing = seen.select(*key, F.lit(None).cast("struct<a:int,b:boolean,c:string,d:string,e:string>").alias("rank"))
    best = active.select(*key, rank.alias("rank")).unionByName(nothing).groupBy(*key).agg(F.min("rank").alias("best"), F.count("rank").alias("n_active"))
    return best.select(*key, F.coalesce("best.e", F.lit("none")).alias("verdict"), F.col("best.d").alias("pattern"), F.col("best.c").alias("list"), "n_active")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages carry no fetch time: the page id fixes one in 2024."""
    minutes = F.pmod(F.col("page_id") * 7919, F.lit(366 * 1440))
    fetched = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    return pages.select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries that the pages themselves give rise to: every 5th page reports its host (block,
    from the 1st of a month), every 7th lifts such a report, every 11th allows its first path step."""
    month = lambda k: F.add_months(F.lit("2024-01-01"), F.pmod(F.col("page_id") * k, F.lit(12)).cast("int")).cast("timestamp")
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), F.element_at(patterns_of(F.col("url")), -1).alias("path"))
    kinds = F.array(
        F.when(F.col("page_id") % 5 == 0, F.struct(F.lit("hosts").alias("list"), F.col("host").alias("pattern"), F.lit("block").alias("action"), month(3).alias("listed_at"))),
        F.when(F.col("page_id") % 7 == 0, F.struct(F.lit("hosts").alias("list"), F.col("host").alias("pattern"), F.lit("remove").alias("action"), month(5).alias("listed_at"))),
        F.when(F.col("page_id") % 11 == 0, F.struct(F.lit("paths").alias("list"), F.col("path").alias("pattern"), F.lit("allow").alias("action"), month(7).alias("listed_at"))),
    )
    return own.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("k.*").distinct()
