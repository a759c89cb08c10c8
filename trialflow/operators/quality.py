"""Data-quality checks. Each is a DataFrame; nothing runs until a report is stored or enforced."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"


class QualityError(AssertionError):
    """A check of severity ``error`` found violations."""


def table_checks(
    df: DataFrame,
    name: str,
    not_null: Sequence[str] = (),
    at_least: Mapping[str, float] | None = None,
    unique: Sequence[str] = (),
    unique_severity: str = ERROR,
    null_share: Mapping[str, float] | None = None,
) -> DataFrame:
    """All row-level and key checks of one table, in one pass over it.

    ``null_share`` warns of columns of which more than a share is NULL. With a ``unique`` key the rows are counted per key first. Counts combine before the
    shuffle, so a key that holds a large part of the table arrives as one row per map task.
    """
    rules = {f"{name}: {c} is not null": F.col(c).isNull() for c in not_null}
    for column, low in (at_least or {}).items():
        rules[f"{name}: {column} >= {low:g}"] = F.col(column) < low
    shares = list((null_share or {}).items())
    conditions = [*rules.values(), *[F.col(c).isNull() for c, _ in shares]]
    counted = [F.count_if(rule).alias(f"v{i}") for i, rule in enumerate(conditions)]
    totals = [F.count(F.lit(1)).alias("total"), *counted]
    if unique:
        per_key = df.groupBy(*unique).agg(*totals)
        zero = F.lit(0).cast("bigint")
        sums = [
            F.coalesce(F.sum(c), zero).alias(c) for c in per_key.columns if c not in unique
        ]
        result = per_key.agg(*sums, F.count(F.lit(1)).alias("keys"))
    else:
        result = df.agg(*totals)
    found: list[tuple] = [(rule, ERROR, F.col(f"v{i}")) for i, rule in enumerate(rules)]
    for i, (column, share) in enumerate(shares, len(rules)):
        rule, few = f"{name}: at most {share:.0%} of {column} is null", F.col(f"v{i}") <= share * F.col("total")
        found.append((rule, WARNING, F.col(f"v{i}"), "total", few))
    if unique:
        rule = f"{name}: ({', '.join(unique)}) is unique"
        found.append((rule, unique_severity, F.col("total") - F.col("keys")))
    return _unpivot(result, found)


def load_checks(
    df: DataFrame, quarantine: DataFrame, name: str, columns: Sequence[str], severity: str = WARNING
) -> DataFrame:
    """What a feed lost when it was stored as ``df``: malformed records, and values per column.

    ``quarantine`` has the records that did not load whole (``sources.files.quarantined``).
    """
    nothing = F.lit(None).cast("array<string>")
    rows = df.select(F.lit(1).alias("_row"), F.lit(False).alias("malformed"), nothing.alias("lost"))
    kept = quarantine.select(F.lit(0).alias("_row"), "malformed", "lost")
    counts = rows.unionByName(kept).agg(
        F.coalesce(F.sum("_row"), F.lit(0)).cast("bigint").alias("total"),
        F.count_if("malformed").alias("malformed"),
        *[F.count_if(F.array_contains("lost", c)).alias(f"v{i}") for i, c in enumerate(columns)],
    )
    found = [(f"{name}: records are well-formed", severity, F.col("malformed"))]
    found += [(f"{name}: {c} loads", severity, F.col(f"v{i}")) for i, c in enumerate(columns)]
    return _unpivot(counts, found)


def check_not_null(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    return table_checks(df, name, not_null=columns)


def check_unique(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Violations are the rows beyond the first of their key. NULL counts as a key."""
    return table_checks(df, name, unique=keys)


def check_range(df: DataFrame, name: str, column: str, low: float) -> DataFrame:
    return table_checks(df, name, at_least={column: low})


def check_single_arm(
    assignment: DataFrame, key: str = "customer_id", arm: str = "is_target"
) -> DataFrame:
    """Nobody may be assigned twice, be it to the same arm or to several."""
    per_user = assignment.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(arm).alias("lo"), F.max(arm).alias("hi")
    )
    result = per_user.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(F.col("lo") != F.col("hi")).alias("torn"),
    )
    return _unpivot(
        result,
        [
            ("assignment: one row per user", ERROR, F.col("repeated")),
            ("assignment: one arm per user", ERROR, F.col("torn")),
        ],
    )


def orphans(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Distinct keys of ``fact`` that ``dim`` lacks. A NULL key is never found.

    Keys are made distinct before the join, so a hot key is one row by then.
    """
    dim_key = dim_key or key
    keys = fact.select(key).distinct()
    side = dim.select(F.col(dim_key).alias("_dim_key"))
    return keys.join(side, keys[key] == side["_dim_key"], "left_anti")


def check_referential(
    fact: DataFrame, dim: DataFrame, name: str, key: str, dim_key: str | None = None
) -> DataFrame:
    """A warning that counts the keys without a dimension row."""
    dim_key = dim_key or key
    result = _matches(fact, dim, key, dim_key)
    return _unpivot(result, [(name, WARNING, F.col("total") - F.col("matched"))])


def participant_checks(
    orders: DataFrame,
    consumers: DataFrame,
    assignment: DataFrame,
    key: str = "customer_id",
    arm: str = "is_target",
) -> DataFrame:
    """All checks that concern one customer across the three tables, from a single grouping.

    The same rows as ``table_checks`` of consumers and assignment, ``check_single_arm`` and two
    ``check_referential`` of the orders. Keys are stacked with counters, which combine before
    the shuffle, so a hot customer arrives as one row per map task. NULL is a key of its own
    and matches nothing. Arms are told apart by their 64-bit hashes: least and greatest of
    texts would have every row sorted before it is combined.
    """

    def keys(df: DataFrame, name: str, value: Column) -> DataFrame:
        marks = [F.lit(int(n == name)).alias(f"n_{n}") for n in ("orders", "consumers", "arms")]
        return df.select(F.col(key).alias("_key"), *marks, value.alias("_arm"))

    no_arm = F.lit(None).cast("bigint")
    arm_hash = F.when(F.col(arm).isNotNull(), F.xxhash64(arm))
    per_key = (
        keys(orders, "orders", no_arm)
        .unionByName(keys(consumers, "consumers", no_arm))
        .unionByName(keys(assignment, "arms", arm_hash))
        .groupBy("_key")
        .agg(
            F.sum("n_orders").alias("n_orders"),
            F.sum("n_consumers").alias("n_consumers"),
            F.sum("n_arms").alias("n_arms"),
            F.min("_arm").alias("lo"),
            F.max("_arm").alias("hi"),
        )
    )
    known = F.col("_key").isNotNull()
    buyer, consumer, assigned = (F.col(f"n_{n}") > 0 for n in ("orders", "consumers", "arms"))

    def rows(n: str, where: Column | None = None) -> Column:
        counted = F.col(n) if where is None else F.when(where, F.col(n)).otherwise(0)
        return F.coalesce(F.sum(counted), F.lit(0).cast("bigint"))

    figures = per_key.agg(
        rows("n_consumers").alias("consumers"),
        rows("n_consumers", ~known).alias("consumers_null"),
        F.count_if(consumer).alias("consumer_keys"),
        rows("n_arms").alias("assignments"),
        rows("n_arms", ~known).alias("assignments_null"),
        F.count_if(assigned).alias("users"),
        F.count_if(F.col("n_arms") > 1).alias("repeated"),
        F.count_if(F.col("lo") != F.col("hi")).alias("torn"),
        F.count_if(buyer).alias("buyers"),
        F.count_if(buyer & ~(consumer & known)).alias("unknown"),
        F.count_if(buyer & ~(assigned & known)).alias("unassigned"),
    )
    c = F.col
    return _unpivot(
        figures,
        [
            (f"consumers: {key} is not null", ERROR, c("consumers_null"), "consumers"),
            (f"consumers: ({key}) is unique", ERROR, c("consumers") - c("consumer_keys"), "consumers"),
            (f"assignment: {key} is not null", ERROR, c("assignments_null"), "assignments"),
            ("assignment: one row per user", ERROR, c("repeated"), "users"),
            ("assignment: one arm per user", ERROR, c("torn"), "users"),
            ("buyers are consumers", WARNING, c("unknown"), "buyers"),
            ("buyers are assigned", WARNING, c("unassigned"), "buyers"),
        ],
    )


def coverage(
    left: DataFrame, right: DataFrame, key: str, right_key: str | None = None
) -> DataFrame:
    """How many distinct keys of ``left`` are in ``right``: total, matched, missing, percent."""
    result = _matches(left, right, key, right_key or key)
    return result.select(
        "total",
        "matched",
        (F.col("total") - F.col("matched")).alias("missing"),
        (F.try_divide("matched", "total") * F.lit(100.0)).alias("matched_pct"),
    )


def experiment_integrity(
    users: DataFrame, abt: DataFrame, consumers: DataFrame, key: str = "customer_id"
) -> DataFrame:
    """The experiment's reconciliation figures, in one row.

    Users, buyers and consumers are reduced to distinct keys, stacked and counted per key, so
    the figures need one grouping where joins would need one per pair. ``users`` is distinct
    (key, arm); a user in two arms therefore counts twice, as well as being reported.
    """

    def presence(df: DataFrame, **flags: int) -> DataFrame:
        return df.select(key, *[F.lit(flag).alias(name) for name, flag in flags.items()])

    stacked = (
        presence(users, in_users=1, buys=0, known=0)
        .unionByName(presence(abt.select(key).distinct(), in_users=0, buys=1, known=0))
        .unionByName(presence(consumers.select(key).distinct(), in_users=0, buys=0, known=1))
    )
    per_key = stacked.groupBy(key).agg(
        F.sum("in_users").alias("arms"),
        F.max("buys").alias("buys"),
        F.max("known").alias("known"),
    )
    joinable = F.col(key).isNotNull()
    buys, known = F.col("buys") == 1, F.col("known") == 1
    arms = F.col("arms")

    def total(value: Column, where: Column | None = None) -> Column:
        counted = value if where is None else F.when(where, value).otherwise(0)
        return F.coalesce(F.sum(counted), F.lit(0).cast("bigint"))

    figures = per_key.agg(
        total(arms).alias("users"),
        total(arms, buys & joinable).alias("users_with_orders"),
        total(arms, known & joinable).alias("consumers_in_experiment"),
        F.count_if(known).alias("consumers"),
        F.count_if(buys & ~(known & joinable)).alias("buyers_not_in_consumers"),
        F.count_if(buys & ~((arms > 0) & joinable)).alias("buyers_not_in_experiment"),
        F.count_if(arms > 1).alias("users_in_several_arms"),
    )
    return figures.select(
        "users",
        "users_with_orders",
        (F.col("users") - F.col("users_with_orders")).alias("users_without_orders"),
        (F.try_divide("users_with_orders", "users") * F.lit(100.0)).alias(
            "users_with_orders_pct"
        ),
        "consumers_in_experiment",
        (F.col("consumers") - F.col("consumers_in_experiment")).alias(
            "consumers_not_in_experiment"
        ),
        "buyers_not_in_consumers",
        "buyers_not_in_experiment",
        "users_in_several_arms",
    )


def quality_report(*checks: DataFrame) -> DataFrame:
    """All checks as one table: check, severity, violations, total, passed."""
    return reduce(DataFrame.unionByName, checks)


def enforce(report: DataFrame) -> DataFrame:
    """Raise if a check of severity ``error`` failed. Only failed checks reach the driver."""
    failed = report.where((F.col("severity") == ERROR) & ~F.col("passed")).collect()
    if failed:
        raise QualityError("; ".join(f"{r['check']}: {r['violations']}" for r in failed))
    return report


def _matches(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    keys = left.select(key).distinct()
    other = right.select(F.col(right_key).alias("_other_key")).distinct()
    joined = keys.join(other, keys[key] == other["_other_key"], "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"), F.count("_other_key").alias("matched")
    )


def _unpivot(result: DataFrame, found: Sequence[tuple]) -> DataFrame:
    """A row per (check, severity, violations) of the one row ``result``.

    A fourth item names its total, a fifth says what passes other than no violation.
    """

    def row(check: str, severity: str, violations: Column, total: str = "total", passed: Column | None = None):
        return F.struct(
            F.lit(check).alias("check"),
            F.lit(severity).alias("severity"),
            violations.alias("violations"),
            F.col(total).alias("total"),
            (violations == 0 if passed is None else passed).alias("passed"),
        )

    return result.select(F.inline(F.array(*[row(*one) for one in found])))
