"""Arm summaries, lift and two-sample t-tests, all as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialflow.functions.stats import lift_pct, student_t_two_sided_p

ALPHA = 0.05


@dataclass(frozen=True)
class Metric:
    """A per-user measure and how to report it.

    ``users`` names the summary column counting the users the metric is about.
    """

    name: str
    measure: str
    label: str
    users: str = "users"
    scale: float = 1.0

    @property
    def stddev(self) -> str:
        return f"stddev_{self.name}"

    @property
    def n(self) -> str:
        return f"n_{self.name}"


REVENUE = Metric("revenue_per_user", "revenue", "Revenue per user")
FREQUENCY = Metric("order_frequency", "order_count", "Orders per user")
TICKET = Metric("avg_ticket", "avg_ticket", "Average ticket", "converted_users")
RETENTION_7D = Metric(
    "retention_7d_pct", "is_retained_7d", "7-day retention, %", scale=100.0
)
RETENTION_14D = Metric(
    "retention_14d_pct", "is_retained_14d", "14-day retention, %", scale=100.0
)
ITEMS = Metric("items_per_order", "avg_items", "Items per order", "converted_users")
REORDER_GAP = Metric(
    "days_to_reorder", "avg_days_to_reorder", "Days to the next order", "converted_users"
)
NEW_RESTAURANT_RATE = Metric(
    "new_restaurant_rate_pct",
    "new_restaurant_rate_pct",
    "Orders at new restaurants, %",
    "converted_users",
)

ARM_METRICS = [
    REVENUE,
    FREQUENCY,
    TICKET,
    RETENTION_7D,
    RETENTION_14D,
    ITEMS,
    REORDER_GAP,
    NEW_RESTAURANT_RATE,
]
# What the segment summary holds, and the part of it that is tested.
SEGMENT_METRICS = [
    REVENUE,
    FREQUENCY,
    TICKET,
    RETENTION_14D,
    REORDER_GAP,
    NEW_RESTAURANT_RATE,
]
SEGMENT_TESTS = [REVENUE, FREQUENCY, RETENTION_14D, REORDER_GAP, NEW_RESTAURANT_RATE]


def arm_sizes(users: DataFrame, arm: str = "arm") -> DataFrame:
    """Users per arm."""
    return users.groupBy(arm).agg(F.count("customer_id").alias("users"))


def order_period(df: DataFrame, ts: str = "order_created_at") -> DataFrame:
    """First and last order time, in one row."""
    return df.agg(F.min(ts).alias("first_order_at"), F.max(ts).alias("last_order_at"))


def kpi_summary(
    spine: DataFrame,
    by: Sequence[str] = ("arm",),
    metrics: Sequence[Metric] = tuple(ARM_METRICS),
    conditional: bool = False,
) -> DataFrame:
    """Mean and sample standard deviation of every metric per group, and the group's users.

    On a zero-filled spine means run over all users. ``conditional`` is for a spine that was
    not filled: means run over the users who have the measure, counted as ``n_<metric>``.
    """
    measures = []
    for metric in metrics:
        scale = F.lit(metric.scale)
        measures += [
            (F.avg(metric.measure) * scale).alias(metric.name),
            (F.stddev_samp(metric.measure) * scale).alias(metric.stddev),
        ]
        if conditional:
            measures.append(F.count(metric.measure).alias(metric.n))
    return spine.groupBy(*by).agg(
        *measures,
        F.count("customer_id").alias("users"),
        F.count_if(F.col("order_count") > 0).alias("converted_users"),
    )


def ttest_from_summary(
    summary: DataFrame,
    metrics: Sequence[Metric],
    control: str = "control",
    target: str = "target",
    arm: str = "arm",
    by: Sequence[str] = (),
    equal_var: bool = True,
    alpha: float = ALPHA,
    legacy_n: bool = False,
) -> DataFrame:
    """One row per group of ``by`` and metric: means, lift, t, degrees of freedom, p.

    A metric's n is the number of users its mean runs over: ``n_<metric>`` if the summary has
    it, else all users. ``legacy_n`` takes the metric's own user count instead and, within
    segments, the control arm's count for both arms. The test is Student's with pooled
    variance, or Welch's with ``equal_var=False``. ``status`` says why a row has no test.
    """
    long = _long_form(summary, metrics, arm, by, legacy_n)
    sides = long.where(F.col(arm).isin(control, target)).groupBy(*by, "metric", "label").agg(
        _side(arm, control).alias("c"), _side(arm, target).alias("t")
    )
    n_control = F.col("c.n")
    n_target = n_control if legacy_n and by else F.col("t.n")
    t_stat, degrees = _t_statistic(
        F.col("t.mean") - F.col("c.mean"),
        F.col("c.sd"),
        F.col("t.sd"),
        n_control.cast("double"),
        n_target.cast("double"),
        equal_var,
    )
    status = (
        F.when(F.col("c").isNull() | F.col("t").isNull(), "missing_arm")
        .when(
            F.col("c.sd").isNull()
            | F.col("t.sd").isNull()
            | (F.col("c.sd") == 0)
            | (F.col("t.sd") == 0)
            | (n_control <= 1)
            | (n_target <= 1),
            "no_spread_or_n",
        )
        .otherwise("tested")
    )
    tested = F.col("status") == "tested"
    return (
        sides.select(
            *by,
            "metric",
            "label",
            F.col("c.mean").alias("control_mean"),
            F.col("t.mean").alias("target_mean"),
            lift_pct(F.col("c.mean"), F.col("t.mean")).alias("lift_pct"),
            n_control.alias("n_control"),
            n_target.alias("n_target"),
            status.alias("status"),
            t_stat.alias("_t"),
            degrees.alias("_df"),
        )
        .withColumns(
            {
                "t_stat": F.when(tested, F.col("_t")),
                "df": F.when(tested, F.col("_df")),
            }
        )
        .drop("_t", "_df")
        .withColumn("p_value", student_t_two_sided_p("t_stat", "df"))
        .withColumn("significant", F.col("p_value") < alpha)
    )


def _long_form(summary, metrics, arm, by, legacy_n) -> DataFrame:
    """The summary with one row per group and metric: (mean, sd, n)."""

    def n_of(metric: Metric) -> Column:
        if legacy_n:
            return F.col(metric.users)
        return F.col(metric.n if metric.n in summary.columns else "users")

    rows = F.array(
        *[
            F.struct(
                F.lit(metric.name).alias("metric"),
                F.lit(metric.label).alias("label"),
                F.col(metric.name).alias("mean"),
                F.col(metric.stddev).alias("sd"),
                n_of(metric).alias("n"),
            )
            for metric in metrics
        ]
    )
    return summary.select(*by, arm, F.inline(rows))


def _side(arm: str, name: str) -> Column:
    return F.max(F.when(F.col(arm) == name, F.struct("mean", "sd", "n")))


def _t_statistic(gap, sd_c, sd_t, n_c, n_t, equal_var) -> tuple[Column, Column]:
    var_c, var_t = sd_c * sd_c, sd_t * sd_t
    if equal_var:
        degrees = n_c + n_t - 2
        pooled = F.try_divide((n_c - 1) * var_c + (n_t - 1) * var_t, degrees)
        error2 = pooled * (F.try_divide(F.lit(1.0), n_c) + F.try_divide(F.lit(1.0), n_t))
    else:
        part_c, part_t = F.try_divide(var_c, n_c), F.try_divide(var_t, n_t)
        error2 = part_c + part_t
        degrees = F.try_divide(
            error2 * error2,
            F.try_divide(part_c * part_c, n_c - 1) + F.try_divide(part_t * part_t, n_t - 1),
        )
    return F.try_divide(gap, F.sqrt(error2)), degrees
