"""Statistics that Spark has no built-in for, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_GAMMA_SHIFT = 12
# Nodes of the tail integral's rule: step and ends of the trapezoid that it is after substitution.
_STEP, _FIRST, _LAST = 1 / 16, -4.0, 3.875
# Amounts below this size are summed exactly; fractions are cut into two parts of so many bits.
EXACT_BELOW = float(1 << 33)
_PART = float(1 << 26)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def array_mean(values: Column) -> Column:
    """Mean of an array<double>; 0.0 if it is NULL or empty."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def population_stddev(values: Column, mean: Column | None = None) -> Column:
    """Population standard deviation of an array<double>; 0.0 if NULL or fewer than two values.

    ``mean`` may name a column that already holds the array's mean.
    """

    def spread(mean: Column) -> Column:
        squares = F.aggregate(
            values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)
        )
        return F.sqrt(squares / F.size(values))

    deviation = spread(mean) if mean is not None else let(array_mean(values), spread)
    return F.when(F.size(values) >= 2, deviation).otherwise(F.lit(0.0))


def lift_pct(control: Column, target: Column) -> Column:
    """Relative change in percent; +infinity when the control value is 0."""
    return F.when(
        control != 0, (target - control) / control * F.lit(100.0)
    ).when(control.isNotNull() & target.isNotNull(), F.lit(float("inf")))


def exact_parts(amount: Column) -> dict[str, Column]:
    """Parts of an amount whose sums do not depend on the order of adding, nor on where rows are cut.

    Whole part and two parts of the fraction are whole numbers; an amount of EXACT_BELOW or more,
    infinity or NaN is a double by itself. NULL has no parts and counts as no amount.
    """
    fits = F.abs(amount) < EXACT_BELOW
    low = F.floor(amount)
    fraction = (amount - low) * _PART
    return {
        "whole": F.when(fits, low),
        "fine": F.when(fits, F.floor(fraction)),
        "finest": F.when(fits, F.floor((fraction - F.floor(fraction)) * _PART)),
        "large": F.when(~fits, amount),
        "amounts": amount.isNotNull().cast("bigint"),
    }


def mean_of_parts(whole: Column, fine: Column, finest: Column, large: Column, amounts: Column) -> Column:
    """The mean from the sums of ``exact_parts``; NULL without amounts."""
    total = F.coalesce(whole + (fine + finest / _PART) / _PART, F.lit(0.0)) + F.coalesce(large, F.lit(0.0))
    return F.when(amounts > 0, total / amounts)


def student_t_two_sided_p(t: str, df: str) -> Column:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom; NULL unless df > 0.

    Both are column names or SQL expressions: the formula is one SQL expression, which takes
    Spark milliseconds to read where building it operator by operator takes the driver a second.

    With a = df / 2, x = df / (df + t^2) and y = 1 - x the tail is x^a / (a B(a, 1/2)) times the
    integral over v > 0 of e^-v / sqrt(y + x (1 - e^(-v/a))), which is summed over the same nodes
    for every t and df.
    """
    values = f"named_struct('t2', pow(double({t}), 2D), 'df', double({df}))"
    return F.expr(
        _let(
            values,
            "v",
            f"""CASE
            WHEN v.t2 IS NULL OR v.df IS NULL OR v.df <= 0 OR isnan(v.t2) THEN NULL
            WHEN v.t2 = 0 THEN 1D
            WHEN v.t2 = double('infinity') THEN 0D
            ELSE {_tail("v.t2", "v.df")} END""",
        )
    )


def tail_nodes() -> list[tuple[float, float]]:
    """(v, weight): the trapezoid rule for e^-v f(v) over v > 0 after v = exp(s - e^-s), which both ends of s suit."""
    nodes = []
    for k in range(round(_FIRST / _STEP), round(_LAST / _STEP) + 1):
        s = k * _STEP
        v = math.exp(s - math.exp(-s))
        nodes.append((v, _STEP * v * (1 + math.exp(-s)) * math.exp(-v)))
    return nodes


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _log_inverse_beta_half(a: str) -> str:
    """-ln B(a, 1/2): Gamma ratio by recurrence up to a + shift, then its asymptotic series."""
    z = f"({a} + {_GAMMA_SHIFT})"
    return f"""(aggregate(sequence(0, {_GAMMA_SHIFT - 1}), 0D,
            (s, k) -> s + ln(({a} + k) / ({a} + k + 0.5D)))
        + 0.5D * ln({z}) - 1 / (8 * {z}) + 1 / (192 * pow({z}, 3))
        - 1 / (640 * pow({z}, 5)) + 17 / (14336 * pow({z}, 7)) - 0.5D * ln(pi()))"""


def _tail(t2: str, df: str) -> str:
    nodes, weights = zip(*tail_nodes())
    arrays = [f"array({', '.join(f'{number!r}D' for number in numbers)})" for numbers in (nodes, weights)]
    parts = f"zip_with({arrays[0]}, {arrays[1]}, (n, m) -> m / sqrt(w.y - w.x * expm1(-n / w.a)))"
    return _let(
        f"named_struct('a', {df} / 2, 'x', {df} / ({df} + {t2}), 'y', {t2} / ({df} + {t2}), 'r', {t2} / {df})",
        "w",
        f"""exp({_log_inverse_beta_half("w.a")} - w.a * log1p(w.r)) / w.a
            * aggregate({parts}, 0D, (total, part) -> total + part)""",
    )
