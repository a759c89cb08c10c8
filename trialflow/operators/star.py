"""Star joins: a fact table left-joined to its dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dim:
    """A dimension: its rows, ``fact_key = dim_key``, and column -> name in the result."""

    df: DataFrame
    fact_key: str
    dim_key: str
    columns: dict[str, str]
    small: bool = False

    def projected(self) -> DataFrame:
        """The join key under a private name, plus the wanted columns under their new names."""
        return self.df.select(
            F.col(self.dim_key).alias("_dim_key"),
            *[F.col(column).alias(name) for column, name in self.columns.items()],
        )


def star_join(fact: DataFrame, dims: Sequence[Dim]) -> DataFrame:
    """Left-join every dimension in turn; a fact row without a match gets NULLs.

    Give dimensions that share a key one after the other: the second join then finds the fact
    already partitioned by it. The join strategy is left to Spark's size statistics, except for
    a dimension marked ``small`` by a caller that knows a bound on its rows.
    """
    for dim in dims:
        side = dim.projected()
        side = F.broadcast(side) if dim.small else side
        fact = fact.join(side, fact[dim.fact_key] == side["_dim_key"], "left").drop("_dim_key")
    return fact
