"""Connected components by contraction, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialflow.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b); root is the component's smallest node.

    In a round each node takes its smallest neighbour as parent if that is smaller, then the
    parent's parent, twice; edges between different parents are the next, smaller graph. Minima
    are pre-aggregated and joins are plain equi-joins, so a hub with many edges is split.
    """
    rest = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph-edges")
    roots = None
    while roots is None or not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("parent")), "graph-parents")
        for _ in range(2):
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            parents = parents.join(up, "parent").select("node", F.col("above").alias("parent"))
        parents = stage(parents, "graph-parents")
        of = lambda name: parents.select(F.col("node").alias(name), F.col("parent").alias(f"p{name}"))  # noqa: E731, B023
        moved = rest.join(of("a"), "a").join(of("b"), "b").filter("pa <> pb")
        rest = stage(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "graph-edges")
        step = parents.withColumnRenamed("parent", "root")
        if roots is None:
            roots = step
        else:
            nxt = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = stage(roots.join(nxt, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "graph-roots")
    return roots
