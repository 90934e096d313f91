"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One operation on edges (u, v), u > v. Large: each node's larger neighbours move to the least of its neighbourhood; small: its smaller ones and itself do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    if large:
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = written(moved.where("u <> v").distinct(), "star")
    deleted(least)
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Nodes of edges (a, b) with the least node that they reach: node, component.

    Nodes without an edge are not in the result. Every step is written to the shared folder. A hub's edges meet
    in skew-split joins and in aggregates that combine before the shuffle. The rounds are of the order of the logarithm
    of the number of nodes; not to have ended after most_rounds is an error.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        large = _star(now, True)
        deleted(now)
        now = _star(large, False)
        deleted(large)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = seen
    raise RuntimeError("the components have not settled")
