"""Connected components of a graph that is too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.scratch import dropped, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Nodes of edges (a, b) with the least node that they reach: node, component. A written table.

    Each round a node takes the least label among its own and its neighbours', then the label of that label, so labels travel twice as far
    from round to round. Every round is written: lineage ends there. Nodes without an edge are not in the result.
    """
    pairs = edges.where("a <> b").select("a", "b")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = written(
        both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels"
    )
    for _ in range(most_rounds):
        seen = both.join(now.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(
            F.min("label").alias("near")
        ).withColumnRenamed("a", "node")
        better = written(
            now.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")),
            "nearer",
        )
        of_label = better.select(F.col("node").alias("label"), F.col("label").alias("farther"))
        new = written(
            better.join(of_label, "label", "left").select("node", "old", F.coalesce("farther", "label").alias("label")),
            "labels",
        )
        moved = new.where("label <> old").limit(1).count()
        dropped(better, now)
        now = new.select("node", "label")
        if not moved:
            dropped(both)
            return now.withColumnRenamed("label", "component")
    raise RuntimeError("the components have not settled")
