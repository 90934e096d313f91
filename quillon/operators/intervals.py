"""Half-open intervals of days: union and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(intervals: DataFrame, key: str) -> DataFrame:
    """key, start, end of overlapping and touching intervals merged."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.where("start < end").distinct().withColumn(
        "new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    )
    marked = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def missing(covered: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """key, start, end of what requested (key, low, high) has and covered (key, start, end) doesn't."""
    inside = union(covered, key).join(requested, key).where(
        (F.col("end") > F.col("low")) & (F.col("start") < F.col("high"))
    )
    marks = inside.select(
        key, F.greatest("start", "low").alias("start"), F.least("end", "high").alias("end")
    ).unionByName(requested.select(key, F.col("high").alias("start"), F.col("high").alias("end")))
    w = Window.partitionBy(key).orderBy("start", "end")
    gaps = marks.join(requested, key).withColumn("from", F.coalesce(F.lag("end").over(w), F.col("low")))
    return gaps.where(F.col("from") < F.col("start")).select(
        key, F.col("from").alias("start"), F.col("start").alias("end")
    )
