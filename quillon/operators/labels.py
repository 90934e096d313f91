"""Forward-looking labels: the only module that looks ahead. Signals never use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.functions.rolling import by_date, by_ticker, ratio, true


def forward_return(x: Column, w: WindowSpec, n: int) -> Column:
    return ratio(F.lead(x, n).over(w), x) - 1


def bottom(x: Column, w: WindowSpec, k: int = 10, ahead: int = 20, least: float = 0.08) -> Column:
    """The least of the k values before and after, all there, from which it goes up by ``least`` in ``ahead`` rows."""
    around = w.rowsBetween(-k, k)
    local = (F.count(x).over(around) == 2 * k + 1) & (x == F.min(x).over(around))
    return true(local) & true(forward_return(x, w, ahead) >= least)


def bottoms(bars: DataFrame, k: int = 10, ahead: int = 20, least: float = 0.08) -> DataFrame:
    """bars with label."""
    return bars.withColumn("label", bottom(F.col("close"), by_ticker(), k, ahead, least))


def first_hit(
    index: DataFrame,
    horizon: int = 10,
    target: float = 0.05,
    adverse: float = -0.03,
    correction: float = -0.08,
    value: str = "sector_index",
    drawdown: str = "drawdown_60d",
    bear: str | None = None,
) -> DataFrame:
    """date, label: in a correction (drawdown at most ``correction``, or bear probability 0.6), 1 if the target comes before the adverse
    move within the horizon, 0 if not; null elsewhere and for the last rows."""
    w = by_date()
    eligible = true(F.col(drawdown) <= correction)
    eligible = eligible | true(F.col(bear) >= 0.60) if bear else eligible
    ahead = F.collect_list(value).over(w.rowsBetween(1, horizon))
    moves = F.transform(ahead, lambda x: x / F.col(value) - 1)
    up = F.array_position(F.transform(moves, lambda m: m >= target), True)
    down = F.array_position(F.transform(moves, lambda m: m <= adverse), True)
    hit = (up > 0) & ((down == 0) | (up < down))
    return index.withColumns({"__up": up, "__n": F.size(ahead)}).select(
        "date", F.when(eligible & (F.col("__n") == horizon), hit.cast("double")).alias("label")
    )


def rebound_leaders(
    panel: DataFrame,
    k: int = 10,
    ahead: int = 20,
    least: float = 0.08,
    horizons: tuple[int, ...] = (5, 10, 20),
    least_events: int = 3,
) -> DataFrame:
    """How each ticker rebounds from the bottoms of its cluster's mean price, ranked in the cluster. panel: ticker, cluster, date, close, dense.

    Columns: ticker, cluster, events, median_rebound_5d/10d/20d, rebound_ratio_20d, recovery_efficiency, consistency,
    median_days_to_recover (-1: never), rank_in_cluster (from three events on).
    """
    c, t = Window.partitionBy("cluster").orderBy("date"), Window.partitionBy("cluster", "ticker").orderBy("date")
    index = panel.groupBy("cluster", "date").agg(F.avg("close").alias("level"))
    index = index.withColumns(
        {"bottom": bottom(F.col("level"), c, k, ahead, least), "ahead": forward_return(F.col("level"), c, ahead)}
    )
    events = index.where("bottom")
    typical = events.where("level > 0").groupBy("cluster").agg(F.median("ahead").alias("typical"))

    future = F.collect_list(F.struct(F.col("close").alias("v"))).over(t.rowsBetween(1, ahead))  # the struct keeps nulls
    rows = panel.withColumns(
        {
            **{f"r{h}": forward_return(F.col("close"), t, h) for h in horizons},
            "forward": forward_return(F.col("close"), t, ahead),
            "peak": F.max("close").over(t.rowsBetween(Window.unboundedPreceding, -1)),
            "future": future,
        }
    )
    at = rows.join(events.select("cluster", "date"), ["cluster", "date"]).where(
        (F.col("close") > 0) & (F.size("future") == ahead)
    ).join(typical, "cluster")
    depth = F.col("close") / F.col("peak") - 1
    recovered = F.array_position(
        F.transform("future", lambda x: F.coalesce(x["v"] >= F.col("peak"), F.lit(False))), True
    )
    at = at.withColumns(
        {
            "efficiency": F.when((F.col("peak") > 0) & (depth < 0), F.col("forward") / F.abs(depth)),
            "beat": true(F.col("forward") > F.col("typical")),
            "days": F.when(F.col("peak") > 0, F.nullif(recovered, F.lit(0)) - 1),
        }
    )
    out = at.groupBy("cluster", "ticker").agg(
        F.count("*").alias("events"),
        *[F.median(f"r{h}").alias(f"median_rebound_{h}d") for h in horizons],
        F.median("efficiency").alias("recovery_efficiency"),
        F.avg(F.col("beat").cast("int")).alias("consistency"),
        F.coalesce(F.median("days"), F.lit(-1.0)).alias("median_days_to_recover"),
        F.first("typical").alias("typical"),
    )
    out = out.withColumn(
        "rebound_ratio_20d", ratio(F.col(f"median_rebound_{horizons[-1]}d"), F.col("typical"))
    ).drop("typical")
    rankable = F.col("events") >= least_events
    order = Window.partitionBy("cluster", rankable).orderBy(
        F.desc_nulls_last("rebound_ratio_20d"), F.desc_nulls_last("consistency"), "ticker"
    )
    return out.withColumn("rank_in_cluster", F.when(rankable, F.row_number().over(order)).cast("long"))
