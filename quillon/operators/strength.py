"""Strength of tickers in their group: capture, drawdown, recovery, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.rolling import by_ticker, padded, ratio
from quillon.operators.features import returns


def last_dates(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the last n dates of the table."""
    days = rows.select("date").distinct().orderBy(F.desc("date")).limit(n)
    return rows.join(F.broadcast(days), "date", "left_semi")


def capture(rows: DataFrame, keys: list[str], own: str, group: str) -> DataFrame:
    """keys, up_capture, down_capture, up_days, down_days: mean own by mean group return on the group's days up and down."""
    both = rows.where(F.col(own).isNotNull() & F.col(group).isNotNull())
    g, t = F.col(group), F.col(own)
    up, down = g > 0, g < 0
    return both.groupBy(*keys).agg(
        ratio(F.avg(F.when(up, t)), F.avg(F.when(up, g))).alias("up_capture"),
        ratio(F.avg(F.when(down, t)), F.avg(F.when(down, g))).alias("down_capture"),
        F.count_if(up).alias("up_days"),
        F.count_if(down).alias("down_days"),
    )


def drawdowns(prices: DataFrame) -> DataFrame:
    """ticker, max_drawdown, recovery_days: bars from the deepest trough to the first close at its peak again, -1 for never."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = prices.where("close is not null").withColumns(
        {"pos": F.row_number().over(w), "peak": F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))}
    )
    rows = rows.withColumn("dd", F.col("close") / F.col("peak") - 1)
    # the windows have the same key, so there is one shuffle and no join
    rows = rows.withColumn("t", F.min(F.struct("dd", "pos", "peak")).over(Window.partitionBy("ticker")))
    days = F.min(
        F.when((F.col("pos") >= F.col("t.pos")) & (F.col("close") >= F.col("t.peak")), F.col("pos") - F.col("t.pos"))
    )
    return rows.groupBy("ticker").agg(
        F.first("t.dd").alias("max_drawdown"), F.coalesce(days, F.lit(-1)).cast("long").alias("recovery_days")
    )


def strength_table(panel: DataFrame, n: int = 120) -> DataFrame:
    """ticker, cluster, up_capture, down_capture, capture_spread, max_drawdown, recovery_days, rank_in_cluster over the last n dates."""
    rows = last_dates(returns(panel), n)
    group = rows.groupBy("cluster", "date").agg(F.avg("log_ret").alias("group_ret"))
    own = capture(rows.join(group, ["cluster", "date"]), ["cluster", "ticker"], "log_ret", "group_ret")
    out = own.withColumn("capture_spread", F.col("up_capture") - F.col("down_capture")).join(drawdowns(rows), "ticker")
    rank = F.when(
        F.col("capture_spread").isNotNull(),
        F.rank().over(Window.partitionBy("cluster").orderBy(F.desc_nulls_last("capture_spread"))),
    )
    return out.withColumn("rank_in_cluster", rank.cast("long")).drop("up_days", "down_days")


def rank_share(x: Column, partition: list[str] | None = None) -> Column:
    """The average rank of ties by the number of values, ascending; null for null."""
    some = Window.partitionBy(*(partition or [F.lit(1)]))
    rank = F.rank().over(some.orderBy(F.asc_nulls_last(x)))
    ties = F.count(x).over(Window.partitionBy(*(partition or []), x))
    return F.when(x.isNotNull(), (rank + (ties - 1) / 2) / F.count(x).over(some))


def least_rank(x: Column) -> Column:
    return F.when(x.isNotNull(), F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(x)))).cast("long")


def rank_tickers(panel: DataFrame, n: int = 60, momentum: int = 20) -> DataFrame:
    """Capture, relative drawdown, momentum and correlation with the sector over the last n dates, with scores and ranks. A row a ticker."""
    w = by_ticker()
    full = returns(panel).withColumn("through", padded(F.col("close"), w))
    full = full.withColumn("momentum", ratio(F.col("through"), F.lag("through", momentum).over(w)) - 1)
    sector = full.groupBy("date").agg(F.avg("ret").alias("sector"))
    rows = last_dates(full, n).join(F.broadcast(sector), "date")
    all_up = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "own_index": F.product(1 + F.coalesce("ret", F.lit(0.0))).over(all_up),
            "sector_index": F.product(1 + F.coalesce("sector", F.lit(0.0))).over(all_up),
        }
    )
    rows = rows.withColumns(
        {
            "own_dd": F.col("own_index") / F.max("own_index").over(all_up) - 1,
            "sector_dd": F.col("sector_index") / F.max("sector_index").over(all_up) - 1,
        }
    )
    up, down, g = F.col("sector") > 0, F.col("sector") < 0, F.col("sector")
    used = F.col("ret").isNotNull() & g.isNotNull()
    x, y = F.when(used, F.col("ret")), F.when(used, g)
    out = rows.groupBy("ticker").agg(
        ratio(F.avg(F.when(down, F.col("ret"))), F.avg(F.when(down, g))).alias("downside_capture"),
        ratio(F.avg(F.when(up, F.col("ret"))), F.avg(F.when(up, g))).alias("upside_capture"),
        (F.min("own_dd") - F.min("sector_dd")).alias("relative_drawdown"),
        F.max_by("momentum", "date").alias("momentum_20d"),
        ratio(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)).alias("sector_correlation"),
    )
    out = out.withColumns(
        {
            "fall_resistance_score": F.round(
                -rank_share(F.round("downside_capture", 9)) + rank_share(F.round("relative_drawdown", 9)), 9
            ),
            "rise_strength_score": F.round(
                rank_share(F.round("upside_capture", 9)) + rank_share(F.round("momentum_20d", 9)), 9
            ),
        }
    )
    return out.withColumns(
        {
            "fall_resistance_rank": least_rank(F.col("fall_resistance_score")),
            "rise_strength_rank": least_rank(F.col("rise_strength_score")),
        }
    )
