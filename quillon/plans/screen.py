"""The point-in-time screen: trends, clusters, strength, rebound alarms and leaders, all from bars up to a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.rolling import by_date
from quillon.operators import correlation, features, indicators, labels, strength
from quillon.plans.config import Config
from quillon.scratch import written
from quillon.sources import bars as source


def market_of(bars: DataFrame, benchmark: str | None = None) -> DataFrame:
    """date, market: the benchmark ticker's close, or without one the mean close of all tickers."""
    if benchmark:
        return bars.where(F.col("ticker") == benchmark).select("date", F.col("close").alias("market"))
    return bars.groupBy("date").agg(F.avg("close").alias("market"))


def found_clusters(panel: DataFrame, market: DataFrame, config: Config) -> DataFrame:
    """cluster, ticker, mean_correlation, from what the market leaves of the last window's logarithmic returns."""
    factor = market.select("date", (F.ln("market") - F.ln(F.lag("market").over(by_date()))).alias("f"))
    rows = strength.last_dates(features.returns(panel), config.windows.long)
    rho = correlation.correlation(correlation.residualize(rows, factor), "resid")
    return correlation.clusters(rho, config.threshold, config.least_cluster)


def screen(
    bars: DataFrame, config: Config, as_of: str | None = None, clusters: DataFrame | None = None
) -> dict[str, DataFrame]:
    """trend, clusters, strength, rebound and leaders, as frames. Rows after as_of are cut at the scan, so nothing can look ahead.

    clusters (cluster, ticker): given, else found by correlation.
    """
    # cut at the scan, then written: all that follows reads these bars and this panel
    own = written(source.as_of(bars, as_of) if as_of else bars, "bars")
    market = market_of(own, config.benchmark)
    stocks = own.where(F.col("ticker") != config.benchmark) if config.benchmark else own
    w = config.windows
    plain = source.panel(stocks, keep=(), values=("close", "volume", "high", "low"))
    groups = clusters if clusters is not None else found_clusters(plain, market, config)
    groups = written(groups.withColumn("cluster", F.col("cluster").cast("string")), "groups")
    panel = written(plain.join(groups.select("ticker", "cluster"), "ticker"), "panel")
    grouped = stocks.drop("cluster").join(groups.select("ticker", "cluster"), "ticker")
    alarms = indicators.alarms(grouped, panel, w.short, w.mid, config.washout_gate, config.alarm_gate)
    columns = ["cluster", "alarm", "washout", "stretch_z", "rsi", "volume_signal", "divergence", "confirmed", "fired"]
    latest = alarms.groupBy("ticker").agg(
        F.max_by(F.struct("date", *columns), "date").alias("x")
    ).select("ticker", "x.*")
    b = config.backtest
    return {
        "trend": indicators.trend_table(stocks, w.short, w.mid),
        "clusters": groups,
        "strength": strength.strength_table(panel, w.long),
        "rebound": latest,
        "leaders": labels.rebound_leaders(panel, b.half_window, b.ahead, b.least_return, b.horizons),
    }


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """A row a ticker: trend with strength and the latest alarm."""
    return tables["trend"].join(
        tables["strength"].select(
            "ticker", "cluster", "capture_spread", "max_drawdown", "recovery_days", "rank_in_cluster"
        ),
        "ticker",
        "left",
    ).join(tables["rebound"].select("ticker", "alarm", "washout", "fired"), "ticker", "left")
