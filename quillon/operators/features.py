"""Cross-sectional features of a group of tickers, a row a date. Frames are dense panels (ticker, cluster, date, close, volume)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.rolling import by_date, by_ticker, change, compound, padded, ratio, roll, roll_std, share, sma, true

YEAR = 252


def returns(panel: DataFrame) -> DataFrame:
    """With ret and log_ret, from each ticker's row before; a gap gives null."""
    w = by_ticker()
    return panel.withColumns(
        {"ret": change(F.col("close"), w), "log_ret": F.ln("close") - F.ln(F.lag("close").over(w))}
    )


def residuals(panel: DataFrame, market: DataFrame, lookback: int = 60) -> DataFrame:
    """With bench (the benchmark's return), beta over the lookback and resid = ret - beta x bench.

    The covariance takes days on which both have a return and must have all of the lookback; the variance is the benchmark's.
    """
    bench = market.select("date", change(F.col("market"), by_date()).alias("bench"))
    both = returns(panel).join(F.broadcast(bench), "date", "left")
    w = by_ticker()
    frame = w.rowsBetween(-(lookback - 1), 0)
    paired = F.when(F.col("ret").isNotNull() & F.col("bench").isNotNull(), F.lit(1))
    covariance = F.when(F.count(paired).over(frame) == lookback, F.covar_samp("ret", "bench").over(frame))
    beta = ratio(covariance, roll(F.var_samp, F.col("bench"), w, lookback))
    return both.withColumn("beta", beta).withColumn("resid", F.col("ret") - F.col("beta") * F.col("bench"))


def group_features(
    panel: DataFrame,
    market: DataFrame,
    beta_lookback: int = 60,
    averages: tuple[int, ...] = (20, 50),
    trends: tuple[int, ...] = (5, 20, 60),
    volume_window: int = 20,
    volatility: int = 20,
    coverage: float = 0.8,
    group: str | None = None,
) -> DataFrame:
    """Group return, excess return, breadth, dispersion, coverage, breadth over averages and at highs, advancing volume, relative returns and
    volatility. Returns are null on dates on which fewer than max(2, ceil(active x coverage)) tickers have a residual."""
    keys = [group, "date"] if group else ["date"]
    w, day = by_ticker(), by_ticker(group) if group else by_date()
    member = F.col("member") if "member" in panel.columns else F.lit(True)
    rows = residuals(panel, market, beta_lookback).withColumn("member", member)
    rows = rows.withColumns({f"ma{n}": sma(F.col("close"), w, n) for n in averages})
    high = min(trends)
    rows = rows.withColumns(
        {
            "top": roll(F.max, F.col("close"), w, high),
            "volume_ratio": ratio(F.col("volume"), sma(F.col("volume"), w, volume_window)),
        }
    )
    close, ret, resid = F.col("close"), F.col("ret"), F.col("resid")
    out = rows.groupBy(*keys).agg(
        F.avg("ret").alias("raw_return"),
        F.avg("resid").alias("raw_excess"),
        F.avg(true(resid > 0).cast("int")).alias("raw_breadth"),
        F.stddev_samp("resid").alias("raw_dispersion"),
        F.count_if("member").alias("active_constituents"),
        F.count("resid").alias("present"),
        *[share(close > F.col(f"ma{n}"), close.isNotNull() & F.col(f"ma{n}").isNotNull()).alias(f"breadth_above_ma{n}") for n in averages],
        share(close >= F.col("top"), close.isNotNull() & F.col("top").isNotNull()).alias(f"breadth_new_high_{high}"),
        share((ret > 0) & (F.col("volume_ratio") > 1), F.col("volume_ratio").isNotNull() & ret.isNotNull()).alias("advancing_volume_breadth"),
        F.median("volume_ratio").alias("median_volume_ratio"),
    )
    eligible = F.col("present") >= F.greatest(F.lit(2), F.ceil(F.col("active_constituents") * coverage))
    names = {
        "group_return": "raw_return",
        "group_excess_return": "raw_excess",
        "breadth_positive_1d": "raw_breadth",
        "cross_sectional_dispersion": "raw_dispersion",
    }
    out = out.withColumns(
        {k: F.when(eligible, F.col(v)) for k, v in names.items()}
        | {"constituent_coverage": ratio(F.col("present"), F.nullif(F.col("active_constituents"), F.lit(0)))}
    )
    out = out.withColumns({f"relative_return_{n}": compound(F.col("group_excess_return"), day, n) for n in trends})
    out = out.withColumn(
        "realized_volatility", roll_std(F.col("group_return"), day, volatility) * F.sqrt(F.lit(float(YEAR)))
    )
    return out.drop("present", *names.values())


def sector_features(panel: DataFrame, short: int = 20, mid: int = 60, long: int = 120) -> DataFrame:
    """The sector's return, index, drawdowns, breadth over averages and of positive changes, thrust, dispersion, dollar volume, trend scores.

    Closes are first filled over gaps of at most two rows. Changes over several rows look through longer gaps.
    """
    w, day = by_ticker(), by_date()
    rows = panel.withColumn("close", padded(F.col("close"), w, 2))
    rows = rows.withColumns({"ret": change(F.col("close"), w), "through": padded(F.col("close"), w)})
    rows = rows.withColumns(
        {
            "ma_short": sma(F.col("close"), w, short),
            "ma_mid": sma(F.col("close"), w, mid),
            "change_5": change(F.col("through"), w, 5),
            "change_short": change(F.col("through"), w, short),
            "dollars": F.col("close") * F.col("volume"),
        }
    )
    present = F.count("close")

    def part(condition):
        return ratio(F.count_if(true(condition)), present)

    out = rows.groupBy("date").agg(
        F.avg("ret").alias("sector_return_1d"),
        ratio(F.count_if(true(F.col("ret") > 0)), F.count("ret")).alias("advance_fraction"),
        part(F.col("close") > F.col("ma_short")).alias("breadth_above_short_ma"),
        part(F.col("close") > F.col("ma_mid")).alias("breadth_above_mid_ma"),
        part(F.col("change_5") > 0).alias("breadth_positive_5d"),
        part(F.col("change_short") > 0).alias("breadth_positive_20d"),
        F.stddev_samp("ret").alias("cross_section_dispersion"),
        F.median("dollars").alias("median_dollar_volume"),
        (present / F.count("*")).alias("eligible_ticker_fraction"),
    )
    index = F.product(1 + F.coalesce("sector_return_1d", F.lit(0.0))).over(
        day.rowsBetween(Window.unboundedPreceding, 0)
    )
    out = out.withColumn("sector_index", index)
    at = F.col("sector_index")
    out = out.withColumns(
        {f"sector_return_{n}d": change(at, day, n) for n in (5, short, mid)}
        | {
            "realized_vol_20d": roll_std(F.col("sector_return_1d"), day, short) * F.sqrt(F.lit(float(YEAR))),
            "drawdown_60d": ratio(at, roll(F.max, at, day, mid)) - 1,
            "drawdown_long": ratio(at, roll(F.max, at, day, long)) - 1,
            "breadth_thrust_5d": F.col("breadth_positive_5d") - F.lag("breadth_positive_5d", 5).over(day),
        }
    )
    vol = F.nullif(F.col("realized_vol_20d"), F.lit(0.0))
    return out.withColumns(
        {
            "short_trend_score": ratio(F.col(f"sector_return_{short}d"), vol),
            "mid_trend_score": ratio(F.col(f"sector_return_{mid}d"), vol),
        }
    )


def members(panel: DataFrame, manifest: DataFrame) -> DataFrame:
    """With member: from the ticker's effective_from on. Values of other days are null."""
    own = panel.join(manifest.select("ticker", "effective_from"), "ticker", "left").withColumn(
        "member", true(F.col("date") >= F.col("effective_from"))
    )
    values = [c for c in ("close", "volume", "open", "high", "low") if c in panel.columns]
    return reduce(lambda d, c: d.withColumn(c, F.when(F.col("member"), F.col(c))), values, own)
