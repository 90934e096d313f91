"""Indicators of each ticker: oscillators, volume, divergence, confirmation, trend; and the alarm made of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.rolling import by_ticker, clip, padded, ratio, roll, roll_median, roll_std, sma, true
from quillon.scratch import written

YEAR = 252
#: Weights of the alarm and of the trend score, and the gates of a fired alarm.
ALARM = {"breadth": 0.25, "stretch": 0.20, "oscillator": 0.25, "volume": 0.15, "confirmation": 0.15}
TREND = {"slope": 0.40, "r2": 0.30, "adx": 0.15, "ma_stack": 0.15}
WASHOUT_GATE, ALARM_GATE = 0.5, 60.0


def smoothed(frame: DataFrame, inputs: dict[str, str], n: int) -> DataFrame:
    """frame with each input smoothed exponentially (1/n, unadjusted, from its first value on) along its ticker; a gap weakens what was before it.

    A row takes the value before it to a * value + b, so a run of rows is one such map. Within a block of rows, running products and sums
    give the maps of all beginnings; a ticker's blocks are then chained by a map each, and a row's value is its map of what its block began with. A
    block is so long that the products stay within doubles, so a history is one block or a few, and no task holds more than a window's buffer.
    """
    w, kept = by_ticker(), 1 - 1 / n
    own = frame.drop(*inputs.values()).withColumn("__pos", F.row_number().over(w) - 1)
    if n == 1:
        return own.withColumns({out: padded(F.col(x).cast("double"), w) for x, out in inputs.items()}).drop("__pos")
    value = {out: F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")) for x, out in inputs.items()}
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns(
        {"__block": F.floor(F.col("__pos") / int(200 / -math.log10(kept)))} | {f"__v_{o}": v for o, v in value.items()}
    )
    own = own.withColumns(
        {
            f"__g_{o}": F.col("__pos") - F.last(
                F.when(F.col(f"__v_{o}").isNotNull(), F.col("__pos")), True
            ).over(earlier)
            for o in value
        }
    )
    upto = Window.partitionBy("ticker", "__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    factor, term = {}, {}
    for o in value:
        v, weight = F.col(f"__v_{o}"), F.greatest(F.pow(F.lit(kept), F.col(f"__g_{o}")), F.lit(1e-50))
        first = F.col(f"__g_{o}").isNull()
        factor[f"__a_{o}"] = F.when(v.isNull() | first, 1.0).otherwise(weight / (weight + 1 / n))
        term[f"__b_{o}"] = F.when(v.isNull(), 0.0).when(first, v).otherwise(v / n / (weight + 1 / n))
    own = own.withColumns(factor | term).withColumns({f"__p_{o}": F.product(f"__a_{o}").over(upto) for o in value})
    own = own.withColumns({f"__s_{o}": F.sum(F.col(f"__b_{o}") / F.col(f"__p_{o}")).over(upto) for o in value})
    own = written(own.drop(*factor, *term), "smoothed")
    maps = F.struct(*[F.col(f"__{k}_{o}").alias(f"{k}_{o}") for o in value for k in "ps"])
    ends = own.groupBy("ticker", "__block").agg(F.max_by(maps, "__pos").alias("m"))
    chain = ends.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("__block", "m"))).alias("chain"))

    def begun(o: str) -> Column:
        """What each block begins with."""
        state = F.struct(F.lit(0.0).alias("now"), F.array().cast("array<double>").alias("begun"))

        def step(s: Column, e: Column) -> Column:
            after = e["m"][f"p_{o}"] * (s["now"] + e["m"][f"s_{o}"])
            return F.struct(after.alias("now"), F.array_append(s["begun"], s["now"]).alias("begun"))

        return F.aggregate("chain", state, step, lambda s: s["begun"])

    begins = chain.select("ticker", *[begun(o).alias(f"__y_{o}") for o in value])
    out = own.join(begins, "ticker")
    known = {
        o: F.when(
            F.col(f"__g_{o}").isNotNull() | F.col(f"__v_{o}").isNotNull(),
            F.col(f"__p_{o}") * (F.get(f"__y_{o}", F.col("__block").cast("int")) + F.col(f"__s_{o}")),
        )
        for o in value
    }
    return out.select(*[c for c in frame.columns if c not in value], *[v.alias(o) for o, v in known.items()])


def with_rsi(frame: DataFrame, n: int = 14, to: str = "rsi") -> DataFrame:
    """Relative strength index; 100 where nothing was lost, null on the first row."""
    delta = F.col("close") - F.lag("close").over(by_ticker())
    moved = frame.withColumns(
        {
            "__gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
            "__loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
        }
    )
    out = smoothed(moved, {"__gain": "__up", "__loss": "__down"}, n)
    value = F.when(F.col("__down").isNull(), None).otherwise(
        F.coalesce(100 - 100 / (1 + ratio(F.col("__up"), F.col("__down"))), F.lit(100.0))
    )
    return out.withColumn(to, value).drop("__gain", "__loss", "__up", "__down")


def indicators(bars: DataFrame, short: int = 20, mid: int = 60, span: int = 14) -> DataFrame:
    """bars with rsi, williams_r, stretch_z, volume_signal, divergence, confirmed."""
    w = by_ticker()
    close, volume = F.col("close"), F.col("volume")
    out = with_rsi(bars, span)
    low, high = roll(F.min, F.col("low"), w, span), roll(F.max, F.col("high"), w, span)
    out = out.withColumns(
        {
            "williams_r": ratio(-100 * (high - close), F.nullif(high - low, F.lit(0.0))),
            "stretch_z": F.coalesce(ratio(close - sma(close, w, mid), roll_std(close, w, mid)), F.lit(0.0)),
            "relative": ratio(volume, roll_median(volume, w, 20)),
            "price_low": roll(F.min, close, w, short),
            "rsi_low": roll(F.min, F.col("rsi"), w, short),
            "ma_short": sma(close, w, short),
        }
    )
    spike = clip((roll(F.max, F.col("relative"), w, 10) - 2) / 3, 0, 1)
    dry = clip((ratio(F.lit(1.0), F.col("relative")) - 1) / 1.5, 0, 1)
    lower = (F.col("price_low") < F.lag("price_low", short).over(w)) & (
        F.col("rsi_low") > F.lag("rsi_low", short).over(w)
    )
    reclaim = (close > F.col("ma_short")) & (F.lag("close").over(w) <= F.lag("ma_short").over(w))
    out = out.withColumns(
        {
            "volume_signal": F.coalesce(0.6 * spike + 0.4 * dry, F.lit(0.0)),
            "divergence": true(lower),
            "confirmed": true(close > F.lag("high").over(w)) | true(reclaim),
        }
    )
    return out.drop("relative", "price_low", "rsi_low", "ma_short")


def washout(panel: DataFrame, n: int = 60, oversold: float = 35.0) -> DataFrame:
    """cluster, date, washout: the share of a cluster's tickers that are oversold and below their mean. panel is dense."""
    rows = with_rsi(panel)
    flag = true(F.col("rsi") < oversold) & true(F.col("close") < sma(F.col("close"), by_ticker(), n))
    return rows.withColumn("flag", flag.cast("double")).groupBy("cluster", "date").agg(F.avg("flag").alias("washout"))


def alarms(
    bars: DataFrame,
    panel: DataFrame,
    short: int = 20,
    mid: int = 60,
    washout_gate: float = WASHOUT_GATE,
    alarm_gate: float = ALARM_GATE,
) -> DataFrame:
    """bars' indicators with washout, alarm (0 to 100) and fired (washout and alarm over their gates, and confirmed)."""
    out = indicators(bars, short, mid).join(washout(panel, mid), ["cluster", "date"], "left")
    washed = clip(F.coalesce("washout", F.lit(0.0)), 0, 1)
    score = ALARM["breadth"] * washed + ALARM["stretch"] * clip(-F.col("stretch_z") / 2, 0, 1) + ALARM["oscillator"] * F.coalesce(clip((50 - F.col("rsi")) / 30, 0, 1), F.lit(0.0)) + ALARM["volume"] * F.col("volume_signal") + ALARM["confirmation"] * (0.5 * F.col("confirmed").cast("double") + 0.5 * F.col("divergence").cast("double"))
    out = out.withColumn("alarm", clip(100 * score, 0, 100)).withColumn("washout", washed)
    return out.withColumn(
        "fired", (F.col("washout") > washout_gate) & (F.col("alarm") > alarm_gate) & F.col("confirmed")
    )


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """ticker, adx: the average directional index at the last bar; 0 for fewer than 2n + 1 bars."""
    w = by_ticker()
    rows = bars.where("high is not null and low is not null and close is not null")
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    before = F.lag("close").over(w)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    moved = rows.select(
        "ticker",
        "date",
        F.when((up > down) & (up > 0), up).otherwise(0.0).alias("plus"),
        F.when((down > up) & (down > 0), down).otherwise(0.0).alias("minus"),
        true_range.alias("range"),
    )
    out = smoothed(moved, {"plus": "p", "minus": "m", "range": "atr"}, n)
    plus, minus = ratio(100 * F.col("p"), F.col("atr")), ratio(100 * F.col("m"), F.col("atr"))
    dx = smoothed(
        out.select("ticker", "date", ratio(100 * F.abs(plus - minus), plus + minus).alias("dx")), {"dx": "value"}, n
    )
    return dx.groupBy("ticker").agg(
        F.when(F.count("*") >= 2 * n + 1, F.coalesce(F.max_by("value", "date"), F.lit(0.0))).otherwise(0.0).alias("adx")
    )


def slope_r2(bars: DataFrame, n: int) -> DataFrame:
    """ticker, slope, r2: of the line through the logarithms of the last n closes, a year's slope; 0 for fewer than three or a flat series."""
    last = bars.where("close is not null").withColumn(
        "k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    ).where(F.col("k") <= n)
    y, x = F.ln("close"), -F.col("k").cast("double")
    fit = last.groupBy("ticker").agg(
        F.count("*").alias("n"), F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy")
    )
    flat = (F.col("n") < 3) | (F.col("yy") < 1e-16)
    slope, r2 = ratio(F.col("xy"), F.col("xx")), ratio(F.col("xy") * F.col("xy"), F.col("xx") * F.col("yy"))
    return fit.select(
        "ticker",
        F.when(flat, 0.0).otherwise(slope * YEAR).alias("slope"),
        F.when(flat, 0.0).otherwise(F.greatest(r2, F.lit(0.0))).alias("r2"),
    )


def _side(a: Column, b: Column) -> Column:
    """1 above, -1 below, 0 if about equal or unknown."""
    near = F.abs(a - b) <= 1e-9 * F.greatest(F.abs(b), F.lit(1.0))
    return F.when(a.isNull() | b.isNull() | near, 0).when(a > b, 1).otherwise(-1)


def ma_stack(bars: DataFrame, short: int, mid: int) -> DataFrame:
    """ticker, ma_stack: the mean of four votes: close over the short average, it over the long one, and both over theirs four bars before."""
    w = by_ticker()
    rows = bars.where("close is not null").withColumns(
        {"s": sma(F.col("close"), w, short), "m": sma(F.col("close"), w, mid)}
    )
    rows = rows.withColumns({"s4": F.lag("s", 4).over(w), "m4": F.lag("m", 4).over(w)})
    last = rows.groupBy("ticker").agg(
        F.count("*").alias("n"), F.max_by(F.struct("close", "s", "m", "s4", "m4"), "date").alias("x")
    )
    votes = _side(F.col("x.close"), F.col("x.s")) + _side(F.col("x.s"), F.col("x.m")) + _side(
        F.col("x.s"), F.col("x.s4")
    ) + _side(F.col("x.m"), F.col("x.m4"))
    return last.select("ticker", F.when(F.col("n") < mid + 5, 0.0).otherwise(votes / 4).alias("ma_stack"))


def trend_scores(bars: DataFrame, n: int) -> DataFrame:
    """ticker, score (-100 to 100), slope, r2, adx, ma_stack."""
    w = Window.partitionBy("ticker").orderBy("date")
    own = bars.where("close is not null").withColumn(
        "r", F.ln("close") - F.ln(F.lag("close").over(w))
    ).where("r is not null")
    last = own.withColumn(
        "k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    ).where(F.col("k") <= n)
    vol = last.groupBy("ticker").agg((F.stddev_samp("r") * F.sqrt(F.lit(float(YEAR)))).alias("vol"))
    out = slope_r2(bars, n).join(vol, "ticker").join(adx(bars), "ticker").join(
        ma_stack(bars, max(n // 3, 2), n), "ticker"
    )
    s = F.tanh(F.coalesce(ratio(F.col("slope"), F.col("vol")), F.lit(0.0)))
    score = TREND["slope"] * s + TREND["r2"] * F.col("r2") * F.sign(s) + TREND["adx"] * F.least(
        F.col("adx") / 50, F.lit(1.0)
    ) * F.sign(s) + TREND["ma_stack"] * F.col("ma_stack")
    return out.withColumn("score", clip(100 * score, -100, 100)).drop("vol")


def trend_table(bars: DataFrame, short: int = 20, mid: int = 60) -> DataFrame:
    """ticker, short_score, mid_score, short_r2, mid_r2, adx, ma_stack, for tickers with mid + 5 closes."""
    enough = bars.groupBy("ticker").agg(F.count("close").alias("n")).where(F.col("n") >= mid + 5).select("ticker")
    a = trend_scores(bars, short).select("ticker", F.col("score").alias("short_score"), F.col("r2").alias("short_r2"))
    b = trend_scores(bars, mid).select(
        "ticker", F.col("score").alias("mid_score"), F.col("r2").alias("mid_r2"), "adx", "ma_stack"
    )
    return enough.join(a, "ticker").join(b, "ticker")
