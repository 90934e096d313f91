"""Signals against labels and against chance; folds, gates and metrics of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.rolling import by_ticker, ratio, true
from quillon.operators.labels import forward_return
from quillon.operators.permute import key_of, permuted


def matches(rows: DataFrame, tolerance: int, keys: list[str] | None = None) -> DataFrame:
    """Each signal with its nearest label of the ticker: keys, ticker, pos, label_pos, lead, matched (within the tolerance).

    rows: ticker, date, signal, label. The nearest label before and after come from two window look-ups; of two as near, the earlier.
    """
    part = [*(keys or []), "ticker"]
    w = Window.partitionBy(*part).orderBy("date")
    placed = rows.withColumn("pos", F.row_number().over(w))
    at = F.when(true(F.col("label")), F.col("pos"))
    placed = placed.withColumns(
        {
            "before": F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "after": F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    nearest = F.when(F.col("before").isNull(), F.col("after")).when(
        F.col("after").isNull() | (F.col("pos") - F.col("before") <= F.col("after") - F.col("pos")), F.col("before")
    ).otherwise(F.col("after"))
    near = placed.where(true(F.col("signal"))).withColumn("label_pos", nearest)
    return near.select(
        *part,
        "pos",
        "label_pos",
        (F.col("label_pos") - F.col("pos")).alias("lead"),
        true(F.abs(F.col("label_pos") - F.col("pos")) <= tolerance).alias("matched"),
    )


def scores(rows: DataFrame, tolerance: int, keys: list[str] | None = None) -> DataFrame:
    """Pooled over tickers: keys, signals, labels, true_positives, matched_labels, precision, recall, f1, mean_lead_days."""
    keys = keys or []
    found = matches(rows, tolerance, keys)
    hits = found.groupBy(*keys).agg(
        F.count("*").alias("signals"),
        F.count_if("matched").alias("true_positives"),
        F.count_distinct(F.when(F.col("matched"), F.struct("ticker", "label_pos"))).alias("matched_labels"),
        F.avg(F.when(F.col("matched"), F.col("lead"))).alias("mean_lead_days"),
    )
    labels = rows.groupBy(*keys).agg(F.count_if(true(F.col("label"))).alias("labels"))
    both = labels.join(hits, keys, "left") if keys else labels.join(F.broadcast(hits))
    both = both.na.fill(0, ["signals", "true_positives", "matched_labels"])
    p, r = F.coalesce(ratio(F.col("true_positives"), F.col("signals")), F.lit(0.0)), F.coalesce(
        ratio(F.col("matched_labels"), F.col("labels")), F.lit(0.0)
    )
    return both.withColumns({"precision": p, "recall": r}).withColumn(
        "f1",
        F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)),
    )


def samples(
    bars: DataFrame, signal: Column, horizons: tuple[int, ...] = (5, 10, 20), keys: list[str] | None = None
) -> DataFrame:
    """keys, horizon, value: the forward returns of all signals."""
    w = by_ticker()
    rows = bars.withColumns({f"h{h}": forward_return(F.col("close"), w, h) for h in horizons}).where(true(signal))
    return rows.select(
        *(keys or []),
        F.explode(
            F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("value")) for h in horizons])
        ).alias("s"),
    ).select(*(keys or []), "s.*").where("value is not null")


def _metrics() -> list[Column]:
    hit = F.avg((F.col("value") > 0).cast("int"))
    return [
        F.count("*").alias("n"),
        F.avg("value").alias("mean_return"),
        F.median("value").alias("median_return"),
        hit.alias("hit_rate"),
    ]


def economics(pooled: DataFrame, horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """horizon, n, mean_return, median_return, hit_rate; a row for every horizon."""
    out = pooled.groupBy("horizon").agg(*_metrics())
    every = pooled.sparkSession.createDataFrame([(h,) for h in horizons], "horizon int")
    return every.join(out, "horizon", "left").na.fill(0, ["n"])


def baseline(
    bars: DataFrame, signal: Column, horizons: tuple[int, ...] = (5, 10, 20), draws: int = 50, seed: int = 0
) -> DataFrame:
    """ticker, draw, horizon, value: forward returns of as many random days of each ticker as it has signals, drawn ``draws`` times.

    Days without room for the longest horizon aren't drawn. A draw takes the first places of a permutation of the ticker's days, keyed by seed,
    draw and ticker: its positions are computed and looked up, so the rows made are draws times signals, not draws times days, and no
    draw has a day twice. The same on any cluster.
    """
    w = by_ticker()
    ahead = {f"h{h}": forward_return(F.col("close"), w, h) for h in horizons}
    days = bars.withColumns({"signalled": true(signal), "pos": F.row_number().over(w) - 1, **ahead})
    size = F.greatest(F.count("*") - max(horizons), F.lit(1))
    own = days.groupBy("ticker").agg(
        F.least(F.count_if("signalled"), size).alias("wanted"), size.alias("room")
    ).where("wanted > 0")
    drawn = own.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn(
        "key", key_of(F.lit(seed), F.col("draw"), F.col("ticker"))
    )
    places = drawn.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wanted") - 1)))
    chosen = places.select("ticker", "draw", permuted(F.col("k"), F.col("room"), F.col("key")).cast("int").alias("pos"))
    taken = chosen.join(days.select("ticker", "pos", *ahead), ["ticker", "pos"])
    values = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("value")) for h in horizons]))
    return taken.select("ticker", "draw", values.alias("s")).select("ticker", "draw", "s.*").where("value is not null")


def random_baseline(
    bars: DataFrame, signal: Column, horizons: tuple[int, ...] = (5, 10, 20), draws: int = 200, seed: int = 0
) -> DataFrame:
    """ticker, horizon, n, mean_return, median_return, hit_rate: the means over draws of each draw's metrics."""
    each = baseline(bars, signal, horizons, draws, seed).groupBy("ticker", "horizon", "draw").agg(*_metrics())
    return each.groupBy("ticker", "horizon").agg(
        *[F.avg(c).alias(c) for c in ("n", "mean_return", "median_return", "hit_rate")]
    )


def edges(signal: DataFrame, chance: DataFrame) -> DataFrame:
    """Signal's metrics and those of chance (with _baseline) by horizon, with mean_edge and hit_rate_edge."""
    other = chance.select(
        "horizon", *[F.col(c).alias(f"{c}_baseline") for c in ("n", "mean_return", "median_return", "hit_rate")]
    )
    return signal.join(other, "horizon").withColumns(
        {
            "mean_edge": F.col("mean_return") - F.col("mean_return_baseline"),
            "hit_rate_edge": F.col("hit_rate") - F.col("hit_rate_baseline"),
        }
    )


def expanding_folds(spark: SparkSession, start: str, end: str, initial: int = 5, step: int = 1) -> DataFrame:
    """fold, fit_start, fit_end, test_start, test_end, partial: fits from the start on, tests of ``step`` years after."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    first = F.year(a) + initial
    years = spark.range(1).select(
        F.explode(F.when(first <= F.year(b), F.sequence(first, F.year(b), F.lit(step)))).alias("y")
    )
    test, last = F.make_date("y", F.lit(1), F.lit(1)), F.make_date(F.col("y") + step - 1, F.lit(12), F.lit(31))
    return years.select(
        (F.floor((F.col("y") - first) / step)).cast("int").alias("fold"),
        a.alias("fit_start"),
        F.date_sub(test, 1).alias("fit_end"),
        test.alias("test_start"),
        F.least(last, b).alias("test_end"),
        (last > b).alias("partial"),
    )


def gate_search(
    alarms: DataFrame,
    folds: DataFrame,
    gates: tuple[float, ...] = (40, 50, 55, 60, 65, 70, 80),
    tolerance: int = 10,
    washout_gate: float = 0.5,
) -> DataFrame:
    """fold, gate, f1: for each fold the gate of the best pooled F1 over its fit window; of equals, the first. One pass over all gates and folds.

    alarms: ticker, date, washout, alarm, confirmed, label.
    """
    fits = alarms.join(
        F.broadcast(folds.select("fold", "fit_start", "fit_end")),
        F.col("date").between(F.col("fit_start"), F.col("fit_end")),
    )
    gated = fits.select(
        "fold",
        "ticker",
        "date",
        "label",
        "washout",
        "alarm",
        "confirmed",
        F.explode(F.array(*[F.lit(float(g)) for g in gates])).alias("gate"),
    )
    signal = (F.col("washout") > washout_gate) & (F.col("alarm") > F.col("gate")) & F.col("confirmed")
    found = scores(gated.withColumn("signal", signal), tolerance, ["fold", "gate"])
    place = F.array_position(F.array(*[F.lit(float(g)) for g in gates]), F.col("gate"))
    best = found.groupBy("fold").agg(F.max_by(F.struct("gate", "f1"), F.struct("f1", -place)).alias("b"))
    return best.select("fold", "b.gate", "b.f1")


def purged_splits(n: int, splits: int, gap: int, spark: SparkSession) -> DataFrame:
    """split, train_end (exclusive), test_start, test_end: equal test blocks at the end, with a gap before each."""
    size = n // (splits + 1)
    start = F.lit(n) - (F.lit(splits) - F.col("id")) * size
    return spark.range(splits).select(
        F.col("id").cast("int").alias("split"),
        F.greatest(start - gap, F.lit(0)).alias("train_end"),
        start.alias("test_start"),
        (start + size).alias("test_end"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def prediction_metrics(
    rows: DataFrame,
    probability: str = "probability",
    target: str = "target",
    future: str = "future",
    high: float = 0.60,
    low: float = 0.40,
    threshold: float = 0.70,
) -> DataFrame:
    """One row: n, accuracy_at_0_5, brier_score, roc_auc, average_precision, precision and recall at the threshold (0 without any), and returns and hit rates where
    the probability is high or low.

    AUC is by average ranks, precision by steps; distinct probabilities are counted first, so ties cost one row.
    """
    use = rows.where(F.col(probability).isNotNull() & F.col(target).isNotNull())
    p, t, r = F.col(probability), F.col(target).cast("double"), F.col(future)
    plain = use.agg(
        F.count("*").alias("n"),
        F.avg(((p >= 0.5).cast("double") == t).cast("int")).alias("accuracy_at_0_5"),
        F.avg((p - t) * (p - t)).alias("brier_score"),
        F.count_if(p >= high).alias("bullish_observations"),
        F.count_if(p <= low).alias("bearish_observations"),
        F.avg(F.when(p >= high, r)).alias("mean_forward_return_when_bullish"),
        F.avg(F.when(p <= low, r)).alias("mean_forward_return_when_bearish"),
        F.avg(F.when(p >= high, (r > 0).cast("int"))).alias("bullish_hit_rate"),
        F.avg(F.when(p <= low, (r < 0).cast("int"))).alias("bearish_hit_rate"),
        _share(F.count_if((p >= threshold) & (t == 1)), F.count_if(p >= threshold)).alias("precision_at_threshold"),
        _share(F.count_if((p >= threshold) & (t == 1)), F.count_if(t == 1)).alias("recall_at_threshold"),
    )
    level = use.groupBy(p.alias("p")).agg(F.sum(t).alias("pos"), F.count("*").alias("all"))
    up, down = Window.orderBy("p").rowsBetween(
        Window.unboundedPreceding, 0
    ), Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = level.select(
        "pos",
        "all",
        (F.sum("all").over(up) - F.col("all") + (F.col("all") + 1) / 2).alias("rank"),
        F.sum("pos").over(down).alias("tp"),
        F.sum("all").over(down).alias("seen"),
    )
    pos, neg = F.sum("pos"), F.sum(F.col("all") - F.col("pos"))
    curve = ranked.agg(
        ratio(F.sum(F.col("pos") * F.col("rank")) - pos * (pos + 1) / 2, pos * neg).alias("roc_auc"),
        ratio(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), pos).alias("average_precision"),
    )
    return plain.join(F.broadcast(curve))
