"""The sector plan: features of a sector, labels of rebounds, a probability, the alert and the ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import correlation, evaluate, features, labels, models, strength
from quillon.scratch import written


#: What regimes are found from.
REGIME_INPUTS = (
    "sector_return_5d",
    "sector_return_20d",
    "realized_vol_20d",
    "drawdown_60d",
    "breadth_positive_20d",
    "breadth_thrust_5d",
    "median_pairwise_correlation",
    "pca_explained_variance",
    "pca_factor",
)


def analyse(
    panel: DataFrame,
    short: int = 20,
    mid: int = 60,
    long: int = 120,
    least: int = 160,
    refit: int = 20,
    trees: int = 120,
) -> DataFrame:
    """A row a date: sector features, median pair correlation, principal component, regimes, rebound label, probability, watch, triggered.

    The probability is the classifier's, out of sample and for the last date, where it could be fitted; else, for all dates, the heuristic's.
    """
    panel = written(panel, "panel")
    returned = written(features.returns(panel), "returns")
    rows = features.sector_features(panel, short, mid, long)
    rows = rows.join(correlation.rolling_median(returned, mid), "date", "left").join(
        correlation.rolling_pca(returned, mid, "ret", complete=True), "date", "left"
    )
    # a row a date from here on; each step reads what the one before has written
    rows = written(rows, "sector-features")
    rows = written(
        rows.join(
            models.causal_regimes(rows, list(REGIME_INPUTS), f"sector_return_{short}d", least, refit), "date", "left"
        ),
        "regimes",
    )
    rows = written(rows.join(labels.first_hit(rows, bear="hmm_bear_probability"), "date", "left"), "labels")
    inputs = [c for c, t in rows.dtypes if t in ("double", "int", "bigint") and c != "label"]
    fitted = models.rebound_probability(rows, inputs, trees=trees)
    fitted = fitted.groupBy("date").agg(F.max_by("probability", "split").alias("model_probability"))
    rows = rows.join(fitted, "date", "left").withColumn(
        "fitted", F.max(F.col("model_probability").isNotNull()).over(Window.partitionBy())
    )
    guess = models.heuristic_probability(
        F.col("drawdown_60d"), F.col("breadth_thrust_5d"), F.coalesce("hmm_bull_probability", F.lit(0.0))
    )
    rows = written(rows, "fitted")
    rows = rows.withColumn(
        "probability", F.when(F.col("fitted"), F.col("model_probability")).otherwise(guess)
    ).drop("fitted", "model_probability")
    watched = models.alert(
        rows.select(
            "date",
            F.col("drawdown_60d").alias("drawdown"),
            F.col("median_pairwise_correlation").alias("correlation"),
            "probability",
            F.col("breadth_thrust_5d").alias("thrust"),
        )
    )
    return rows.join(watched.select("date", "watch", "triggered"), "date")


def validation(analysed: DataFrame, trees: int = 120) -> tuple[DataFrame, DataFrame]:
    """The classifier's metrics out of sample (one row), and its feature importance: feature, importance, the largest first."""
    inputs = [c for c, t in analysed.dtypes if t in ("double", "int", "bigint") and c not in ("label", "probability")]
    found = written(models.rebound_probability(written(analysed, "analysed"), inputs, trees=trees), "rebounds")
    metrics = evaluate.prediction_metrics(
        found.where("target is not null").withColumn("future", F.lit(None).cast("double"))
    )
    shares = found.where("importance is not null").select(F.explode("importance").alias("feature", "importance"))
    return metrics, shares.orderBy(F.desc("importance"), "feature")


def latest_alert(analysed: DataFrame, ranking: DataFrame) -> DataFrame:
    """One row: the last date with correlation and component, its watch and trigger, and the three best of either rank."""
    last = analysed.where("median_pairwise_correlation is not null and pca_explained_variance is not null").agg(
        F.max_by(F.struct("date", "watch", "triggered", "probability"), "date").alias("x")
    ).select("x.*")

    def best(rank: str, name: str) -> DataFrame:
        return ranking.orderBy(rank, "ticker").limit(3).agg(
            F.array_sort(F.collect_list(F.struct(rank, "ticker"))).alias("t")
        ).select(F.transform("t", lambda s: s["ticker"]).alias(name))

    return last.join(F.broadcast(best("fall_resistance_rank", "top_fall_resistant"))).join(
        F.broadcast(best("rise_strength_rank", "top_rise_strength"))
    )


def ranking(panel: DataFrame, window: int = 60) -> DataFrame:
    return strength.rank_tickers(panel, window)
