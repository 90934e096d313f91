"""The regime plan: group features, principal component, regimes, boosted trees, signals and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.rolling import by_date, forward_compound
from quillon.operators import correlation, dumps, evaluate, features, models
from quillon.plans.config import Config
from quillon.scratch import written


def group_frame(panel: DataFrame, market: DataFrame, horizon: int = 20, pca_window: int = 126) -> DataFrame:
    """A row a date: group features, mean pair correlation, principal component, and future_excess_return over the horizon."""
    panel, market = written(panel, "panel"), written(market, "market")
    rows = features.group_features(panel, market)
    rows = rows.join(correlation.rolling_mean(features.returns(panel)), "date", "left")
    rows = rows.join(correlation.rolling_pca(features.residuals(panel, market), pca_window, "resid"), "date", "left")
    return rows.withColumn("future_excess_return", forward_compound(F.col("group_excess_return"), by_date(), horizon))


#: What the classifier learns from: features, pair correlation, principal component and regimes.
INPUTS = (
    "relative_return_5", "relative_return_20", "relative_return_60", "breadth_positive_1d", "breadth_above_ma20", "breadth_above_ma50", "breadth_new_high_5",
    "advancing_volume_breadth", "median_volume_ratio", "cross_sectional_dispersion", "realized_volatility", "average_pairwise_correlation", "pca_factor",
    "pca_explained_variance", "bear_probability", "neutral_probability", "bull_probability",
)


def configured(panel: DataFrame, market: DataFrame, config: Config) -> tuple[
    DataFrame, DataFrame, DataFrame, DataFrame
]:
    """``run`` by a configuration, and the table of the final models, which ``dumps`` keeps, loads and applies."""
    b, s = config.boosting, config.signals
    frame, metrics, importance = run(
        panel,
        market,
        b.horizon,
        config.features.component,
        config.regimes.least,
        b.least,
        b.refit,
        b.trees,
        signals=(s.high, s.low, s.regime, s.wide, s.narrow),
    )
    frame = written(frame, "regimes")
    fitted = models.fit_boosted(frame, list(INPUTS), "future_excess_return", b.trees, b.depth)
    return frame, metrics, importance, fitted.unionByName(
        dumps.fit_regimes(frame, list(REGIMES), config.regimes.states)
    )


#: What regimes are found from.
REGIMES = ("group_excess_return", "realized_volatility", "breadth_above_ma20")


def run(
    panel: DataFrame,
    market: DataFrame,
    horizon: int = 20,
    pca_window: int = 126,
    least: int = 252,
    learn: int = 504,
    refit: int = 21,
    trees: int = 400,
    regimes: tuple[str, ...] = REGIMES,
    inputs: tuple[str, ...] = INPUTS,
    signals: tuple[float, ...] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The frame with probabilities and signal, the metrics of its predictions (one row), and the final model's feature importance.

    Regimes and classifier are fitted anew every ``refit`` rows, from ``least`` and ``learn`` rows on. probability is of models that never saw returns past their fit, and the metrics are of it;
    live_probability is the final model's, of all labelled rows, from which the signal comes.
    """
    # a row a date; each step reads what the one before has written
    frame = written(group_frame(panel, market, horizon, pca_window), "group-frame")
    states = models.walk_forward_regimes(frame, list(regimes), least, refit)
    frame = written(frame.join(states, "date", "left"), "states")
    boosted = written(
        models.walk_forward_boosted(frame, list(inputs), "future_excess_return", horizon, learn, refit, trees),
        "boosted",
    )
    live, importance = models.live_boosted(frame, list(inputs), "future_excess_return", trees)
    out = frame.join(boosted.select("date", "probability", "target"), "date", "left").join(live, "date", "left")
    signal = models.signal(
        F.col("live_probability"),
        F.col("bull_probability"),
        F.col("bear_probability"),
        F.col("breadth_above_ma20"),
        F.col("relative_return_20"),
        *signals,
    )
    return out.withColumn("signal", signal), evaluate.prediction_metrics(boosted), importance
