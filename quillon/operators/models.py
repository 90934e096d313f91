"""Models walked forward: a Gaussian hidden Markov model of regimes and boosted trees; and the rules that turn them into signals."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.rolling import true
from quillon.operators import dumps
from quillon.operators.boosting import BoostedTrees
from quillon.operators.hmm import GaussianHmm as GaussianHmm
from quillon.operators.hmm import _log_density as _log_density  # tests take it from here
from quillon.scratch import written


def walk_forward_regimes(
    features: DataFrame, columns: list[str], least: int = 252, refit: int = 21, states: int = 3
) -> DataFrame:
    """date, bear_probability, neutral_probability, bull_probability, regime: filtered, each block of ``refit`` rows by a model of all rows before.

    Blocks are independent, so each is a group of its own: the rows up to its end. States are named by their mean of the first
    column. The series has a row a date. Rows with a null in a column are left out.
    """
    rows = features.select("date", *columns).dropna().withColumn("k", F.row_number().over(Window.orderBy("date")) - 1)
    n = rows.count()
    if n <= least:
        return rows.sparkSession.createDataFrame(
            [], "date date, bear_probability double, neutral_probability double, bull_probability double, regime string"
        )
    blocks = rows.sparkSession.range(-(-(n - least) // refit)).select(
        F.col("id").alias("block"), (F.lit(least) + F.col("id") * refit).alias("first")
    )
    fold = rows.join(F.broadcast(blocks), F.col("k") < F.col("first") + refit)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        first = int(part["first"].iloc[0])
        train, test = part[part["k"] < first], part[part["k"] >= first]
        x = train[columns].to_numpy(float)
        mean, spread = x.mean(axis=0), x.std(axis=0)
        spread[spread == 0] = 1
        model = GaussianHmm(states).fit((x - mean) / spread)
        prior = model.filtered((x - mean) / spread)[-1]
        found = model.filtered((test[columns].to_numpy(float) - mean) / spread, prior)
        return dumps.named_regimes(test["date"], found, model.means[:, 0])

    return fold.repartition("block").groupBy("block").applyInPandas(
        run, "date date, bear_probability double, neutral_probability double, bull_probability double, regime string"
    )


def causal_regimes(
    features: DataFrame,
    columns: list[str],
    named_by: str = "sector_return_20d",
    least: int = 160,
    refit: int = 20,
    states: int = 3,
    context: int = 31,
) -> DataFrame:
    """date, hmm_state, hmm_bear_probability, hmm_bull_probability: each block of ``refit`` rows by a model with diagonal covariances of all rows before.

    A row's probabilities are those of the last of the ``context`` rows up to it, begun anew. The states with the least and the largest mean of
    ``named_by`` over the rows that the model was fitted on are bear and bull. Rows with a null in a column are left out; the first ``least`` have none.
    """
    rows = features.select("date", *dict.fromkeys([*columns, named_by])).dropna().withColumn(
        "k", F.row_number().over(Window.orderBy("date")) - 1
    )
    n = rows.count()
    schema = "date date, hmm_state int, hmm_bear_probability double, hmm_bull_probability double"
    if n <= least:
        return rows.sparkSession.createDataFrame([], schema)
    blocks = rows.sparkSession.range(-(-(n - least) // refit)).select(
        F.col("id").alias("block"), (F.lit(least) + F.col("id") * refit).alias("first")
    )
    fold = rows.join(F.broadcast(blocks), F.col("k") < F.col("first") + refit)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        first = int(part["first"].iloc[0])
        x = part[columns].to_numpy(float)
        mean, spread = x[:first].mean(axis=0), x[:first].std(axis=0)
        spread[spread == 0] = 1
        z = (x - mean) / spread
        model = GaussianHmm(states, rounds=150, diagonal=True).fit(z[:first])
        own, value = model.decoded(z[:first]), part[named_by].to_numpy(float)[:first]
        means = np.array([value[own == s].mean() if (own == s).any() else 0.0 for s in range(states)])
        bear, bull = int(means.argmin()), int(means.argmax())
        last = np.array([model.filtered(z[max(0, k - context + 1) : k + 1])[-1] for k in range(first, len(z))])
        return pd.DataFrame(
            {
                "date": part["date"].iloc[first:],
                "hmm_state": last.argmax(axis=1),
                "hmm_bear_probability": last[:, bear],
                "hmm_bull_probability": last[:, bull],
            }
        )

    return fold.repartition("block").groupBy("block").applyInPandas(run, schema)


def _finite_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows whose columns are all finite numbers (NaN is above infinity).

    A condition for each column, which names it once: the optimizer keeps a condition with each choice of old and new names of the columns that are
    renamed after it, so one over all of them would be kept 2 to the power of their number times.
    """
    return rows.where(reduce(lambda a, b: a & b, [F.abs(F.col(c).cast("double")) < float("inf") for c in columns]))


def _complete(features: DataFrame, columns: list[str], future: str) -> DataFrame:
    """date, columns, future, target (its sign), and k, the number of a row among those with a target; rows with a null or no finite column go."""
    rows = _finite_rows(features, columns).select(
        "date", *[F.col(c).cast("double").alias(c) for c in columns], F.col(future).alias("future")
    )
    rows = rows.withColumn("target", (F.col("future") > 0).cast("double"))
    labelled = F.count("target").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.withColumn("k", F.when(F.col("target").isNotNull(), labelled))


def walk_forward_boosted(
    features: DataFrame,
    columns: list[str],
    future: str,
    horizon: int = 20,
    least: int = 504,
    refit: int = 21,
    trees: int = 400,
    depth: int = 3,
) -> DataFrame:
    """date, probability, target, future: each block of ``refit`` rows by boosted trees learned from rows that end ``horizon`` before it.

    Rows with a target are counted, the first block begins after ``least`` and the horizon. A block whose rows to learn from have one
    target only has no probability. Blocks are groups of their own, so all are fitted at once.
    """
    rows = _complete(features, columns, future).where("k is not null")
    n, schema = rows.count(), "date date, probability double, target double, future double"
    if n <= least + horizon:
        return rows.sparkSession.createDataFrame([], schema)
    blocks = rows.sparkSession.range(-(-(n - least - horizon) // refit)).select(
        F.col("id").alias("block"), (F.lit(least + horizon) + F.col("id") * refit).alias("first")
    )
    fold = rows.join(
        F.broadcast(blocks),
        (F.col("k") < F.col("first") - horizon) | F.col("k").between(F.col("first"), F.col("first") + refit - 1),
    )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        early = part["k"] < part["first"]
        train, test = part[early], part[~early]
        if train["target"].nunique() < 2:
            return pd.DataFrame(columns=["date", "probability", "target", "future"])
        model = BoostedTrees(trees, depth, lasso=0.05).fit(train[columns].to_numpy(), train["target"].to_numpy())
        return pd.DataFrame(
            {
                "date": test["date"],
                "probability": model.probability(test[columns].to_numpy()),
                "target": test["target"],
                "future": test["future"],
            }
        )

    return fold.repartition("block").groupBy("block").applyInPandas(run, schema)


def fit_boosted(features: DataFrame, columns: list[str], future: str, trees: int = 400, depth: int = 3) -> DataFrame:
    """The model table of boosted trees of all complete rows with a target. With one target only its parameters are null and each importance is 0.

    A row a date, so one task's; ``largeboost.fit_large`` fits tables of any size.
    """
    rows = _complete(features, columns, future).where("target is not null")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        train = part.sort_values("date")
        row = (dumps.BOOSTED, dumps.VERSION, columns, None, dict.fromkeys(columns, 0.0))
        if train["target"].nunique() == 2:
            row = dumps.boosted_row(
                BoostedTrees(trees, depth, lasso=0.05).fit(train[columns].to_numpy(), train["target"].to_numpy()),
                columns,
            )
        return pd.DataFrame([row], columns=["kind", "version", "columns", "parameters", "importance"])

    return rows.groupBy().applyInPandas(run, dumps.SCHEMA)


def importances(models: DataFrame) -> DataFrame:
    """feature, importance of a model table, the largest first."""
    return models.where("importance is not null").select(
        F.explode("importance").alias("feature", "importance")
    ).orderBy(F.desc("importance"), "feature")


def live_boosted(
    features: DataFrame, columns: list[str], future: str, trees: int = 400, depth: int = 3
) -> tuple[DataFrame, DataFrame]:
    """The model of all rows with a target, fitted once: date, live_probability of all complete rows, and feature, importance, the largest first.

    With one target only there is no live probability, and as no split gains anything then, each importance is 0. Without a target neither has a row.
    """
    model = written(fit_boosted(features, columns, future, trees, depth), "model")
    return dumps.score_boosted(
        _finite_rows(features, columns), model, ("date",), "live_probability"
    ), importances(model)


def rebound_probability(
    rows: DataFrame, columns: list[str], horizon: int = 10, splits: int = 4, trees: int = 120, least: int = 60
) -> DataFrame:
    """date, split, probability, target, importance: a rebound's probability by class-weighted boosted trees over splits with a gap.

    rows: date, columns, label (null: not eligible). Labelled complete rows are cut into equal test blocks at their end, each learned from the rows that end ``horizon`` before
    it, with class weights of these rows alone; split is the block's number, and splits the row of the final model, of all labelled rows, for the last complete date, with importance as a
    map of columns. With under ``least`` labelled rows or one class only there is no row, and the caller takes the heuristic.
    """
    own = _finite_rows(rows, columns).select(
        "date", *[F.col(c).cast("double").alias(c) for c in columns], F.col("label").alias("target")
    )

    def model(train: pd.DataFrame) -> BoostedTrees:
        positives = int(train["target"].sum())
        weight = max(1.0, (len(train) - positives) / max(1, positives))
        return BoostedTrees(trees, 3, 0.05, 0.85, 0.85, 3.0, 2.0, positive=weight).fit(
            train[columns].to_numpy(), train["target"].to_numpy()
        )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        known = part[part["target"].notna()]
        out: list[tuple] = []
        if len(known) >= least and known["target"].nunique() == 2:
            blocks = min(splits, max(2, len(known) // 30))
            size = len(known) // (blocks + 1)
            for i in range(blocks):
                start = len(known) - (blocks - i) * size
                train, test = known.iloc[: max(start - horizon, 0)], known.iloc[start : start + size]
                if train["target"].nunique() == 2:
                    found = model(train).probability(test[columns].to_numpy())
                    out += [
                        (d, i, float(p), float(t), None)
                        for d, p, t in zip(test["date"], found, test["target"], strict=True)
                    ]
            final, last = model(known), part.iloc[[-1]]
            shares = {c: float(v) for c, v in zip(columns, final.importance(), strict=True)}
            out.append(
                (last["date"].iloc[0], blocks, float(final.probability(last[columns].to_numpy())[0]), None, shares)
            )
        return pd.DataFrame(out, columns=["date", "split", "probability", "target", "importance"])

    return own.groupBy().applyInPandas(
        run, "date date, split int, probability double, target double, importance map<string,double>"
    )


def heuristic_probability(drawdown: Column, thrust: Column, bull: Column) -> Column:
    """Of a rebound, without a model."""
    x = -4 * F.coalesce(drawdown, F.lit(0.0)) + 2 * F.coalesce(thrust, F.lit(0.0)) + F.coalesce(bull, F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(10.0)), F.lit(-10.0))))


def signal(
    probability: Column,
    bull: Column,
    bear: Column,
    breadth: Column,
    trend: Column,
    high: float = 0.60,
    low: float = 0.40,
    regime: float = 0.50,
    wide: float = 0.60,
    narrow: float = 0.40,
) -> Column:
    """bullish, bearish, neutral, or unavailable without a probability; bearish goes before bullish."""
    up = (probability >= high) & (bull >= regime) & (breadth >= wide) & (trend > 0)
    down = (probability <= low) & (bear >= regime) & (breadth <= narrow) & (trend < 0)
    return F.when(
        probability.isNull(), "unavailable"
    ).when(true(down), "bearish").when(true(up), "bullish").otherwise("neutral")


def alert(
    rows: DataFrame,
    correction: float = -0.08,
    least_correlation: float = 0.55,
    least_probability: float = 0.70,
    least_thrust: float = 0.10,
) -> DataFrame:
    """rows with watch (a correction in step) and triggered (and a likely rebound with breadth thrust)."""
    watch = true((F.col("drawdown") <= correction) & (F.col("correlation") >= least_correlation))
    return rows.withColumn("watch", watch).withColumn(
        "triggered",
        F.col("watch") & true((F.col("probability") >= least_probability) & (F.col("thrust") >= least_thrust)),
    )


def finite(x: Column) -> Column:
    """x, null where it is no finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
