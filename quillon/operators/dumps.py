"""Fitted models as rows of a table (kind, version, columns, parameters, importance), to be kept, loaded and applied without a fit."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.boosting import BoostedTrees, Node
from quillon.operators.hmm import GaussianHmm

VERSION = 1
BOOSTED, REGIMES = "boosted", "regimes"
SCHEMA = "kind string, version int, columns array<string>, parameters string, importance map<string,double>"


def _flat(root: Node) -> list[list]:
    """A tree's nodes in order of visit: feature, cut, weight and the places of both branches, -1 for none."""
    out: list[list] = []

    def visit(node: Node) -> int:
        at = len(out)
        out.append([node.feature, node.cut, node.weight, -1, -1])
        if node.feature >= 0:
            out[at][3], out[at][4] = visit(node.left), visit(node.right)
        return at

    visit(root)
    return out


def _tree(flat: list[list], at: int = 0) -> Node:
    feature, cut, weight, left, right = flat[at]
    return Node(weight, feature, cut, _tree(flat, left), _tree(flat, right)) if feature >= 0 else Node(weight)


def boosted_row(model: BoostedTrees, columns: list[str]) -> tuple:
    text = json.dumps({"rate": model.rate, "trees": [_flat(t) for t in model.grown]})
    return BOOSTED, VERSION, columns, text, {c: float(v) for c, v in zip(columns, model.importance(), strict=True)}


def boosted_model(parameters: str) -> BoostedTrees:
    found = json.loads(parameters)
    return BoostedTrees(trees=len(found["trees"]), rate=found["rate"], grown=[_tree(t) for t in found["trees"]])


def regimes_row(model: GaussianHmm, columns: list[str], mean: np.ndarray, spread: np.ndarray) -> tuple:
    arrays = {
        "start": model.start,
        "step": model.step,
        "means": model.means,
        "covs": model.covs,
        "mean": mean,
        "spread": spread,
    }
    return REGIMES, VERSION, columns, json.dumps({k: np.asarray(v).tolist() for k, v in arrays.items()}), None


def regimes_model(parameters: str) -> tuple[GaussianHmm, np.ndarray, np.ndarray]:
    """The model, and the mean and spread of the rows it was fitted on."""
    found = {k: np.array(v) for k, v in json.loads(parameters).items()}
    model = GaussianHmm(len(found["start"]))
    model.start, model.step, model.means, model.covs = (found[k] for k in ("start", "step", "means", "covs"))
    return model, found["mean"], found["spread"]


def save(models: DataFrame, path: str) -> None:
    models.select("kind", "version", "columns", "parameters", "importance").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _only(models: DataFrame, kind: str):
    found = models.where((F.col("kind") == kind) & F.col("parameters").isNotNull()).limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"several models of kind {kind}")
    if found and found[0].version != VERSION:
        raise ValueError(f"the model has version {found[0].version}, not {VERSION}")
    return found[0] if found else None


def score_boosted(
    rows: DataFrame, models: DataFrame, keep: tuple[str, ...] = ("date",), to: str = "probability"
) -> DataFrame:
    """keep and the probability of 1 by the table's boosted trees, in Arrow batches; null for rows with a null or NaN input. No model: no rows."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keep}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), f"`{to}` double"])
    found = _only(models, BOOSTED)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    columns, parameters = list(found["columns"]), found.parameters
    slim = rows.select(*keep, *[F.col(c).cast("double").alias(f"__{c}") for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = boosted_model(parameters)
        for batch in batches:
            x = np.column_stack(
                [batch.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(len(columns))]
            ) if batch.num_rows else np.empty((0, len(columns)))
            p = model.probability(x)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(p, mask=np.isnan(x).any(axis=1))], [*keep, to]
            )

    return slim.mapInArrow(run, schema)


def fit_regimes(features: DataFrame, columns: list[str], states: int = 3) -> DataFrame:
    """The model table of a hidden Markov model of all complete rows (a row a date, so one task's)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("date")[columns].to_numpy(float)
        mean, spread = x.mean(axis=0), x.std(axis=0)
        spread[spread == 0] = 1
        row = regimes_row(GaussianHmm(states).fit((x - mean) / spread), columns, mean, spread)
        return pd.DataFrame([row], columns=["kind", "version", "columns", "parameters", "importance"])

    return features.select("date", *columns).dropna().groupBy().applyInPandas(run, SCHEMA)


def score_regimes(features: DataFrame, models: DataFrame) -> DataFrame:
    """date, bear_probability, neutral_probability, bull_probability, regime of all complete rows, filtered by the table's model from the first row on."""
    schema = "date date, bear_probability double, neutral_probability double, bull_probability double, regime string"
    found = _only(models, REGIMES)
    if found is None:
        return features.sparkSession.createDataFrame([], schema)
    columns, parameters = list(found["columns"]), found.parameters

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        model, mean, spread = regimes_model(parameters)
        return named_regimes(
            part["date"], model.filtered((part[columns].to_numpy(float) - mean) / spread), model.means[:, 0]
        )

    return features.select("date", *columns).dropna().groupBy().applyInPandas(run, schema)


def named_regimes(dates, filtered: np.ndarray, means: np.ndarray) -> pd.DataFrame:
    """States by the mean of the first column: the least is bear, the largest bull, the rest neutral. Of equal probabilities the first name."""
    order = np.argsort(means)
    bear, bull, neutral = filtered[:, order[0]], filtered[:, order[-1]], filtered[:, order[1:-1]].sum(axis=1)
    names = np.array(["bear", "neutral", "bull"])[np.argmax(np.c_[bear, neutral, bull], axis=1)]
    return pd.DataFrame(
        {
            "date": dates,
            "bear_probability": bear,
            "neutral_probability": neutral,
            "bull_probability": bull,
            "regime": names,
        }
    )
