"""The backtest of the alarm: expanding folds, the gate fitted on each fit window, scores and economics on each test window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import evaluate, indicators, labels
from quillon.plans.config import Config
from quillon.scratch import written


def run(bars: DataFrame, panel: DataFrame, config: Config) -> dict[str, DataFrame]:
    """per_fold (gate and pooled scores of each test window), economics, baseline and edges over all tests.

    The alarm is computed once; folds and gates are joined to it, so there is one pass for all. bars and panel have clusters.
    A label near a fold's end looks past it, as in the fit of any label of the future; signals never do.
    """
    b, w, spark = config.backtest, config.windows, bars.sparkSession
    alarms = indicators.alarms(bars, panel, w.short, w.mid, config.washout_gate, config.alarm_gate)
    rows = labels.bottoms(alarms, b.half_window, b.ahead, b.least_return).select(
        "ticker",
        "date",
        "close",
        "washout",
        "alarm",
        "confirmed",
        "label",
    )
    rows = written(rows, "alarms")
    folds = evaluate.expanding_folds(spark, b.start, b.end, b.initial_years, b.step_years)
    gates = evaluate.gate_search(rows, folds, b.gates, b.half_window, config.washout_gate)
    plan = folds.join(gates.select("fold", "gate"), "fold")
    test = rows.join(
        F.broadcast(plan.select("fold", "gate", "test_start", "test_end")),
        F.col("date").between(F.col("test_start"), F.col("test_end")),
    )
    test = test.withColumn(
        "signal", (F.col("washout") > config.washout_gate) & (F.col("alarm") > F.col("gate")) & F.col("confirmed")
    )
    per_fold = plan.join(evaluate.scores(test, b.half_window, ["fold"]), "fold", "left")
    own = evaluate.economics(evaluate.samples(test, F.col("signal"), b.horizons), b.horizons)
    chance = evaluate.economics(evaluate.baseline(test, F.col("signal"), b.horizons, b.draws), b.horizons)
    return {"per_fold": per_fold, "economics": own, "baseline": chance, "edges": evaluate.edges(own, chance)}
