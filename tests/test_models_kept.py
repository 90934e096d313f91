"""Models kept as tables, class weights, and boosted trees over executors."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import dumps, largeboost, models
from quillon.operators.boosting import BoostedTrees
from quillon.operators.hmm import GaussianHmm


def rows(seed, n=260):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    return pd.DataFrame(
        {
            "date": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)],
            "a": a,
            "b": b,
            "future": a * 0.5 + rng.normal(size=n) * 0.3,
        }
    )


def test_trees_score_after_loading_as_before(spark, tmp_path):
    frame = rows(1)
    table = models.fit_boosted(spark.createDataFrame(frame), ["a", "b"], "future", 30)
    dumps.save(table, str(tmp_path / "models"))
    loaded = dumps.load(spark, str(tmp_path / "models"))
    got = {
        r.date: r.probability
        for r in dumps.score_boosted(spark.createDataFrame(frame).repartition(5), loaded).collect()
    }
    own = BoostedTrees(30, 3, lasso=0.05).fit(frame[["a", "b"]].to_numpy(), (frame["future"] > 0).to_numpy(float))
    assert np.array_equal([got[d] for d in frame["date"]], own.probability(frame[["a", "b"]].to_numpy()))
    assert loaded.first().importance == pytest.approx(dict(zip("ab", own.importance(), strict=True)))
    odd = spark.createDataFrame(
        [(dt.date(2021, 1, 1), None, 1.0), (dt.date(2021, 1, 2), float("nan"), 1.0)], "date date, a double, b double"
    )
    assert [r.probability for r in dumps.score_boosted(odd, loaded).collect()] == [None, None]


def test_regimes_score_after_loading_as_before(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 240
    level = np.repeat([-1.0, 0.0, 1.0, 0.0], n // 4)
    frame = pd.DataFrame(
        {
            "date": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)],
            "r": level + rng.normal(size=n) * 0.3,
            "v": rng.normal(size=n),
        }
    )
    dumps.save(dumps.fit_regimes(spark.createDataFrame(frame), ["r", "v"]), str(tmp_path / "models"))
    got = dumps.score_regimes(
        spark.createDataFrame(frame).repartition(3), dumps.load(spark, str(tmp_path / "models"))
    ).orderBy("date").toPandas()
    x = frame[["r", "v"]].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    model = GaussianHmm(3).fit(z)
    want = model.filtered(z)
    assert np.allclose(got["bear_probability"], want[:, model.means[:, 0].argmin()], atol=1e-12)
    assert (got["regime"][10:55] == "bear").mean() > 0.8


def test_a_table_of_models(spark):
    none = spark.createDataFrame([], dumps.SCHEMA)
    frame = spark.createDataFrame(rows(3))
    assert dumps.score_boosted(frame, none).count() == 0 and dumps.score_regimes(frame, none).count() == 0
    later = spark.createDataFrame([("boosted", 99, ["a"], "{}", None)], dumps.SCHEMA)
    with pytest.raises(ValueError, match="version"):
        dumps.score_boosted(frame, later)
    with pytest.raises(ValueError, match="several"):
        dumps.score_boosted(frame, later.unionByName(later))


def test_class_weights_are_of_the_rows_learned_from(spark):
    """Other labels in a test block change neither its probabilities nor those of blocks before it."""
    rng = np.random.default_rng(4)
    n = 200
    a = rng.normal(size=n)
    label = (a + rng.normal(size=n) * 0.5 > 0.8).astype(float)
    frame = pd.DataFrame(
        {"date": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)], "a": a, "label": label}
    )
    other = frame.copy()
    other.loc[n - 40 :, "label"] = 1.0

    def found(f):
        return {
            (r.split, r.date): r.probability
            for r in models.rebound_probability(spark.createDataFrame(f), ["a"], 10, 4, 20).where("split < 4").collect()
        }

    x, y = found(frame), found(other)
    assert x == y and len(x) == 160


@pytest.mark.parametrize("seed", [1, 2])
def test_large_trees_are_those_of_the_exact_search(spark, seed):
    """Where the bins hold all values. Rows come from several partitions; some have no target or no number."""
    rng = np.random.default_rng(seed)
    n = 600
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 40, n) / 7, rng.integers(0, 3, n)]).astype(float)
    y = ((x[:, 0] > 6) ^ (x[:, 1] > 3) ^ (rng.random(n) < 0.1)).astype(float)
    frame = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y)
    given = spark.createDataFrame(frame).repartition(4).unionByName(
        spark.createDataFrame(
            [(float("nan"), 1.0, 1.0, 1.0), (1.0, None, 1.0, 0.0), (1.0, 1.0, 1.0, None)],
            "a double, b double, c double, y double",
        )
    )
    kind = {"trees": 3, "depth": 3, "rate": 0.3, "rows": 1.0, "columns": 1.0, "lasso": 0.1, "positive": 1.5}
    own, exact = largeboost.fit_large(given, ["a", "b", "c"], "y", BoostedTrees(**kind)), BoostedTrees(**kind).fit(x, y)

    def same(a, b):
        assert a.feature == b.feature and a.weight == pytest.approx(b.weight, rel=1e-9)
        if a.feature >= 0:
            assert a.cut == b.cut
            same(a.left, b.left)
            same(a.right, b.right)

    for a, b in zip(own.grown, exact.grown, strict=True):
        same(a, b)
    assert own.importance() == pytest.approx(exact.importance())


def test_large_trees_with_more_values_than_bins_and_samples(spark):
    rng = np.random.default_rng(7)
    n = 3000
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.2 * rng.normal(size=n) > 0.3).astype(float)
    frame = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(y=y)).repartition(3)
    model = largeboost.fit_large(frame, ["a", "b"], "y", BoostedTrees(12, 2, 0.3, rows=0.7, columns=1.0))
    assert len(model.grown) == 12 and abs(model.grown[0].cut - 0.3) < 0.15
    assert (((model.probability(x) > 0.5) == y).mean()) > 0.93
    again = largeboost.fit_large(frame, ["a", "b"], "y", BoostedTrees(12, 2, 0.3, rows=0.7, columns=1.0))
    assert np.allclose(again.probability(x), model.probability(x))
    assert largeboost.fit_large(frame.where("false"), ["a", "b"], "y", BoostedTrees(2)).grown == []


def test_bins():
    b = largeboost.Bins(np.array([1.0, 2.0, 5.0]), True)
    assert b.of(np.array([1.0, 2.0, 5.0])).tolist() == [0, 1, 2] and b.cut(0, 2) == 3.0
    q = largeboost.Bins(np.array([1.0, 2.0, 5.0]), False)
    assert q.of(np.array([0.5, 1.5, 2.0, 9.0])).tolist() == [0, 1, 1, 2] and 2.0 < q.cut(1, 2) < 2.0000001
