"""Permutations, pair correlations, linkage, smoothing and digests against brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions.digest import multiset_digest, row_digest
from quillon.operators import correlation, evaluate, graph, indicators, pairs, permute
from quillon.sources import bars as source


def days(n):
    return [dt.date(2019, 1, 1) + dt.timedelta(days=i) for i in range(n)]


def test_a_key_permutes_every_range(spark):
    rows = [(n, k, a) for n in (1, 2, 3, 7, 50, 357) for k in (0, 5, 123_456_789) for a in range(n)]
    got = spark.createDataFrame(rows, "n int, k long, a int").select(
        "n", "k", permute.permuted(F.col("a"), F.col("n"), F.col("k")).alias("p")
    ).collect()
    taken = {}
    for r in got:
        taken.setdefault((r.n, r.k), []).append(r.p)
    assert all(sorted(v) == list(range(n)) for (n, _), v in taken.items())
    assert len({tuple(v) for (n, _), v in taken.items() if n == 50}) == 3


def test_each_position_is_drawn_as_often(spark):
    keys = spark.range(4000).select(
        permute.key_of(F.lit(0), F.col("id")).alias("key"), F.explode(F.array(F.lit(0), F.lit(1))).alias("a")
    )
    counts = keys.select(
        permute.permuted(F.col("a"), F.lit(20), F.col("key")).alias("p")
    ).groupBy("p").count().collect()
    assert len(counts) == 20
    assert sum((r["count"] - 400) ** 2 / 400 for r in counts) < 45  # chi squared of 19 degrees, beyond a thousandth


def test_a_draw_has_no_day_twice_and_as_many_as_signals(spark):
    rows = [(t, d, 100.0 + i, i % 4 == 0) for t, n in (("A", 60), ("B", 24), ("C", 10)) for i, d in enumerate(days(n))]
    frame = spark.createDataFrame(rows, "ticker string, date date, close double, signal boolean")
    got = evaluate.baseline(frame, F.col("signal"), (1, 5), 30).where("horizon = 1").collect()
    own = {}
    for r in got:
        own.setdefault((r.ticker, r.draw), []).append(r.value)
    # closes rise by one, so a value names its day
    assert all(len(set(v)) == len(v) == {"A": 15, "B": 6, "C": 3}[t] for (t, _), v in own.items()) and len(own) == 90
    assert len({tuple(sorted(v)) for (t, _), v in own.items() if t == "A"}) == 30


def returns(seed, tickers, n, gap=0.2):
    rng = np.random.default_rng(seed)
    wide = pd.DataFrame(
        rng.normal(size=(n, tickers)) + rng.normal(size=(n, 1)),
        index=days(n),
        columns=[f"T{j:03}" for j in range(tickers)],
    )
    return wide.mask(rng.random((n, tickers)) < gap)


def long(spark, wide, value="ret"):
    rows = [(t, d, None if np.isnan(v) else float(v)) for t in wide for d, v in wide[t].items()]
    return spark.createDataFrame(rows, f"ticker string, date date, {value} double")


def test_pair_correlations_in_tiles_and_chunks_against_pandas(spark, monkeypatch):
    wide = returns(1, 11, 90)
    wide["T005"], wide.loc[wide.index[5:], "T006"] = 2.5, np.nan
    monkeypatch.setattr(pairs, "TILE", 4)
    monkeypatch.setattr(pairs, "CHUNK_DAYS", 17)
    got = {(r.a, r.b): r for r in correlation.correlation(long(spark, wide + 1000), "ret", 20).collect()}
    want = wide.corr(min_periods=20)
    for i, a in enumerate(wide):
        for b in list(wide)[i + 1 :]:
            n = int((wide[a].notna() & wide[b].notna()).sum())
            assert got[a, b].n == n
            w = want.loc[a, b]
            assert got[a, b].rho is None if np.isnan(w) else got[a, b].rho == pytest.approx(w, abs=1e-9)
    assert len(got) == 55
    assert correlation.correlation(long(spark, wide).where("false")).count() == 0


def test_a_pair_without_a_common_day_has_no_row(spark):
    rows = [("A", days(2)[0], 1.0), ("B", days(2)[1], 1.0), ("C", days(2)[0], 2.0)]
    got = correlation.correlation(spark.createDataFrame(rows, "ticker string, date date, ret double")).collect()
    assert [(r.a, r.b, r.n, r.rho) for r in got] == [("A", "C", 1, None)]


def test_moving_sums_against_whole_products():
    x = returns(2, 9, 150).to_numpy()
    x[40:, 3] = 0.25  # flat from here on, after large values
    x[:, 4] *= 1e4
    moving = pairs.Moving(x, 30, side=4)
    for end in range(29, 150):
        own = np.sort(np.concatenate([pairs.upper(r, p, q) for p, q, r in moving.correlations(end, 10)]))
        want = np.sort(pairs.pair_values(x[end - 29 : end + 1], 10))
        assert np.allclose(own[~np.isnan(own)], want, atol=1e-9)


def naive_linkage(dist, cut):
    groups = [[i] for i in range(len(dist))]
    while len(groups) > 1:
        best = min(
            (np.mean([dist[a, b] for a in g for b in h]), i, j)
            for i, g in enumerate(groups)
            for j, h in enumerate(groups)
            if i < j
        )
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("seed", range(12))
def test_chained_linkage_against_all_searches(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 25))
    points = rng.normal(size=(n, 3))
    dist = np.sqrt(((points[:, None] - points) ** 2).sum(axis=2))
    for cut in (0.3, 0.8, 1.5, 9.0):
        got = correlation.average_linkage([f"{i:02}" for i in range(n)], dist, cut)
        assert [[int(k) for k in g] for g in got] == naive_linkage(dist, cut)


def test_clusters_against_the_whole_matrix(spark):
    """Groups found in components are those of the linkage of all tickers."""
    rng = np.random.default_rng(5)
    n, rows = 24, []
    rho = np.clip(0.3 + 0.3 * rng.normal(size=(n, n)), -0.9, 0.98)
    for i in range(n):
        for j in range(i + 1, n):
            value = float(rho[i, j]) if i // 6 == j // 6 else float(rho[i, j] - 0.6)
            rho[i, j] = rho[j, i] = value
            if (i, j) != (0, 7):
                rows.append((f"{i:02}", f"{j:02}", 50, None if (i, j) == (1, 2) else value))
    rho[0, 7] = rho[7, 0] = rho[1, 2] = rho[2, 1] = np.nan
    dist = np.sqrt(np.maximum(2 * (1 - np.where(np.isnan(rho), -1, rho)), 0))
    np.fill_diagonal(dist, 0)
    got = correlation.clusters(spark.createDataFrame(rows, "a string, b string, n int, rho double"), 0.35, 2).collect()
    found = {}
    for r in got:
        found.setdefault(r.cluster, []).append(int(r.ticker))
    want = []
    for g in naive_linkage(dist, float(np.sqrt(2 * 0.65))):
        values = rho[np.ix_(g, g)][np.triu_indices(len(g), 1)]
        if len(g) >= 2 and np.isfinite(values).any() and np.nanmean(values) >= 0.35:
            want.append(g)
    assert [sorted(found[c]) for c in sorted(found)] == want and len(want) > 1


def test_components(spark):
    edges = [(f"n{a:03}", f"n{a + 1:03}") for a in range(100, 140)] + [("b", "a"), ("c", "b"), ("z", "z")] + [
        ("hub", f"x{i}") for i in range(30)
    ]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {
        got[f"n{a}"] for a in range(100, 141)
    } == {"n100"} and got["c"] == "a" and got["x29"] == "hub" and "z" not in got


@pytest.mark.parametrize("n", [1, 2, 14])
def test_smoothing_against_pandas_with_gaps_and_across_blocks(spark, n):
    """For n of 2 a block has 664 rows, so three are chained; B begins with gaps, C has a gap of several blocks' decay."""
    rng = np.random.default_rng(n)
    rows, want = [], {}
    for t, size in (("A", 1700), ("B", 300), ("C", 1500), ("D", 1), ("E", 3)):
        x = rng.normal(size=size) * 10.0 ** rng.integers(-3, 4)
        x[rng.random(size) < 0.3] = np.nan
        if t == "B":
            x[:50] = np.nan
        if t == "C":
            x[200:1400] = np.nan
        if t == "E":
            x[:] = np.nan
        rows += [
            (t, d, None if np.isnan(v) else float(v), i) for i, (d, v) in enumerate(zip(days(size), x, strict=True))
        ]
        want[t] = pd.Series(x).ewm(alpha=1 / n, adjust=False).mean().to_numpy()
    frame = spark.createDataFrame(rows, "ticker string, date date, x double, k int")
    got = indicators.smoothed(frame, {"x": "y"}, n)
    assert got.columns == ["ticker", "date", "x", "k", "y"]
    for r in got.collect():
        w = want[r.ticker][r.k]
        assert r.y is None if np.isnan(w) else r.y == pytest.approx(w, rel=1e-9, abs=1e-12), r


def test_digests_of_rows_in_any_order(spark):
    rows = [("A", d, 1.0, 2.0, 3.0, 4.0 + i, None) for i, d in enumerate(days(40))] + [
        ("B", days(1)[0], None, None, None, 1.0, 2.0)
    ]
    frame = spark.createDataFrame(rows, source.BARS)

    def sums(f):
        return {r.ticker: (r.n, r.digest) for r in source.checksums(f).collect()}

    own = sums(frame)
    assert sums(frame.repartition(7).orderBy(F.rand(3))) == own
    assert sums(frame.unionByName(frame.where("ticker = 'B'")))["B"] != own["B"]
    assert sums(
        frame.withColumn("close", F.when(F.col("date") == days(3)[2], 9.5).otherwise(F.col("close")))
    )["A"] != own["A"]
    pair = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("", None), (None, "")], "x string, y string")
    assert pair.select(row_digest(F.col("x"), F.col("y")).alias("d")).distinct().count() == 4
    one, two = (
        spark.createDataFrame([(x,) for x in xs], "x string").agg(
            multiset_digest(row_digest(F.col("x"))).alias("d")
        ).first().d
        for xs in (["a", "a", "b"], ["a", "b", "b"])
    )
    assert one != two
