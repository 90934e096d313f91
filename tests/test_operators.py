"""Operators against pandas, brute force and facts known by hand."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions.rolling import by_ticker, forward_compound
from quillon.operators import correlation, evaluate, features, indicators, intervals, labels, models, strength, universe
from quillon.operators.boosting import BoostedTrees
from quillon.plans import backtest, regime, screen, sector
from quillon.plans.config import Backtest, Config, Windows, load
from quillon.sources import bars as source
from quillon.sources import synthetic

NAMES = ["AAA", "BBB", "CCC", "DDD", "EEE", "FFF"]


@pytest.fixture(scope="module")
def frame():
    return synthetic.frame(NAMES, "MARKET", 420)


@pytest.fixture(scope="module")
def bars(spark, frame):
    return spark.createDataFrame(frame, source.BARS).withColumn("cluster", F.lit("x")).cache()


def series(spark, values, ticker="A", start="2020-01-01"):
    days = pd.bdate_range(start, periods=len(values)).date
    rows = [
        (ticker, d, float(v), float(v) * 1.01, float(v) * 0.99, float(v), 1e6)
        for d, v in zip(days, values, strict=True)
    ]
    return spark.createDataFrame(rows, source.BARS).withColumn("cluster", F.lit("x"))


def test_rsi_against_pandas_and_flat_series(spark, frame, bars):
    got = {(r.ticker, r.date): r.rsi for r in indicators.with_rsi(bars).collect()}
    one = frame[frame.ticker == "CCC"].sort_values("date")
    delta = one["close"].diff()
    up, down = delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-delta).clip(lower=0).ewm(
        alpha=1 / 14, adjust=False
    ).mean()
    want = 100 - 100 / (1 + up / down)
    for d, v in zip(one["date"][1:], want[1:], strict=True):
        assert got["CCC", d] == pytest.approx(v)
    flat = [r.rsi for r in indicators.with_rsi(series(spark, [5.0] * 6)).orderBy("date").collect()]
    assert flat == [None, *[100.0] * 5]


def test_trend_of_a_steady_rise_and_of_a_flat_line(spark):
    up = indicators.trend_table(series(spark, 100 * np.exp(np.arange(120) * 0.01))).first()
    assert up.short_score > 80 and up.ma_stack == 1.0 and up.mid_r2 == pytest.approx(1)
    down = indicators.trend_table(series(spark, 100 * np.exp(-np.arange(120) * 0.01))).first()
    assert down.short_score < -80 and down.ma_stack == -1.0
    flat = indicators.trend_table(series(spark, [100.0] * 120)).first()
    assert flat.short_score == 0 and flat.mid_r2 == 0
    assert indicators.trend_table(series(spark, [100.0] * 64)).count() == 0


def test_bottom_of_a_v(spark):
    v = [*np.linspace(100, 70, 30), *np.linspace(71, 100, 40)]
    found = labels.bottoms(series(spark, v), 10, 20, 0.08).where("label").collect()
    assert [r.close for r in found] == [70.0]
    d = strength.drawdowns(series(spark, v)).first()
    assert d.max_drawdown == pytest.approx(-0.3) and d.recovery_days == 40


def test_forward_compound_by_hand(spark):
    rows = series(spark, [1, 2, 3, 4]).withColumn(
        "r", F.element_at(F.array(*map(F.lit, (0.10, 0.20, -0.10, 0.05))), F.col("close").cast("int"))
    )
    got = [r.f for r in rows.withColumn("f", forward_compound(F.col("r"), by_ticker(), 2)).orderBy("date").collect()]
    assert got[:2] == pytest.approx([1.2 * 0.9 - 1, 0.9 * 1.05 - 1]) and got[2:] == [None, None]


def test_nothing_looks_ahead(spark, bars):
    cutoff = "2021-03-01"
    panel = source.panel(bars)
    full = {r.ticker: r.alarm for r in indicators.alarms(bars, panel).where(F.col("date") == cutoff).collect()}
    cut = source.as_of(bars, cutoff)
    part = {
        r.ticker: r.alarm for r in indicators.alarms(cut, source.panel(cut)).where(F.col("date") == cutoff).collect()
    }
    assert full == pytest.approx(part) and len(full) == len(NAMES) + 1


def test_three_blocks_make_three_clusters(spark):
    rng = np.random.default_rng(3)
    rows = []
    for block in range(3):
        driver = rng.normal(0, 0.012, 600)
        for i in range(4):
            close = 100 * np.exp(np.cumsum(driver + rng.normal(0, 0.003, 600)))
            rows += [
                (f"B{block}_{i}", d, float(c))
                for d, c in zip(pd.bdate_range("2020-01-01", periods=600).date, close, strict=True)
            ]
    frame = spark.createDataFrame(rows, "ticker string, date date, close double").withColumn("volume", F.lit(1.0))
    rho = correlation.correlation(features.returns(source.panel(frame, keep=())), "log_ret")
    got = correlation.clusters(rho).collect()
    groups = {frozenset(r.ticker for r in got if r.cluster == c) for c in {r.cluster for r in got}}
    assert groups == {frozenset(f"B{b}_{i}" for i in range(4)) for b in range(3)}
    assert min(r.mean_correlation for r in got) > 0.6
    assert correlation.clusters(rho.where("a like 'B0%' and b like 'B0%' and a < 'B0_1'").limit(1)).count() == 0


def test_average_linkage_by_hand():
    dist = np.array([[0, 1, 4, 9], [1, 0, 4, 9], [4, 4, 0, 9], [9, 9, 9, 0]], float)
    assert correlation.average_linkage(list("abcd"), dist, 1) == [["a", "b"], ["c"], ["d"]]
    assert correlation.average_linkage(list("abcd"), dist, 4) == [["a", "b", "c"], ["d"]]


def test_principal_component_against_numpy(spark, frame, bars):
    panel = source.panel(bars.where("ticker <> 'MARKET'"))
    got = {r.date: r for r in correlation.rolling_pca(features.returns(panel), 60, complete=True).collect()}
    wide = frame[frame.ticker != "MARKET"].pivot(index="date", columns="ticker", values="close").pct_change()
    for end in (60, 100, 300):
        x = wide.iloc[end - 59 : end + 1].dropna()
        z = (x - x.mean()) / x.std(ddof=0)
        values = np.linalg.eigvalsh(z.T @ z)
        assert got[wide.index[end]].pca_explained_variance == pytest.approx(values[-1] / values.sum())


def test_residuals_of_a_line_are_flat(spark, bars):
    rows = features.returns(source.panel(bars))
    factor = rows.where("ticker = 'MARKET'").select("date", F.col("log_ret").alias("f"))
    own = correlation.residualize(rows.where("ticker = 'MARKET'"), factor).where("resid is not null")
    assert own.agg(F.max(F.abs("resid"))).first()[0] < 1e-9


def test_hidden_states_are_filtered_and_named(spark):
    rng = np.random.default_rng(5)
    means = np.repeat([0.02, -0.02, 0.02, -0.02], 100)
    rows = [
        (dt.date(2020, 1, 1) + dt.timedelta(days=i), float(m + rng.normal(0, 0.004)), float(abs(rng.normal(0, 1))))
        for i, m in enumerate(means)
    ]
    frame = spark.createDataFrame(rows, "date date, r double, v double")
    got = models.walk_forward_regimes(frame, ["r", "v"], 250, 50, states=2).orderBy("date").collect()
    assert len(got) == 150
    assert all(abs(g.bear_probability + g.neutral_probability + g.bull_probability - 1) < 1e-9 for g in got)
    right = sum((g.regime == "bull") == (means[250 + i] > 0) for i, g in enumerate(got))
    assert right > 140
    short = models.walk_forward_regimes(
        frame.where(F.col("date") < "2020-11-01"), ["r", "v"], 250, 50, states=2
    ).collect()
    assert {g.date: round(g.bull_probability, 9) for g in short}.items() <= {
        g.date: round(g.bull_probability, 9) for g in got
    }.items()


def test_nearest_labels_and_ties(spark):
    flags = [(0, 0), (0, 1), (1, 0), (0, 1), (0, 0), (0, 0), (0, 0), (1, 0)]
    rows = spark.createDataFrame(
        [("A", dt.date(2020, 1, 1 + i), bool(s), bool(x)) for i, (s, x) in enumerate(flags)],
        "ticker string, date date, signal boolean, label boolean",
    )
    got = {r.pos: (r.label_pos, r.matched) for r in evaluate.matches(rows, 2).collect()}
    assert got == {3: (2, True), 8: (4, False)}
    s = evaluate.scores(rows, 2).first()
    assert (s.signals, s.labels, s.true_positives, s.matched_labels, s.precision, s.recall) == (2, 2, 1, 1, 0.5, 0.5)
    none = evaluate.scores(rows.withColumn("signal", F.lit(False)), 2).first()
    assert (none.signals, none.f1) == (0, 0.0)


def test_folds(spark):
    rows = evaluate.expanding_folds(spark, "2010-01-01", "2026-06-30", 5).orderBy("fold").collect()
    assert len(rows) == 12 and [r.partial for r in rows] == [False] * 11 + [True]
    assert all(r.fit_end < r.test_start <= r.test_end for r in rows)


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame(
        [(0.1, 0, 0.0), (0.4, 0, -0.1), (0.35, 1, 0.2), (0.8, 1, 0.3)], "probability double, target int, future double"
    )
    m = evaluate.prediction_metrics(rows).first()
    assert m.roc_auc == pytest.approx(0.75) and m.average_precision == pytest.approx(0.8333333)


def test_average_rank_of_ties(spark):
    rows = spark.createDataFrame([(3.0,), (1.0,), (1.0,), (2.0,), (None,)], "x double")
    got = sorted(r.p for r in rows.withColumn("p", strength.rank_share(F.col("x"))).collect() if r.p is not None)
    assert got == pytest.approx([0.375, 0.375, 0.75, 1.0])


def test_intervals(spark):
    rows = spark.createDataFrame(
        [("a", 1, 3), ("a", 3, 5), ("a", 8, 9), ("a", 2, 4), ("b", 1, 1)], "k string, start int, end int"
    )
    assert sorted(map(tuple, intervals.union(rows, "k").collect())) == [("a", 1, 5), ("a", 8, 9)]
    wanted = spark.createDataFrame([("a", 0, 10), ("b", 2, 4)], "k string, low int, high int")
    assert sorted(map(tuple, intervals.missing(rows, wanted, "k").collect())) == [
        ("a", 0, 1), ("a", 5, 8), ("a", 9, 10), ("b", 2, 4)
    ]


def listing(spark, rows):
    return spark.createDataFrame(
        rows, "symbol string, name string, industry string, sector string, country string, market_cap string"
    )


def test_universe_cleaning(spark):
    rows = listing(
        spark,
        [
            (" aaa", "Alpha", "Chips & Tools", "Tech", "US", "$1,000"),
            ("BBB", "Beta", "Chips & Tools", "Tech", "US", "3000"),
            ("CCC", "Gamma", "Chips & Tools", "Tech", "US", "2000"),
            ("DDD", "Delta Warrant", "Chips & Tools", "Tech", "US", "9"),
            ("AAA", "Alpha old", "Other", "Tech", "US", "bad"),
            ("", "x", "y", "z", "US", "1"),
        ],
    )
    out = universe.normalised(rows)
    assert {r.symbol: (r.market_cap, r.eligible) for r in out.collect()} == {
        "AAA": (1000.0, True), "BBB": (3000.0, True), "CCC": (2000.0, True), "DDD": (9.0, False)
    }
    assert [r.symbol for r in universe.by_industry(out, "chips tools").collect()] == ["BBB", "CCC", "AAA"]
    with pytest.raises(ValueError):
        universe.by_industry(out, "nothing")


def test_stocks_and_other_securities(spark):
    """Marks are words: United Airlines and depositary shares are stocks, plurals of marks aren't."""
    names = {
        "UAL": "United Airlines",
        "BFAM": "Bright Horizons",
        "TSM": "Taiwan Semiconductor Depositary Shares",
        "W": "Alpha Warrants",
        "R": "Beta Right",
        "P": "Gamma Preference Shares",
        "N": "Delta 5% Notes due 2030",
        "D": "Debentures of Epsilon",
        "BRK/B": "Berkshire",
        "TWELVELETTER": "Long",
        "9X": "Nine",
        "NONAME": " ",
    }
    out = universe.normalised(listing(spark, [(k, n, "i", "s", "US", "1") for k, n in names.items()]))
    got = {r.symbol: r.eligible for r in out.collect()}
    assert got == {
        "UAL": True,
        "BFAM": True,
        "TSM": True,
        "W": False,
        "R": False,
        "P": False,
        "N": False,
        "D": False,
        "BRK-B": True,
        "TWELVELETTER": True,
    }
    symbols = spark.createDataFrame(
        [(k, f"{n} chip", False) for k, n in names.items()], "ticker string, name string, etf boolean"
    )
    kept = {r.ticker for r in universe.candidates(symbols, {"chip": ["chip"]}, [], []).collect()}
    assert kept == {"UAL", "BFAM", "TSM", "P", "D", "BRK/B", "TWELVELETTER", "9X", "NONAME"}
    with pytest.raises(ValueError):
        universe.checked_export(out, least_rows=100)
    with pytest.raises(ValueError):
        universe.checked_export(
            listing(spark, [("9X", "n", "", "", "", "")] * 2 + [("A", "n", "", "", "", "")] * 8), least_rows=5
        )


def test_the_screen_of_a_group_takes_first_rows(spark):
    rows = listing(
        spark,
        [
            ("aa", "first", "CHIPS", "Tech", "united states", "5"),
            ("AA", "larger", "chips", "Tech", "United States", "9"),
            ("BB", "b", "chips", "Tech", "France", "9"),
            ("CC", "c", "chips", "Tech", "United States", "n/a"),
        ],
    ).coalesce(1)
    out = universe.screened(rows, ["Chips"], ["UNITED STATES"], sector="tech").collect()
    assert sorted((r.symbol, r.name, r.market_cap) for r in out) == [("AA", "first", 5.0), ("CC", "c", 0.0)]


def test_membership_over_time(spark):
    schema = "symbol string, name string, sector string, industry string, country string, ipo_year int, market_cap double"
    first = spark.createDataFrame(
        [("AAA", "a", "s", "i", "US", 2020, 1.0), ("BBB", "b", "s", "i", "US", 2010, 1.0)], schema
    )
    one = universe.synced(None, first, "2024-01-15", "2018-01-01")
    assert {r.symbol: str(r.effective_from) for r in one.collect()} == {"AAA": "2020-01-01", "BBB": "2018-01-01"}
    second = spark.createDataFrame(
        [("AAA", "a", "s", "i", "US", 2020, 2.0), ("CCC", "c", "s", "i", "US", 2001, 1.0)], schema
    )
    two = {r.symbol: r for r in universe.synced(one, second, "2024-02-15", "2018-01-01").collect()}
    assert str(two["CCC"].effective_from) == "2024-02-15" and not two["BBB"].active and two["AAA"].market_cap == 2.0
    assert universe.retention(one, second).first().share == 0.5


def test_listed_symbols_themes_and_candidates(spark):
    lines = spark.createDataFrame(
        [
            ("AAA", "Alpha Chip Co", "N", "N"),
            ("ETFX", "Some Fund", "N", "Y"),
            ("TST", "Test", "Y", "N"),
            ("WWW", "Chips Inc Warrant", "N", "N"),
            ("File Creation Time: 1", None, None, None),
        ],
        "`Symbol` string, `Security Name` string, `Test Issue` string, `ETF` string",
    )
    out = universe.listed(lines)
    assert {r.ticker for r in out.collect()} == {"AAA", "ETFX", "WWW"} and {
        r.exchange for r in out.collect()
    } == {"NASDAQ"}
    other = spark.createDataFrame(
        [
            ("AAA", "Twice", "N", "N", "N"),
            ("mkt.a", "Small", "A", "N", "N"),
            ("ARC", "Fund", "P", "N", "Y"),
            ("ODD", "x", "?", "N", "N"),
            ("A$B", "x", "N", "N", "N"),
        ],
        "`ACT Symbol` string, `Security Name` string, `Exchange` string, `Test Issue` string, `ETF` string",
    )
    every = {r.ticker: (r.name, r.exchange) for r in universe.all_listed(lines, other).collect()}
    assert every["AAA"] == ("Alpha Chip Co", "NASDAQ") and every["mkt.a"][1] == "NYSE MKT" and every["ARC"][1] == "NYSE ARCA" and every["ODD"][1] == "OTHER" and "A$B" not in every
    assert {r.ticker for r in universe.candidates(out, {"chip": ["chip"]}, [], []).collect()} == {"AAA"}
    assert {r.ticker for r in universe.candidates(out, {}, ["ETFX"], ["AAA"]).collect()} == {"AAA", "ETFX"}
    found = spark.range(1).select(
        universe.themes(F.lit("Microchips and chips"), {"a": ["chip"], "b": ["microchip"], "c": ["micro"]}).alias("t")
    ).first().t
    assert found == ["a", "b"]


def test_snapshot_rows(spark):
    text = '{"data":{"rows":[{"symbol":"A","name":"n","marketCap":"$1"},{"symbol":"B"}]},"status":{"rCode":200}}'
    rows = universe.snapshot_rows(
        spark.createDataFrame([(text,), ('{"status":{"rCode":500}}',), ("broken",)], "payload string")
    )
    assert [r.symbol for r in rows.orderBy("symbol").collect()] == ["A", "B"]


def test_config(tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"defaults": {"threshold": 0.5, "windows": {"short": 10}}, "dev": {"windows": {"mid": 30}}}')
    c = load(str(file), "dev")
    assert (c.threshold, c.windows.short, c.windows.mid, c.windows.long) == (0.5, 10, 30, 120)
    file.write_text('{"defaults": {"nonsense": 1}}')
    with pytest.raises(ValueError):
        load(str(file))
    with pytest.raises(ValueError):
        Windows(60, 20, 120)


def test_plans_run(spark, bars):
    config = Config(
        threshold=0.2,
        benchmark="MARKET",
        backtest=Backtest("2020-01-01", "2021-12-31", 1, 1, 5, 10, 0.02, (5, 10), (20, 40), 3),
        washout_gate=-0.1,
        alarm_gate=10.0,
    )
    groups = bars.where("ticker <> 'MARKET'").select("cluster", "ticker").distinct()
    tables = screen.screen(bars, config, "2021-06-01", groups)
    assert screen.summary(tables).count() == len(NAMES)
    assert tables["rebound"].agg(F.max("date")).first()[0] <= dt.date(2021, 6, 1)
    panel = source.panel(bars, values=("close", "volume", "high", "low"))
    out = backtest.run(bars, panel, config)
    assert out["per_fold"].count() == 1 and out["edges"].count() == 2
    found, ranked = sector.analyse(panel), sector.ranking(panel)
    assert len(sector.latest_alert(found, ranked).first().top_rise_strength) == 3


def test_regime_plan(spark, bars):
    panel = source.panel(bars.where("ticker <> 'MARKET'"))
    out, metrics, importance = regime.run(
        panel,
        screen.market_of(bars, "MARKET"),
        horizon=10,
        pca_window=60,
        least=150,
        learn=60,
        refit=60,
        trees=40,
    )
    rows = out.where("probability is not null").collect()
    assert rows and all(r.signal in ("bullish", "bearish", "neutral") for r in rows)
    assert metrics.first().n > 0
    shares = [r.importance for r in importance.collect()]
    assert len(shares) == len(regime.INPUTS) and abs(sum(shares) - 1) < 1e-9 and shares == sorted(shares, reverse=True)
    # a date's probability out of sample doesn't change with what comes later; all complete dates have a live one
    last = max(r.date for r in rows)
    assert out.where("live_probability is not null").count() >= len(rows) and last in {r.date for r in rows}


def test_importance_of_a_model_with_one_target_or_none(spark):
    """All futures of one sign leave nothing to split: a row a column, each 0, and no live probability. Without a future there are no rows."""
    rows = [
        (dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i % 7), float(i % 5), 0.01 if i < 50 else None)
        for i in range(60)
    ]
    frame = spark.createDataFrame(rows, "date date, a double, b double, future double")
    for one in (frame, frame.withColumn("future", -F.col("future"))):
        live, importance = models.live_boosted(one, ["b", "a"], "future", trees=5)
        assert [tuple(r) for r in importance.collect()] == [("a", 0.0), ("b", 0.0)] and live.count() == 0
    assert not BoostedTrees(trees=5).fit(np.array([r[1:3] for r in rows[:50]]), np.ones(50)).importance().any()
    for none in (frame.withColumn("future", F.lit(None).cast("double")), frame.where("false")):
        live, importance = models.live_boosted(none, ["b", "a"], "future", trees=5)
        assert importance.collect() == [] and live.collect() == []
    both = frame.withColumn("future", F.when(F.col("a") > 3, F.col("future")).otherwise(-F.col("future")))
    live, importance = models.live_boosted(both, ["b", "a"], "future", trees=5)
    assert live.count() == 60 and importance.first().feature == "a" and importance.agg(F.sum("importance")).first()[0] == pytest.approx(1)


def test_finite_rows_and_what_the_optimizer_keeps_of_them(spark, tmp_path):
    """Conditions kept for 12 columns are some dozens, not 2 to the power of 12."""
    columns = [f"c{i}" for i in range(12)]
    odd = [1.0, None, float("nan"), float("inf"), -float("inf"), -1e308]
    rows = [
        (dt.date(2020, 1, 1) + dt.timedelta(days=i), 0.1, *[v if j == i else 0.0 for j in range(12)])
        for i, v in enumerate(odd)
    ]
    spark.createDataFrame(
        rows, "date date, future double, " + ", ".join(f"{c} double" for c in columns)
    ).write.parquet(str(tmp_path / "frame"))
    frame = spark.read.parquet(str(tmp_path / "frame"))
    complete = models._complete(frame, columns, "future")
    node, kept = complete._jdf.queryExecution().analyzed(), []
    while node.children().size():
        kept.append(node.validConstraints().size())
        node = node.children().head()
    assert 12 <= max(kept) < 200, kept
    assert sorted(r.date.day for r in complete.collect()) == [1, 6]


def test_regime_refits_the_classifier_as_asked(monkeypatch):
    asked = {}

    class Seen(Exception):
        pass

    def seen(frame, columns, future, horizon, learn, refit, trees):
        asked.update(refit=refit, trees=trees)
        raise Seen

    class Frame:
        def join(self, *a):
            return self

    monkeypatch.setattr(regime, "group_frame", lambda *a: Frame())
    monkeypatch.setattr(regime, "written", lambda df, name: df)
    monkeypatch.setattr(models, "walk_forward_regimes", lambda *a: None)
    monkeypatch.setattr(models, "walk_forward_boosted", seen)
    with pytest.raises(Seen):
        regime.run(None, None, refit=21, trees=30)
    assert asked == {"refit": 21, "trees": 30}


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = BoostedTrees(trees=80, rate=0.2).fit(x[:400], y[:400])
    assert np.mean((model.probability(x[400:]) > 0.5) == y[400:]) > 0.9
    assert set(np.argsort(model.importance())[-2:]) == {1, 3} and abs(model.importance().sum() - 1) < 1e-9
    weighted = BoostedTrees(trees=40, positive=5.0).fit(x, y)
    assert weighted.probability(x).mean() > BoostedTrees(trees=40).fit(x, y).probability(x).mean()


def test_the_first_split_against_brute_force():
    """One tree of one split: the cut of the largest gain, over all cuts of all columns."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 3)), (rng.random(60) > 0.4).astype(float)
    model = BoostedTrees(trees=1, depth=1, rate=1.0, rows=1.1, columns=1.0, ridge=2.0, least_weight=0.0).fit(x, y)
    g, h = 0.5 - y, np.full(60, 0.25)
    best = max(
        ((g[m].sum() ** 2 / (h[m].sum() + 2) + g[~m].sum() ** 2 / (h[~m].sum() + 2)), j, c)
        for j in range(3)
        for c in x[:, j]
        if (m := x[:, j] < c).any()
    )
    root = model.grown[0]
    assert root.feature == best[1] and np.array_equal(x[:, root.feature] < root.cut, x[:, best[1]] < best[2])
    assert root.left.weight == pytest.approx(
        -g[x[:, root.feature] < root.cut].sum() / (h[x[:, root.feature] < root.cut].sum() + 2)
    )


def test_causal_regimes_look_at_the_past_only(spark):
    rng = np.random.default_rng(5)
    calm = np.r_[rng.normal(0.02, 0.01, 120), rng.normal(-0.03, 0.03, 60), rng.normal(0.02, 0.01, 70)]
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v), float(abs(v))) for i, v in enumerate(calm)]
    frame = spark.createDataFrame(rows, "date date, sector_return_20d double, v double")
    got = {
        r.date: r
        for r in models.causal_regimes(frame, ["sector_return_20d", "v"], least=160, refit=20, states=2).collect()
    }
    assert len(got) == 90
    bear = [got[rows[i][0]].hmm_bear_probability for i in range(160, 178)]
    bull = [got[rows[i][0]].hmm_bull_probability for i in range(200, 250)]
    assert np.mean(bear) > 0.8 and np.mean(bull) > 0.8
    short = models.causal_regimes(
        frame.where(F.col("date") < rows[220][0]), ["sector_return_20d", "v"], least=160, refit=20, states=2
    ).collect()
    assert all(abs(r.hmm_bear_probability - got[r.date].hmm_bear_probability) < 1e-9 for r in short)


def test_a_filtered_state_against_all_paths():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 2))
    model = models.GaussianHmm(3, rounds=5, diagonal=True).fit(x)
    assert all(np.allclose(c, np.diag(np.diag(c))) for c in model.covs)
    tail = x[:5]
    density = models._log_density(tail, model.means, model.covs)
    paths = list(itertools.product(range(3), repeat=5))
    logs = np.array(
        [
            np.log(model.start[p[0]] + 1e-300) + sum(density[t, s] for t, s in enumerate(p)) + sum(
                np.log(model.step[a, b] + 1e-300) for a, b in zip(p, p[1:])
            )
            for p in paths
        ]
    )
    share = np.exp(logs - logs.max())
    last = np.array([share[[p[-1] == s for p in paths]].sum() for s in range(3)]) / share.sum()
    assert np.allclose(model.filtered(tail)[-1], last)
    assert tuple(model.decoded(tail)) == paths[int(logs.argmax())]


def test_the_rebound_classifier_and_its_fallback(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(200):
        a, b = rng.normal(), rng.normal()
        label = None if i % 5 == 0 else float(a + 0.3 * rng.normal() > 0.5)
        rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=i), float(a), float(b), label))
    frame = spark.createDataFrame(rows, "date date, a double, b double, label double")
    out = models.rebound_probability(frame, ["a", "b"]).collect()
    scored, final = [r for r in out if r.target is not None], [r for r in out if r.importance]
    assert len(scored) == 4 * (160 // 5) and len(final) == 1 and final[0].date == rows[-1][0] and final[0].importance["a"] > final[0].importance["b"]
    assert np.mean([(r.probability > 0.5) == r.target for r in scored]) > 0.85
    known = sorted(r[0] for r in rows if r[3] is not None)
    # tests are the last blocks of labelled rows, and each row is scored once
    assert sorted(r.date for r in scored) == known[160 - 128 :]
    assert models.rebound_probability(frame.limit(40), ["a", "b"]).count() == 0
    assert models.rebound_probability(frame.withColumn("label", F.lit(1.0)), ["a", "b"]).count() == 0


def test_pair_values_against_pandas():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 7))
    x[rng.random((40, 7)) < 0.3] = np.nan
    x[:, 5], x[:, 6] = 1.0, np.nan
    got = np.sort(correlation.pair_values(x, 10, block=3))
    whole = pd.DataFrame(x[:, :5]).corr(min_periods=10).to_numpy()
    want = np.sort(whole[np.triu_indices(5, 1)])
    assert np.allclose(got, want[np.isfinite(want)])


def test_the_component_of_more_tickers_than_dates(spark):
    rng = np.random.default_rng(9)
    common = rng.normal(size=30)
    rows = [
        (f"T{j:02}", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(common[i] + 0.5 * rng.normal()))
        for j in range(40)
        for i in range(30)
    ]
    got = correlation.rolling_pca(spark.createDataFrame(rows, "ticker string, date date, ret double"), 20).collect()
    wide = pd.DataFrame(rows, columns=["t", "d", "v"]).pivot(index="d", columns="t", values="v")
    for r in got:
        x = wide.loc[: r.date].iloc[-20:]
        z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
        _, scale, axes = np.linalg.svd(z, full_matrices=False)
        sign = 1 if axes[0].sum() >= 0 else -1
        assert r.pca_explained_variance == pytest.approx(
            scale[0] ** 2 / (scale**2).sum()
        ) and r.pca_factor == pytest.approx(sign * (z @ axes[0])[-1])


def test_reasons_print_numbers_by_their_exact_value(spark):
    """Ties go to even and numbers just below a tie go down, as C, Python and the SQL print them."""
    numbers = [866.635, 1234.125, 1234.375, 1.005, 0.5, 2.5, 3.5, 0.0, 12.0, 59999.5, 885.885]
    rows = spark.createDataFrame(
        [(i, 300, x, x) for i, x in enumerate(numbers)],
        "i int, history_days long, last_close double, median_dollar_volume double",
    )
    out = universe.with_reasons(rows, F.lit(True), 1e5, 1e5, 250).orderBy("i").collect()
    assert [r.reason for r in out] == [f"price below floor ({x:.2f}); dollar_volume below floor ({x:.0f})" for x in numbers]


def test_market_queries_read_trades_once(spark):
    """The features that hmm_regimes learns from and trend_table read the written bars, not the trades again, and bars without open need no sort of trades."""
    from quillon import catalog

    folder = "/root/testdata/sf0.001"
    for name in ("group_features", "trend_table"):
        files = catalog.QUERIES[name](spark, folder).inputFiles()
        assert files and not [f for f in files if "lineitem" in f], name
    plan = source.bars(spark, folder).drop("open")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    placed = source.trades(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert placed.index("Join Inner, (l_orderkey") < placed.index("Join Inner, (o_custkey"), "orders meet customers before line items"
