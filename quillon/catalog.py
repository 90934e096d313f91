"""All queries over the test tables, and the SQL that they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.rolling import by_date, by_ticker, forward_compound
from quillon.operators import correlation, evaluate, features, indicators, intervals, labels, largeboost, models, strength, universe
from quillon.operators.boosting import BoostedTrees
from quillon.oracle import ORACLE_SQL
from quillon.plans import backtest as backtest_plan
from quillon.plans import regime, sector
from quillon.plans import screen as screen_plan
from quillon.plans.config import Backtest, Config
from quillon.scratch import root, written
from quillon.sources import bars as source
from quillon.sources import dayfiles, provider, report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """All doubles to so many digits, as sums differ in their last bits by the order of rows."""
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars without open, written once for a query that takes them several times, so that trades are read once."""
    return written(source.bars(spark, sf_dir).drop("open"), "bars")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.panel(held(spark, sf_dir), values=("close", "volume", "high", "low"))


def dense_and_market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The dense panel and the benchmark, from one reading of the trades."""
    own = written(source.totals(spark, sf_dir).drop("open"), "bars")
    return source.panel(own, values=("close", "volume", "high", "low")), source.market_of(own)


@query
def bars(spark, sf_dir):
    return rounded(source.bars(spark, sf_dir))


@query
def panel(spark, sf_dir):
    return rounded(source.panel(held(spark, sf_dir)))


@query
def asof_truncate(spark, sf_dir):
    return rounded(source.as_of(source.bars(spark, sf_dir), "1995-06-30").select("ticker", "date", "close"))


@query
def half_open_range(spark, sf_dir):
    return rounded(
        source.within(source.bars(spark, sf_dir), "1996-01-01", "1997-01-06", half_open=True).select(
            "ticker", "date", "close"
        )
    )


@query
def min_history(spark, sf_dir):
    return source.available(source.bars(spark, sf_dir), 350)


@query
def coverage_gate(spark, sf_dir):
    return source.coverage_gate(held(spark, sf_dir), 25, 357, 0.8)


@query
def returns(spark, sf_dir):
    return rounded(features.returns(dense(spark, sf_dir)).select("ticker", "date", "ret", "log_ret"))


@query
def beta_residual(spark, sf_dir):
    return rounded(
        features.residuals(*dense_and_market(spark, sf_dir)).select(
            "ticker", "date", "bench", "beta", "resid"
        )
    )


@query
def group_features(spark, sf_dir):
    return rounded(features.group_features(*dense_and_market(spark, sf_dir)))


@query
def sector_features(spark, sf_dir):
    return rounded(features.sector_features(dense(spark, sf_dir)), median_dollar_volume=3)


@query
def pair_correlation(spark, sf_dir):
    return rounded(correlation.distance(correlation.correlation(features.returns(dense(spark, sf_dir)), "log_ret")))


@query
def rolling_mean_correlation(spark, sf_dir):
    return rounded(correlation.rolling_mean(features.returns(dense(spark, sf_dir))))


@query
def rolling_median_correlation(spark, sf_dir):
    return rounded(correlation.rolling_median(features.returns(dense(spark, sf_dir))))


def log_factor(market: DataFrame) -> DataFrame:
    return market.select("date", (F.ln("market") - F.ln(F.lag("market").over(by_date()))).alias("f"))


@query
def residualize(spark, sf_dir):
    own, market = dense_and_market(spark, sf_dir)
    return rounded(
        correlation.residualize(features.returns(own), log_factor(market)).select("ticker", "date", "resid")
    )


@query
def indicators_(spark, sf_dir):
    return rounded(
        indicators.indicators(source.bars(spark, sf_dir)).select(
            "ticker",
            "date",
            "rsi",
            "williams_r",
            "stretch_z",
            "volume_signal",
            "divergence",
            "confirmed",
        )
    )


QUERIES["indicators"] = QUERIES.pop("indicators_")


@query
def cluster_washout(spark, sf_dir):
    return rounded(indicators.washout(dense(spark, sf_dir)))


def alarmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = held(spark, sf_dir)
    return indicators.alarms(
        own, source.panel(own, values=("close", "volume", "high", "low")), alarm_gate=20.0, washout_gate=-0.5
    )


@query
def ticker_alarm(spark, sf_dir):
    return rounded(alarmed(spark, sf_dir).select("ticker", "date", "washout", "alarm", "fired"))


@query
def adx(spark, sf_dir):
    return rounded(indicators.adx(source.bars(spark, sf_dir)))


@query
def log_slope_r2(spark, sf_dir):
    return rounded(indicators.slope_r2(source.bars(spark, sf_dir), 60))


@query
def ma_stack(spark, sf_dir):
    return indicators.ma_stack(source.bars(spark, sf_dir), 20, 60)


@query
def trend_table(spark, sf_dir):
    return rounded(indicators.trend_table(held(spark, sf_dir)))


@query
def capture_ratios(spark, sf_dir):
    rows = features.returns(dense(spark, sf_dir))
    group = rows.groupBy("cluster", "date").agg(F.avg("log_ret").alias("group_ret"))
    return rounded(strength.capture(rows.join(group, ["cluster", "date"]), ["ticker"], "log_ret", "group_ret"))


@query
def drawdown_recovery(spark, sf_dir):
    return rounded(strength.drawdowns(source.bars(spark, sf_dir)))


@query
def strength_table(spark, sf_dir):
    return rounded(strength.strength_table(dense(spark, sf_dir)))


@query
def rank_tickers(spark, sf_dir):
    return rounded(strength.rank_tickers(dense(spark, sf_dir)))


@query
def bottom_labels(spark, sf_dir):
    return labels.bottoms(source.bars(spark, sf_dir), 5, 10, 0.05).select("ticker", "date", "label")


@query
def first_hit_labels(spark, sf_dir):
    return labels.first_hit(features.sector_features(dense(spark, sf_dir)))


@query
def forward_returns(spark, sf_dir):
    rows, w = features.returns(dense(spark, sf_dir)), by_ticker()
    return rounded(
        rows.select(
            "ticker",
            "date",
            labels.forward_return(F.col("close"), w, 5).alias("forward_5"),
            forward_compound(F.col("ret"), w, 5).alias("compound_5"),
        )
    )


@query
def rebound_leaders(spark, sf_dir):
    return rounded(labels.rebound_leaders(dense(spark, sf_dir), 5, 20, 0.05))


def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.bottoms(alarmed(spark, sf_dir), 5, 10, 0.05).withColumn("signal", F.col("fired"))


@query
def signal_matches(spark, sf_dir):
    return rounded(
        evaluate.matches(signalled(spark, sf_dir), 10).select("ticker", "pos", "label_pos", "lead", "matched")
    )


@query
def classification_scores(spark, sf_dir):
    return rounded(evaluate.scores(signalled(spark, sf_dir), 10))


@query
def economic_metrics(spark, sf_dir):
    return rounded(evaluate.economics(evaluate.samples(alarmed(spark, sf_dir), F.col("fired"))))


@query
def edge_table(spark, sf_dir):
    rows = alarmed(spark, sf_dir)
    own = evaluate.economics(evaluate.samples(rows, F.col("fired")))
    return rounded(evaluate.edges(own, evaluate.economics(evaluate.baseline(rows, F.col("fired")))))


@query
def folds(spark, sf_dir):
    return evaluate.expanding_folds(spark, "1995-01-02", "2001-06-30", 3)


@query
def gate_search(spark, sf_dir):
    return rounded(
        evaluate.gate_search(
            signalled(spark, sf_dir),
            evaluate.expanding_folds(spark, "1995-01-02", "2001-06-30", 3),
            (5, 10, 15, 20, 25),
            10,
            -0.5,
        )
    )


@query
def purged_splits(spark, sf_dir):
    return evaluate.purged_splits(300, 4, 10, spark)


@query
def prediction_metrics(spark, sf_dir):
    rows = source.table(spark, sf_dir, "orders").select(
        (F.col("o_totalprice") % 101 / 101).alias("x"),
        (F.col("o_orderkey") % 3 == 0).cast("int").alias("target"),
        (F.col("o_custkey") % 21 / 100.0 - 0.1).alias("future"),
    )
    return rounded(evaluate.prediction_metrics(rows.withColumn("probability", F.round("x", 2))))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("ts").cast("date")
    return source.table(spark, sf_dir, "events").select(
        "user_id", day.alias("start"), F.date_add(day, (F.col("event_id") % 4).cast("int")).alias("end")
    )


@query
def interval_union(spark, sf_dir):
    return intervals.union(coverage(spark, sf_dir), "user_id")


@query
def interval_gaps(spark, sf_dir):
    wanted = coverage(spark, sf_dir).select("user_id").distinct().select(
        "user_id", F.lit("2024-01-01").cast("date").alias("low"), F.lit("2024-02-01").cast("date").alias("high")
    )
    return intervals.missing(coverage(spark, sf_dir), wanted, "user_id")


@query
def refresh_gaps(spark, sf_dir):
    return source.refresh_gaps(source.bars(spark, sf_dir), "1994-12-01", "2003-01-01")


@query
def merge_keep_last(spark, sf_dir):
    own = written(source.bars(spark, sf_dir), "bars")
    return rounded(
        source.merged(
            source.as_of(own, "1999-12-31"), own.where("date >= '1999-06-01'").withColumn("close", F.col("close") * 2)
        ).select("ticker", "date", "close")
    )


@query
def checksums(spark, sf_dir):
    part = source.table(spark, sf_dir, "part")
    return universe.membership_hash(part, ["p_size"], "p_brand")


#: What a share of the exported names has before and after it, by p_partkey % 13.
PREFIXES = {3: "United ", 8: "Bright "}
SUFFIXES = {
    0: " Warrant",
    1: " Warrants",
    2: " Rights",
    4: " Unit",
    5: " Preference Shares",
    6: " Depositary Shares",
    7: " Notes Due 2030",
    9: " Bonds",
}


def _by_number(parts: dict[int, str]) -> Column:
    out = F.lit("")
    for i, text in parts.items():
        out = F.when(F.col("p_partkey") % 13 == i, text).otherwise(out)
    return out


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a screener's export: place, symbol, name, industry, sector, country, market_cap as text. Some symbols are odd, some names no stock's."""
    part, k = source.table(spark, sf_dir, "part"), F.col("p_partkey")
    symbol = F.concat(
        F.when(k % 29 == 0, "9").otherwise("s"), k % 700, F.when(k % 5 == 0, "/b").when(k % 7 == 0, ".c").otherwise("")
    )
    name = F.concat(_by_number(PREFIXES), F.col("p_name"), _by_number(SUFFIXES))
    country = F.when(F.col("p_size") % 2 == 0, "France").otherwise("Japan")
    cap = F.concat(F.lit("$"), (F.col("p_retailprice") * 100).cast("long"))
    return part.select(
        k.alias("place"),
        symbol.alias("symbol"),
        name.alias("name"),
        F.col("p_type").alias("industry"),
        F.col("p_brand").alias("sector"),
        country.alias("country"),
        cap.alias("market_cap"),
    )


@query
def universe_normalised(spark, sf_dir):
    return universe.normalised(export(spark, sf_dir))


@query
def industry_counts(spark, sf_dir):
    return universe.industries(universe.normalised(export(spark, sf_dir)))


@query
def industry_query(spark, sf_dir):
    rows = universe.normalised(export(spark, sf_dir))
    first = rows.agg(F.min("industry")).first()[0]
    return universe.by_industry(rows, first, 5).select("symbol", "industry", "market_cap")


@query
def universe_screen(spark, sf_dir):
    rows = export(spark, sf_dir).withColumn("industry", F.lit("Chips"))
    return universe.screened(rows, ["chips"], ["FRANCE"], least_cap=1000, top=50).select("symbol", "name", "market_cap")


@query
def universe_edit(spark, sf_dir):
    nation = source.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("ticker"), F.col("n_nationkey").alias("place")
    )
    return universe.resolved(nation, ["atlantis", "FRANCE"], ["japan"], 20)


@query
def liquidity_reasons(spark, sf_dir):
    stats = universe.liquidity(source.bars(spark, sf_dir))
    return rounded(universe.with_reasons(stats, F.col("ticker") < "M", 1000.0, 300000.0, 357))


@query
def random_baseline(spark, sf_dir):
    return rounded(evaluate.random_baseline(alarmed(spark, sf_dir), F.col("fired")))


THEMES = {"metal": ["steel", "tin", "copper"], "shape": ["ring", "bolt", "gear"], "size": ["large", "small"]}


@query
def theme_scope(spark, sf_dir):
    part = source.table(spark, sf_dir, "part")
    found = universe.themes(F.concat_ws(" ", "p_name", "p_type"), THEMES)
    return part.select(
        "p_partkey",
        F.concat_ws("|", found).alias("themes"),
        universe.in_scope(F.col("p_brand"), found, ["Brand#1"]).alias("in_scope"),
    )


def symbols_and_profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as listed symbols (ticker, name, exchange, etf), parts as the profiles of some of them (ticker, long_name, industry, summary)."""
    supplier, part = source.table(spark, sf_dir, "supplier"), source.table(spark, sf_dir, "part")
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    name = F.concat(
        F.when(k % 4 == 0, "Tin Gear ").otherwise(""), "s_name", F.when(k % 9 == 0, " Warrant").otherwise("")
    )
    listed = supplier.select(
        F.concat(F.lit("S"), k).alias("ticker"),
        name.alias("name"),
        F.when(k % 3 == 0, "NYSE").when(k % 3 == 1, "NASDAQ").alias("exchange"),
        (k % 11 == 0).alias("etf"),
    )
    known = part.where(p % 3 != 0).select(
        F.concat(F.lit("S"), p).alias("ticker"),
        F.when(p % 4 > 0, F.col("p_name")).alias("long_name"),
        F.col("p_brand").alias("industry"),
        F.col("p_type").alias("summary"),
    )
    return listed, known


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, close, volume: a supplier's weeks."""
    line = source.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("ticker"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
        "l_extendedprice",
        "l_quantity",
    )
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return line.groupBy("ticker", "date").agg(
        (total / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume")
    )


@query
def universe_built(spark, sf_dir):
    listed, known = symbols_and_profiles(spark, sf_dir)
    return rounded(
        universe.built(
            listed,
            known,
            supplier_bars(spark, sf_dir),
            THEMES,
            ["Brand#1", "Brand#23"],
            1400.0,
            60000.0,
            160,
        ),
        last_close=9,
        median_dollar_volume=3,
    )


@query
def enrichment_candidates(spark, sf_dir):
    return universe.candidates(
        symbols_and_profiles(spark, sf_dir)[0], THEMES, ["S11", "S22"], ["S5", "S9", "S33"]
    ).select("ticker", "name", "exchange")


@query
def newest_listing(spark, sf_dir):
    """The last hundred purchases, the newest first."""
    rows = source.table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    return report.newest(rows, "ts", "event_id")


@query
def day_files(spark, sf_dir):
    """The bars as binary day files, of which some tickers' days are read back by a provider's range."""
    path = f"{root(spark)}/quillon-dayfiles-{uuid.uuid4().hex}"
    dayfiles.write(source.bars(spark, sf_dir), path)
    back = provider.prices(
        spark, "dayfiles", "1995-01-02", "1997-06-30", ["NATION_3", "nation_7", "NATION_11", "NATION_24"], path
    )
    return rounded(back.where("close is not null"), 3)


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customer = source.table(spark, sf_dir, "customer")
    rows = customer.select(
        F.col("c_custkey").alias("k"),
        F.col("c_name").alias("symbol"),
        F.concat(F.lit("N"), "c_custkey").alias("name"),
        F.lit("tech").alias("sector"),
        F.col("c_mktsegment").alias("industry"),
        F.lit("US").alias("country"),
        F.when(F.col("c_custkey") % 4 > 0, 2010 + F.col("c_custkey") % 14).alias("ipo_year"),
        F.abs("c_acctbal").alias("market_cap"),
    )
    return rows.where("k % 3 <> 0").drop("k"), rows.where("k % 5 <> 0").withColumn(
        "market_cap", F.col("market_cap") + 1
    ).drop("k")


@query
def universe_sync(spark, sf_dir):
    first, second = manifests(spark, sf_dir)
    return rounded(
        universe.synced(universe.synced(None, first, "2024-01-15", "2018-01-01"), second, "2024-02-15", "2018-01-01")
    )


@query
def snapshot_retention(spark, sf_dir):
    first, second = manifests(spark, sf_dir)
    return rounded(universe.retention(universe.synced(None, first, "2024-01-15", "2018-01-01"), second))


@query
def membership_mask(spark, sf_dir):
    own = dense(spark, sf_dir)
    manifest = own.groupBy("ticker").agg(F.date_add(F.min("date"), 700).alias("effective_from"))
    return rounded(features.members(own, manifest).select("ticker", "date", "member", "close"))


@query
def set_changes(spark, sf_dir):
    first, second = (d.select("symbol") for d in manifests(spark, sf_dir))
    marked = [
        d.withColumn("change", F.lit(c))
        for d, c in (
            (second.exceptAll(first), "added"), (first.exceptAll(second), "removed"), (first.intersect(second), "kept")
        )
    ]
    return marked[0].unionByName(marked[1]).unionByName(marked[2])


@query
def signals(spark, sf_dir):
    rows = features.group_features(*dense_and_market(spark, sf_dir))
    k = F.row_number().over(Window.orderBy("date"))
    given = rows.withColumns({"k": k}).withColumns(
        {
            "p": F.when(F.col("k") % 7 > 0, F.col("k") % 10 / 10.0),
            "bull": F.col("k") % 3 / 2.0,
            "bear": F.col("k") % 4 / 3.0,
        }
    )
    return given.select(
        "date",
        models.signal(
            F.col("p"),
            F.col("bull"),
            F.col("bear"),
            F.col("breadth_above_ma20"),
            F.col("relative_return_20"),
            wide=0.5,
            narrow=0.5,
        ).alias("signal"),
    )


@query
def alerts(spark, sf_dir):
    own = dense(spark, sf_dir)
    rows = features.sector_features(own).join(correlation.rolling_median(features.returns(own)), "date", "left")
    given = rows.select(
        "date",
        F.col("drawdown_60d").alias("drawdown"),
        F.col("median_pairwise_correlation").alias("correlation"),
        F.col("breadth_thrust_5d").alias("thrust"),
    )
    given = given.withColumn(
        "probability", models.heuristic_probability(F.col("drawdown"), F.col("thrust"), F.lit(0.3))
    )
    return rounded(
        models.alert(given, least_correlation=-0.05, least_probability=0.6).select(
            "date", "probability", "watch", "triggered"
        )
    )


@query
def latest_signal(spark, sf_dir):
    """The last date that has a signal, as one row."""
    return signals(spark, sf_dir).where("signal <> 'unavailable'").agg(
        F.max("date").alias("date"), F.max_by("signal", "date").alias("signal")
    )


@query
def top_strength(spark, sf_dir):
    rows = strength.rank_tickers(dense(spark, sf_dir)).select("ticker", "rise_strength_rank")
    return rows.orderBy("rise_strength_rank", "ticker").limit(3)


#: The plans over the test tables: weeks for days, regions for clusters.
SETTINGS = Config(
    washout_gate=-0.5,
    alarm_gate=20.0,
    backtest=Backtest("1995-01-02", "2001-06-30", 3, 1, 5, 20, 0.05, (5, 10, 20), (5, 10, 15, 20, 25), 50),
)


@query
def screen(spark, sf_dir):
    own = held(spark, sf_dir)
    tables = screen_plan.screen(own, SETTINGS, "2001-06-30", own.select("cluster", "ticker").distinct())
    return rounded(screen_plan.summary(tables))


@query
def correlation_clusters(spark, sf_dir):
    return rounded(
        correlation.clusters(correlation.correlation(features.returns(dense(spark, sf_dir)), "log_ret"), 0.05, 3)
    )


@query
def rolling_pca_residual(spark, sf_dir):
    return rounded(
        correlation.rolling_pca(features.residuals(*dense_and_market(spark, sf_dir)), 126, "resid")
    )


@query
def rolling_pca_sector(spark, sf_dir):
    return rounded(correlation.rolling_pca(features.returns(dense(spark, sf_dir)), 60, "ret", complete=True))


@query
def hmm_regimes(spark, sf_dir):
    rows = features.group_features(*dense_and_market(spark, sf_dir))
    return rounded(
        models.walk_forward_regimes(rows, ["group_return", "realized_volatility", "breadth_above_ma20"], 200, 42)
    )


def regimes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return regime.run(
        *dense_and_market(spark, sf_dir), horizon=10, pca_window=60, least=120, learn=60
    )


@query
def regime_signals(spark, sf_dir):
    return rounded(regimes(spark, sf_dir)[0].select("date", "regime", "probability", "live_probability", "signal"))


@query
def regime_importance(spark, sf_dir):
    return rounded(regimes(spark, sf_dir)[2])


@query
def causal_regimes(spark, sf_dir):
    rows = features.sector_features(dense(spark, sf_dir))
    return rounded(
        models.causal_regimes(rows, ["sector_return_5d", "sector_return_20d", "realized_vol_20d", "drawdown_60d"])
    )


@query
def sector_alert(spark, sf_dir):
    rows = written(dense(spark, sf_dir), "panel")
    return rounded(sector.latest_alert(sector.analyse(rows), sector.ranking(rows)))


@query
def rebound_model(spark, sf_dir):
    """The classifier's metrics out of sample, over labels that a third of all dates have."""
    rows = written(features.sector_features(dense(spark, sf_dir)), "features")
    wide = labels.first_hit(rows, horizon=10, target=0.02, adverse=-0.02, correction=0.0)
    return rounded(sector.validation(rows.join(wide, "date"))[0])


def backtested(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    own = held(spark, sf_dir)
    return backtest_plan.run(own, source.panel(own, values=("close", "volume", "high", "low")), SETTINGS)


@query
def backtest_folds(spark, sf_dir):
    return rounded(backtested(spark, sf_dir)["per_fold"])


@query
def backtest_economics(spark, sf_dir):
    return rounded(backtested(spark, sf_dir)["economics"])


@query
def backtest_edges(spark, sf_dir):
    return rounded(backtested(spark, sf_dir)["edges"])


@query
def screen_clusters(spark, sf_dir):
    """The screen with clusters of its own, found by correlation of what the market leaves."""
    tables = screen_plan.screen(held(spark, sf_dir), replace(SETTINGS, threshold=0.02), "2001-06-30")
    return rounded(screen_plan.summary(tables))


@query
def large_split(spark, sf_dir):
    """The first split of boosted trees over all line items: whether one is returned, from four columns."""
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    rows = source.table(spark, sf_dir, "lineitem").select(
        *columns, (F.col("l_returnflag") == "R").cast("int").alias("returned")
    )
    model = largeboost.fit_large(rows, columns, "returned", BoostedTrees(1, 1, rows=1.0, columns=1.0))
    found = [
        (columns[t.feature], t.cut, float(model.gain[t.feature]), t.left.weight, t.right.weight)
        for t in model.grown
        if t.feature >= 0
    ]
    return rounded(
        spark.createDataFrame(found, "feature string, cut double, gain double, left_weight double, right_weight double")
    )


@query
def large_importance(spark, sf_dir):
    """Importance in boosted trees of all line items, with columns of many values in bins by quantiles."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "day"]
    day = F.unix_date(F.col("l_shipdate").cast("date")).alias("day")
    rows = source.table(spark, sf_dir, "lineitem").select(
        *columns[:-1], day, (F.col("l_returnflag") == "R").cast("int").alias("returned")
    )
    model = largeboost.fit_large(rows, columns, "returned", BoostedTrees(4, 3, 0.3))
    return rounded(
        spark.createDataFrame(
            [(c, float(v)) for c, v in zip(columns, model.importance(), strict=True)],
            "feature string, importance double",
        ),
        4,
    )
