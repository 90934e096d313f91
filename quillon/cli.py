"""Commands over bars, universes and plans. Networks are outside: what asks one names a fetcher (module:function)."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import dumps, universe
from quillon.plans import backtest, regime, screen, sector
from quillon.plans.config import Config, load
from quillon.scratch import swept
from quillon.sources import bars as source
from quillon.sources import provider, report, store, synthetic

Command = Callable[[argparse.Namespace, SparkSession], int]
COMMANDS: dict[str, tuple[Command, str, dict[str, dict]]] = {}

_PLAN = {
    "--bars": {"help": "a store or a CSV file of bars", "required": True},
    "--config": {},
    "--profile": {},
    "--as-of": {},
    "--out": {"required": True},
}
_STORE = {
    "--store": {"required": True},
    "--tickers": {"help": "names with commas, or a text file of a pool", "required": True},
    "--start": {"required": True},
    "--end": {"required": True},
    "--fetcher": {"help": "module:function", "required": True},
}


def command(name: str, options: dict[str, dict]) -> Callable[[Command], Command]:
    def kept(f: Command) -> Command:
        COMMANDS[name] = f, f.__doc__ or "", options
        return f

    return kept


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, text, options) in COMMANDS.items():
        c = commands.add_parser(name, help=text.splitlines()[0])
        for option, kind in options.items():
            c.add_argument(option, **kind)
    return top


def _say(**found: object) -> None:
    print(json.dumps(found, default=str))


def _export(spark: SparkSession, path: str) -> DataFrame:
    return universe.renamed_header(spark.read.csv(path, header=True))


def _bars(spark: SparkSession, path: str) -> DataFrame:
    return source.cleaned(
        spark.read.csv(path, header=True)
    ) if path.endswith(".csv") else source.read_store(spark, path)


def _tickers(spark: SparkSession, given: str) -> list[str]:
    if given.endswith(".txt"):
        return [r.ticker for r in store.pool(spark, given).orderBy("place").collect()]
    return list(dict.fromkeys(t.strip().upper() for t in given.split(",") if t.strip()))


def _fetch(spark: SparkSession, fetcher: str) -> Callable[[DataFrame], DataFrame]:
    """Bars of gaps by the named fetcher, a ticker a task."""
    spark.dataSource.register(provider.BarSource)

    def fetch(gaps: DataFrame) -> DataFrame:
        out = spark.createDataFrame([], source.BARS)
        for (low, high), names in _by_range(gaps).items():
            got = spark.read.format("bars").options(
                tickers=",".join(names), start=str(low), end=str(high), fetcher=fetcher
            ).load()
            out = out.unionByName(got)
        return out

    return fetch


def _by_range(gaps: DataFrame) -> dict[tuple[date, date], list[str]]:
    """Tickers by the range that they lack; a row a gap, so some for each ticker of the universe."""
    out: dict[tuple[date, date], list[str]] = {}
    for r in gaps.select("ticker", "gap_start", "gap_end").collect():
        out.setdefault((r.gap_start, r.gap_end), []).append(r.ticker)
    return out


def _planned(given: argparse.Namespace, spark: SparkSession) -> tuple[DataFrame, Config]:
    rows = _bars(spark, given.bars)
    return (source.as_of(rows, given.as_of) if given.as_of else rows), load(given.config, given.profile)


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    grouped = rows.withColumn("cluster", F.lit("all"))
    return grouped, source.panel(grouped, values=("close", "volume", "high", "low"))


def _written(tables: dict[str, DataFrame], out: str) -> int:
    report.write_csvs(tables, out)
    _say(tables=sorted(tables), out=out)
    return 0


@command("screen", _PLAN)
def _screen(given, spark):
    """The point-in-time screen, as CSV."""
    return _written(screen.screen(*_planned(given, spark)), given.out)


@command("backtest", _PLAN)
def _backtest(given, spark):
    """Walk-forward validation of the alarm, as CSV."""
    rows, config = _planned(given, spark)
    return _written(backtest.run(*_grouped(rows), config), given.out)


@command("regime", _PLAN)
def _regime(given, spark):
    """Regimes, probabilities and signals of a group, as CSV, and the final models as a table."""
    rows, config = _planned(given, spark)
    *tables, models = regime.configured(_grouped(rows)[1], screen.market_of(rows, config.benchmark), config)
    dumps.save(models, f"{given.out}/models")
    return _written(dict(zip(("signals", "metrics", "importance"), tables, strict=True)), given.out)


@command("sector", _PLAN)
def _sector(given, spark):
    """A sector's features, ranking and alert, as CSV."""
    panel = _grouped(_planned(given, spark)[0])[1]
    found, ranked = sector.analyse(panel), sector.ranking(panel)
    return _written({"features": found, "ranking": ranked, "alert": sector.latest_alert(found, ranked)}, given.out)


@command("report", _PLAN)
def _report(given, spark):
    """The screen as a page."""
    tables = screen.screen(*_planned(given, spark))
    with open(given.out, "w") as file:
        file.write(report.page(tables, f"Screen as of {given.as_of or 'the last day'}"))
    _say(tables=sorted(tables), out=given.out)
    return 0


@command("rebound-leaders", _PLAN)
def _leaders(given, spark):
    """Ranked rebound leaders of each cluster: printed, and as CSV."""
    found = screen.screen(*_planned(given, spark))["leaders"]
    report.write_csvs({"rebound_leaders": found}, given.out)
    found.orderBy("cluster", F.col("rank_in_cluster").asc_nulls_last(), "ticker").select(
        "cluster",
        "ticker",
        "rank_in_cluster",
        "events",
        "median_rebound_20d",
        "rebound_ratio_20d",
        "consistency",
    ).show(1000, False)
    return 0


@command(
    "generate-sample",
    {"--out": {"required": True}, "--periods": {"type": int, "default": 1250}, "--seed": {"type": int, "default": 42}},
)
def _sample(given, spark):
    """Deterministic bars of five tickers and a benchmark, as CSV."""
    rows = synthetic.bars(
        spark,
        ["ALPHA", "BETA", "GAMMA", "DELTA", "EPSILON"],
        benchmark="MARKET",
        periods=given.periods,
        seed=given.seed,
    )
    rows.coalesce(1).write.mode("overwrite").csv(given.out, header=True)
    _say(out=given.out)
    return 0


@command("demo", {"--out": {"required": True}, "--config": {}, "--profile": {}})
def _demo(given, spark):
    """The screen of generated bars."""
    return _written(
        screen.screen(
            synthetic.bars(spark, ["AAA", "BBB", "CCC", "DDD", "EEE"], benchmark=None),
            load(given.config, given.profile),
        ),
        given.out,
    )


@command("validate", {"--config": {"required": True}, "--profile": {}})
def _validate(given, spark):
    """Prints a configuration, or its first error."""
    print(load(given.config, given.profile))
    return 0


@command("info", {"--manifest": {"required": True}, "--config": {}, "--profile": {}})
def _info(given, spark):
    """The stages that have run, and the parameters."""
    found = store.load_manifest(given.manifest)
    _say(schema_version=found["schema_version"], stages=found["stages"], config=str(load(given.config, given.profile)))
    return 0


@command("fetch", {**_STORE, "--manifest": {}})
def _fetched(given, spark):
    """Refreshes a store with what it lacks of a range."""
    status = store.refresh(
        spark, given.store, _tickers(spark, given.tickers), given.start, given.end, _fetch(spark, given.fetcher)
    ).groupBy("status").count().collect()
    if given.manifest:
        store.record_stage(given.manifest, "fetch")
    _say(**{r.status: r["count"] for r in status})
    return 0


@command(
    "download",
    {
        **_STORE,
        "--least-share": {"type": float, "default": 0.8},
        "--summary": {},
        "--tail-days": {"type": int, "default": 0},
        "--force": {"action": "store_true"},
    },
)
def _download(given, spark):
    """A refresh with a coverage gate and a summary."""
    try:
        found = store.download(
            spark,
            given.store,
            _tickers(spark, given.tickers),
            given.start,
            given.end,
            _fetch(spark, given.fetcher),
            given.least_share,
            given.summary,
            given.tail_days,
            given.force,
        )
    except RuntimeError as e:
        print(e)
        return 1
    _say(cache_hits=found["cache_hits"], remote_fetches=found["remote_fetches"], failures=found["failures"])
    return 0


@command("industries", {"--export": {"required": True}})
def _industries(given, spark):
    """The industries of an export, with their numbers of stocks."""
    universe.industries(universe.normalised(_export(spark, given.export))).orderBy("industry").show(1000, False)
    return 0


@command(
    "refresh-universe",
    {
        "--export": {"required": True},
        "--out": {"required": True},
        "--least-rows": {"type": int, "default": 1000},
        "--most-shrink": {"type": float, "default": 0.30},
    },
)
def _refresh_universe(given, spark):
    """A checked export becomes the table of all listed stocks, unless it shrank too much."""
    new = universe.normalised(universe.checked_export(_export(spark, given.export), given.least_rows))
    n, old = new.count(), _read(spark, given.out)
    before = old.count() if old is not None else 0
    if n < (1 - given.most_shrink) * before:
        print(f"the export has {n} symbols, there were {before}; the table stays as it is")
        return 1
    new.write.mode("overwrite").parquet(given.out)
    _say(symbols=n, before=before)
    return 0


@command(
    "resolve",
    {
        "--universe": {"required": True},
        "--industry": {"required": True},
        "--include": {"default": ""},
        "--exclude": {"default": ""},
        "--most": {"type": int},
    },
)
def _resolve(given, spark):
    """The tickers of an industry of the table, with those to include and without those to exclude."""
    rows = universe.by_industry(spark.read.parquet(given.universe), given.industry)
    base = spark.createDataFrame(
        [(r.symbol, i) for i, r in enumerate(rows.select("symbol").collect())], "ticker string, place long"
    )
    out = universe.resolved(
        base, [t for t in given.include.split(",") if t], [t for t in given.exclude.split(",") if t], given.most
    )
    _say(tickers=[r.ticker for r in out.orderBy("place").collect()])
    return 0


@command(
    "build-universe",
    {
        "--nasdaq": {"required": True},
        "--other": {"required": True},
        "--profiles": {"required": True},
        "--bars": {"required": True},
        "--rules": {
            "help": "YAML or JSON: industry_allow_list, theme_keywords, seed_etfs, seed_tickers, exchanges",
            "required": True,
        },
        "--out": {},
        "--dry-run": {"action": "store_true"},
    },
)
def _build(given, spark):
    """Listed symbols with profiles, themes and liquidity: who is in, and why others aren't."""
    rules = store.industries(given.rules)
    nasdaq, other = (spark.read.csv(p, header=True, sep="|") for p in (given.nasdaq, given.other))
    symbols = universe.all_listed(nasdaq, other)
    symbols = symbols.where(F.col("exchange").isin(rules["exchanges"])) if rules.get("exchanges") else symbols
    found = universe.candidates(
        symbols, rules["theme_keywords"], rules.get("seed_etfs", []), rules.get("seed_tickers", [])
    )
    if given.dry_run or not given.out:
        _say(symbols=symbols.count(), candidates=[r.ticker for r in found.select("ticker").orderBy("ticker").collect()])
        return 0
    profiles = spark.read.parquet(given.profiles)
    built = universe.built(
        symbols, profiles, _bars(spark, given.bars), rules["theme_keywords"], rules["industry_allow_list"]
    )
    built.write.mode("overwrite").parquet(given.out)
    made = spark.read.parquet(given.out).agg(
        F.count_if("included").alias("included"), F.count("*").alias("evaluated")
    ).first()
    _say(included=made.included, evaluated=made.evaluated, out=given.out)
    return 0


@command(
    "sync-universe",
    {
        "--export": {"required": True}, "--manifest": {"required": True}, "--out": {"required": True}, "--day": {"required": True}, "--bootstrap": {"default": "2018-01-01"},
        "--least-retention": {"type": float}, "--config": {}, "--profile": {},
    },
)
def _sync(given, spark):
    """The manifest after an export: screened by the configuration's universe, numbers parsed, and refused if it lost too many members."""
    own = load(given.config, given.profile).universe
    raw = _export(spark, given.export)
    new = universe.screened(
        raw, list(own.industries) or None, list(own.countries) or None, own.sector, own.least_cap, top=own.most
    )
    new = new.withColumn("ipo_year", F.col("ipo_year").cast("string").try_cast("int"))
    old = _read(spark, given.manifest)
    share = None if old is None else universe.retention(old, new).first()["share"]
    if share is not None and share < (given.least_retention or own.least_retention):
        print("the snapshot has too few of the known symbols; the manifest stays as it is")
        return 1
    universe.synced(old, new, given.day, given.bootstrap).write.mode("overwrite").parquet(given.out)
    return 0


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    run = COMMANDS[given.command][0]
    if given.command == "validate":
        return run(given, spark)
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    with swept(spark):  # what a plan has written for itself goes once its results are written
        return run(given, spark)


if __name__ == "__main__":
    raise SystemExit(main())
