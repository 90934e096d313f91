"""Commands and the bounds of parameters."""

import dataclasses
import datetime as dt
import json

import pytest

from quillon import cli, scratch
from quillon.operators import dumps
from quillon.plans import config
from quillon.sources import bars as source
from quillon.sources import store



def said(capsys):
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def prices(ticker, start, end):
    """A fetcher: a bar a day; none of a ticker that begins with X."""
    if ticker.startswith("X"):
        return []
    day, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    return [(day + dt.timedelta(days=i), 1.0, 2.0, 0.5, 1.5, 10.0) for i in range((last - day).days + 1)]


def test_fetch_and_download(spark, tmp_path, capsys):
    path, tickers = str(tmp_path / "store"), [
        "--tickers",
        "aaa,BBB,ccc,XXX",
        "--start",
        "2020-01-01",
        "--end",
        "2020-01-10",
        "--fetcher",
        "tests.test_commands:prices",
    ]
    assert cli.main(["fetch", "--store", path, *tickers, "--manifest", str(tmp_path / "m.json")], spark) == 0
    assert said(capsys) == {"fetched": 3, "failed": 1}
    assert "fetch" in store.load_manifest(str(tmp_path / "m.json"))["stages"]
    tickers[-3] = "2020-01-12"
    assert cli.main(
        ["download", "--store", path, *tickers, "--least-share", "0.5", "--summary", str(tmp_path / "s.json")], spark
    ) == 0
    assert said(capsys) == {"cache_hits": 0, "remote_fetches": 3, "failures": ["XXX"]}
    assert json.loads((tmp_path / "s.json").read_text())["tickers"]["AAA"] == {
        "status": "fetched", "fetched_rows": 2, "rows": 12
    }
    assert cli.main(["download", "--store", path, *tickers, "--least-share", "1"], spark) == 1
    assert source.read_store(spark, path).groupBy("ticker").count().where("count = 12").count() == 3
    assert cli.main(
        ["info", "--manifest", str(tmp_path / "m.json")], spark
    ) == 0 and said(capsys)["schema_version"] == store.SCHEMA_VERSION


def test_sample_screen_report_and_leaders(spark, tmp_path, capsys):
    assert cli.main(["generate-sample", "--out", str(tmp_path / "sample.csv"), "--periods", "400"], spark) == 0
    settings = {
        "defaults": {
            "threshold": -0.5,
            "benchmark": "MARKET",
            "least_cluster": 2,
            "backtest": {"half_window": 5, "ahead": 10, "least_return": 0.01, "horizons": [5, 10, 20]},
        }
    }
    (tmp_path / "c.json").write_text(json.dumps(settings))
    plan = ["--bars", str(tmp_path / "sample.csv"), "--config", str(tmp_path / "c.json"), "--as-of", "2021-06-01"]
    before = len(scratch._made)
    assert cli.main(["screen", *plan, "--out", str(tmp_path / "screen")], spark) == 0
    assert "leaders" in said(capsys)["tables"]
    assert len(scratch._made) == before  # a command leaves none of its own tables
    assert cli.main(["report", *plan, "--out", str(tmp_path / "page.html")], spark) == 0
    assert (tmp_path / "page.html").read_text().startswith("<!DOCTYPE html>")
    assert cli.main(["rebound-leaders", *plan, "--out", str(tmp_path / "leaders")], spark) == 0
    assert "rank_in_cluster" in capsys.readouterr().out and list(
        (tmp_path / "leaders" / "rebound_leaders").glob("*.csv")
    )


def test_regime_keeps_its_models(spark, tmp_path, capsys):
    assert cli.main(["generate-sample", "--out", str(tmp_path / "sample.csv"), "--periods", "330"], spark) == 0
    (tmp_path / "c.json").write_text(
        json.dumps(
            {
                "defaults": {
                    "benchmark": "MARKET",
                    "boosting": {"trees": 10, "least": 126, "refit": 200},
                    "regimes": {"least": 126, "refit": 200},
                    "features": {"component": 60},
                }
            }
        )
    )
    assert cli.main(
        [
            "regime",
            "--bars",
            str(tmp_path / "sample.csv"),
            "--config",
            str(tmp_path / "c.json"),
            "--out",
            str(tmp_path / "r"),
        ],
        spark,
    ) == 0
    kept = dumps.load(spark, str(tmp_path / "r" / "models"))
    assert sorted(r.kind for r in kept.collect()) == ["boosted", "regimes"]
    assert sorted(said(capsys)["tables"]) == ["importance", "metrics", "signals"]


def test_universe_commands(spark, tmp_path, capsys):
    head = "Symbol,Name,Industry,Sector,Country,IPO Year,Market Cap\n"
    rows = "".join(
        f"S{i},Name {i},{'Chip Makers' if i % 2 else 'Food'},Tech,{'US' if i % 3 else 'FR'},20{10 + i},${i}00\n"
        for i in range(12)
    )
    (tmp_path / "e.csv").write_text(head + rows + "W,Some Warrant,Chip Makers,Tech,US,2020,$5\n")
    refresh = [
        "refresh-universe",
        "--export",
        str(tmp_path / "e.csv"),
        "--out",
        str(tmp_path / "u"),
        "--least-rows",
        "5",
    ]
    assert cli.main(refresh, spark) == 0 and said(capsys) == {"symbols": 13, "before": 0}
    assert cli.main(
        [
            "resolve",
            "--universe",
            str(tmp_path / "u"),
            "--industry",
            "chip",
            "--include",
            "zz, S1",
            "--exclude",
            "s3",
            "--most",
            "4",
        ],
        spark,
    ) == 0
    assert said(capsys)["tickers"] == ["S11", "S9", "S7", "S5"]
    (tmp_path / "e.csv").write_text(head + rows[:200])
    assert cli.main(refresh[:-1] + ["2"], spark) == 1 and spark.read.parquet(str(tmp_path / "u")).count() == 13


def test_sync_screens_and_parses(spark, tmp_path):
    (tmp_path / "e.csv").write_text('Symbol,Name,Industry,Sector,Country,IPO Year,Market Cap\na,A Inc,Chips,Tech,US,2020,"$1,500.50"\nB,B Inc,Chips,Tech,US,n/a,none\nC,C Warrant,Chips,Tech,US,2020,9\nD,D Inc,Food,Tech,US,2020,9\n')
    (tmp_path / "c.json").write_text('{"defaults": {"universe": {"industries": ["chips"]}}}')
    sync = [
        "sync-universe",
        "--export",
        str(tmp_path / "e.csv"),
        "--manifest",
        str(tmp_path / "m0"),
        "--out",
        str(tmp_path / "m1"),
        "--day",
        "2024-01-15",
        "--config",
        str(tmp_path / "c.json"),
    ]
    assert cli.main(sync, spark) == 0
    got = {
        r.symbol: (r.market_cap, r.ipo_year, str(r.effective_from))
        for r in spark.read.parquet(str(tmp_path / "m1")).collect()
    }
    assert got == {"A": (1500.5, 2020, "2020-01-01"), "B": (0.0, None, "2018-01-01")}


def test_build_universe(spark, tmp_path, capsys):
    (tmp_path / "n.txt").write_text("Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares\nAAA|Alpha Chips Common|Q|N|N|100|N|N\nETF1|An Index|Q|N|N|100|Y|N\nTST|Test|Q|Y|N|100|N|N\nFile Creation Time: 1|||||||\n")
    (tmp_path / "o.txt").write_text("ACT Symbol|Security Name|Exchange|CQS Symbol|ETF|Round Lot Size|Test Issue|NASDAQ Symbol\nBBB|Beta Foods|N|BBB|N|100|N|BBB\nFile Creation Time: 1|||||||\n")
    (tmp_path / "rules.json").write_text(
        json.dumps(
            {
                "industry_allow_list": ["Semis"],
                "theme_keywords": {"chip": ["chip"]},
                "seed_etfs": ["ETF1"],
                "seed_tickers": [],
            }
        )
    )
    spark.createDataFrame(
        [("BBB", "Beta", "Semis", "")], "ticker string, long_name string, industry string, summary string"
    ).write.parquet(str(tmp_path / "p"))
    source.write_store(
        spark.createDataFrame(
            [("AAA", dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0, 1.0, 1.0, 10.0, 1e6) for i in range(260)],
            source.BARS,
        ),
        str(tmp_path / "bars"),
    )
    build = [
        "build-universe",
        "--nasdaq",
        str(tmp_path / "n.txt"),
        "--other",
        str(tmp_path / "o.txt"),
        "--profiles",
        str(tmp_path / "p"),
        "--bars",
        str(tmp_path / "bars"),
        "--rules",
        str(tmp_path / "rules.json"),
    ]
    assert cli.main([*build, "--dry-run"], spark) == 0 and said(capsys) == {"symbols": 3, "candidates": ["AAA", "ETF1"]}
    assert cli.main([*build, "--out", str(tmp_path / "u")], spark) == 0
    assert {k: v for k, v in said(capsys).items() if k != "out"} == {"included": 1, "evaluated": 3}
    assert spark.read.parquet(str(tmp_path / "u")).where("included").first().ticker == "AAA"


@pytest.mark.parametrize(
    ("kind", "name", "bad"),
    [
        ("Features", "beta", 19),
        ("Features", "least_coverage", 0),
        ("Regimes", "states", 1),
        ("Regimes", "least", 100),
        ("Boosting", "depth", 11),
        ("Boosting", "rows", 1.5),
        ("Signals", "high", 0.5),
        ("Signals", "narrow", 0.5),
        ("Universe", "most", 1),
        ("Universe", "least_retention", 0),
    ],
)
def test_parameters_have_bounds(kind, name, bad):
    with pytest.raises(ValueError, match=name):
        getattr(config, kind)(**{name: bad})


def test_parameters_of_a_file(tmp_path):
    (tmp_path / "c.json").write_text('{"defaults": {"signals": {"high": 0.7}, "universe": {"industries": ["Chips"]}}, "dev": {"boosting": {"trees": 20}}}')
    c = config.load(str(tmp_path / "c.json"), "dev")
    assert (c.signals.high, c.universe.industries, c.boosting.trees, c.boosting.depth) == (0.7, ("Chips",), 20, 3)
    (tmp_path / "c.json").write_text('{"defaults": {"signals": {"height": 0.7}}}')
    with pytest.raises(ValueError, match="height"):
        config.load(str(tmp_path / "c.json"))


def test_requests():
    good = config.request({"include": [" aaa ", ""], "exclude": ["b"], "start": "2020-01-01", "end": "2021-01-01"})
    assert good.include == ("AAA",) and good.exclude == ("B",)
    tomorrow = dt.datetime.now(dt.UTC).date() + dt.timedelta(days=2)
    for bad in (
        {"start": "2021-01-01", "end": "2021-01-01"},
        {"end": str(tomorrow)},
        {"short": 60, "mid": 60},
        {"mid": 126, "long": 100},
        {"target_pct": 3.0},
        {"include": ["a"], "exclude": ["A "]},
        {"industry": "a b"},
        {"include": [f"T{i}" for i in range(51)]},
        {"nothing": 1},
    ):
        with pytest.raises(ValueError):
            config.request(bad)
    for name, (low, high) in config.Request.BOUNDS.items():
        for value in (low - 0.001, high + 0.001):
            with pytest.raises(ValueError, match=name):
                dataclasses.replace(config.Request(), **{name: value})


def test_years_are_shifted_with_a_clamp():
    assert config.shifted(dt.date(2020, 2, 29), -1) == dt.date(2019, 2, 28) and config.shifted(dt.date(2020, 2, 29), 4) == dt.date(2024, 2, 29)


def test_ranges_of_gaps(spark):
    rows = [
        ("A", dt.date(2020, 1, 1), dt.date(2020, 1, 2)),
        ("B", dt.date(2020, 1, 1), dt.date(2020, 1, 2)),
        ("A", dt.date(2020, 2, 1), dt.date(2020, 2, 2)),
    ]
    found = cli._by_range(spark.createDataFrame(rows, "ticker string, gap_start date, gap_end date"))
    assert {k[0].month: sorted(v) for k, v in found.items()} == {1: ["A", "B"], 2: ["A"]}

