"""Readers, stores, caches, reports, streams and commands."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillon import cli
from quillon.sources import bars as source
from quillon.sources import provider, report, store, synthetic
from quillon.streaming import incremental

DAY = dt.date(2024, 1, 1)


def fake_bars(ticker, start, end):
    for i in range(3):
        yield (DAY + dt.timedelta(days=i), 1.0, 2.0, 0.5, 1.5 + i, 10.0)


def bar(ticker, day, close=1.0):
    return (ticker, DAY + dt.timedelta(days=day), close, close, close, close, 1.0)


def test_a_provider_is_a_data_source(spark):
    spark.dataSource.register(provider.BarSource)
    rows = spark.read.format("bars").options(
        tickers="A,B", start="2024-01-01", end="2024-02-01", fetcher="tests.test_sources:fake_bars"
    ).load()
    assert rows.count() == 6 and {r.ticker for r in rows.select("ticker").distinct().collect()} == {"A", "B"}


def test_retries():
    waits, tries = [], []

    def fetch(x):
        tries.append(x)
        if len(tries) < 3:
            raise provider.Limited
        return x

    assert provider.with_retries(fetch, 7, sleep=waits.append) == 7 and waits == [60, 180]


def test_cleaning(spark):
    raw = spark.createDataFrame(
        [
            (" a ", "2024-01-01", "1", "2", "0", "1.5", "10", 1),
            ("A", "2024-01-01", "1", "2", "0", "1.7", "10", 2),
            ("A", "2024-01-02", "1", "2", "0", "bad", "10", 3),
        ],
        "Ticker string, Date string, Open string, HIGH string, Low string, Close string, Volume string, seq int",
    )
    assert [(r.ticker, r.close) for r in source.cleaned(raw).collect()] == [("A", 1.7)]
    with pytest.raises(ValueError):
        source.cleaned(raw.drop("Close"))


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,ticker,close,volume\n2024-01-01,a,1,2\n2024-01-02,a,2,3\n")
    assert source.read_csv(spark, str(tmp_path / "a.csv")).count() == 2
    (tmp_path / "b.csv").write_text("date,ticker,close,volume\n2024-01-01,a,1,2\n2024-01-01,A,2,3\n")
    with pytest.raises(ValueError):
        source.read_csv(spark, str(tmp_path / "b.csv"))


def test_store_is_refreshed_and_never_cut(spark, tmp_path):
    path, asked = str(tmp_path / "bars"), []

    def fetch(gaps):
        asked.append(sorted(map(tuple, gaps.collect())))
        return spark.createDataFrame(
            [bar("A", d, float(d)) for d in range(3)] if len(asked) == 1 else [bar("A", 3, 9.0)], source.BARS
        )

    first = {
        r.ticker: r.status for r in store.refresh(spark, path, ["A", "B"], "2024-01-01", "2024-01-03", fetch).collect()
    }
    assert first == {"A": "fetched", "B": "failed"}
    store.refresh(spark, path, ["A"], "2024-01-01", "2024-01-04", fetch)
    assert asked[1] == [("A", dt.date(2024, 1, 4), dt.date(2024, 1, 4))]
    assert sorted(r.close for r in source.read_store(spark, path).collect()) == [0.0, 1.0, 2.0, 9.0]
    assert source.read_store(spark, path, ["A"], "2024-01-02").count() == 2
    done = {r.ticker: r.status for r in store.refresh(spark, path, ["A"], "2024-01-01", "2024-01-04", fetch).collect()}
    assert done["A"] in ("skipped", "fetched")


def test_failures_and_profiles(spark, tmp_path):
    status = spark.createDataFrame([("A", "failed", 0), ("B", "fetched", 3)], "ticker string, status string, n int")
    store.record_failures(status, str(tmp_path / "log"), "no answer")
    store.record_failures(status, str(tmp_path / "log"), "no answer")
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 2
    seen = []

    def look_up(pending):
        seen.append(sorted(r.ticker for r in pending.collect()))
        return pending.withColumn("sector", F.lit("x"))

    symbols = spark.createDataFrame([("A",), ("B",)], "ticker string")
    store.enrich(spark, str(tmp_path / "profiles"), symbols.limit(1), look_up)
    assert store.enrich(spark, str(tmp_path / "profiles"), symbols, look_up).count() == 2 and seen == [["A"], ["B"]]


def test_manifest(tmp_path):
    path = str(tmp_path / "m.json")
    store.record_stage(path, "screen", 5)
    assert store.load_manifest(path)["stages"] == {"screen": 5}
    (tmp_path / "m.json").write_text('{"schema_version": 99}')
    with pytest.raises(ValueError):
        store.load_manifest(path)


def test_snapshot_cache(tmp_path):
    cache = store.SnapshotCache(str(tmp_path / "s.json"), ttl=10, least_rows=2)
    rows = [{"symbol": c} for c in "ABCD"]
    with pytest.raises(ValueError):
        cache.ensure(lambda: rows[:1], now=0)
    assert not cache.ensure(lambda: rows, now=0)["stale"]
    assert len(cache.ensure(lambda: rows[:3], now=5)["rows"]) == 4  # not due yet
    assert cache.ensure(lambda: rows[:2], now=20)["stale"]  # shrank too much
    assert len(cache.ensure(lambda: rows[:3], now=20)["rows"]) == 3
    (tmp_path / "s.json").write_text((tmp_path / "s.json").read_text().replace('"A"', '"Z"'))
    assert cache.read() is None


def test_pool(spark, tmp_path):
    (tmp_path / "p.txt").write_text("bbb\t1\t2\naaa\t1\t2\nbbb\t3\t4\n\n")
    assert [r.ticker for r in store.pool(spark, str(tmp_path / "p.txt")).orderBy("place").collect()] == ["BBB", "AAA"]


def test_reports(spark, tmp_path):
    frame = spark.createDataFrame([("A", float("nan"), ["x"])], "ticker string, v double, l array<string>")
    report.write_csvs({"t": frame}, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/t"), header=True).count() == 1
    report.write_json(frame, str(tmp_path / "t.json"))
    assert json.loads((tmp_path / "t.json").read_text())[0]["v"] is None
    assert "| A |" in report.markdown(frame, "T") and "<td>A</td>" in report.page({"t": frame}, "T")
    assert [report.trend_label(x) for x in (1, -1, 0)] == ["strong up", "strong down", "mixed"]


def test_streams(spark, tmp_path):
    trades = spark.createDataFrame(
        [("A", dt.datetime(2024, 1, 1, h), float(h), 1) for h in range(1, 5)] + [
            ("A", dt.datetime(2024, 1, 9), 1.0, 1)
        ],
        "ticker string, ts timestamp, price double, quantity int",
    )
    trades.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(trades.schema).parquet(str(tmp_path / "in"))
    bars = incremental.bars_of_trades(stream)
    q = bars.writeStream.format("memory").queryName("made").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    first = spark.table("made").orderBy("date").first()
    assert (first.open, first.high, first.low, first.close, first.volume) == (1.0, 4.0, 1.0, 4.0, 4.0)
    spark.createDataFrame([bar("A", 0), bar("B", 0)], source.BARS).write.parquet(str(tmp_path / "new"))
    path = str(tmp_path / "bars")
    incremental.upsert(
        spark.readStream.schema(source.BARS).parquet(str(tmp_path / "new")), path, str(tmp_path / "cp")
    ).awaitTermination(120)
    spark.createDataFrame([bar("A", 0, 5.0)], source.BARS).write.mode("append").parquet(str(tmp_path / "new"))
    incremental.upsert(
        spark.readStream.schema(source.BARS).parquet(str(tmp_path / "new")), path, str(tmp_path / "cp")
    ).awaitTermination(120)
    assert {r.ticker: r.close for r in source.read_store(spark, path).collect()} == {"A": 5.0, "B": 1.0}


def test_commands(spark, tmp_path, capsys):
    assert cli.main(["demo", "--out", str(tmp_path / "demo")], spark) == 0
    assert json.loads(capsys.readouterr().out)["tables"] == ["clusters", "leaders", "rebound", "strength", "trend"]
    (tmp_path / "c.json").write_text('{"defaults": {"threshold": 0.4}}')
    assert cli.main(["validate", "--config", str(tmp_path / "c.json")]) == 0
    (tmp_path / "e.csv").write_text(
        "Symbol,Name,Industry,Sector,Country,IPO Year,Market Cap\nA,a,i,s,US,2020,1\nB,b,i,s,US,2010,2\n"
    )
    sync = [
        "sync-universe",
        "--export",
        str(tmp_path / "e.csv"),
        "--manifest",
        str(tmp_path / "m1"),
        "--out",
        str(tmp_path / "m2"),
        "--day",
        "2024-01-15",
    ]
    assert cli.main(sync, spark) == 0 and spark.read.parquet(str(tmp_path / "m2")).count() == 2
    (tmp_path / "e.csv").write_text("Symbol,Name,Industry,Sector,Country,IPO Year,Market Cap\nC,c,i,s,US,2020,1\n")
    assert cli.main([*sync[:4], str(tmp_path / "m2"), "--out", str(tmp_path / "m3"), "--day", "2024-02-15"], spark) == 1
    assert cli.main(["industries", "--export", str(tmp_path / "e.csv")], spark) == 0


def test_generator_is_deterministic():
    a, b = synthetic.frame(["X"], None, 30), synthetic.frame(["X"], None, 30)
    assert a.equals(b) and (a["high"] >= a["close"]).all()


def _bars(rows):
    return [(t, dt.date(2024, 1, d), c, c, c, c, 1.0) for t, d, c in rows]


def _fetcher(spark, table, asked=None):
    def fetch(gaps):
        rows = gaps.collect()
        if asked is not None:
            asked.extend((r.ticker, str(r.gap_start), str(r.gap_end)) for r in rows)
        own = [b for b in _bars(table) if any(r.ticker == b[0] and r.gap_start <= b[1] <= r.gap_end for r in rows)]
        return spark.createDataFrame(own, source.BARS)

    return fetch


def test_a_refresh_of_one_ticker_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "store")
    store.refresh(
        spark,
        path,
        ["AAA", "BBB"],
        "2024-01-01",
        "2024-01-02",
        _fetcher(spark, [("AAA", 1, 1.0), ("AAA", 2, 1.0), ("BBB", 1, 5.0)]),
    )
    store.replace_tickers(spark.createDataFrame(_bars([("AAA", 1, 9.0), ("AAA", 2, 1.0)]), source.BARS), path)
    store.refresh(spark, path, ["BBB"], "2024-01-01", "2024-01-03", _fetcher(spark, [("BBB", 2, 6.0), ("BBB", 3, 7.0)]))
    got = {(r.ticker, r.date.day): r.close for r in source.read_store(spark, path).collect()}
    assert got == {("AAA", 1): 9.0, ("AAA", 2): 1.0, ("BBB", 1): 5.0, ("BBB", 2): 6.0, ("BBB", 3): 7.0}
    assert not list(tmp_path.glob("*staged*"))


def test_tail_and_force(spark, tmp_path):
    path, asked = str(tmp_path / "store"), []
    first = [("A", d, 1.0) for d in range(1, 11)]
    store.refresh(spark, path, ["A"], "2024-01-01", "2024-01-10", _fetcher(spark, first))
    store.refresh(
        spark,
        path,
        ["A"],
        "2024-01-01",
        "2024-01-10",
        _fetcher(spark, [("A", d, 2.0) for d in range(1, 11)], asked),
        tail_days=3,
    )
    assert asked == [("A", "2024-01-07", "2024-01-10")]
    assert {r.date.day for r in source.read_store(spark, path).collect() if r.close == 2.0} == {7, 8, 9, 10}
    store.refresh(spark, path, ["A"], "2024-01-01", "2024-01-10", _fetcher(spark, [("A", 5, 3.0)]), force=True)
    assert [(r.date.day, r.close) for r in source.read_store(spark, path).collect()] == [(5, 3.0)]


def test_broken_and_altered_folders_are_put_aside(spark, tmp_path):
    path = tmp_path / "store"
    table = [("A", 1, 1.0), ("A", 2, 1.0), ("B", 1, 2.0)]
    store.refresh(spark, str(path), ["A", "B"], "2024-01-01", "2024-01-02", _fetcher(spark, table))
    assert store.load(spark, str(path), ["A", "B"], "2024-01-01", "2024-01-02").count() == 2
    for file in (path / "ticker=A").glob("*.parquet"):
        file.write_bytes(b"no parquet")
    for crc in (path / "ticker=A").glob(".*.crc"):
        crc.unlink()
    assert store.corrupt(spark, str(path), ["A", "B"]) == ["A"]
    with pytest.raises(ValueError, match="checksums"):
        store.load(spark, str(path), ["A"], "2024-01-01", "2024-01-03")
    with pytest.raises(ValueError, match="no bars"):
        store.load(spark, str(path), ["B"], "2024-02-01", "2024-03-01")
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"), ["B"], "2024-02-01", "2024-03-01")
    store.refresh(spark, str(path), ["A", "B"], "2024-01-01", "2024-01-02", _fetcher(spark, table))
    assert store.load(spark, str(path), ["A", "B"], "2024-01-01", "2024-01-03").count() == 3
    assert len(list((tmp_path / "store.quarantine").iterdir())) == 1


def test_profiles_are_flushed_on_the_way(spark, tmp_path):
    path, calls = str(tmp_path / "profiles"), []

    def look_up(pending):
        calls.append(pending.count())
        if len(calls) == 3:
            raise RuntimeError("the provider is gone")
        return pending.selectExpr("ticker", "'x' AS industry")

    symbols = spark.createDataFrame([(f"T{i:02}",) for i in range(60)], "ticker string")
    with pytest.raises(RuntimeError):
        store.enrich(spark, path, symbols, look_up)
    assert spark.read.parquet(path).count() == 50
    assert store.enrich(spark, path, symbols, look_up).count() == 60 and calls == [25, 25, 10, 10]
