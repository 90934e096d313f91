"""Day files, the store's lock and replacement, downloads, validation, and the universe built of symbols and profiles."""

import datetime as dt
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import universe
from quillon.sources import bars as source
from quillon.sources import dayfiles, provider, store


def days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_day_files_are_read_back(spark, tmp_path):
    rows = [("AAA", d, 1.5 + i, 100.0 * i) for i, d in enumerate(days(30))] + [
        ("BBB", d, None if i == 2 else 7.25 - i, 5.0) for i, d in enumerate(days(6, days(30)[10]))
    ]
    frame = spark.createDataFrame(rows, "ticker string, date date, close double, volume double")
    assert dayfiles.write(frame, str(tmp_path)) == 4
    assert sorted(map(tuple, dayfiles.read(spark, str(tmp_path)).collect())) == sorted(rows)
    some = dayfiles.read(spark, str(tmp_path), ["close", "nothing"]).where(
        "ticker = 'BBB' and date > '2020-01-12' and close > 0"
    )
    assert [(r.date.day, r.close, r.nothing) for r in some.orderBy("date").collect()] == [
        (14, 4.25, None), (15, 3.25, None), (16, 2.25, None)
    ]
    plain = (tmp_path / "features" / "bbb" / "close.day.bin").read_bytes()
    assert np.frombuffer(plain, "<f4")[0] == 10 and len(plain) == 4 * 7


def test_a_range_is_pushed_down_to_the_bytes():
    class File:
        def __init__(self, data):
            self.data, self.read = data, []

        def read_at(self, n, at):
            self.read.append((at, n))
            return self.data[at : at + n]

    data = np.array([100, *range(50)], "<f4").tobytes()
    file = File(data)
    first, values = dayfiles.read_values(file, len(data), 110, 115)
    assert first == 110 and values.tolist() == [10, 11, 12, 13, 14] and file.read == [(0, 4), (44, 20)]
    assert dayfiles.read_values(File(data), len(data), 0, 100)[1].tolist() == []
    assert dayfiles.read_values(File(data), len(data), 0, 102)[1].tolist() == [0, 1]
    assert dayfiles.read_values(File(data), len(data), 148, 999)[1].tolist() == [48, 49]
    assert dayfiles.read_values(File(b""), 0, 0, 9)[1].tolist() == []


def test_filters_that_a_reader_takes():
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan

    reader = dayfiles.DayFileReader({"path": "/x", "fields": "close"})
    rest = list(
        reader.pushFilters(
            [
                GreaterThanOrEqual(("date",), dt.date(2020, 1, 2)),
                LessThan(("date",), dt.date(2020, 2, 1)),
                In(("ticker",), ("A", "B")),
                EqualTo(("ticker",), "B"),
                IsNotNull(("date",)),
                GreaterThan(("close",), 1.0),
            ]
        )
    )
    assert (reader.low, reader.high, reader.tickers) == (dt.date(2020, 1, 2), dt.date(2020, 1, 31), {"B"})
    assert [type(f).__name__ for f in rest] == ["IsNotNull", "GreaterThan"]


def test_providers(spark, tmp_path):
    rows = [("AAA", d, float(i), 1.0) for i, d in enumerate(days(10))] + [("BBB", days(1)[0], 2.0, 1.0)]
    frame = spark.createDataFrame(rows, "ticker string, date date, close double, volume double")
    dayfiles.write(frame, str(tmp_path / "days"))
    frame.coalesce(1).write.csv(str(tmp_path / "csv"), header=True)
    for name, path in (("dayfiles", tmp_path / "days"), ("csv", tmp_path / "csv")):
        got = provider.prices(spark, name, "2020-01-03", "2020-01-05", ["aaa"], str(path))
        assert sorted(r.close for r in got.collect()) == [2.0, 3.0, 4.0]
        assert provider.prices(spark, name, "2020-01-01", path=str(path)).count() == 11
    with pytest.raises(ValueError, match="unknown provider"):
        provider.prices(spark, "tape", "2020-01-01")
    with pytest.raises(ValueError, match="needs a path"):
        provider.prices(spark, "csv", "2020-01-01")
    with pytest.raises(ValueError, match="needs a fetcher"):
        provider.prices(spark, "fetcher", "2020-01-01")


def priced(spark, ticker, n, close=1.0, start=dt.date(2020, 1, 1)):
    return spark.createDataFrame(
        [(ticker, d, close, close, close, close + i, 1.0) for i, d in enumerate(days(n, start))], source.BARS
    )


def fetcher(spark, close=1.0, known=None):
    def fetch(gaps):
        own = gaps.where(F.col("ticker").isin(known)) if known is not None else gaps
        each = own.select("ticker", F.explode(F.sequence("gap_start", "gap_end")).alias("date"))
        return each.select(
            "ticker", "date", *[F.lit(close).alias(c) for c in ("open", "high", "low", "close", "volume")]
        )

    return fetch


def test_two_refreshes_at_once_lose_nothing(spark, tmp_path):
    path, errors = str(tmp_path / "store"), []

    def run(tickers):
        try:
            store.refresh(spark, path, tickers, "2020-01-01", "2020-01-10", fetcher(spark))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=run, args=(t,)) for t in (["AAA", "BBB"], ["BBB", "CCC"], ["DDD"])]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    got = {
        r.ticker: r.n for r in source.read_store(spark, path).groupBy("ticker").agg(F.count("*").alias("n")).collect()
    }
    assert got == dict.fromkeys(["AAA", "BBB", "CCC", "DDD"], 10)
    assert store.corrupt(spark, path, list(got)) == [] and not list(tmp_path.glob("*.lock")) and not list(
        tmp_path.glob("*staged*")
    )


def test_locks(spark, tmp_path):
    path = str(tmp_path / "store")
    with store.locked(spark, path), pytest.raises(TimeoutError), store.locked(spark, path, patience=0.3, pause=0.05):
        pass
    (tmp_path / "store.lock").write_text("a run that died")
    with store.locked(spark, path, patience=5, stale=-1):
        assert (tmp_path / "store.lock").exists()
    assert not (tmp_path / "store.lock").exists()


@pytest.mark.parametrize("step", ["staging", "first rename", "second rename", "checksums"])
def test_a_run_that_dies_leaves_a_store_that_can_be_read(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "store")
    store.refresh(spark, path, ["AAA", "BBB"], "2020-01-01", "2020-01-05", fetcher(spark))

    class Died(BaseException):
        pass

    def dies(*_):
        raise Died

    if step == "staging":
        monkeypatch.setattr(store, "_create_alone", dies)
    elif step == "checksums":
        monkeypatch.setattr(store, "_note", dies)
    else:
        seen, moved = [], store._moved

        def some(fs, a, b):
            seen.append(b)
            if len(seen) == (1 if step == "first rename" else 2):
                raise Died
            moved(fs, a, b)

        monkeypatch.setattr(store, "_moved", some)
    with pytest.raises(Died):
        store.replace_tickers(priced(spark, "AAA", 9), path)
    monkeypatch.undo()
    # whichever step it was, a load has all of the old rows or all of the new
    got = store.load(
        spark, path, ["AAA", "BBB"], "2020-01-01", "2020-02-01"
    ).groupBy("ticker").agg(F.count("*").alias("n")).collect()
    assert {r.ticker: r.n for r in got} == {"AAA": 5 if step == "staging" else 9, "BBB": 5}
    assert not list(tmp_path.glob("*staged*"))


def test_a_download_has_a_gate_and_a_summary(spark, tmp_path):
    path, summary = str(tmp_path / "store"), str(tmp_path / "notes" / "last.json")
    with pytest.raises(RuntimeError, match="only 2 of 4"):
        store.download(
            spark,
            path,
            ["A", "B", "C", "D"],
            "2020-01-01",
            "2020-01-05",
            fetcher(spark, known=["A", "B"]),
            0.5,
        )
    found = store.download(
        spark,
        path,
        ["A", "B", "C", "D"],
        "2020-01-01",
        "2020-01-05",
        fetcher(spark, known=["C"]),
        0.7,
        summary,
    )
    assert found == json.loads((tmp_path / "notes" / "last.json").read_text())
    assert found["failures"] == ["D"] and found["cache_hits"] == 2 and found["remote_fetches"] == 1
    assert found["tickers"]["C"] == {
        "status": "fetched", "fetched_rows": 5, "rows": 5
    } and found["tickers"]["A"]["rows"] == 5


def test_validation(spark):
    good = priced(spark, "A", 220).unionByName(priced(spark, "B", 3))
    assert source.validated(good, ["A", "B"]) is good
    with pytest.raises(ValueError, match="no prices of"):
        source.validated(good, ["A", "C"])
    with pytest.raises(ValueError, match="at least 200"):
        source.validated(good, ["B"])
    with pytest.raises(ValueError, match="twice"):
        source.validated(good.unionByName(priced(spark, "B", 1)), ["A", "B"])
    with pytest.raises(ValueError, match="rise"):
        source.validated(good.withColumn("seq", -F.unix_date("date")), ["A"])


def test_a_universe_of_symbols_and_profiles(spark):
    symbols = spark.createDataFrame(
        [("A", "Alpha Chips Inc", "NYSE"), ("B", "Beta", None), ("C", "Gamma", "NASDAQ"), ("D", "Delta", "NYSE")],
        "ticker string, name string, exchange string",
    )
    profiles = spark.createDataFrame(
        [("B", "Beta Foods", "Food", "makes optics for lasers"), ("C", None, "Semis", None)],
        "ticker string, long_name string, industry string, summary string",
    )
    bars = priced(spark, "A", 300, 10.0).unionByName(priced(spark, "B", 300, 1.0)).unionByName(
        priced(spark, "C", 20, 50.0)
    )
    got = {
        r.ticker: r
        for r in universe.built(
            symbols,
            profiles,
            bars,
            {"photonics": ["optic", "laser"], "chip": ["chip"]},
            ["Semis"],
            2.0,
            100.0,
            250,
        ).collect()
    }
    assert got["A"].included and got["A"].themes == "chip" and got["A"].industry == "" and got["A"].history_days == 300
    assert got["B"].name == "Beta Foods" and got["B"].themes == "photonics" and got["B"].exchange == "" and got["B"].included
    assert not got["C"].included and got["C"].name == "Gamma" and got["C"].reason == "insufficient history (20d); dollar_volume below floor (60)"
    assert got[
        "D"
    ].reason == "off theme; insufficient history (0d); price below floor (0.00); dollar_volume below floor (0)"
