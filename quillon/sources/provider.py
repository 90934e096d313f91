"""A provider of bars as a Spark data source: each ticker is a partition, read with retries on an executor."""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.sources import bars as source
from quillon.sources import dayfiles

SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


class Limited(Exception):
    """The provider asks to wait."""


class TickerPartition(InputPartition):
    def __init__(self, ticker: str):
        self.ticker = ticker


def with_retries(fetch, *args, waits: tuple[float, ...] = (60, 180, 420), sleep=time.sleep):
    """fetch(*args), again after each wait while the provider asks to wait."""
    for wait in waits:
        try:
            return fetch(*args)
        except Limited:
            sleep(wait)
    return fetch(*args)


class BarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.tickers = [t for t in options["tickers"].split(",") if t]
        self.fetcher, self.start, self.end = options["fetcher"], options["start"], options["end"]

    def partitions(self) -> list[TickerPartition]:
        return [TickerPartition(t) for t in self.tickers]

    def read(self, partition: TickerPartition) -> Iterator[tuple]:
        module, _, name = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for row in with_retries(fetch, partition.ticker, self.start, self.end):
            yield (partition.ticker, *row)


class BarSource(DataSource):
    """Options: tickers (with commas), start, end, fetcher: ``module:function`` of (ticker, start, end), giving date and prices."""

    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarReader:
        return BarReader(self.options)


PROVIDERS = ("csv", "fetcher", "dayfiles")


def prices(
    spark: SparkSession,
    provider: str,
    start: str,
    end: str | None = None,
    tickers: list[str] | None = None,
    path: str | None = None,
    fetcher: str | None = None,
) -> DataFrame:
    """ticker, date, close, volume of the days from start to end, both included, of the given tickers.

    csv: a long file. dayfiles: binary day files. fetcher: ``module:function`` of a network, asked a ticker a task. The range and the
    tickers are filters, which binary files and the file scan take.
    """
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider}; there are {', '.join(PROVIDERS)}")
    if provider != "fetcher" and not path:
        raise ValueError(f"provider {provider} needs a path")
    names = [t.strip().upper() for t in tickers] if tickers else None
    if provider == "csv":
        rows = source.read_csv(spark, path)
    elif provider == "dayfiles":
        rows = dayfiles.read(spark, path)
    else:
        if not fetcher or not names:
            raise ValueError("provider fetcher needs a fetcher and tickers")
        spark.dataSource.register(BarSource)
        rows = spark.read.format("bars").options(
            tickers=",".join(names), start=start, end=end or "", fetcher=fetcher
        ).load()
    day = F.col("date")
    rows = rows.where(day >= F.lit(start).cast("date"))
    rows = rows.where(day <= F.lit(end).cast("date")) if end else rows
    rows = rows.where(F.col("ticker").isin(names)) if names else rows
    return rows.select("ticker", "date", "close", "volume")
