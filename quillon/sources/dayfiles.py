"""Binary day files as a Spark data source and sink: for each instrument and field a file of float32, which begins with the place of its first day in a calendar.

    calendars/day.txt                       a day a line
    features/<instrument>/<field>.day.bin   start, value, value, ... (little-endian)

An instrument is a partition. A range of dates and a choice of tickers are pushed down, so only the files that are asked for are opened, and of these
only the range's bytes are read.
"""

from __future__ import annotations

import bisect
import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

FIELDS = ("close", "volume")
WIDTH = 4
ONE_DAY = dt.timedelta(days=1)


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def calendar(path: str) -> list[dt.date]:
    system, root = _place(path)
    with system.open_input_stream(f"{root}/calendars/day.txt") as file:
        return [dt.date.fromisoformat(line.strip()[:10]) for line in file.read().decode().splitlines() if line.strip()]


def read_values(file, size: int, low: int, high: int) -> tuple[int, np.ndarray]:
    """Of a file of so many bytes, the values of the calendar's places from low to high (exclusive), and the place of the first. Reads the start and these bytes only."""
    if size < 2 * WIDTH:
        return low, np.empty(0, np.float32)
    start = int(np.frombuffer(file.read_at(WIDTH, 0), "<f4")[0])
    end = min(high, start + size // WIDTH - 1)
    first = max(low, start)
    if first >= end:
        return first, np.empty(0, np.float32)
    return first, np.frombuffer(file.read_at((end - first) * WIDTH, (1 + first - start) * WIDTH), "<f4")


class InstrumentPartition(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class DayFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.fields = options["path"], [f for f in options.get("fields", ",".join(FIELDS)).split(",") if f]
        self.low, self.high = dt.date.min, dt.date.max
        self.tickers: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds of date and choices of ticker; Spark applies all others."""
        for f in filters:
            if getattr(f, "attribute", None) == ("date",) and isinstance(
                getattr(f, "value", None), dt.date
            ) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + ONE_DAY)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, f.value)
                if isinstance(f, LessThan):
                    self.high = min(self.high, f.value - ONE_DAY)
            elif getattr(f, "attribute", None) == ("ticker",) and isinstance(f, (EqualTo, In)):
                chosen = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = chosen if self.tickers is None else self.tickers & chosen
            else:
                yield f

    def partitions(self) -> Sequence[InstrumentPartition]:
        system, root = _place(self.path)
        found = system.get_file_info(pafs.FileSelector(f"{root}/features"))
        names = sorted(i.base_name for i in found if i.type == pafs.FileType.Directory)
        return [InstrumentPartition(n) for n in names if self.tickers is None or n.upper() in self.tickers]

    def read(self, partition: InstrumentPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no instrument is asked for
            return
        system, root = _place(self.path)
        days = calendar(self.path)
        low, high = bisect.bisect_left(days, self.low), bisect.bisect_right(days, self.high)
        parts = {}
        for field in self.fields:
            info = system.get_file_info(f"{root}/features/{partition.folder}/{field}.day.bin")
            if info.type == pafs.FileType.File:
                with system.open_input_file(info.path) as file:
                    parts[field] = read_values(file, info.size, low, high)
        spans = [(first, first + len(v)) for first, v in parts.values() if len(v)]
        if not spans:
            return
        begin, end = min(a for a, _ in spans), max(b for _, b in spans)
        columns = []
        for field in self.fields:
            whole = np.full(end - begin, np.nan)
            first, values = parts.get(field, (begin, np.empty(0, np.float32)))
            whole[first - begin : first - begin + len(values)] = values
            columns.append(pa.array(whole, mask=np.isnan(whole)))
        names = ["ticker", "date", *self.fields]
        yield pa.RecordBatch.from_arrays(
            [pa.array([partition.folder.upper()] * (end - begin)), pa.array(days[begin:end], pa.date32()), *columns],
            names,
        )


class DayFiles(DataSource):
    """Options: path, fields (with commas). Columns: ticker, date and the fields, a row for each day from an instrument's first to its last; a missing value is null."""

    @classmethod
    def name(cls) -> str:
        return "dayfiles"

    def schema(self) -> str:
        fields = [f for f in self.options.get("fields", ",".join(FIELDS)).split(",") if f]
        return ", ".join(["ticker string", "date date", *(f"`{f}` double" for f in fields)])

    def reader(self, schema) -> DayFileReader:
        return DayFileReader(self.options)


def read(spark: SparkSession, path: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    spark.dataSource.register(DayFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("dayfiles").option("fields", ",".join(fields)).load(path)


def write(frame: DataFrame, path: str, fields: Sequence[str] = FIELDS) -> int:
    """frame (ticker, date, fields) as day files; the number of files. A ticker is a task's group: a value a day.

    The calendar has the frame's days, a row a date. A file is written under another name and then renamed, so a task that runs twice leaves whole files.
    """
    days = [r.date for r in frame.select("date").distinct().orderBy("date").collect()]
    system, root = _place(path)
    system.create_dir(f"{root}/calendars")
    with system.open_output_stream(f"{root}/calendars/day.txt") as file:
        file.write("".join(f"{d.isoformat()}\n" for d in days).encode())
    fields = list(fields)

    def one(part: pa.Table) -> pa.Table:
        own, place = part.to_pandas().sort_values("date"), {d: i for i, d in enumerate(days)}
        ticker, at = str(own["ticker"].iloc[0]), np.array([place[d] for d in own["date"]])
        folder, files = f"{_place(path)[1]}/features/{ticker.lower()}", _place(path)[0]
        files.create_dir(folder)
        for field in fields:
            values = np.full(at[-1] - at[0] + 1, np.nan, "<f4")
            values[at - at[0]] = own[field].to_numpy(float)
            draft = f"{folder}/{field}.{id(values):x}.draft"
            with files.open_output_stream(draft) as file:
                file.write(np.concatenate([np.array([at[0]], "<f4"), values]).tobytes())
            files.move(draft, f"{folder}/{field}.day.bin")
        return pa.table({"n": pa.array([len(fields)], pa.int64())})

    return frame.select(
        "ticker", "date", *[F.col(f).cast("double").alias(f) for f in fields]
    ).groupBy("ticker").applyInArrow(one, "n long").agg(F.sum("n")).first()[0] or 0
