"""Tables kept from run to run: a bar store that is refreshed, a log of failures, profiles that are looked up once, a manifest, a snapshot cache."""

from __future__ import annotations

import hashlib
import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.rolling import true
from quillon.sources import bars as source

SCHEMA_VERSION = 1


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


#: A lock that is older than this many seconds is that of a run that died.
STALE_LOCK = 3600.0


def _create_alone(spark: SparkSession, path: str, text: str) -> bool:
    """Creates the file unless it is there already: one of several callers does."""
    fs, p = _file_system(spark, path)
    if fs.getUri().getScheme() == "file":
        try:
            os.makedirs(os.path.dirname(p.toUri().getPath()), exist_ok=True)
            handle = os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        os.write(handle, text.encode())
        os.close(handle)
        return True
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


@contextmanager
def locked(
    spark: SparkSession, path: str, patience: float = 600.0, stale: float = STALE_LOCK, pause: float = 0.2
) -> Iterator[None]:
    """One writer of a store at a time, by a file that is created exclusively. Waits for at most ``patience`` seconds.

    A lock older than ``stale`` is put aside by a rename, which one of those that wait can do. What a writer that died left half done is finished first.
    """
    lock, began = f"{path}.lock", time.time()
    while not _create_alone(spark, lock, f"{os.getpid()} {time.time()}"):
        fs, p = _file_system(spark, lock)
        try:
            old = time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > stale
            if old:
                aside = spark._jvm.org.apache.hadoop.fs.Path(f"{lock}-{uuid.uuid4().hex}")
                if fs.rename(p, aside):
                    fs.delete(aside, False)
                continue
        except Exception as e:
            if "FileNotFound" not in str(e):
                raise
            continue
        if time.time() - began > patience:
            raise TimeoutError(f"another run holds {lock}")
        time.sleep(pause)
    try:
        recover(spark, path)
        yield
    finally:
        fs, p = _file_system(spark, lock)
        fs.delete(p, False)


def _staged(spark: SparkSession, path: str) -> list[str]:
    fs, p = _file_system(spark, path)
    parent = p.getParent()
    if not fs.exists(parent):
        return []
    return sorted(
        str(s.getPath()) for s in fs.listStatus(parent) if s.getPath().getName().startswith(f"{p.getName()}.staged-")
    )


def recover(spark: SparkSession, path: str) -> None:
    """Finishes what a writer had staged in whole, and deletes what it hadn't. Under the store's lock only."""
    for staged in _staged(spark, path):
        if _exists(spark, f"{staged}/complete"):
            _put_in_place(spark, path, staged)
        else:
            fs, p = _file_system(spark, staged)
            fs.delete(p, True)


def _put_in_place(spark: SparkSession, path: str, staged: str) -> None:
    """Takes each staged ticker's folder into the store by renames, and then their checksums. May be begun again at any step.

    The old folder is moved into the staged one and deleted with it at the end, so it is there until the new one is.
    """
    new = spark._jvm.org.apache.hadoop.fs.Path
    fs, p = _file_system(spark, path)
    fs.mkdirs(p)
    fs.mkdirs(new(f"{staged}/old"))
    rows = new(f"{staged}/rows")
    for status in fs.listStatus(rows) if fs.exists(rows) else []:
        name = status.getPath().getName()
        if not name.startswith("ticker="):
            continue
        live = new(p, name)
        if fs.exists(live):
            _moved(fs, live, new(f"{staged}/old/{name}"))
        _moved(fs, status.getPath(), live)
    _note(spark.read.parquet(f"{staged}/sums"), path)
    fs.delete(new(staged), True)


def _moved(fs, source_path, target) -> None:
    if not fs.rename(source_path, target):
        raise OSError(f"{source_path} can't be moved")


def _note(sums: DataFrame, path: str) -> None:
    sums.write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("ticker").parquet(f"{path}.checksums")


def replace_tickers(frame: DataFrame, path: str) -> None:
    """The store's folders of frame's tickers become frame's rows, and their checksums are noted; all other folders stay. Under the store's lock.

    frame may read the store. Rows and checksums are staged first, and a mark is set when they are whole: from then on a run that dies here is
    finished by the next, before that it has changed nothing.
    """
    spark, staged = frame.sparkSession, f"{path}.staged-{uuid.uuid4().hex}"
    try:
        source.write_store(frame, f"{staged}/rows")
        source.checksums(source.read_store(spark, f"{staged}/rows")).write.parquet(f"{staged}/sums")
    except BaseException:
        fs, p = _file_system(spark, staged)
        fs.delete(p, True)
        raise
    _create_alone(spark, f"{staged}/complete", "")
    _put_in_place(spark, path, staged)


def corrupt(spark: SparkSession, path: str, tickers: list[str]) -> list[str]:
    """The tickers whose rows aren't what was written last: broken files, lost or altered rows. Stores without checksums are taken as they are."""
    if not _exists(spark, f"{path}.checksums"):
        return []
    noted = spark.read.schema("ticker string, n long, digest string").parquet(f"{path}.checksums").where(
        F.col("ticker").isin(tickers)
    )
    found = source.checksums(source.read_store(spark, path, tickers)).select(
        "ticker", F.col("n").alias("own_n"), F.col("digest").alias("own")
    )
    same = F.col("digest").isNull() | true((F.col("own_n") == F.col("n")) & (F.col("own") == F.col("digest")))
    return sorted(r.ticker for r in noted.join(found, "ticker", "left").where(~same).select("ticker").collect())


def quarantine(spark: SparkSession, path: str, tickers: list[str]) -> list[str]:
    """Moves the folders of these tickers out of the store; returns where they are."""
    moved = []
    for ticker in tickers:
        to = f"{path}.quarantine/{ticker}-{uuid.uuid4().hex}"
        fs, p = _file_system(spark, f"{path}/ticker={ticker}")
        target = spark._jvm.org.apache.hadoop.fs.Path(to)
        fs.mkdirs(target.getParent())
        if fs.exists(p) and fs.rename(p, target):
            moved.append(to)
    return moved


def refresh(
    spark: SparkSession,
    path: str,
    tickers: list[str],
    start: str,
    end: str,
    fetch: Callable[[DataFrame], DataFrame],
    tail_days: int = 0,
    force: bool = False,
) -> DataFrame:
    """Fetches what the store lacks of [start, end] and merges it; bars that are there are never lost. Returns ticker, status, n.

    fetch takes gaps (ticker, gap_start, gap_end) and returns bars. A ticker of which nothing came for a gap is ``failed``, one without
    a gap is ``skipped``. Only folders of tickers that got bars are written. The last ``tail_days`` before end are fetched again; with ``force``,
    all of the range is, and takes the place of what was there. Tickers whose checksum doesn't fit are put aside and fetched anew. Of two
    refreshes of a store at once, one waits for the other.
    """
    with locked(spark, path):
        return _refreshed(spark, path, tickers, start, end, fetch, tail_days, force)


def _refreshed(
    spark: SparkSession,
    path: str,
    tickers: list[str],
    start: str,
    end: str,
    fetch: Callable[[DataFrame], DataFrame],
    tail_days: int,
    force: bool,
) -> DataFrame:
    wanted = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    there = _exists(spark, path)
    broken = corrupt(spark, path, tickers) if there else []
    quarantine(spark, path, broken)
    old = source.read_store(spark, path, tickers) if there and not force else spark.createDataFrame([], source.BARS)
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    known = source.refresh_gaps(old, start, end).select("ticker", "gap_start", "gap_end")
    fresh = wanted.join(old.select("ticker").distinct(), "ticker", "left_anti").select(
        "ticker", low.alias("gap_start"), high.alias("gap_end")
    )
    gaps = fresh.unionByName(known)
    if tail_days:
        tail = wanted.join(old.select("ticker").distinct(), "ticker", "left_semi")
        gaps = gaps.unionByName(
            tail.select(
                "ticker", F.greatest(low, F.date_sub(high, tail_days)).alias("gap_start"), high.alias("gap_end")
            )
        )
    gaps = gaps.cache()
    new = fetch(gaps).select(*source.BARS.names).where("close is not null").cache()
    try:
        came = {r.ticker: r.n for r in new.groupBy("ticker").agg(F.count("*").alias("n")).collect()}
        asked = {r.ticker for r in gaps.select("ticker").distinct().collect()}
        if came:
            touched = old.where(F.col("ticker").isin(list(came)))
            replace_tickers(source.merged(touched, new), path)
    finally:
        gaps.unpersist()
        new.unpersist()
    status = [(t, "fetched" if came.get(t) else "failed" if t in asked else "skipped", came.get(t, 0)) for t in tickers]
    return spark.createDataFrame(status, "ticker string, status string, n long")


def download(
    spark: SparkSession,
    path: str,
    tickers: list[str],
    start: str,
    end: str,
    fetch: Callable[[DataFrame], DataFrame],
    least_share: float = 0.8,
    summary: str | None = None,
    tail_days: int = 0,
    force: bool = False,
) -> dict:
    """A refresh of a universe with its coverage gate, and what it did: as a dictionary, and as JSON in the file ``summary``.

    max(3, ceil(tickers x least_share)) of the tickers must have bars in [start, end] afterwards; fewer are an error that names the others.
    """
    status = refresh(spark, path, tickers, start, end, fetch, tail_days, force).collect()
    held = source.within(source.read_store(spark, path, tickers), start, end) if _exists(spark, path) else None
    there = {
        r.ticker: r.n for r in held.groupBy("ticker").agg(F.count("*").alias("n")).collect()
    } if held is not None else {}
    failures = sorted(t for t in tickers if t not in there)
    least = max(3, math.ceil(len(tickers) * least_share))
    if len(there) < least:
        raise RuntimeError(
            f"only {len(there)} of {len(tickers)} tickers have bars, {least} are needed; none of {failures}"
        )
    own = {r.ticker: {"status": r.status, "fetched_rows": r.n, "rows": there.get(r.ticker, 0)} for r in status}
    found = {
        "start": start,
        "end": end,
        "cache_hits": sum(r.status == "skipped" for r in status),
        "remote_fetches": sum(r.status == "fetched" for r in status),
        "tickers": own,
        "failures": failures,
    }
    if summary:
        draft = Path(f"{summary}.draft")
        draft.parent.mkdir(parents=True, exist_ok=True)
        draft.write_text(json.dumps(found, indent=2, sort_keys=True))
        os.replace(draft, summary)
    return found


def load(spark: SparkSession, path: str, tickers: list[str], start: str, end: str) -> DataFrame:
    """The bars of [start, end) of all tickers, without a provider. A ticker that is missing, broken or without bars in the range is an error."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no store at {path}: run a refresh first")
    if _staged(spark, path):
        with locked(spark, path):
            pass
    if broken := corrupt(spark, path, tickers):
        raise ValueError(f"the checksums of {broken} don't fit: refresh them by force")
    out = source.within(source.read_store(spark, path, tickers), start, end, half_open=True)
    if missing := sorted(set(tickers) - {r.ticker for r in out.select("ticker").distinct().collect()}):
        raise ValueError(f"the store has no bars of {missing} from {start} to {end}")
    return out


def record_failures(status: DataFrame, path: str, reason: str) -> None:
    """Appends failed tickers to a log."""
    status.where("status = 'failed'").select(
        "ticker", F.lit(reason).alias("reason"), F.current_timestamp().alias("at")
    ).write.mode("append").csv(path, header=True)


def enrich(
    spark: SparkSession, path: str, symbols: DataFrame, look_up: Callable[[DataFrame], DataFrame], flush: int = 25
) -> DataFrame:
    """The profiles of all symbols (ticker); those that aren't in the table yet are looked up.

    Each ``flush`` of them are appended when they are there, so a run that broke goes on where it was. The listing of symbols (some thousands)
    is at the driver, as each look-up asks a provider.
    """
    pending = symbols.join(
        spark.read.parquet(path).select("ticker"), "ticker", "left_anti"
    ) if _exists(spark, path) else symbols
    rows = pending.orderBy("ticker").collect()
    for at in range(0, max(len(rows), 1), flush):
        look_up(spark.createDataFrame(rows[at : at + flush], symbols.schema)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def load_manifest(path: str) -> dict:
    file = Path(path)
    if not file.exists():
        return {"schema_version": SCHEMA_VERSION, "stages": {}}
    found = json.loads(file.read_text())
    if found.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"the manifest has version {found.get('schema_version')}, not {SCHEMA_VERSION}")
    return found


def record_stage(path: str, stage: str, at: float | None = None) -> dict:
    """Notes when a stage ran; the file is replaced as a whole."""
    found = load_manifest(path)
    found["stages"][stage] = at if at is not None else time.time()
    draft = Path(f"{path}.draft")
    draft.write_text(json.dumps(found, indent=2, sort_keys=True))
    os.replace(draft, path)
    return found


class SnapshotCache:
    """A listing kept for a time: validated, refused if it shrank too much, and used when stale if there is no new one."""

    def __init__(
        self,
        path: str,
        ttl: float = 86_400,
        least_rows: int = 1000,
        most_invalid: float = 0.10,
        most_shrink: float = 0.30,
    ):
        self.path, self.ttl, self.least_rows, self.most_invalid, self.most_shrink = Path(
            path
        ), ttl, least_rows, most_invalid, most_shrink

    @staticmethod
    def digest(rows: list[dict]) -> str:
        return hashlib.sha256(json.dumps(rows, sort_keys=True).encode()).hexdigest()

    def read(self) -> dict | None:
        try:
            found = json.loads(self.path.read_text())
        except (OSError, ValueError):
            return None
        return found if found.get("version") == SCHEMA_VERSION and found.get("sha256") == self.digest(found.get("rows", [])) else None

    def ensure(self, download: Callable[[], list[dict]], now: float | None = None, force: bool = False) -> dict:
        """The snapshot with ``stale``. Without a valid one, a failed download is an error."""
        now, old = time.time() if now is None else now, self.read()
        if old and not force and now - old["at"] < self.ttl:
            return old | {"stale": False}
        try:
            rows = download()
            good = [r for r in rows if str(r.get("symbol", "")).strip()]
            if len(rows) < self.least_rows or len(good) < (1 - self.most_invalid) * len(rows):
                raise ValueError("the download is too small or has too many invalid rows")
            if old and len(good) < (1 - self.most_shrink) * len(old["rows"]):
                raise ValueError("the download shrank too much")
        except Exception:
            if old is None:
                raise
            return old | {"stale": True}
        new = {"version": SCHEMA_VERSION, "at": now, "rows": good, "sha256": self.digest(good)}
        draft = self.path.with_suffix(".draft")
        draft.write_text(json.dumps(new))
        os.replace(draft, self.path)
        return new | {"stale": False}


def industries(path: str) -> dict[str, list[str]]:
    """A catalogue of universes by name, from YAML or JSON."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def pool(spark: SparkSession, path: str) -> DataFrame:
    """ticker, place of a text file with tabs: the first field of each line, each once, in order."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    rows = lines.select(F.upper(F.trim(F.split("value", "\t")[0])).alias("ticker"), "n").where("ticker <> ''")
    return rows.groupBy("ticker").agg(F.min("n").alias("place"))
