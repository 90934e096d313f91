"""Tables that a plan writes for itself, in the shared folder that the cluster names in spark.checkpoint.dir: lineage ends there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written so far by this driver and not deleted yet.
_made: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder. Where it is unset, a cluster is an error; a master of one machine, as in tests, gets a folder that goes with the driver."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own, so that what comes after it reads it and doesn't make it again."""
    path = f"{root(df.sparkSession)}/quillon-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes the written tables that these read; for tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables that were written within it: a plan's results read some of them, so the caller writes the results within this."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            _delete(spark, path)
        del _made[before:]
