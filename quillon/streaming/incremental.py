"""Bars that come as a stream: trades to bars by watermark, and bars into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources import bars as source
from quillon.sources import store


def bars_of_trades(trades: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """ticker, date, open, high, low, close, volume of a stream of trades (ticker, ts, price, quantity); a bar is final once the watermark has passed."""
    at = F.struct("ts", "price")
    window = trades.withWatermark("ts", late).groupBy("ticker", F.window("ts", width).alias("w"))
    out = window.agg(
        F.min(at).alias("first"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max(at).alias("last"),
        F.sum("quantity").alias("volume"),
    )
    return out.select(
        "ticker",
        F.col("w.start").cast("date").alias("date"),
        F.col("first.price").alias("open"),
        "high",
        "low",
        F.col("last.price").alias("close"),
        F.col("volume").cast("double").alias("volume"),
    )


def upsert(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merges each batch of bars into the store at path; the folders of its tickers are replaced, so a batch that runs again gives the same."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.select(*source.BARS.names)
        tickers = [r.ticker for r in batch.select("ticker").distinct().collect()]
        if not tickers:
            return
        try:
            old = source.read_store(spark, path, tickers)
            old.limit(1).count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = spark.createDataFrame([], source.BARS)
        store.replace_tickers(source.merged(old, batch), path)

    return stream.writeStream.foreachBatch(merge).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
