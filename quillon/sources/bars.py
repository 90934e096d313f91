"""Price bars: readers, cleaning, the view of the test tables as bars, and the dense panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.digest import multiset_digest, row_digest

BARS = T.StructType(
    [
        T.StructField("ticker", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
REQUIRED = ("date", "open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades: ticker is the customer's nation, cluster its region, date the week of shipping.

    Orders meet their customers first, so line items are shuffled once, with the nation's number and no names, and only with the columns that are asked for.
    """
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_shipdate",
        F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    # 25 nations and 5 regions at any scale factor
    nation = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", F.col("n_name").alias("ticker"), F.col("r_name").alias("cluster"))
    full = line.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(
        F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return full.select(
        "ticker",
        "cluster",
        "date",
        F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("quantity"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at"),
    )


def _total() -> Column:
    return F.sum(F.col("amount").cast("decimal(18,2)"))


def _bar_columns() -> list[Column]:
    price = F.col("amount") / F.col("quantity")
    return [
        F.min_by(price, "at").alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        (_total().cast("double") / F.sum("quantity")).alias("close"),
        F.sum("quantity").alias("volume"),
    ]


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars with amount, the exact sum of their trades. Without open, each task's sums are kept by hash; open needs them sorted."""
    return trades(spark, sf_dir).groupBy("ticker", "cluster", "date").agg(*_bar_columns(), _total().alias("amount"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, cluster, date, open, high, low, close, volume."""
    return totals(spark, sf_dir).drop("amount")


def market_of(sums: DataFrame) -> DataFrame:
    """The benchmark of bars with amount, so that trades aren't read again: date, market, the close of all trades together."""
    return sums.groupBy("date").agg((F.sum("amount").cast("double") / F.sum("volume")).alias("market"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark: date, market, the close of all trades together."""
    return market_of(totals(spark, sf_dir))


def as_of(frame: DataFrame, cutoff: str) -> DataFrame:
    """Rows up to the cutoff, at the scan, before any window."""
    return frame.where(F.col("date") <= F.lit(cutoff).cast("date"))


def within(frame: DataFrame, start: str, end: str, half_open: bool = False) -> DataFrame:
    day, a, b = F.col("date"), F.lit(start).cast("date"), F.lit(end).cast("date")
    return frame.where((day >= a) & ((day < b) if half_open else (day <= b)))


def panel(
    frame: DataFrame, keep: tuple[str, ...] = ("cluster",), values: tuple[str, ...] = ("close", "volume")
) -> DataFrame:
    """Every ticker on every date of the table; values are null where there is no bar. The calendar is one row of dates."""
    calendar = frame.agg(F.array_sort(F.collect_set("date")).alias("dates"))
    tickers = frame.select("ticker", *keep).distinct()
    grid = tickers.join(F.broadcast(calendar)).select("ticker", *keep, F.explode("dates").alias("date"))
    return grid.join(frame.select("ticker", "date", *values), ["ticker", "date"], "left")


def available(frame: DataFrame, least: int) -> DataFrame:
    """Tickers with so many closes: ticker, n."""
    return frame.groupBy("ticker").agg(F.count("close").alias("n")).where(F.col("n") >= least)


def coverage_gate(frame: DataFrame, requested: int, least_rows: int, least_share: float) -> DataFrame:
    """Tickers with enough rows and those without, and whether max(3, ceil(requested x share)) of them have enough."""
    own = frame.groupBy("ticker").agg(F.count("close").alias("n")).withColumn("enough", F.col("n") >= least_rows)
    total = own.agg(F.count_if("enough").alias("usable"))
    return own.join(F.broadcast(total)).withColumn(
        "gate", F.col("usable") >= F.greatest(F.lit(3), F.ceil(F.lit(requested * least_share)))
    )


def cleaned(raw: DataFrame) -> DataFrame:
    """Any frame with bar columns in any case as bars: numbers by try_cast, days by date, no null close, the last row of a day kept.

    A column ``seq``, if there is one, says which row is last.
    """
    low = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if missing := [c for c in ("ticker", *REQUIRED) if c not in low.columns]:
        raise ValueError(f"missing columns: {missing}")
    number = [F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in REQUIRED[1:]]
    seq = F.col("seq") if "seq" in low.columns else F.lit(0)
    rows = low.select(
        F.upper(F.trim("ticker")).alias("ticker"), F.to_date("date").alias("date"), *number, seq.alias("seq")
    ).where("close is not null")
    return keep_last(rows, ["ticker", "date"], "seq").drop("seq")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key. The aggregate combines before the shuffle, so a hot key costs a row for each task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(
        F.max(F.struct(F.col(order).alias("__o"), *[F.col(c) for c in rest])).alias("r")
    ).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def merged(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both tables' bars; where both have a day, the incoming one."""
    both = existing.select(*BARS.names, F.lit(0).alias("seq")).unionByName(
        incoming.select(*BARS.names, F.lit(1).alias("seq"))
    )
    return keep_last(both, ["ticker", "date"], "seq").select(*BARS.names)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Long CSV of date, ticker, close, volume. A ticker and date that occur twice are an error."""
    rows = spark.read.csv(path, header=True)
    if missing := {"date", "ticker", "close", "volume"} - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    out = rows.select(
        F.upper("ticker").alias("ticker"),
        F.to_date("date").alias("date"),
        F.col("close").cast("double").alias("close"),
        F.col("volume").cast("double").alias("volume"),
    )
    if out.groupBy("ticker", "date").count().where("count > 1").limit(1).count():
        raise ValueError("a ticker has a date twice")
    return out


def write_store(frame: DataFrame, path: str) -> None:
    """A folder for each ticker; only those that frame has are replaced."""
    frame.repartition("ticker").sortWithinPartitions("date").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("ticker").parquet(path)


def read_store(
    spark: SparkSession, path: str, tickers: list[str] | None = None, cutoff: str | None = None
) -> DataFrame:
    """Bars of a store; tickers prune folders and the cutoff is pushed to the scan. Corrupt files count as absent; ``store.corrupt`` names their tickers."""
    out = spark.read.schema(BARS).option("ignoreCorruptFiles", True).parquet(path)
    out = out.where(F.col("ticker").isin(tickers)) if tickers else out
    return as_of(out, cutoff) if cutoff else out


def refresh_gaps(frame: DataFrame, start: str, end: str) -> DataFrame:
    """What a store lacks of [start, end]: ticker, gap (leading or forward), gap_start, gap_end."""
    own = frame.groupBy("ticker").agg(F.min("date").alias("low"), F.max("date").alias("high"))
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    gaps = F.array(
        F.struct(F.lit("leading").alias("gap"), a.alias("gap_start"), F.date_sub("low", 1).alias("gap_end")),
        F.struct(F.lit("forward").alias("gap"), F.date_add("high", 1).alias("gap_start"), b.alias("gap_end")),
    )
    return own.select("ticker", F.explode(gaps).alias("g")).select("ticker", "g.*").where("gap_start <= gap_end")


def checksums(frame: DataFrame) -> DataFrame:
    """Each ticker's rows (n) and the digest of all their values, in any order of rows; added up before the shuffle."""
    own = frame.select("ticker", row_digest(*[F.col(c) for c in BARS.names[1:]]).alias("row"))
    return own.groupBy("ticker").agg(F.count("*").alias("n"), multiset_digest(F.col("row")).alias("digest"))


def validated(frame: DataFrame, tickers: list[str], least: int = 200) -> DataFrame:
    """frame, or an error: of tickers without a close, a ticker's day that occurs twice, days that go back in file order (``seq``, if there is one), or fewer than ``least`` days in all."""
    own = frame.where(F.col("ticker").isin(tickers))
    known = {r.ticker for r in own.where("close is not null").select("ticker").distinct().collect()}
    if missing := sorted(set(tickers) - known):
        raise ValueError(f"no prices of {missing}")
    if own.groupBy("ticker", "date").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a ticker has a date twice")
    if "seq" in frame.columns:
        before = F.lag("date").over(Window.partitionBy("ticker").orderBy("seq"))
        if own.withColumn("back", F.col("date") < before).where("back").limit(1).count():
            raise ValueError("dates must rise")
    if (days := own.select("date").distinct().count()) < least:
        raise ValueError(f"at least {least} days are needed, there are {days}")
    return frame


def close_panel(frame: DataFrame, tickers: list[str]) -> DataFrame:
    """Closes as a wide table, for export of a few tickers."""
    return frame.where(F.col("ticker").isin(tickers)).groupBy("date").pivot("ticker", tickers).agg(F.first("close"))


def ordered(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    return rows.withColumn(
        "__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(value).desc()))
    ).where(F.col("__n") <= n).drop("__n")
