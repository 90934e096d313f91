"""Universes of tickers: cleaning of listings, themes, reasons, membership over time."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.digest import multiset_digest, row_digest
from quillon.functions.rolling import true

#: Marks of securities that are no common stock, of derivatives, exchange codes, patterns of symbols, columns of a membership manifest.
NOT_COMMON = r"(?i)\b(warrants?|rights?|units?|preferred|preference|bonds?|debentures?)\b|\bnotes due\b"
DERIVATIVE = r"(?i)\b(warrant|right|unit|preferred|notes\s+due)s?\b"
EXCHANGES = {"A": "NYSE MKT", "N": "NYSE", "P": "NYSE ARCA", "Z": "BATS", "V": "IEX"}
EXPORTED, LISTED = r"^[A-Z][A-Z0-9.^/-]{0,14}$", r"^[A-Za-z0-9.\-]{1,15}$"
MANIFEST = (
    "symbol",
    "name",
    "sector",
    "industry",
    "country",
    "ipo_year",
    "market_cap",
    "discovered_at",
    "effective_from",
    "last_seen",
    "active",
    "source",
)
#: A screen needs so many tickers.
LEAST_TICKERS = 3


def money(x: Column) -> Column:
    """A number out of text such as $1,234.50; null for anything else and for negatives."""
    value = F.regexp_replace(x, r"[$,\s]", "").try_cast("double")
    return F.when(value >= 0, value)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def renamed_header(raw: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Column names in lower case with underscores, and by alias."""
    names = [re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") for c in raw.columns]
    return raw.toDF(*[(aliases or {}).get(n, n) for n in names])


def _text(name: str) -> Column:
    return F.trim(F.coalesce(name, F.lit("")))


def normalised(raw: DataFrame) -> DataFrame:
    """symbol, name, industry, sector, country, market_cap, eligible of a screener export, a row a symbol: that of the largest cap.

    Rows with an odd symbol or without a name go; / and . in a symbol become -. Eligible: the name has no mark of another security as a word, so
    depositary shares are. No cap and a cap of zero count alike.
    """
    own = F.upper(_text("symbol"))
    rows = raw.select(
        own.alias("own"),
        *[_text(c).alias(c) for c in ("name", "industry", "sector", "country")],
        money(F.col("market_cap").cast("string")).alias("market_cap"),
    )
    rows = rows.where(F.col("own").rlike(EXPORTED) & (F.col("name") != "")).withColumn(
        "symbol", F.translate("own", "/.", "--")
    )
    rest = ("name", "industry", "sector", "country", "market_cap")
    size = F.coalesce(F.nullif(F.col("market_cap"), F.lit(0.0)), F.lit(-1.0)).alias("k")
    best = rows.groupBy("symbol").agg(F.max(F.struct(size, *rest)).alias("r")).select(
        "symbol", *[F.col(f"r.{c}").alias(c) for c in rest]
    )
    return best.withColumn("eligible", ~F.col("name").rlike(NOT_COMMON))


def checked_export(raw: DataFrame, least_rows: int = 1000, most_invalid: float = 0.10) -> DataFrame:
    """raw, or an error if it is too small or too many of its rows have an odd symbol or no name."""
    good = F.upper(_text("symbol")).rlike(EXPORTED) & (_text("name") != "")
    seen = raw.agg(F.count("*").alias("n"), F.count_if(~good).alias("invalid")).first()
    if seen.n < least_rows:
        raise ValueError(f"the export has only {seen.n} rows")
    if seen.invalid > most_invalid * seen.n:
        raise ValueError(f"{seen.invalid} of {seen.n} rows of the export are invalid")
    return raw


def industries(rows: DataFrame) -> DataFrame:
    """industry, n: eligible symbols of each that has a name."""
    return rows.where("eligible and industry <> ''").groupBy("industry").agg(F.count("*").alias("n"))


def by_industry(rows: DataFrame, wanted: str, most: int | None = None, least: int = LEAST_TICKERS) -> DataFrame:
    """Eligible symbols whose industry's slug holds that of ``wanted``, by cap and symbol; fewer than ``least`` are an error."""
    text = re.sub(r"[^a-z0-9]+", "-", wanted.strip().lower()).strip("-")
    found = rows.where(F.col("eligible") & F.contains(slug(F.col("industry")), F.lit(text)))
    out = found.orderBy(F.desc(F.coalesce(F.nullif(F.col("market_cap"), F.lit(0.0)), F.lit(-1.0))), "symbol")
    out = out.limit(most) if most else out
    if out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} symbols for {wanted}")
    return out


def screened(
    rows: DataFrame,
    industries: list[str] | None,
    countries: list[str] | None = None,
    sector: str | None = None,
    least_cap: float = 0.0,
    excluded: tuple[str, ...] = ("warrant", "right", "unit", "preferred"),
    top: int | None = None,
) -> DataFrame:
    """The rows of an export that a group takes, the largest first: each symbol's first row that passes.

    Industry, sector and country are compared without case, none of them if not given; what is no number is no cap, 0. A column ``place`` says
    which row is first.
    """
    cap = F.coalesce(money(F.col("market_cap").cast("string")), F.lit(0.0))
    clean = rows.withColumns(
        {"symbol": F.upper(_text("symbol")), "market_cap": cap}
        | {c: _text(c) for c in ("name", "industry", "sector", "country")}
    )
    keep = (F.col("symbol") != "") & (F.col("market_cap") >= least_cap)
    if industries:
        keep = keep & F.lower("industry").isin([i.lower() for i in industries])
    if countries:
        keep = keep & F.lower("country").isin([c.lower() for c in countries])
    if sector:
        keep = keep & (F.lower("sector") == sector.lower())
    for word in excluded:
        keep = keep & ~F.contains(F.lower("name"), F.lit(word.lower()))
    passed = clean.where(true(keep))
    rest = [c for c in passed.columns if c not in ("symbol", "place")]
    place = F.col("place") if "place" in rows.columns else F.monotonically_increasing_id()
    first = passed.withColumn("place", place).groupBy("symbol").agg(
        F.min(F.struct("place", *rest)).alias("r")
    ).select("symbol", *[F.col(f"r.{c}").alias(c) for c in rest])
    return first.orderBy(F.desc("market_cap"), "symbol").limit(top) if top else first


def themes(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The themes of which a keyword, also with a plural s, stands in the text as words."""
    found = [
        F.when(F.lower(text).rlike("|".join(rf"\b{re.escape(k.lower())}s?\b" for k in words)), F.lit(theme))
        for theme, words in sorted(keywords.items())
    ]
    return F.array_compact(F.array(*found))


def in_scope(industry: Column, found: Column, allowed: list[str]) -> Column:
    return true(industry.isin(allowed)) | (F.size(found) > 0)


def candidates(
    symbols: DataFrame, keywords: dict[str, list[str]], seed_etfs: list[str], seed_tickers: list[str]
) -> DataFrame:
    """Symbols (ticker, name, etf) worth looking up: seed ETFs, then no other ETF, no derivative, and of the rest seeds and such with a keyword."""
    derivative = F.col("name").rlike(DERIVATIVE)
    keep = F.when(F.col("ticker").isin(seed_etfs), True).when(F.col("etf"), False).when(derivative, False).when(
        F.col("ticker").isin(seed_tickers), True
    ).otherwise(F.size(themes(F.col("name"), keywords)) > 0)
    return symbols.where(true(keep))


def listed(
    lines: DataFrame, symbol: str = "Symbol", name: str = "Security Name", exchange: str | None = None
) -> DataFrame:
    """ticker, name, exchange, etf of a pipe table read with its header: without footer, test issues and odd symbols; the first row of each.

    exchange names the column of exchange codes; a table without one is that of NASDAQ. A column ``place`` says which row is first, else
    the order of the file does.
    """
    names = F.create_map(*[F.lit(x) for pair in EXCHANGES.items() for x in pair])
    market = F.coalesce(names[F.trim(exchange)], F.lit("OTHER")) if exchange else F.lit("NASDAQ")
    place = F.col("place") if "place" in lines.columns else F.monotonically_increasing_id()
    rows = lines.withColumn("place", place).where(
        ~F.startswith(F.col(symbol), F.lit("File Creation Time")) & (F.col("Test Issue") == "N")
    )
    own = rows.select(
        "place",
        F.trim(symbol).alias("ticker"),
        F.trim(name).alias("name"),
        market.alias("exchange"),
        F.coalesce(F.trim("ETF") == "Y", F.lit(False)).alias("etf"),
    )
    first = own.where(F.col("ticker").rlike(LISTED)).groupBy("ticker").agg(
        F.min(F.struct("place", "name", "exchange", "etf")).alias("r")
    )
    return first.select("ticker", "r.name", "r.exchange", "r.etf")


def all_listed(nasdaq: DataFrame, other: DataFrame) -> DataFrame:
    """The symbols of both listing files; where both have one, NASDAQ's row."""
    own, more = listed(nasdaq), listed(other, "ACT Symbol", "Security Name", "Exchange")
    return own.unionByName(more.join(own.select("ticker"), "ticker", "left_anti"))


def liquidity(bars: DataFrame, n: int = 60) -> DataFrame:
    """ticker, median_dollar_volume of the last n bars, last_close, history_days."""
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    rows = bars.withColumn("k", k)
    return rows.groupBy("ticker").agg(
        F.median(F.when(F.col("k") <= n, F.col("close") * F.col("volume"))).alias("median_dollar_volume"),
        F.max_by("close", "date").alias("last_close"),
        F.count("close").alias("history_days"),
    )


def _printed(x: Column, digits: int) -> Column:
    """x with so many decimals, by its exact binary value and ties to even, as C and Python print it. format_string rounds the shortest decimal form, ties up."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def with_reasons(
    rows: DataFrame, scope: Column, least_price: float = 2.0, least_dollars: float = 5e6, least_days: int = 250
) -> DataFrame:
    """rows with included, and reason: all that speaks against each, with what was measured."""
    days, price, dollars = F.coalesce("history_days", F.lit(0)), F.coalesce("last_close", F.lit(0.0)), F.coalesce(
        "median_dollar_volume", F.lit(0.0)
    )
    no = [
        F.when(~true(scope), "off theme"),
        F.when(days < least_days, F.format_string("insufficient history (%dd)", days)),
        F.when(price < least_price, F.format_string("price below floor (%s)", _printed(price, 2))),
        F.when(dollars < least_dollars, F.format_string("dollar_volume below floor (%s)", _printed(dollars, 0))),
    ]
    reasons = F.array_compact(F.array(*no))
    return rows.withColumns({"included": F.size(reasons) == 0, "reason": F.concat_ws("; ", reasons)})


def built(
    symbols: DataFrame,
    profiles: DataFrame,
    bars: DataFrame,
    keywords: dict[str, list[str]],
    allowed: list[str],
    least_price: float = 2.0,
    least_dollars: float = 5e6,
    least_days: int = 250,
    window: int = 60,
) -> DataFrame:
    """A row for each symbol: ticker, name, industry, themes, exchange, median_dollar_volume, last_close, history_days, included and reason.

    symbols (ticker, name, exchange) are joined with profiles (ticker, long_name, industry, summary), which may lack some, and with what the bars
    say of their liquidity; without bars that is 0. The profile's name goes before the listing's. Themes are looked for in name and summary. What is rejected
    stays, with all that speaks against it.
    """
    text = {c: F.coalesce(c, F.lit("")) for c in ("name", "exchange", "long_name", "industry", "summary")}
    known = symbols.select("ticker", "name", "exchange").join(
        profiles.select("ticker", "long_name", "industry", "summary"), "ticker", "left"
    ).withColumns(text)
    known = known.withColumn("name", F.when(F.col("long_name") != "", F.col("long_name")).otherwise(F.col("name")))
    stats = liquidity(bars, window)
    rows = known.join(stats, "ticker", "left").na.fill(
        0.0, ["median_dollar_volume", "last_close"]
    ).na.fill(0, ["history_days"])
    rows = rows.withColumn("found", themes(F.concat_ws(" ", "name", "summary"), keywords))
    rows = with_reasons(
        rows, in_scope(F.col("industry"), F.col("found"), allowed), least_price, least_dollars, least_days
    )
    return rows.select(
        "ticker",
        "name",
        "industry",
        F.concat_ws("|", "found").alias("themes"),
        "exchange",
        "median_dollar_volume",
        "last_close",
        "history_days",
        "included",
        "reason",
    )


def retention(old: DataFrame, new: DataFrame) -> DataFrame:
    """previous, retained, share: how many of the active symbols the new snapshot has."""
    seen = old.where("active").select("symbol").distinct().join(
        new.select("symbol").distinct().withColumn("kept", F.lit(1)), "symbol", "left"
    )
    return seen.agg(
        F.count("*").alias("previous"),
        F.count("kept").alias("retained"),
        F.try_divide(F.count("kept").cast("double"), F.count("*").cast("double")).alias("share"),
    )


def synced(old: DataFrame | None, new: DataFrame, day: str, bootstrap: str, source: str = "snapshot") -> DataFrame:
    """The manifest after a snapshot: new symbols come in, missing ones become inactive, all are kept.

    In the first snapshot a symbol is a member from the bootstrap date or its listing year on, the later; afterwards from the day it is seen.
    """
    now = F.lit(day).cast("date")
    start = F.greatest(
        F.lit(bootstrap).cast("date"),
        F.coalesce(
            F.make_date(F.col("ipo_year").cast("string").try_cast("int"), F.lit(1), F.lit(1)),
            F.lit(bootstrap).cast("date"),
        ),
    )
    attributes = ("name", "sector", "industry", "country", "ipo_year", "market_cap")
    if old is None:
        return new.select(
            "symbol",
            *attributes,
            now.alias("discovered_at"),
            start.alias("effective_from"),
            now.alias("last_seen"),
            F.lit(True).alias("active"),
            F.lit(source).alias("source"),
        )
    n = new.select("symbol", *[F.col(c).alias(f"n_{c}") for c in attributes], F.lit(True).alias("seen"))
    both = old.join(n, "symbol", "full")
    seen = true(F.col("seen"))
    return both.select(
        "symbol",
        *[F.when(seen, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in attributes],
        F.coalesce("discovered_at", now).alias("discovered_at"),
        F.coalesce("effective_from", now).alias("effective_from"),
        F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
        seen.alias("active"),
        F.coalesce("source", F.lit(source)).alias("source"),
    )


def resolved(
    base: DataFrame, include: list[str], exclude: list[str], most: int | None = None, least: int = LEAST_TICKERS
) -> DataFrame:
    """ticker, place: the base's tickers (ticker, place), then those to include, without those to exclude, each once, in order; fewer than ``least`` are an error."""
    more = base.sparkSession.createDataFrame(
        [(t.strip().upper(), (1 << 40) + i) for i, t in enumerate(include)], "ticker string, place long"
    )
    rows = base.select(
        F.upper(F.trim("ticker")).alias("ticker"), F.col("place").cast("long")
    ).unionByName(more).where(~F.col("ticker").isin([e.strip().upper() for e in exclude] or [""]))
    out = rows.groupBy("ticker").agg(F.min("place").alias("place"))
    out = out.withColumn("place", F.row_number().over(Window.orderBy("place")) - 1)
    out = out.where(F.col("place") < most) if most else out
    if out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} tickers")
    return out


def membership_hash(rows: DataFrame, keys: list[str] | None = None, symbol: str = "symbol") -> DataFrame:
    """The digest of a group's distinct symbols, whatever their order, and their number (n). Symbols are made distinct, then added up, both before the shuffle."""
    own = rows.select(*(keys or []), symbol).where(F.col(symbol).isNotNull()).distinct()
    return own.groupBy(*(keys or [])).agg(
        multiset_digest(row_digest(F.col(symbol))).alias("digest"), F.count("*").alias("n")
    )


def snapshot_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The rows of a screener's JSON answers: symbol, name, industry, sector, country, market_cap."""
    schema = "struct<data:struct<rows:array<struct<symbol:string,name:string,industry:string,sector:string,country:string,marketCap:string>>>,status:struct<rCode:int>>"
    rows = payloads.select(F.from_json(column, schema).alias("j")).where("j.status.rCode = 200").select(
        F.explode("j.data.rows").alias("r")
    )
    return rows.select(
        "r.symbol", "r.name", "r.industry", "r.sector", "r.country", F.col("r.marketCap").alias("market_cap")
    )
