"""Rolling windows that are null until full, and safe division."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker(key: str = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def by_date(order: str = "date") -> WindowSpec:
    """For series with one row a date: as many rows as there are dates, so one task is enough at any scale."""
    return Window.orderBy(order)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def roll(agg: Callable[[Column], Column], x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """agg of x over the last n rows; null unless ``least`` of them (all, if not given) have a value."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (least or n), agg(x).over(frame))


def sma(x: Column, w: WindowSpec, n: int) -> Column:
    return roll(F.avg, x, w, n)


def roll_std(x: Column, w: WindowSpec, n: int) -> Column:
    return roll(F.stddev_samp, x, w, n)


def roll_median(x: Column, w: WindowSpec, n: int) -> Column:
    return roll(lambda c: F.percentile(c, F.lit(0.5)), x, w, n)


def compound(x: Column, w: WindowSpec, n: int) -> Column:
    """The product of 1 + x over the last n rows, less 1."""
    return roll(lambda c: F.product(1 + c), x, w, n) - 1


def forward_compound(x: Column, w: WindowSpec, n: int) -> Column:
    """The product of 1 + x over the next n rows, less 1."""
    frame = w.rowsBetween(1, n)
    return F.when(F.count(x).over(frame) == n, F.product(1 + x).over(frame)) - 1


def change(x: Column, w: WindowSpec, n: int = 1) -> Column:
    """x by its value n rows before, less 1; gaps aren't filled."""
    return ratio(x, F.lag(x, n).over(w)) - 1


def padded(x: Column, w: WindowSpec, limit: int | None = None) -> Column:
    """x with gaps filled from before, over at most ``limit`` rows."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def true(condition: Column) -> Column:
    """The condition, false where it is null."""
    return F.coalesce(condition, F.lit(False))


def share(condition: Column, valid: Column) -> Column:
    """An aggregate: the share of rows with the condition among valid rows; null without any."""
    return ratio(F.count_if(true(condition) & true(valid)), F.count_if(true(valid)))


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))
