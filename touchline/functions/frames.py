"""Bounded window frames over an instrument's candles."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def order() -> WindowSpec:
    return Window.partitionBy("instrument").orderBy("bar_idx")


def last(n: int) -> WindowSpec:
    return order().rowsBetween(-(n - 1), 0)


def rolling(value: Column, n: int, least: int | None = None) -> Column:
    """The mean of the last ``n`` values; null before ``least`` (all ``n`` unless given) values were seen."""
    return F.when(F.count(value).over(last(n)) >= (least or n), F.avg(value).over(last(n)))


def back_fill(value: Column) -> Column:
    """The next value that is not null. The rows are taken backwards: a frame that only grows costs each row once."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("instrument").orderBy(F.desc("bar_idx")).rowsBetween(Window.unboundedPreceding, 0))


def forward_fill(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0; a null stays null."""
    return F.when(b == 0, F.when(a.isNotNull(), 0.0)).otherwise(F.try_divide(a, b))
