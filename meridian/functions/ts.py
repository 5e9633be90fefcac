"""Time-series columns per code, on a dense grid.

A panel has one row for every (calendar ordinal ``di``, ``code``), so a lag of k rows
is a lag of k calendar steps. All helpers share one window specification per code, so
Catalyst plans a single exchange and sort for any number of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_code() -> WindowSpec:
    """Rows of a code by day."""
    return Window.partitionBy("code").orderBy("di")


def shift(x: Column | str, k: int) -> Column:
    """The value k calendar rows ago; ahead for negative k."""
    return F.lag(x, k).over(by_code()) if k >= 0 else F.lead(x, -k).over(by_code())


def rolling(how: Callable[[Column], Column], x: Column, n: int, min_periods: int) -> Column:
    """``how`` over the last n rows, nulls skipped; null with fewer than ``min_periods`` values."""
    frame = by_code().rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= min_periods, how(x).over(frame))


def rolling_median(x: Column, n: int, min_periods: int) -> Column:
    return rolling(lambda c: F.percentile(c, F.lit(0.5)), x, n, min_periods)


def forward_fill(x: Column, limit: int | None = None) -> Column:
    """The last value, at most ``limit`` rows old."""
    return F.last(x, ignorenulls=True).over(by_code().rowsBetween(-limit if limit is not None else Window.unboundedPreceding, 0))


def pct_change(x: Column, k: int = 1) -> Column:
    """x over its value k rows ago, less one; null if either is missing."""
    return F.try_divide(x, shift(x, k)) - 1


def running_count(x: Column) -> Column:
    return F.count(x).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
