"""Cross-section columns per calendar day: every window is partitioned by ``di`` only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_day() -> WindowSpec:
    """All rows of a day."""
    return Window.partitionBy("di")


def rank_average(x: Column, *keys: str) -> Column:
    """Rank of a value among the non-null ones of its day (and keys); ties share their mean rank.

    Rank and number of ties come from one window specification, so a day is dealt and sorted once.
    """
    order = Window.partitionBy("di", *keys).orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(order) + (ties - 1) / F.lit(2.0))


def rank_pct(x: Column, *keys: str) -> Column:
    """``rank_average`` over the number of non-null values."""
    return rank_average(x, *keys) / F.count(x).over(Window.partitionBy("di", *keys))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def zscore(x: Column) -> Column:
    """Distance from the day's mean in sample standard deviations; null where those are zero."""
    return F.try_divide(x - F.avg(x).over(by_day()), F.stddev_samp(x).over(by_day()))


def winsorize_mad(df: DataFrame, column: str, k: float = 5.0) -> DataFrame:
    """``column`` clipped to the day's median plus or minus k times 1.4826 times the median absolute deviation."""
    middle, spread = "__median", "__mad"
    out = df.withColumn(middle, F.percentile(F.col(column), F.lit(0.5)).over(by_day()))
    out = out.withColumn(spread, F.lit(1.4826 * k) * F.percentile(F.abs(F.col(column) - F.col(middle)), F.lit(0.5)).over(by_day()))
    return out.withColumn(column, clip(F.col(column), F.col(middle) - F.col(spread), F.col(middle) + F.col(spread))).drop(middle, spread)


def bucket(x: Column, q: int) -> Column:
    """1..q by percentile rank: the ceiling of rank times q."""
    return F.ceil(rank_pct(x) * q)


def correlation(x: Column, y: Column) -> Column:
    """Aggregate Pearson correlation; null on constant input."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
