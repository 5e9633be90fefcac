"""What a signal's readings are made of: suspension pollution, realisation in raw returns, windows of time, styles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.operators import evaluate as ev


def pollution_by_year(factor: DataFrame, label: DataFrame, polluted: DataFrame, raw: DataFrame) -> DataFrame:
    """By year: ``scored`` cells (factor and label there), ``polluted`` ones and their ``share``; the median absolute raw return of polluted and clean cells, and the
    share of polluted ones whose raw return is zero."""
    cells = ev.paired(factor, label).select("di", "date", "code").join(polluted.select("di", "code", "polluted"), ["di", "code"]).join(raw.select("di", "code", F.col("value").alias("r")), ["di", "code"], "left")
    bad, size = F.col("polluted"), F.abs("r")
    return cells.groupBy(F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(bad).alias("polluted"), (F.count_if(bad) / F.count(F.lit(1))).alias("share"),
        F.median(F.when(bad, size)).alias("median_polluted"), F.median(F.when(~bad, size)).alias("median_clean"), F.try_divide(F.count_if(bad & (F.col("r") == 0)), F.count_if(bad)).alias("zero_share"),
    )


def without_polluted(factor: DataFrame, polluted: DataFrame) -> DataFrame:
    """The factor with polluted cells emptied."""
    joined = factor.join(polluted.select("di", "code", "polluted"), ["di", "code"], "left")
    return joined.select("di", "date", "code", F.when(~F.coalesce("polluted", F.lit(False)), F.col("value")).alias("value"))


def realisation(factor: DataFrame, residual_label: DataFrame, raw_label: DataFrame, min_names: int = 30) -> DataFrame:
    """One row: mean coefficient against the residual and the raw label, their ratio ``rate``, the number of years in which their yearly means differ in sign
    (``flips``), and the ``years`` that both have."""
    parts = [ev.ic_series(factor, y, min_names).withColumn("which", F.lit(which)) for which, y in (("residual", residual_label), ("raw", raw_label))]
    ic = parts[0].unionByName(parts[1])
    pick = lambda which: F.when(F.col("which") == which, F.col("ic"))
    years = ic.groupBy(F.year("date").alias("year")).agg(F.avg(pick("residual")).alias("a"), F.avg(pick("raw")).alias("b"), *[F.sum(pick(w)).alias(f"s_{w}") for w in ("residual", "raw")], *[F.count(pick(w)).alias(f"n_{w}") for w in ("residual", "raw")])
    mean = lambda which: F.try_divide(F.sum(f"s_{which}"), F.sum(f"n_{which}"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return years.agg(mean("residual").alias("ic_residual"), mean("raw").alias("ic_raw"), F.try_divide(mean("raw"), mean("residual")).alias("rate"), F.count_if(both & (F.signum("a") != F.signum("b"))).alias("flips"), F.count_if(both).alias("years"))


def by_window(series: DataFrame, windows: dict[str, tuple[str, str]], column: str = "ic") -> DataFrame:
    """``window, mean, total, n`` of a series (``date`` and a column) within named windows of dates, both ends included; windows may overlap."""
    rows = [F.when(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(name)) for name, (a, b) in windows.items()]
    inside = series.where(F.col(column).isNotNull()).select(F.explode(F.array_compact(F.array(*rows))).alias("window"), F.col(column).alias("x"))
    return inside.groupBy("window").agg(F.avg("x").alias("mean"), F.sum("x").alias("total"), F.count("x").alias("n"))


def style_totals(coefficients: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``style, total``: each style's cumulative return over the days of the frame."""
    return coefficients.select(F.inline(F.array(*[F.struct(F.lit(n).alias("style"), F.col(n).alias("x")) for n in names]))).groupBy("style").agg(F.sum("x").alias("total"))
