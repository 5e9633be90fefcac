"""Composites of factors, buffered top-N portfolios, and what follows from weights."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.ts import by_code
from meridian.functions.xs import rank_pct
from meridian.operators.backtest import YEAR_DAYS, metrics, overlay
from meridian.operators.evaluate import ic_of


def stacked(factors: dict[str, DataFrame]) -> DataFrame:
    """All factors in one long frame: ``factor, di, date, code, r`` (percentile ranks, non-null)."""
    parts = [f.select(F.lit(name).alias("factor"), "di", "date", "code", "value") for name, f in factors.items()]
    return _ranked(reduce(DataFrame.unionByName, parts))


def _ranked(long: DataFrame) -> DataFrame:
    return long.select("factor", "di", "date", "code", rank_pct(F.col("value"), "factor").alias("r")).where("r IS NOT NULL")


def equal_weight(factors: dict[str, DataFrame], min_count: int = 2) -> DataFrame:
    """Mean percentile rank of the factors that a cell has; cells with fewer than ``min_count`` are left out."""
    means = stacked(factors).groupBy("di", "date", "code").agg(F.avg("r").alias("value"), F.count("r").alias("n"))
    return means.where(F.col("n") >= min_count).drop("n")


def _known(ics: DataFrame, calendar: DataFrame, horizon: int, names: tuple[str, ...]) -> DataFrame:
    """``factor, di, ic`` for every calendar day: the coefficient that became known on it, ``horizon + 2`` calendar rows after its own day."""
    days = calendar.select("di", F.explode(F.array(*[F.lit(n) for n in names])).alias("factor"))
    ahead = Window.partitionBy("factor").orderBy("di")
    return days.join(ics.select("factor", "di", "ic"), ["factor", "di"], "left").select("factor", "di", F.lag("ic", horizon + 2).over(ahead).alias("ic"))


def _together(factors: dict[str, DataFrame], label: DataFrame) -> DataFrame:
    """All factors and the label in one long frame, dealt by factor and day once for all that ranks it."""
    long = reduce(DataFrame.unionByName, [f.select(F.lit(name).alias("factor"), "di", "date", "code", "value") for name, f in factors.items()])
    y = label.select("di", "code", F.col("value").alias("y"))
    return long.where("value IS NOT NULL").join(y, ["di", "code"], "left").repartition("factor", "di")


def _weights(cells: DataFrame, calendar: DataFrame, names: tuple[str, ...], horizon: int, window: int, min_periods: int, min_names: int) -> DataFrame:
    ics = ic_of(cells.where("y IS NOT NULL").withColumnRenamed("value", "f"), "factor", min_names=min_names)
    frame = Window.partitionBy("factor").orderBy("di").rowsBetween(-(window - 1), 0)
    ratio = F.try_divide(F.avg("ic").over(frame), F.stddev_samp("ic").over(frame))
    return _known(ics, calendar, horizon, names).select("factor", "di", F.when(F.count("ic").over(frame) >= min_periods, F.greatest(ratio, F.lit(0.0))).alias("w"))


def icir_weights(factors: dict[str, DataFrame], label: DataFrame, calendar: DataFrame, horizon: int, window: int = 252, min_periods: int = 120, min_names: int = 30) -> DataFrame:
    """``factor, di, w``: mean over standard deviation of the coefficients known by a day, negative ones as zero.

    A coefficient is known ``horizon + 2`` calendar rows after its day; the window counts calendar rows.
    """
    return _weights(_together(factors, label), calendar, tuple(factors), horizon, window, min_periods, min_names)


def rolling_prior(ic: DataFrame, calendar: DataFrame, horizon: int, window: int = 252, min_periods: int = 120) -> DataFrame:
    """``di, ic``: the mean of the coefficients known by each calendar day over ``window`` rows, negative ones as zero; null with fewer than ``min_periods``."""
    frame = Window.partitionBy("factor").orderBy("di").rowsBetween(-(window - 1), 0)
    known = _known(ic.withColumn("factor", F.lit("ic")), calendar, horizon, ("ic",))
    return known.select("di", F.when(F.count("ic").over(frame) >= min_periods, F.greatest(F.avg("ic").over(frame), F.lit(0.0))).alias("ic"))


def icir_weight(factors: dict[str, DataFrame], label: DataFrame, calendar: DataFrame, horizon: int, window: int = 252, min_periods: int = 120, min_count: int = 2, min_names: int = 30) -> DataFrame:
    """Mean percentile rank weighted by ``icir_weights``; a missing weight counts as zero; cells need a positive weight and ``min_count`` factors."""
    together = _together(factors, label)
    weights = _weights(together, calendar, tuple(factors), horizon, window, min_periods, min_names)
    # one row per factor and day
    cells = _ranked(together).join(F.broadcast(weights), ["factor", "di"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    sums = cells.groupBy("di", "date", "code").agg(F.sum(F.col("w") * F.col("r")).alias("num"), F.sum("w").alias("den"), F.count("r").alias("n"))
    return sums.where((F.col("den") > 0) & (F.col("n") >= min_count)).select("di", "date", "code", (F.col("num") / F.col("den")).alias("value"))


def topn_buffer_weights(signal: DataFrame, calendar: DataFrame, top_n: int = 50, buffer_n: int = 80, rebal_days: int = 5) -> DataFrame:
    """``di, code, weight`` of an equal-weight portfolio that changes on every ``rebal_days``-th of the signal's own days.

    On a rebalance day with at least ``buffer_n`` names, held names within the first ``buffer_n`` stay and the best others fill up to ``top_n``.
    Ties go by code. Only the first max(top_n, buffer_n) names of a rebalance matter, so the sequential part sees
    that many rows per rebalance.
    """
    day = Window.partitionBy("di")
    days = signal.select("di").distinct().select("di", (F.row_number().over(Window.orderBy("di")) - 1).alias("i"))  # one row per day
    ranked = signal.where("value IS NOT NULL").join(F.broadcast(days.where(F.col("i") % rebal_days == 0)), "di")
    ranked = ranked.select("di", "code", F.row_number().over(day.orderBy(F.desc("value"), "code")).alias("place"), F.count(F.lit(1)).over(day).alias("n"))
    ranked = ranked.where((F.col("place") <= max(top_n, buffer_n)) & (F.col("n") >= buffer_n))

    def hold(rows: pd.DataFrame) -> pd.DataFrame:
        held: list[str] = []
        out = []
        for di, names in rows.sort_values(["di", "place"]).groupby("di")["code"]:
            names = names.tolist()
            inside = set(names[:buffer_n])
            held = [c for c in held if c in inside]
            own = set(held)
            held += [c for c in names if c not in own][: max(0, top_n - len(held))]
            out.extend((di, c, 1.0 / len(held)) for c in held)
        return pd.DataFrame(out, columns=["di", "code", "weight"])

    changes = ranked.groupBy(F.lit(1).alias("book")).applyInPandas(hold, "di int, code string, weight double")
    dates = changes.select(F.col("di").alias("since")).distinct().withColumn("until", F.lead("since").over(Window.orderBy("since")))
    days = calendar.join(F.broadcast(dates), (F.col("di") >= F.col("since")) & (F.col("until").isNull() | (F.col("di") < F.col("until")))).select("di", "since")
    return days.join(changes.withColumnRenamed("di", "since"), "since").select("di", "code", "weight")


def turnover_series(weights: DataFrame, grid: DataFrame) -> DataFrame:
    """``di, turnover``: half the sum of absolute weight changes; the first day has none."""
    cells = grid.select("di", "code").join(weights, ["di", "code"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    change = F.abs(F.col("weight") - F.lag("weight").over(by_code()))
    return cells.select("di", change.alias("c")).groupBy("di").agg((F.coalesce(F.sum("c"), F.lit(0.0)) / 2).alias("turnover"))


def portfolio_returns(weights: DataFrame, fwd1: DataFrame) -> DataFrame:
    """``di, ret``: the weighted sum of next-day returns; a missing return counts as zero."""
    y = fwd1.select("di", "code", F.col("value").alias("y"))
    return weights.join(y, ["di", "code"], "left").groupBy("di").agg(F.sum(F.col("weight") * F.coalesce("y", F.lit(0.0))).alias("ret"))


def targets(weights: DataFrame, di: int) -> DataFrame:
    """Positive weights of a day, largest first."""
    return weights.where((F.col("di") == di) & (F.col("weight") > 0)).select("code", "weight").orderBy(F.desc("weight"), "code")


def export_targets(weights: DataFrame, di: int, path: str) -> DataFrame:
    out = targets(weights, di)
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return out


def sweep(signal: DataFrame, calendar: DataFrame, grid: DataFrame, fwd1: DataFrame, benchmark: DataFrame, choices: list[tuple[int, int, int]], cost: float = 0.003, periods: int = YEAR_DAYS) -> DataFrame:
    """One row per choice of (``top_n, buffer_n, rebal_days``): net return and Sharpe ratio, excess and information ratio over the benchmark, and yearly turnover.

    Each choice is a book of its own; all run in one job.
    """
    out = []
    for top_n, buffer_n, rebal_days in choices:
        weights = topn_buffer_weights(signal, calendar, top_n, buffer_n, rebal_days).persist()  # at most top_n rows a day
        turns = turnover_series(weights, grid)
        net = portfolio_returns(weights, fwd1).join(turns, "di", "left").select("di", (F.col("ret") - cost * F.coalesce("turnover", F.lit(0.0))).alias("ret"))
        key = [F.lit(x).alias(n) for x, n in zip((top_n, buffer_n, rebal_days), ("top_n", "buffer_n", "rebal_days"))]
        one = metrics(net, periods=periods).select(*key, "ann_ret", "sharpe")
        over = overlay(net, benchmark, periods).select(*key, F.bround("excess", 4).alias("excess"), F.bround("information_ratio", 2).alias("information_ratio"))
        spent = turns.agg(F.bround(F.avg("turnover") * periods, 1).alias("turnover_ann")).select(*key, "turnover_ann")
        out.append(one.join(over, ["top_n", "buffer_n", "rebal_days"]).join(spent, ["top_n", "buffer_n", "rebal_days"]))
    return reduce(DataFrame.unionByName, out)
