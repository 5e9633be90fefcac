"""Layered backtests with costs, without and with tradability, and their metrics.

Both kinds come down to intervals: a leg's names with the day since which each is held and the day it is given up. Without masks the intervals are the
rebalances themselves. With masks a name's interval depends on its own past alone, so names are folded side by side in slices of a leg,
and returns, costs and turnover are sums over intervals in Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.xs import rank_pct

YEAR_DAYS = 252
LEGS = ("top", "bottom")
SLICES = 16  # groups of names of a leg that are folded apart


def _aligned(factor: DataFrame, fwd1: DataFrame) -> DataFrame:
    """Common days with their position ``i``."""
    days = factor.select("di").distinct().join(fwd1.select("di").distinct(), "di")
    return days.select("di", (F.row_number().over(Window.orderBy("di")) - 1).alias("i"))


def _legs(factor: DataFrame, days: DataFrame, q: int, rebal_days: int) -> DataFrame:
    """``leg, i, di, code`` on rebalance days: the names above 1 - 1/q and those up to 1/q by percentile rank. Only those days are ranked."""
    chosen = factor.join(F.broadcast(days.where(F.col("i") % rebal_days == 0)), "di")
    pct = chosen.select("di", "i", "code", rank_pct(F.col("value")).alias("p")).where("p IS NOT NULL")
    both = F.array(F.when(F.col("p") > 1 - 1 / q, F.lit("top")), F.when(F.col("p") <= 1 / q, F.lit("bottom")))
    return pct.select("di", "i", "code", F.explode(F.array_compact(both)).alias("leg"))


def _with_spread(legs: DataFrame) -> DataFrame:
    """The legs (``di, leg, ret, turnover``) and their difference ``ls`` on days that both have, from one row per day."""
    pick = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    wide = legs.groupBy("di").agg(*[pick(x, "ret").alias(x) for x in LEGS], *[pick(x, "turnover").alias(f"{x}_turnover") for x in LEGS], *[F.max(F.col("leg") == x).alias(f"{x}_there") for x in LEGS])
    row = lambda leg, there, ret, turnover: F.when(there, F.struct(F.lit(leg).alias("leg"), ret.alias("ret"), turnover.alias("turnover")))
    top, bottom = F.col("top"), F.col("bottom")
    rows = [row(x, F.col(f"{x}_there"), F.col(x), F.col(f"{x}_turnover")) for x in LEGS]
    rows.append(row("ls", top.isNotNull() & bottom.isNotNull(), top - bottom, F.lit(None).cast("double")))
    return wide.select("di", F.inline(F.array_compact(F.array(*rows))))


def layered_backtest(factor: DataFrame, fwd1: DataFrame, q: int = 5, rebal_days: int = 5, cost_bps: float = 15.0, impact_bps: float = 0.0) -> DataFrame:
    """``di, leg, ret, turnover``: daily net returns of the legs ``top``, ``bottom`` and ``ls`` (days with both).

    Every ``rebal_days``-th day the target is held until the next; a rebalance with an empty target changes nothing. Turnover is 1 at
    first, then the share of the new names; its cost is twice the rate. ``turnover`` is set on rebalance days.
    """
    rate = (cost_bps + impact_bps) / 1e4
    days = _aligned(factor, fwd1)
    members = _legs(factor, days, q, rebal_days)
    order = Window.partitionBy("leg").orderBy("i")
    # rebalances with a target: one row per leg and rebalance
    dates = members.groupBy("leg", "i").agg(F.count(F.lit(1)).alias("size")).select("leg", "i", F.row_number().over(order).alias("k"), F.lead("i").over(order).alias("until"))
    last = days.agg(F.max("i").alias("end")).first()["end"]
    spans = members.join(F.broadcast(dates), ["leg", "i"])
    kept = F.coalesce(F.lag("k").over(Window.partitionBy("leg", "code").orderBy("k")) == F.col("k") - 1, F.lit(False))
    spans = spans.select("leg", "code", "k", "i", kept.alias("kept"), F.explode(F.sequence("i", F.coalesce("until", F.lit((last or 0) + 1)) - 1)).alias("at"))
    y = fwd1.select("di", "code", F.col("value").alias("y"))
    cells = spans.join(F.broadcast(days.withColumnRenamed("i", "at")), "at").join(y, ["di", "code"], "left")
    first = F.col("at") == F.col("i")
    daily = cells.groupBy("di", "leg").agg(F.avg("y").alias("gross"), F.min("k").alias("k"), F.count_if(first).alias("new"), F.count_if(first & F.col("kept")).alias("stay"))
    turnover = F.when(F.col("new") > 0, F.when(F.col("k") == 1, 1.0).otherwise(1.0 - F.col("stay") / F.col("new")))
    legs = daily.select("di", "leg", "gross", turnover.alias("turnover"))
    cost = F.coalesce(F.col("turnover") * (2 * rate), F.lit(0.0))
    return _with_spread(legs.select("di", "leg", F.when(F.col("gross").isNotNull(), F.col("gross") - cost).when(F.col("turnover").isNotNull(), -cost).alias("ret"), "turnover"))


def _intervals(cells: DataFrame, n_days: int) -> DataFrame:
    """``leg, code, since, until, late``: when each name of a leg is held; ``late`` if it was given up between rebalances, null if never.

    ``cells`` has ``leg, slice, i, code, active, wanted, can_buy, can_sell`` for every day of every name that is ever wanted.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(rows["code"].to_numpy(), return_inverse=True)
        day = rows["i"].to_numpy()
        table = {c: np.zeros((n_days, len(names)), bool) for c in ("active", "wanted", "can_buy", "can_sell")}
        for c, values in table.items():
            values[day, at] = rows[c].to_numpy()
        since, waiting = np.full(len(names), -1), np.zeros(len(names), bool)
        out: list[tuple[np.ndarray, np.ndarray, int, bool | None]] = []

        def close(which: np.ndarray, i: int, late: bool | None) -> None:
            if which.any():
                out.append((np.flatnonzero(which), since[which].copy(), i, late))
                since[which] = -1

        for i in range(n_days):
            active, wanted, buy, sell = (table[c][i] for c in table)
            close(waiting & sell, i, True)
            waiting &= ~sell
            held = since >= 0
            unwanted = active & held & ~wanted
            close(unwanted & sell, i, False)
            waiting = np.where(active, unwanted & ~sell, waiting)
            since[active & wanted & ~held & buy] = i
        close(since >= 0, n_days, None)
        flat = [(names[k], int(s), i, late) for ks, starts, i, late in out for k, s in zip(ks, starts)]
        found = pd.DataFrame(flat, columns=["code", "since", "until", "late"])
        found.insert(0, "leg", rows["leg"].iloc[0])
        return found.astype({"late": "boolean"})

    return cells.groupBy("leg", "slice").applyInPandas(fold, "leg string, code string, since int, until int, late boolean")


def _accounted(spans: DataFrame, days: DataFrame, active: DataFrame, fwd1: DataFrame, n_days: int, rate: float) -> DataFrame:
    """``leg, i, di, gross, held, turnover, cost, emptied``: what intervals earn and cost, by day, in one aggregate over the days of the intervals."""
    end = F.least(F.col("until"), F.lit(n_days - 1))
    cells = spans.select("leg", "code", "since", "until", "late", F.explode(F.sequence("since", end)).alias("i")).join(F.broadcast(days.select("i", "di")), "i")
    cells = cells.join(fwd1.select("di", "code", F.col("value").alias("y")), ["di", "code"], "left")
    inside, out = F.col("i") < F.col("until"), F.col("i") == F.col("until")
    events = cells.groupBy("leg", "i").agg(F.avg(F.when(inside, F.col("y"))).alias("gross"), F.count_if(inside).alias("held"), F.count_if(F.col("i") == F.col("since")).alias("bought"), F.count_if(out & ~F.col("late")).alias("sold"), F.count_if(out & F.col("late")).alias("late"))
    # a row per leg and day
    every = days.select("i", "di", F.explode(F.array(*[F.lit(x) for x in LEGS])).alias("leg")).join(events, ["leg", "i"], "left").join(active.withColumn("active", F.lit(True)), ["leg", "i"], "left").fillna(0, ["held", "bought", "sold", "late"])
    every = every.withColumn("before", F.coalesce(F.lag("held").over(Window.partitionBy("leg").orderBy("i")), F.lit(0)))
    traded, turned = F.col("bought") + F.col("sold"), F.col("active") & (F.col("held") > 0)
    late = F.when(F.col("late") > 0, rate * F.col("late") / F.col("before"))
    now = F.when(turned, rate * traded / F.col("held"))
    cost = F.when(late.isNotNull() | now.isNotNull(), F.coalesce(late, F.lit(0.0)) + F.coalesce(now, F.lit(0.0)))
    return every.select("leg", "i", "di", "gross", "held", F.when(turned, traded / (2 * F.col("held"))).alias("turnover"), cost.alias("cost"), (F.col("active") & (F.col("held") == 0) & (F.col("sold") > 0)).alias("emptied"))


def layered_backtest_masked(factor: DataFrame, fwd1: DataFrame, masks: DataFrame, q: int = 5, rebal_days: int = 5, cost_bps: float = 15.0, impact_bps: float = 0.0) -> DataFrame:
    """As ``layered_backtest``, with ``masks`` (``di, code, can_buy, can_sell``) of the execution day, the row after the signal day.

    A wanted name that can't be bought is left out; an unwanted one that can't be sold is held and sold on the first day it can
    be. Unknown is tradable; the last day has no execution day. A rebalance that would leave nothing is skipped. Cost is the rate per
    traded share of the held names. Only names that are ever in a leg's target are looked at.

    Names depend on each other only through skipped rebalances. One can be skipped only if none of its names can be bought, so without such a rebalance
    there is one pass; else passes go on until none empties a leg, the earliest being taken out each time.
    """
    rate = (cost_bps + impact_bps) / 1e4
    days = _aligned(factor, fwd1)
    n_days = days.count()
    target = _legs(factor, days, q, rebal_days).select("leg", "i", "code")
    ahead = days.select((F.col("i") - 1).alias("i"), F.col("di").alias("exec_di"))
    days = days.join(ahead, "i", "left")
    side = masks.select(F.col("di").alias("exec_di"), "code", F.coalesce("can_buy", F.lit(True)).alias("can_buy"), F.coalesce("can_sell", F.lit(True)).alias("can_sell"))
    names = target.select("leg", "code").distinct().select("leg", "code", F.pmod(F.xxhash64("code"), F.lit(SLICES)).alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(max(0, n_days - 1)))).alias("i"))
    cells = names.join(F.broadcast(days), "i").join(side, ["exec_di", "code"], "left").join(target.withColumn("wanted", F.lit(True)), ["leg", "i", "code"], "left")
    cells = cells.select("leg", "slice", "i", "code", *[F.coalesce(c, F.lit(c != "wanted")).alias(c) for c in ("wanted", "can_buy", "can_sell")])
    active = cells.where("wanted").groupBy("leg", "i").agg(F.max("can_buy").alias("open"))
    doubtful = active.where("NOT open").select("leg", "i").collect()  # rebalances of which no name can be bought
    skipped: list[tuple[str, int]] = []
    while True:
        taken = active.select("leg", "i")
        if skipped:
            taken = taken.join(F.broadcast(taken.sparkSession.createDataFrame(skipped, "leg string, i int")), ["leg", "i"], "left_anti")
        spans = _intervals(cells.join(F.broadcast(taken.withColumn("active", F.lit(True))), ["leg", "i"], "left").fillna(False, ["active"]), n_days)  # a row per rebalance
        daily = _accounted(spans, days, taken, fwd1, n_days, rate)
        emptied = daily.where("emptied").groupBy("leg").agg(F.min("i").alias("i")).collect() if doubtful else []
        if not emptied:
            break
        skipped += [(r["leg"], r["i"]) for r in emptied]
    legs = daily.where("gross IS NOT NULL OR cost IS NOT NULL")
    zero = F.lit(0.0)
    return _with_spread(legs.select("di", "leg", (F.coalesce("gross", zero) - F.coalesce("cost", zero)).alias("ret"), "turnover"))


def metrics(series: DataFrame, column: str = "ret", *keys: str, periods: int = YEAR_DAYS) -> DataFrame:
    """``ann_ret, sharpe, max_dd, n`` per key, with ``periods`` rows a year; the drawdown is of the summed returns from their running peak."""
    order = Window.partitionBy(*keys).orderBy("di") if keys else Window.orderBy("di")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = series.where(F.col(column).isNotNull()).select(*keys, "di", F.col(column).alias("r"), F.sum(column).over(run).alias("cum"))
    rows = rows.withColumn("dd", F.col("cum") - F.max("cum").over(run))
    mean, sd = F.avg("r") * periods, F.stddev_samp("r") * F.sqrt(F.lit(float(periods)))
    return rows.groupBy(*keys).agg(F.bround(mean, 4).alias("ann_ret"), F.bround(F.try_divide(mean, sd), 2).alias("sharpe"), F.bround(F.min("dd"), 3).alias("max_dd"), F.count("r").alias("n"))


def average_turnover(legs: DataFrame, leg: str = "top") -> DataFrame:
    """Mean turnover per rebalance of a leg, without its first."""
    turns = legs.where((F.col("leg") == leg) & F.col("turnover").isNotNull()).select("turnover", F.row_number().over(Window.orderBy("di")).alias("k"))
    return turns.agg(F.bround(F.avg(F.when(F.col("k") > 1, F.col("turnover"))), 3).alias("avg_turnover"), F.count(F.lit(1)).alias("n_rebalances"))


def overlay(net: DataFrame, benchmark: DataFrame, periods: int = YEAR_DAYS) -> DataFrame:
    """One row: ``excess`` (per year), ``tracking_error`` (per year) and ``information_ratio`` of a series (``di, ret``) over a benchmark, on days that have both, and their number ``n``."""
    both = net.select("di", F.col("ret").alias("a")).join(benchmark.select("di", F.col("ret").alias("b")), "di").select((F.col("a") - F.col("b")).alias("x")).where("x IS NOT NULL")
    mean, sd = F.avg("x") * periods, F.stddev_samp("x") * F.sqrt(F.lit(float(periods)))
    return both.agg(mean.alias("excess"), sd.alias("tracking_error"), F.try_divide(mean, sd).alias("information_ratio"), F.count("x").alias("n"))


def excess(net: Column, benchmark: Column) -> Column:
    return net - benchmark
