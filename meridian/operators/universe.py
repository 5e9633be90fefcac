"""Which names may be held and traded on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.ts import rolling_median, running_count, shift
from meridian.operators.asof import membership_asof

LIQUIDITY_DAYS, LIQUIDITY_LEAST = 60, 40
LIMIT, LIMIT_ST, LIMIT_GROWTH = 0.098, 0.048, 0.198
GROWTH_BOARDS = ("sz.300", "sh.688")
GROWTH_SINCE = "2020-08-24"


def pit_universe(snapshots: DataFrame, panel: DataFrame, calendar: DataFrame, min_list_days: int = 120, exclude_st: bool = True, top_n: int | None = 1500, require_trading: bool = True, days: int = LIQUIDITY_DAYS, least: int = LIQUIDITY_LEAST) -> DataFrame:
    """``di, date, code, in_universe`` for every cell, never null.

    Gates: in the newest snapshot; ``min_list_days`` closes so far; a close today, no ST flag (a missing flag passes) and trading (a
    missing flag fails); then the ``top_n`` names that pass by median amount, ties by code. Names without a liquidity value are out.
    """
    if min_list_days < 0 or (top_n is not None and top_n < 1):
        raise ValueError("min_list_days must not be negative and top_n must be positive")
    member = membership_asof(snapshots, calendar, panel).withColumn("member", F.lit(True))
    amount = F.when(F.col("amount") > 0, F.col("amount"))
    cells = panel.select("di", "date", "code", "close", "is_st", "is_trading", running_count(F.col("close")).alias("listed"), rolling_median(amount, days, least).alias("liquidity"))
    cells = cells.join(member, ["di", "code"], "left")
    ok = F.coalesce("member", F.lit(False)) & (F.col("listed") >= min_list_days) & F.col("close").isNotNull()
    if exclude_st:
        ok &= F.coalesce("is_st", F.lit(0)) != 1
    if require_trading:
        ok &= F.coalesce("is_trading", F.lit(0)) == 1
    if top_n is None:
        return cells.select("di", "date", "code", ok.alias("in_universe"))
    cells = cells.withColumn("eligible", ok & F.col("liquidity").isNotNull())
    place = F.row_number().over(Window.partitionBy("di", "eligible").orderBy(F.desc("liquidity"), "code"))
    return cells.select("di", "date", "code", (F.col("eligible") & (place <= top_n)).alias("in_universe"))


def limits(growth_since: str = GROWTH_SINCE, limit: float = LIMIT, limit_st: float = LIMIT_ST, limit_growth: float = LIMIT_GROWTH) -> Column:
    """The price limit of a cell: growth boards from a date on, else ST names, else the main board."""
    growth = F.lit(False)
    for board in GROWTH_BOARDS:
        growth |= F.col("code").startswith(board)
    return F.when(growth & (F.col("date") >= F.lit(growth_since).cast("date")), limit_growth).when(F.coalesce("is_st", F.lit(0)) == 1, limit_st).otherwise(limit)


def tradability(panel: DataFrame, **limit_args) -> DataFrame:
    """``di, date, code, can_buy, can_sell``: false at one-price boards at the limit up (no buying) or down (no selling); unknown is tradable."""
    cells = panel.select("di", "date", "code", "open", "high", "low", "is_st", shift("close", 1).alias("before"))
    one_price = (F.col("open") == F.col("high")) & (F.col("open") == F.col("low"))
    move, limit = F.try_divide("open", "before") - 1, limits(**limit_args)
    up, down = one_price & (move >= limit), one_price & (move <= -limit)
    return cells.select("di", "date", "code", (~F.coalesce(up, F.lit(False))).alias("can_buy"), (~F.coalesce(down, F.lit(False))).alias("can_sell"))
