"""Factors: a registry of functions from a dense panel to ``di, date, code, value``, and their materialisation.

A factor is a plain function over the panel's DataFrame; the registry adds metadata. Materialised factors carry a manifest with three fingerprints
(source code, input data, output) and are computed anew when any of them or the end date differs.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions.ts import by_code, pct_change, rolling, shift

Factor = Callable[[DataFrame], DataFrame]
_REGISTRY: dict[str, tuple[Factor, dict]] = {}
TINY_TURN = 1e-8
TINY_RANGE = 1e-12


def factor(name: str, **meta) -> Callable[[Factor], Factor]:
    """Register a factor; a name that is taken raises ``KeyError``."""

    def add(f: Factor) -> Factor:
        if name in _REGISTRY:
            raise KeyError(f"factor {name} exists")
        _REGISTRY[name] = (f, meta)
        return f

    return add


def get_meta(name: str) -> dict:
    return dict(_REGISTRY[name][1])


def list_factors() -> list[str]:
    return sorted(_REGISTRY)


def evaluate(name: str, panel: DataFrame) -> DataFrame:
    """The values of a registered factor over a dense panel."""
    return _REGISTRY[name][0](panel)


def _values(panel: DataFrame, x: Column) -> DataFrame:
    return panel.select("di", "date", "code", x.alias("value"))


@factor("mom_20_5", family="momentum", direction=1)
def mom_20_5(panel: DataFrame) -> DataFrame:
    """Return from 25 to 5 days ago."""
    return _values(panel, F.try_divide(shift("adj_close", 5), shift("adj_close", 25)) - 1)


@factor("rev_5", family="reversal", direction=-1)
def rev_5(panel: DataFrame) -> DataFrame:
    """Return of the last 5 days."""
    return _values(panel, pct_change(F.col("adj_close"), 5))


def with_returns(panel: DataFrame) -> DataFrame:
    """The panel with ``ret``, the one-day return."""
    return panel.withColumn("ret", pct_change(F.col("adj_close")))


@factor("vol_20", family="volatility", direction=-1)
def vol_20(panel: DataFrame) -> DataFrame:
    """Standard deviation of 20 one-day returns, 15 at least."""
    return _values(with_returns(panel), rolling(F.stddev_samp, F.col("ret"), 20, 15))


@factor("turn_surge_5_60", family="liquidity", direction=-1)
def turn_surge_5_60(panel: DataFrame) -> DataFrame:
    """Mean turnover of 5 days (3 at least) over that of 60 (40 at least)."""
    turn = F.col("turn")
    slow = rolling(F.avg, turn, 60, 40)
    return _values(panel, F.when(slow > TINY_TURN, rolling(F.avg, turn, 5, 3) / slow))


@factor("amihud_20", family="liquidity", direction=1)
def amihud_20(panel: DataFrame) -> DataFrame:
    """Mean absolute return per traded amount (in thousand millions) over 20 days, 12 at least."""
    priced = with_returns(panel).withColumn("impact", F.when(F.col("amount") > 0, F.abs("ret") / F.col("amount") * 1e9))
    return _values(priced, rolling(F.avg, F.col("impact"), 20, 12))


@factor("px_pos_250", family="momentum", direction=1)
def px_pos_250(panel: DataFrame) -> DataFrame:
    """Position of the price in its 250-day range, 120 days at least."""
    x = F.col("adj_close")
    low, high = rolling(F.min, x, 250, 120), rolling(F.max, x, 250, 120)
    return _values(panel, F.when(high - low > TINY_RANGE, (x - low) / (high - low)))


AGE_WARMUP = 60


def _ages(days: pd.DataFrame) -> pd.DataFrame:
    days = days.sort_values("di")
    kept = 1.0 - days["turn"].fillna(0.0).clip(0.0, 1.0).to_numpy()
    ages, age = np.empty(len(kept)), 0.0
    for t, k in enumerate(kept):
        age = k * (age + 1.0)
        ages[t] = age
    valid = days["close"].notna().cumsum() >= AGE_WARMUP
    days["value"] = np.where(days["close"].notna() & valid, ages, np.nan)
    return days[["di", "date", "code", "value"]]


@factor("chip_age", family="holding", direction=1)
def chip_age(panel: DataFrame) -> DataFrame:
    """Mean holding age: age = (1 - turn) * (age before + 1), over all calendar rows from the first on, null turnover as none.

    Null without a close or with fewer than 60 closes. The recurrence is sequential, so it runs per code (one row per day) in Python.
    """
    out = panel.select("di", "date", "code", "turn", "close").groupBy("code").applyInPandas(_ages, "di int, date date, code string, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def panel_signature(values: DataFrame) -> str:
    """first day ~ last day ~ number of days ~ hash of the codes, in one aggregate."""
    row = values.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count_distinct("date").alias("n"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_set("code"))), 256).alias("h")).first()
    return f"{row['a']}~{row['b']}~{row['n']}~{(row['h'] or '')[:16]}"


def code_fingerprint(name: str) -> str:
    f = _REGISTRY[name][0]
    try:
        source = inspect.getsource(f).encode()
    except OSError:
        source = f.__code__.co_code
    return hashlib.sha256(source).hexdigest()[:16]


def _manifest(spark: SparkSession, path: str) -> dict:
    """The manifest beside a materialised factor; a missing or damaged one is empty."""
    try:
        found = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}.manifest").collect()))
    except Exception:  # noqa: BLE001 - absent, unreadable and malformed are alike: compute anew
        return {}
    return found if isinstance(found, dict) else {}


def compute(name: str, panel: DataFrame, cache_dir: str, use_cache: bool = True) -> DataFrame:
    """A factor, materialised under ``cache_dir``. The manifest is written last, so a broken write is never used."""
    spark, path = panel.sparkSession, f"{cache_dir.rstrip('/')}/{name}"
    wanted = {"code": code_fingerprint(name), "data": panel_signature(panel.where("close IS NOT NULL"))}
    if use_cache:
        found = _manifest(spark, path)
        if found and {k: found.get(k) for k in wanted} == wanted:
            cached = spark.read.parquet(path)
            if panel_signature(cached) == found.get("out"):
                return cached
    values = evaluate(name, panel)
    values.write.mode("overwrite").parquet(path)
    cached = spark.read.parquet(path)
    ends = [df.agg(F.max("date").alias("d")).first()["d"] for df in (cached, panel)]
    if ends[0] != ends[1]:
        raise ValueError(f"factor {name} ends on {ends[0]}, the data on {ends[1]}")
    wanted["out"] = panel_signature(cached)
    spark.createDataFrame([(json.dumps(wanted, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
    return cached


def suspension_pollution(panel: DataFrame, h: int = 5) -> DataFrame:
    """``polluted``: whether any of the h + 1 days after a day has no turnover (a null is not zero)."""
    still = F.max((F.col("turn") == 0).cast("int")).over(by_code().rowsBetween(1, h + 1))
    return panel.select("di", "date", "code", (F.coalesce(still, F.lit(0)) == 1).alias("polluted"))


