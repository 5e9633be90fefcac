import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridian.functions.ts import forward_fill, pct_change, rolling, rolling_median, shift
from meridian.functions.xs import bucket, clip, rank_pct, winsorize_mad, zscore

START = dt.date(2024, 1, 1)


def long(spark, wide: pd.DataFrame, name: str = "value"):
    """A wide frame (rows are days) as a dense long one."""
    rows = [(i, START + dt.timedelta(days=i), c, None if pd.isna(v) else float(v)) for i, row in enumerate(wide.to_dict("records")) for c, v in row.items()]
    return spark.createDataFrame(rows, f"di int, date date, code string, {name} double")


def wide(df, name: str = "value") -> pd.DataFrame:
    found = df.select("di", "code", name).toPandas()
    return found.pivot(index="di", columns="code", values=name).astype(float).rename_axis(index=None, columns=None)


@pytest.fixture(scope="session")
def walk():
    rng = np.random.default_rng(7)
    prices = pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0, 0.02, (60, 12)), axis=0)), columns=[f"s{k:02}" for k in range(12)])
    return prices.mask(rng.random(prices.shape) < 0.1)


def same(a: pd.DataFrame, b: pd.DataFrame):
    np.testing.assert_allclose(a.reindex_like(b).to_numpy(), b.to_numpy(), rtol=1e-9, atol=1e-12)


def test_calendar_windows_match_pandas(spark, walk):
    x = F.col("value")
    df = long(spark, walk)
    cases = {
        "lag": (shift(x, 3), walk.shift(3)), "lead": (shift(x, -2), walk.shift(-2)), "change": (pct_change(x), walk.pct_change(fill_method=None)),
        "mean": (rolling(F.avg, x, 10, 6), walk.rolling(10, min_periods=6).mean()), "std": (rolling(F.stddev_samp, x, 10, 6), walk.rolling(10, min_periods=6).std()),
        "median": (rolling_median(x, 9, 5), walk.rolling(9, min_periods=5).median()), "fill": (forward_fill(x, 1), walk.ffill(limit=1)), "fill_all": (forward_fill(x), walk.ffill()),
    }
    for column, expected in cases.values():
        same(wide(df.select("di", "code", column.alias("value"))), expected)


def test_cross_sections_match_pandas(spark, walk):
    ties = walk.round(0)
    x = F.col("value")
    df = long(spark, ties)
    same(wide(df.select("di", "code", rank_pct(x).alias("value"))), ties.rank(axis=1, pct=True))
    same(wide(df.select("di", "code", zscore(x).alias("value"))), ties.sub(ties.mean(axis=1), axis=0).div(ties.std(axis=1), axis=0))
    same(wide(df.select("di", "code", bucket(x, 5).cast("double").alias("value"))), np.ceil(ties.rank(axis=1, pct=True) * 5))
    middle = ties.median(axis=1)
    spread = 1.4826 * ties.sub(middle, axis=0).abs().median(axis=1)
    same(wide(winsorize_mad(df, "value", 1.0)), ties.clip(middle - spread, middle + spread, axis=0))


def test_empty_and_constant_days(spark):
    flat = long(spark, pd.DataFrame({"a": [1.0, np.nan], "b": [1.0, np.nan]}))
    assert [r["z"] for r in flat.select(zscore(F.col("value")).alias("z")).collect()] == [None] * 4
    assert flat.select(clip(F.col("value"), F.lit(2.0), F.lit(3.0)).alias("c")).where("c IS NULL").count() == 2
