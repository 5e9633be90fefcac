"""Normalising raw tables, the diagnostics and whole runs."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridian.operators import backtest, diagnose
from meridian.plans import assembly
from meridian.sources import normalise
from meridian.sources.panel import Panel

from .test_functions import long


def test_bars_from_text(spark, tmp_path):
    rows = [("2024-01-02", "a", "10", "x", "150", "1", "0"), ("2024-01-03", "a", None, "11", "", "0", "1"), ("bad", "b", "1", "2", "3.5", "1", None)]
    raw = spark.createDataFrame(rows, "date string, code string, open string, close string, turn string, tradestatus string, isST string")
    found = normalise.normalised_bars(raw).collect()
    assert [(r["open"], r["close"], r["turn"], r["is_trading"], r["is_st"]) for r in found] == [(10.0, None, 1.0, 1, 0), (None, 11.0, 0.0, 0, 1), (1.0, 2.0, pytest.approx(0.035), 1, 0)]
    assert found[2]["date"] is None
    adjusted = raw.limit(1).withColumn("close", F.lit("9"))
    assert [r["adj_close"] for r in normalise.with_adjusted(raw, adjusted).orderBy("date").collect()] == ["9", None, None]
    raw.write.parquet(str(tmp_path / "a"))
    raw.drop("isST").withColumn("isST", F.lit("1")).limit(1).write.parquet(str(tmp_path / "b"))
    assert normalise.merged_parts(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).count() == 4
    assert [r["code"] for r in normalise.union_of_lists(raw, raw.select(F.lit("c").alias("code"))).collect()] == ["a", "b", "c"]


def test_fundamentals_from_a_page(spark):
    raw = spark.createDataFrame([("1", "2.5", "2024-04-20"), ("600000", "-1", "2024-04-21"), ("2", "?", "2024-04-20"), ("3", "1", None)], "c string, v string, d string")
    found = normalise.normalised_fundamentals(raw, "2024-03-31", {"code": "c", "value": "v", "pub_date": "d"})
    assert found.columns == list(normalise.EVENTS) and [(r["code"], r["value"], str(r["report_date"])) for r in found.collect()] == [("000001", 2.5, "2024-03-31"), ("600000", -1.0, "2024-03-31")]
    codes = spark.createDataFrame([("600000",), ("300001",), ("000001",), ("830001",)], "c string").select(normalise.exchange_code(F.col("c"))).collect()
    assert [r[0] for r in codes] == ["sh.600000", "sz.300001", "sz.000001", None]
    assert normalise.report_quarters("2023-12-31", "2024-06-30") == ["2023-12-31", "2024-03-31", "2024-06-30"]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"paths": {"data": "x/../y"}, "q": 5}))
    assert normalise.load_config(str(tmp_path / "c.json")) == {"paths": {"data": str(tmp_path / "y")}, "q": 5}


def test_overlay_and_windows(spark):
    net = spark.createDataFrame([(k, 0.01 * (k % 3)) for k in range(30)], "di int, ret double")
    bench = net.withColumn("ret", F.col("ret") * 0.5).where("di < 20")
    row, x = backtest.overlay(net, bench, 50).first(), pd.Series([0.005 * (k % 3) for k in range(20)])
    assert row["n"] == 20 and row["excess"] == pytest.approx(x.mean() * 50) and row["information_ratio"] == pytest.approx(x.mean() / x.std() * 50**0.5)
    ic = long(spark, pd.DataFrame({"a": [1.0, 2.0, 3.0]}), "ic")
    found = {r["window"]: (r["mean"], r["n"]) for r in diagnose.by_window(ic, {"all": ("2024-01-01", "2024-12-31"), "two": ("2024-01-02", "2024-01-03")}).collect()}
    assert found == {"all": (2.0, 3), "two": (2.5, 2)}


def test_whole_runs(spark, tmp_path):
    """A context, a factor's study, a composite with its book, the discipline block and a report table on the small tables."""
    ctx = assembly.build_context(spark, "/root/testdata/sf0.001", min_names=4, styles=("size",), style_windows={"beta_window": 52, "beta_least": 26, "long": 52, "short": 4, "vol": 26, "vol_least": 13, "liq": 8, "liq_least": 4})
    study = assembly.one_factor(ctx, "rev_5")
    assert study["summary"]["factor"] == "rev_5"
    run = assembly.composite_and_portfolio(ctx, ("rev_5", "vol_20"), 2, 3, 5)
    assert "ann_ret" in assembly.md_table(run["metrics"]) and run["overlay"].first()["n"] > 50
    strategies = ctx.fwd1.where("code IN ('sh.6000004', 'sz.0000001')").select(F.col("di").alias("t"), F.col("code").alias("strategy"), F.coalesce("value", F.lit(0.0)).alias("ret"))
    block = assembly.discipline_block(run["net"], strategies, 10, 4)
    assert block["n_combinations"] == 6 and 0 <= block["dsr"] <= 1
    assert assembly.guard(lambda: 1 / 0, "x") == {"failed": "x", "error": "ZeroDivisionError: division by zero"}
    path = str(tmp_path / "long")
    ctx.panel.save(path)
    again = Panel.load(spark, path)
    assert again.grid.count() == ctx.panel.grid.count()
    again.release()
