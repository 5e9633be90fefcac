"""Signal evaluation: labels, rank information coefficients and their statistics, quantile returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.ts import by_code, shift
from meridian.functions.xs import bucket, correlation, rank_average, rank_pct

YEAR_DAYS = 252


def forward_returns(panel: DataFrame, h: int) -> DataFrame:
    """Return from the next day's price to h days later; null if either price is missing."""
    return panel.select("di", "date", "code", (F.try_divide(shift("adj_close", -(1 + h)), shift("adj_close", -1)) - 1).alias("value"))


def paired(factor: DataFrame, label: DataFrame) -> DataFrame:
    """Cells where both are present: ``di, date, code, f, y``."""
    y = label.select("di", "code", F.col("value").alias("y")).where("y IS NOT NULL")
    return factor.select("di", "date", "code", F.col("value").alias("f")).where("f IS NOT NULL").join(y, ["di", "code"])


def ic_of(pairs: DataFrame, *keys: str, min_names: int = 30) -> DataFrame:
    """Daily Spearman correlation of ``f`` and ``y`` over pairs, by ``di`` (and keys); days with few names or no spread are left out."""
    day = Window.partitionBy("di", *keys)
    ranked = pairs.withColumn("n", F.count(F.lit(1)).over(day)).where(F.col("n") >= min_names)
    ranked = ranked.select("di", "date", *keys, rank_average(F.col("f"), *keys).alias("a"), rank_average(F.col("y"), *keys).alias("b"))
    return ranked.groupBy("di", "date", *keys).agg(correlation(F.col("a"), F.col("b")).alias("ic")).where("ic IS NOT NULL")


def ic_series(factor: DataFrame, label: DataFrame, min_names: int = 30) -> DataFrame:
    """``di, date, ic``: ranks are taken among the names that have both values."""
    return ic_of(paired(factor, label), min_names=min_names)


def _moments(ic: DataFrame, lag: int | str, column: str, keys: tuple[str, ...], most: int) -> DataFrame:
    """By ``keys``, in one aggregate: mean ``m``, deviation ``sd``, rows ``n`` and long-run variance ``s`` over ``lag`` rows (a number, or a key that holds it, of at most ``most``)."""
    order = Window.partitionBy(*keys).orderBy("di") if keys else Window.orderBy("di")
    whole = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(whole)
    rows = ic.select(*keys, "di", F.col(column).alias("x"), (F.col(column) - F.avg(column).over(whole)).alias("d"), F.avg(column).over(whole).alias("m"), n.alias("n"))
    width = F.least(F.col(lag) if isinstance(lag, str) else F.lit(lag), F.col("n") - 1)
    rows = rows.select("*", width.alias("width"), *[F.lag("d", k).over(order).alias(f"d{k}") for k in range(1, most + 1)])
    weight = lambda k: F.when(F.col("width") >= k, 2 * (1 - F.lit(float(k)) / (F.col("width") + 1))).otherwise(0.0)
    each = F.col("d") * F.col("d")
    for k in range(1, most + 1):
        each = each + F.coalesce(weight(k) * F.col("d") * F.col(f"d{k}"), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.first("m").alias("m"), F.stddev_samp("x").alias("sd"), F.count("x").alias("n"), (F.sum(each) / F.first("n")).alias("s"))


def _nw_t() -> Column:
    return F.when((F.col("n") >= 2) & (F.col("s") > 0), F.col("m") / F.sqrt(F.col("s") / F.col("n")))


def newey_west(ic: DataFrame, lag: int, column: str = "ic", *keys: str) -> DataFrame:
    """``nw_t`` of a mean with Bartlett weights over ``lag`` autocovariances (at most n - 1), each divided by n.

    Lags count rows of the series, not calendar days. Null with under two rows or without variance.
    """
    return _moments(ic, lag, column, keys, lag).select(*keys, "n", _nw_t().alias("nw_t"))


def ic_summary(ic: DataFrame, horizon: int | str, *keys: str, most: int | None = None) -> DataFrame:
    """``ic_mean, icir, t_cons, nw_t, n``: the conservative t counts one independent reading per horizon.

    The horizon is a number, or the key that holds it (then ``most`` is the largest).
    """
    base = _moments(ic, horizon, "ic", keys, horizon if most is None else most)
    ratio = F.try_divide(F.col("m"), F.col("sd"))
    t = ratio * F.sqrt(F.greatest(F.col("n") / (F.col(horizon) if isinstance(horizon, str) else F.lit(float(horizon))), F.lit(1.0)))
    return base.select(*keys, F.bround("m", 4).alias("ic_mean"), F.bround(ratio, 3).alias("icir"), F.bround(t, 2).alias("t_cons"), F.bround(_nw_t(), 2).alias("nw_t"), "n")


def yearly_table(ic: DataFrame) -> DataFrame:
    out = ic.groupBy(F.year("date").alias("year")).agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), F.count("ic").alias("n"))
    return out.select("year", F.bround("m", 4).alias("ic_mean"), F.bround(F.try_divide("m", "s"), 3).alias("icir"), "n", (F.col("m") > 0).alias("positive"))


def monthly_matrix(ic: DataFrame) -> DataFrame:
    """Mean by year and month, one column per month (m1..m12)."""
    out = ic.withColumn("month", F.month("date")).groupBy(F.year("date").alias("year")).pivot("month", list(range(1, 13)))
    return out.agg(F.avg("ic")).select("year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


def rank_autocorr(factor: DataFrame, lag: int = 5) -> DataFrame:
    """Mean over days of the correlation of percentile ranks with those ``lag`` days earlier; the factor need not have a row for every day."""
    ranks = factor.select("di", "code", rank_pct(F.col("value")).alias("r"))
    before = F.first("r").over(by_code().rangeBetween(-lag, -lag))
    ranks = ranks.select("di", "r", before.alias("before")).where("r IS NOT NULL AND before IS NOT NULL")
    daily = ranks.groupBy("di").agg(correlation(F.col("r"), F.col("before")).alias("c"))
    return daily.agg(F.bround(F.avg("c"), 4).alias("rank_autocorr"))


def orient(factor: DataFrame, label: DataFrame) -> DataFrame:
    """One row, ``sign``: the sign of the mean daily correlation of ranks, each taken over its own non-null set; -1 without any."""
    y = label.select("di", "code", rank_pct(F.col("value")).alias("b"))
    pairs = factor.select("di", "code", rank_pct(F.col("value")).alias("a")).join(y, ["di", "code"]).where("a IS NOT NULL AND b IS NOT NULL")
    daily = pairs.groupBy("di").agg(correlation(F.col("a"), F.col("b")).alias("c"))
    return daily.agg(F.avg("c").alias("m")).select(F.when(F.col("m") >= 0, 1).otherwise(-1).alias("sign"), F.col("m").alias("mean_corr"))


def oriented(factor: DataFrame, label: DataFrame) -> DataFrame:
    """The factor, turned so that larger values are better."""
    sign = orient(factor, label).first()["sign"]
    return factor.withColumn("value", F.col("value") * F.lit(float(sign)))


def quantile_returns(factor: DataFrame, fwd1: DataFrame, q: int = 5) -> DataFrame:
    """Mean next-day return per bucket (q1..qq) and day, and the top less the bottom (``ls``); days without any are left out."""
    named = factor.select("di", "date", "code", bucket(F.col("value"), q).alias("bucket")).where("bucket IS NOT NULL")
    y = fwd1.select("di", "code", F.col("value").alias("y")).where("y IS NOT NULL")
    means = [F.avg(F.when(F.col("bucket") == k, F.col("y"))).alias(f"q{k}") for k in range(1, q + 1)]
    return named.join(y, ["di", "code"]).groupBy("di", "date").agg(*means).withColumn("ls", F.col(f"q{q}") - F.col("q1"))


def horizon_profile(factor: DataFrame, panel: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20), min_names: int = 30) -> DataFrame:
    """``ic_summary`` per horizon against raw forward returns, in one job: the horizon is a grouping key."""
    ahead = [F.struct(F.lit(h).alias("h"), (F.try_divide(shift("adj_close", -(1 + h)), shift("adj_close", -1)) - 1).alias("y")) for h in horizons]
    labels = panel.select("di", "code", F.array(*ahead).alias("a")).select("di", "code", F.inline("a")).where("y IS NOT NULL")
    pairs = factor.select("di", "date", "code", F.col("value").alias("f")).where("f IS NOT NULL").join(labels, ["di", "code"])
    return ic_summary(ic_of(pairs, "h", min_names=min_names), "h", "h", most=max(horizons))


def run_panel(name: str, factor: DataFrame, panel: DataFrame, horizon: int = 5, q: int = 5, min_names: int = 30, label: DataFrame | None = None, fwd1: DataFrame | None = None, periods: int = YEAR_DAYS) -> dict:
    """The tear sheet: summary scalars and the tables as DataFrames; ``periods`` is the number of rows of the calendar in a year."""
    label = forward_returns(panel, horizon) if label is None else label
    fwd1 = forward_returns(panel, 1) if fwd1 is None else fwd1
    ic = ic_series(factor, label, min_names).persist()
    buckets = quantile_returns(factor, fwd1, q).persist()
    top = ic_summary(ic, horizon).first()
    summary = {"factor": name, **top.asDict(), "rank_autocorr": rank_autocorr(factor).first()[0], "ls_annual": (buckets.agg(F.avg("ls")).first()[0] or 0.0) * periods}
    return {"summary": summary, "ic": ic, "yearly": yearly_table(ic), "monthly": monthly_matrix(ic), "quantiles": buckets}


def coverage(factor: DataFrame, panel: DataFrame, days: int = 252) -> DataFrame:
    """Mean over the last ``days`` days of the share of closes that have a value."""
    last = panel.agg(F.max("di")).first()[0] or 0
    have = factor.where(F.col("di") > last - days).groupBy("di").agg(F.count("value").alias("n"))
    of = panel.where(F.col("di") > last - days).groupBy("di").agg(F.count("close").alias("m"))
    return have.join(of, "di").agg(F.avg(F.try_divide("n", "m")).alias("coverage"))
