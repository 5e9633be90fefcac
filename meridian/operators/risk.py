"""Styles, neutralisation and covariance.

Neutralisation is ordinary least squares per day, written as windows: values are
demeaned by day (and industry), then the styles are made orthogonal one after the other
(Frisch-Waugh-Lovell); a style without an own part is skipped. No Python runs and no day is gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.ts import forward_fill, pct_change, rolling, shift
from meridian.functions.xs import by_day, winsorize_mad, zscore
from meridian.operators.asof import pit_fill

STYLES = ("size", "beta", "momentum", "volatility", "liquidity")


def size_proxy(panel: DataFrame) -> DataFrame:
    """Log of close * volume / turn (a turn over 1e-6), at most 20 days old; zero volume gives null, as a logarithm of zero does."""
    worth = F.when(F.col("turn") > 1e-6, F.col("close") * F.col("volume") / F.col("turn"))
    cells = panel.withColumn("__size", F.ln(F.when(worth > 0, worth)))
    return cells.select("di", "date", "code", forward_fill(F.col("__size"), 20).alias("value"))


def build_styles(panel: DataFrame, beta_window: int = 250, beta_least: int = 150, long: int = 273, short: int = 21, vol: int = 60, vol_least: int = 40, liq: int = 21, liq_least: int = 10) -> DataFrame:
    """``di, date, code`` and one column per style.

    Beta is (E[xy] - E[x]E[y]) / (E[yy] - E[y]E[y]) over rolling windows, y the equal-weight market return; E[x] and E[y]
    skip their own nulls only, and the market series is rolled over days.
    """
    cells = panel.withColumn("ret", pct_change(F.col("adj_close")))
    market = cells.groupBy("di").agg(F.avg("ret").alias("mkt"))
    days = Window.orderBy("di").rowsBetween(-(beta_window - 1), 0)  # one row per day
    market = market.select("di", "mkt", *[F.when(F.count(x).over(days) >= beta_least, F.avg(x).over(days)).alias(n) for n, x in (("ey", F.col("mkt")), ("eyy", F.col("mkt") * F.col("mkt")))])
    worth = F.when(F.col("turn") > 1e-6, F.col("close") * F.col("volume") / F.col("turn"))
    cells = cells.join(F.broadcast(market), "di").withColumn("__size", F.ln(F.when(worth > 0, worth)))
    ex, exy = (rolling(F.avg, x, beta_window, beta_least) for x in (F.col("ret"), F.col("ret") * F.col("mkt")))
    flow = rolling(F.avg, F.col("turn"), liq, liq_least)
    return cells.select(
        "di", "date", "code", forward_fill(F.col("__size"), 20).alias("size"),
        F.try_divide(exy - ex * F.col("ey"), F.col("eyy") - F.col("ey") * F.col("ey")).alias("beta"),
        (F.try_divide(shift("adj_close", short), shift("adj_close", long)) - 1).alias("momentum"),
        rolling(F.stddev_samp, F.col("ret"), vol, vol_least).alias("volatility"), F.ln(F.when(flow > 0, flow)).alias("liquidity"),
    )


def value_style(panel: DataFrame, events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Book value known on the day over the unadjusted close."""
    known = pit_fill(events, calendar, panel).select("di", "code", F.col("value").alias("book"))
    return panel.select("di", "date", "code", "close").join(known, ["di", "code"]).select("di", "date", "code", F.when(F.col("close") > 1e-12, F.col("book") / F.col("close")).alias("value"))


def _prepared(styles: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Styles winsorised and standardised over their own non-null sets."""
    for name in names:
        styles = winsorize_mad(styles, name)
    return styles.select("di", "code", *[zscore(F.col(n)).alias(n) for n in names])


def _orthogonal(cells: DataFrame, y: str, names: tuple[str, ...], by: Window) -> DataFrame:
    """``y`` less its projection on the group's constant and the styles, in ``residual``; ``__x*`` are the orthogonal styles."""
    cells = cells.select("*", (F.col(y) - F.avg(y).over(by)).alias("__y"), *[(F.col(n) - F.avg(n).over(by)).alias(f"__x{k}") for k, n in enumerate(names)])
    for k in range(len(names)):
        x = F.col(f"__x{k}")
        norm = F.sum(x * x).over(by_day())
        later = ["__y", *[f"__x{j}" for j in range(k + 1, len(names))]]
        on = lambda c: F.when(norm > 1e-12, F.sum(x * F.col(c)).over(by_day()) / norm).otherwise(0.0)  # noqa: B023, E731
        cells = cells.withColumns({c: F.col(c) - on(c) * x for c in later})
    return cells.withColumn("residual", F.col("__y"))


def residualize(values: DataFrame, styles: DataFrame, names: tuple[str, ...], industry: DataFrame | None = None, min_names: int = 50) -> DataFrame:
    """``di, date, code, value``: daily residuals on standardised styles and, if given, industry dummies (``code, industry``) instead of a constant.

    A day is left out if fewer than max(min_names, number of industries + styles + 11) names have all values.
    """
    cells = values.join(_prepared(styles, names), ["di", "code"]).where(" AND ".join(f"{c} IS NOT NULL" for c in ("value", *names)))
    n_groups = 0
    if industry is not None:
        cells = cells.join(industry, "code", "left").withColumn("industry", F.coalesce("industry", F.lit("未分类")))
        n_groups = industry.select("industry").distinct().count()
    least = max(min_names, n_groups + len(names) + 1 + 10)
    cells = cells.withColumn("__n", F.count(F.lit(1)).over(by_day())).where(F.col("__n") >= least)
    by = Window.partitionBy("di", "industry") if industry is not None else by_day()
    return _orthogonal(cells, "value", names, by).select("di", "date", "code", F.col("residual").alias("value"))


def neutralize(values: DataFrame, *styles: DataFrame) -> DataFrame:
    """Daily residuals of ``value`` on a constant and raw styles; days with fewer complete names than styles and ten are left out."""
    names, cells = tuple(f"x{k}" for k in range(len(styles))), values.where("value IS NOT NULL")
    for name, style in zip(names, styles):
        cells = cells.join(style.select("di", "code", F.col("value").alias(name)).where(F.col(name).isNotNull()), ["di", "code"])
    cells = cells.withColumn("__n", F.count(F.lit(1)).over(by_day())).where(F.col("__n") >= len(styles) + 10)
    return _orthogonal(cells, "value", names, by_day()).select("di", "date", "code", F.col("residual").alias("value"))


def style_factor_returns(fwd1: DataFrame, styles: DataFrame, names: tuple[str, ...], industry: DataFrame | None = None, min_names: int = 100) -> tuple[DataFrame, DataFrame]:
    """Daily style coefficients (``di`` and one column per style) and residuals (``di, date, code, value``).

    One aggregate per day gives the cross products of the demeaned styles and values; the equations are solved on one row per day and the coefficients
    sent back. A style without a part of its own gets no coefficient.
    """
    cells = fwd1.join(_prepared(styles, names), ["di", "code"]).where(" AND ".join(f"{c} IS NOT NULL" for c in ("value", *names)))
    n_groups = 0
    if industry is not None:
        cells = cells.join(industry, "code", "left").withColumn("industry", F.coalesce("industry", F.lit("未分类")))
        n_groups = industry.select("industry").distinct().count()
    cells = cells.withColumn("__n", F.count(F.lit(1)).over(by_day())).where(F.col("__n") >= max(min_names, n_groups + len(names) + 10))
    by = Window.partitionBy("di", "industry") if industry is not None else by_day()
    centred = cells.select("di", "date", "code", *[(F.col(n) - F.avg(n).over(by)).alias(f"__x{k}") for k, n in enumerate(("value", *names))])
    solved = _solved(centred, len(names))
    coefficients = solved.select("di", *[F.col(f"b{k}").alias(n) for k, n in enumerate(names, 1)])
    fitted = sum((F.coalesce(F.col(f"b{k}"), F.lit(0.0)) * F.col(f"__x{k}") for k in range(1, len(names) + 1)), F.lit(0.0))
    residual = centred.join(F.broadcast(solved), "di").select("di", "date", "code", (F.col("__x0") - fitted).alias("value"))  # one row per day
    return coefficients, residual


def _solved(centred: DataFrame, k: int) -> DataFrame:
    """``di, b1..bk``: coefficients of ``__x1..__xk`` for ``__x0`` by elimination on the day's cross products; null for a style that the ones before it explain."""
    sums = centred.groupBy("di").agg(*[F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"s{i}_{j}") for i in range(1, k + 1) for j in (0, *range(i, k + 1))])
    at = lambda i, j: f"s{min(i, j)}_{max(i, j)}" if j else f"s{i}_0"
    for p in range(1, k + 1):  # forward: take style p out of the later ones
        free = F.col(at(p, p)) > 1e-12
        share = lambda i: F.when(free, F.col(at(p, i)) / F.col(at(p, p))).otherwise(0.0)  # noqa: B023, E731
        sums = sums.withColumns({at(i, j): F.col(at(i, j)) - share(i) * F.col(at(p, j)) for i in range(p + 1, k + 1) for j in (0, *range(i, k + 1))})
    for p in range(k, 0, -1):  # back substitution
        rest = F.col(at(p, 0))
        for i in range(p + 1, k + 1):
            rest = rest - F.col(at(p, i)) * F.coalesce(F.col(f"b{i}"), F.lit(0.0))
        sums = sums.withColumn(f"b{p}", F.when(F.col(at(p, p)) > 1e-12, rest / F.col(at(p, p))))
    return sums.select("di", *[f"b{p}" for p in range(1, k + 1)])


def half_life_weight(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(float(half_life)))


def ewm_cov(returns: DataFrame, names: tuple[str, ...], half_life: float, asof: int | None = None) -> DataFrame:
    """``a, b, cov``: exponentially weighted, bias-corrected covariances as of a day (the last one by default), in one aggregate."""
    rows = returns.dropna(subset=list(names))
    rows = rows.where(F.col("di") <= asof) if asof is not None else rows
    rows = rows.withColumn("w", half_life_weight(F.row_number().over(Window.orderBy(F.desc("di"))) - 1, half_life))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    w = F.col("w")
    sums = rows.agg(F.sum(w).alias("w"), F.sum(w * w).alias("ww"), *[F.sum(w * F.col(n)).alias(f"s_{n}") for n in names], *[F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in pairs])
    cov = lambda a, b: (F.col(f"s_{a}_{b}") / F.col("w") - F.col(f"s_{a}") * F.col(f"s_{b}") / (F.col("w") * F.col("w"))) * F.try_divide(F.col("w") * F.col("w"), F.col("w") * F.col("w") - F.col("ww"))
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cov(a, b).alias("cov")) for a, b in pairs])).alias("x")).select("x.*")


def specific_variance(residuals: DataFrame, last_di: int, half_life: float = 60, min_periods: int = 60) -> DataFrame:
    """``code, var``: exponentially weighted mean of squared residuals by calendar age; null with fewer than ``min_periods`` values."""
    w = half_life_weight(F.lit(last_di) - F.col("di"), half_life)
    rows = residuals.where((F.col("di") <= last_di) & F.col("value").isNotNull())
    return rows.groupBy("code").agg(F.when(F.count("value") >= min_periods, F.sum(w * F.col("value") * F.col("value")) / F.sum(w)).alias("var"))


def known_days(style_ret: DataFrame, days: DataFrame, names: tuple[str, ...], lag: int, min_obs: int) -> DataFrame:
    """``di, last``: for each day with at least ``min_obs`` factor returns known on it, the last of them; the newest ``lag`` up to the day are not known yet."""
    usable = style_ret.dropna(subset=list(names)).select(F.col("di").alias("last"))
    counted = usable.select("last", F.row_number().over(Window.orderBy("last")).alias("k"))  # one row per day
    upto = days.select("di").unionByName(counted.select(F.col("last").alias("di")), allowMissingColumns=True).distinct()
    upto = upto.join(counted.withColumnRenamed("last", "di"), "di", "left").select("di", F.max("k").over(Window.orderBy("di").rowsBetween(Window.unboundedPreceding, 0)).alias("k"))
    wanted = days.select("di").join(upto, "di").select("di", (F.col("k") - lag).alias("k")).where(F.col("k") >= min_obs)
    return wanted.join(counted, "k").select("di", "last")


def factor_covariances(style_ret: DataFrame, known: DataFrame, names: tuple[str, ...], half_life: float) -> DataFrame:
    """``di, cov``: for each day of ``known`` (``di, last``) the exponentially weighted, bias-corrected covariance matrix of the factor returns up to ``last``, row by row."""
    rows = style_ret.dropna(subset=list(names)).select(F.col("di").alias("at"), *names)
    # both sides have one row per day or rebalance
    rows = rows.join(F.broadcast(known), F.col("at") <= F.col("last"))
    age = F.row_number().over(Window.partitionBy("di").orderBy(F.desc("at"))) - 1
    rows = rows.withColumn("w", half_life_weight(age, half_life))
    w = F.col("w")
    sums = rows.groupBy("di").agg(F.sum(w).alias("w"), F.sum(w * w).alias("ww"), *[F.sum(w * F.col(n)).alias(f"s_{n}") for n in names], *[F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:]])
    pair = lambda a, b: F.col(f"s_{a}_{b}") if f"s_{a}_{b}" in sums.columns else F.col(f"s_{b}_{a}")
    unbiased = F.try_divide(w * w, w * w - F.col("ww"))
    return sums.select("di", F.array(*[(pair(a, b) / w - F.col(f"s_{a}") * F.col(f"s_{b}") / (w * w)) * unbiased for a in names for b in names]).alias("cov"))


def specific_variances(residuals: DataFrame, known: DataFrame, half_life: float, min_periods: int) -> DataFrame:
    """``di, code, var`` of every code for each day of ``known`` (``di, last``), as ``specific_variance`` has it at ``last``.

    Growing weights make all days running sums of one window per code, whatever the number of days asked for.
    """
    grow = F.pow(F.lit(2.0), F.col("at") / F.lit(float(half_life)))
    values = residuals.where("value IS NOT NULL").select(F.col("di").alias("at"), "code", F.lit(None).cast("int").alias("di"), grow.alias("w"), (grow * F.col("value") * F.col("value")).alias("q"))
    asked = [F.struct(F.lit(r["last"]).alias("at"), F.lit(r["di"]).alias("di")) for r in known.collect()]  # a row per day asked for
    if not asked:
        return values.select("di", "code", F.col("q").alias("var")).limit(0)
    none = F.lit(None).cast("double")
    marks = values.select("code").distinct().select("code", F.inline(F.array(*asked))).select("at", "code", "di", none.alias("w"), none.alias("q"))
    past = Window.partitionBy("code").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    sums = values.unionByName(marks).select("di", "code", F.count("w").over(past).alias("n"), (F.sum("q").over(past) / F.sum("w").over(past)).alias("var"))
    return sums.where(F.col("di").isNotNull()).select("di", "code", F.when(F.col("n") >= min_periods, F.col("var")).alias("var"))


def risk_inputs(days: DataFrame, styles: DataFrame, style_ret: DataFrame, residuals: DataFrame, names: tuple[str, ...], half_life_f: float = 90, half_life_s: float = 60, lag: int = 2, min_obs: int = 120) -> DataFrame:
    """``di, code``, exposures, ``var`` (specific) and ``cov`` (of the factors, the same in a day's rows) known on each of ``days``; days with fewer than ``min_obs`` factor returns are left out."""
    known = known_days(style_ret, days, names, lag, min_obs)
    spec = specific_variances(residuals, known, half_life_s, min_obs // 2).where("var > 0")
    exposures = _prepared(styles.join(F.broadcast(known.select("di")), "di", "left_semi"), names).dropna(subset=list(names))
    return exposures.join(spec, ["di", "code"]).join(F.broadcast(factor_covariances(style_ret, known, names, half_life_f)), "di")


def positive(cov: np.ndarray) -> np.ndarray:
    """A symmetric matrix without its negative eigenvalues."""
    values, vectors = np.linalg.eigh(cov)
    return (vectors * np.maximum(values, 0)) @ vectors.T


def sigma_at(di: int, styles: DataFrame, style_ret: DataFrame, residuals: DataFrame, names: tuple[str, ...], half_life_f: float = 90, half_life_s: float = 60, lag: int = 2, min_obs: int = 120) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Exposures (by code), factor covariance (no negative eigenvalue) and specific standard deviations known on a day.

    The last ``lag`` factor returns up to the day are not known yet. ``ValueError`` with fewer than ``min_obs`` of them. Sizes: one row per code of one day.
    """
    day = styles.sparkSession.createDataFrame([(di,)], "di int")
    rows = risk_inputs(day, styles, style_ret, residuals, names, half_life_f, half_life_s, lag, min_obs).orderBy("code").toPandas()
    if rows.empty:
        raise ValueError(f"too few factor returns are known on day {di}")
    cov = np.array(rows["cov"].iloc[0]).reshape(len(names), len(names))
    return rows.set_index("code")[list(names)], positive(cov), np.sqrt(rows["var"].to_numpy())
