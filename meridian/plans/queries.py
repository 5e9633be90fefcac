"""Queries over the driver's tables, one per operator.

Every query starts from the weekly panel of order lines (``Panel.of``). Doubles are rounded to eight decimals, so that the order of
additions does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions.xs import rank_pct, winsorize_mad, zscore
from meridian.operators import asof, backtest, diagnose, discipline, factors, model, optimizer, risk, strategy, universe
from meridian.operators import evaluate as ev
from meridian.sources import normalise
from meridian.sources.panel import Panel, calendar_of, code_of, densify, fundamentals, industries, membership, weekly_bars

Query = Callable[[SparkSession, str], DataFrame]
HORIZON, MIN_NAMES, PERIODS = 5, 30, 52  # rows of the weekly calendar
GROWTH_SINCE = "1998-08-24"
STYLE_WINDOWS = {"beta_window": 52, "beta_least": 26, "long": 52, "short": 4, "vol": 26, "vol_least": 13, "liq": 8, "liq_least": 4}
COMPOSITE = ("rev_5", "vol_20", "amihud_20")


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def present(df: DataFrame) -> DataFrame:
    return rounded(df.where("value IS NOT NULL").select("date", "code", "value"))


def _factor(name: str) -> Query:
    return lambda spark, d: present(factors.evaluate(name, Panel.of(spark, d).grid))


def _ic(spark: SparkSession, d: str, min_names: int = MIN_NAMES) -> DataFrame:
    grid = Panel.of(spark, d).grid
    return ev.ic_series(factors.evaluate("rev_5", grid), ev.forward_returns(grid, HORIZON), min_names)


def panel_weekly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weekly_bars(spark.read.parquet(f"{d}/lineitem.parquet")))


def panel_dense_grid(spark: SparkSession, d: str) -> DataFrame:
    bars = weekly_bars(spark.read.parquet(f"{d}/lineitem.parquet"))
    days = calendar_of(bars)
    return rounded(densify(bars, days, days.count()).select("di", "date", "code", "close", "turn", "is_trading"))


def calendar_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return Panel.of(spark, d).calendar.select("date", "di")


def xs_rank_pct(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    return rounded(grid.select("date", "code", rank_pct(F.col("amount")).alias("value")).where("value IS NOT NULL"))


def xs_winsorize_mad(spark: SparkSession, d: str) -> DataFrame:
    return present(winsorize_mad(Panel.of(spark, d).grid.select("date", "di", "code", F.col("amount").alias("value")), "value", 1.5))


def xs_zscore(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    return rounded(grid.select("date", "code", zscore(F.col("close")).alias("value")).where("value IS NOT NULL"))


def ic_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_ic(spark, d).select("date", "ic"))


def ic_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.ic_summary(_ic(spark, d), HORIZON).drop("nw_t")


def ic_yearly(spark: SparkSession, d: str) -> DataFrame:
    return ev.yearly_table(_ic(spark, d))


def ic_monthly_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.monthly_matrix(_ic(spark, d)))


def newey_west_t(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.newey_west(_ic(spark, d), HORIZON))


def horizon_profile(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    return ev.horizon_profile(factors.evaluate("rev_5", grid), grid, min_names=MIN_NAMES).drop("nw_t")


def rank_autocorr(spark: SparkSession, d: str) -> DataFrame:
    return ev.rank_autocorr(factors.evaluate("vol_20", Panel.of(spark, d).grid))


def orient_sign(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    return rounded(ev.orient(factors.evaluate("rev_5", grid), ev.forward_returns(grid, HORIZON)))


def quantile_returns(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    return rounded(ev.quantile_returns(factors.evaluate("rev_5", grid), ev.forward_returns(grid, 1)).drop("di"))


def tear_sheet(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    found = ev.run_panel("rev_5", factors.evaluate("rev_5", grid), grid, HORIZON, min_names=MIN_NAMES, periods=PERIODS)["summary"]
    return spark.createDataFrame([found], "factor string, ic_mean double, icir double, t_cons double, nw_t double, n long, rank_autocorr double, ls_annual double")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    return rounded(ev.coverage(factors.evaluate("vol_20", grid), grid))


def _styles(spark: SparkSession, d: str) -> DataFrame:
    return risk.build_styles(Panel.of(spark, d).grid, **STYLE_WINDOWS)


def _style(name: str) -> Query:
    return lambda spark, d: present(_styles(spark, d).withColumnRenamed(name, "value"))


def neutralize_size(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    return present(risk.neutralize(factors.evaluate("rev_5", grid), risk.size_proxy(grid)))


def neutralize_two_styles(spark: SparkSession, d: str) -> DataFrame:
    grid, styles = Panel.of(spark, d).grid, _styles(spark, d)
    return present(risk.neutralize(factors.evaluate("rev_5", grid), *[styles.select("di", "code", F.col(n).alias("value")) for n in ("size", "volatility")]))


def residualize_industry_size(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    size = risk.size_proxy(grid).withColumnRenamed("value", "size")
    return present(risk.residualize(factors.evaluate("rev_5", grid), size, ("size",), industries(spark, d)))


def residualize_multi_style(spark: SparkSession, d: str) -> DataFrame:
    return present(risk.residualize(factors.evaluate("rev_5", Panel.of(spark, d).grid), _styles(spark, d), ("size", "volatility")))


def pit_fundamental_asof(spark: SparkSession, d: str) -> DataFrame:
    panel = Panel.of(spark, d)
    return present(asof.pit_fill(fundamentals(spark, d), panel.calendar, panel.grid))


def value_btop(spark: SparkSession, d: str) -> DataFrame:
    panel = Panel.of(spark, d)
    return present(risk.value_style(panel.grid, fundamentals(spark, d), panel.calendar))


def membership_asof(spark: SparkSession, d: str) -> DataFrame:
    panel = Panel.of(spark, d)
    return asof.membership_asof(membership(panel.bars), panel.calendar, panel.bars).join(panel.calendar, "di").select("date", "code")


def pit_universe(spark: SparkSession, d: str) -> DataFrame:
    panel = Panel.of(spark, d)
    n = max(5, panel.bars.select("code").distinct().count() // 2)
    return universe.pit_universe(membership(panel.bars), panel.grid, panel.calendar, 26, top_n=n, days=26, least=17).drop("di")


def tradability_masks(spark: SparkSession, d: str) -> DataFrame:
    return universe.tradability(Panel.of(spark, d).grid, growth_since=GROWTH_SINCE).drop("di")


def suspension_pollution(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    quiet = grid.withColumn("turn", F.when(F.col("is_trading") == 1, F.col("turn")).otherwise(0.0))
    return factors.suspension_pollution(quiet, HORIZON).drop("di")


def factor_returns(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    size = risk.size_proxy(grid).withColumnRenamed("value", "size")
    coefficients, _ = risk.style_factor_returns(ev.forward_returns(grid, 1), size, ("size",), min_names=MIN_NAMES)
    return rounded(coefficients.join(Panel.of(spark, d).calendar, "di").select("date", "size"))


def _two_styles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    grid = Panel.of(spark, d).grid
    return risk.style_factor_returns(ev.forward_returns(grid, 1), _styles(spark, d), ("size", "volatility"), min_names=MIN_NAMES)


def ewm_cov(spark: SparkSession, d: str) -> DataFrame:
    """Of a leg pair's daily returns, so that the SQL twin needs no regression."""
    grid = Panel.of(spark, d).grid
    q = ev.quantile_returns(factors.evaluate("rev_5", grid), ev.forward_returns(grid, 1))
    return rounded(risk.ewm_cov(q.select("di", "q1", "q5"), ("q1", "q5"), 26))


def ewm_spec_var(spark: SparkSession, d: str) -> DataFrame:
    panel = Panel.of(spark, d)
    return rounded(risk.specific_variance(ev.forward_returns(panel.grid, 1), panel.n_days - 3, 26, 60))


def covariance_inputs(spark: SparkSession, d: str) -> DataFrame:
    coefficients, _ = _two_styles(spark, d)
    return rounded(coefficients)


def _composite_parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    grid = Panel.of(spark, d).grid
    return {name: factors.evaluate(name, grid) for name in COMPOSITE}


def composite_equal_weight(spark: SparkSession, d: str) -> DataFrame:
    return present(strategy.equal_weight(_composite_parts(spark, d)))


def composite_icir(spark: SparkSession, d: str) -> DataFrame:
    panel = Panel.of(spark, d)
    return present(strategy.icir_weight(_composite_parts(spark, d), ev.forward_returns(panel.grid, HORIZON), panel.calendar, HORIZON, 52, 26, min_names=MIN_NAMES))


def _book(spark: SparkSession, d: str) -> tuple[Panel, DataFrame]:
    panel = Panel.of(spark, d)
    n = panel.bars.select("code").distinct().count()
    return panel, strategy.topn_buffer_weights(factors.evaluate("rev_5", panel.grid), panel.calendar, max(2, n // 10), max(3, n // 6), 5)


def topn_buffer_weights(spark: SparkSession, d: str) -> DataFrame:
    panel, weights = _book(spark, d)
    return rounded(weights.join(panel.calendar, "di").select("date", "code", "weight"))


def turnover(spark: SparkSession, d: str) -> DataFrame:
    panel, weights = _book(spark, d)
    return rounded(strategy.turnover_series(weights, panel.grid))


def portfolio_returns(spark: SparkSession, d: str) -> DataFrame:
    panel, weights = _book(spark, d)
    return rounded(strategy.portfolio_returns(weights, ev.forward_returns(panel.grid, 1)))


def target_holdings(spark: SparkSession, d: str) -> DataFrame:
    panel, weights = _book(spark, d)
    return rounded(strategy.targets(weights, panel.n_days - 1))


def _layered(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    return backtest.layered_backtest(factors.evaluate("rev_5", grid), ev.forward_returns(grid, 1))


def layered_backtest_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_layered(spark, d))


def layered_metrics(spark: SparkSession, d: str) -> DataFrame:
    return backtest.metrics(_layered(spark, d), "ret", "leg", periods=PERIODS)


def overlay_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The top leg over the equal-weight market."""
    market = ev.forward_returns(Panel.of(spark, d).grid, 1).groupBy("di").agg(F.avg("value").alias("ret"))
    return rounded(backtest.overlay(_layered(spark, d).where("leg = 'top'"), market, PERIODS))


def rolling_prior(spark: SparkSession, d: str) -> DataFrame:
    return rounded(strategy.rolling_prior(_ic(spark, d), Panel.of(spark, d).calendar, HORIZON, 52, 26))


def prior_asof(spark: SparkSession, d: str) -> DataFrame:
    """The coefficient known on every 20th day, negative and missing ones as zero."""
    return rounded(asof.latest_known(_ic(spark, d), Panel.of(spark, d).calendar.where("di % 20 = 0"), "ic", floor=0.0))


def execution_days(spark: SparkSession, d: str) -> DataFrame:
    return asof.next_day(Panel.of(spark, d).calendar)


def upsert_periods(spark: SparkSession, d: str) -> DataFrame:
    """Fundamentals with the quarters of 1998 fetched again, doubled."""
    events = fundamentals(spark, d)
    return rounded(asof.upsert_periods(events, events.where("year(report_date) = 1998").withColumn("value", F.col("value") * 2)))


def _polluted(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    return factors.suspension_pollution(grid.withColumn("turn", F.when(F.col("is_trading") == 1, F.col("turn")).otherwise(0.0)), HORIZON)


def pollution_by_year(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    label = ev.forward_returns(grid, HORIZON)
    return rounded(diagnose.pollution_by_year(factors.evaluate("rev_5", grid), label, _polluted(spark, d), label))


def ic_without_polluted(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    return rounded(ev.ic_series(diagnose.without_polluted(factors.evaluate("rev_5", grid), _polluted(spark, d)), ev.forward_returns(grid, HORIZON), 10).select("date", "ic"))


def realisation_rate(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients against the forward return less what size explains, and against the raw one."""
    grid = Panel.of(spark, d).grid
    label = ev.forward_returns(grid, HORIZON)
    return rounded(diagnose.realisation(factors.evaluate("rev_5", grid), risk.neutralize(label, risk.size_proxy(grid)), label, MIN_NAMES), 6)


def attribution_windows(spark: SparkSession, d: str) -> DataFrame:
    windows = {"first half of 1998": ("1998-01-01", "1998-06-30"), "1998": ("1998-01-01", "1998-12-31"), "autumn 2000": ("2000-09-01", "2000-11-30"), "never": ("1980-01-01", "1980-12-31")}
    return rounded(diagnose.by_window(_ic(spark, d), windows))


def style_totals(spark: SparkSession, d: str) -> DataFrame:
    coefficients, _ = _two_styles(spark, d)
    return rounded(diagnose.style_totals(coefficients, ("size", "volatility")), 6)


def universe_union(spark: SparkSession, d: str) -> DataFrame:
    """The names of two lists: suppliers of nations 0 to 4, and those with over 5,000 in their account."""
    lists = industries(spark, d).join(spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 5"), F.col("industry") == F.col("n_name"), "left_semi")
    rich = spark.read.parquet(f"{d}/supplier.parquet").where("s_acctbal > 5000").select(code_of("s_suppkey").alias("code"))
    return normalise.union_of_lists(lists, rich)


def raw_with_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Bars as text, normalised, with the closes of trading weeks as adjusted ones."""
    bars = weekly_bars(spark.read.parquet(f"{d}/lineitem.parquet"))
    text = bars.select("date", "code", *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume", "amount")], F.when(F.col("is_st") == 1, "-").otherwise((F.col("turn") * 100).cast("string")).alias("turn"), F.col("is_trading").cast("string").alias("tradestatus"), F.col("is_st").cast("string").alias("isST"))
    return rounded(normalise.normalised_bars(normalise.with_adjusted(text, bars.where("is_trading = 1"))))


def normalised_fundamentals(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a raw page of one period: some balances are no numbers, some dates are missing."""
    raw = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("amount"), F.when(F.col("c_custkey") % 5 != 0, F.date_add(F.lit("1998-04-01").cast("date"), (F.col("c_custkey") % 60).cast("int")).cast("string")).alias("told"), F.col("c_name").alias("name"))
    found = normalise.normalised_fundamentals(raw, "1998-03-31", {"code": "id", "value": "amount", "pub_date": "told"})
    return rounded(found.withColumn("code", normalise.exchange_code(F.translate("code", "12", "63"))).where("code IS NOT NULL"))


def series_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(discipline.series_moments(_layered(spark, d).where("leg = 'ls'")), 6)


def portfolio_sweep(spark: SparkSession, d: str) -> DataFrame:
    panel = Panel.of(spark, d)
    n, fwd1 = panel.bars.select("code").distinct().count(), ev.forward_returns(panel.grid, 1)
    market = fwd1.groupBy("di").agg(F.avg("value").alias("ret"))
    choices = [(max(2, n // 10), max(3, n // buffer), days) for days, buffer in ((5, 8), (10, 5))]
    return strategy.sweep(factors.evaluate("rev_5", panel.grid), panel.calendar, panel.grid, fwd1, market, choices, periods=PERIODS)


def layered_backtest_masked(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    masks = universe.tradability(grid, growth_since=GROWTH_SINCE)
    return rounded(backtest.layered_backtest_masked(factors.evaluate("rev_5", grid), ev.forward_returns(grid, 1), masks))


def optimizer_solve(spark: SparkSession, d: str) -> DataFrame:
    """One problem per week: expected returns from the reversal factor, diagonal risk."""
    grid = Panel.of(spark, d).grid
    cells = factors.evaluate("rev_5", grid).where("value IS NOT NULL").withColumnRenamed("value", "alpha")
    cells = cells.join(factors.evaluate("vol_20", grid).select("di", "code", F.col("value").alias("vol")).where("vol > 0"), ["di", "code"])
    sizes = cells.groupBy("di").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    cells = cells.join(sizes, "di").select(F.col("di").alias("problem"), "code", (F.col("alpha") * 0.01).alias("alpha"), (F.col("vol") * F.col("vol")).alias("var"), (1.0 / F.col("n")).alias("base"))
    return optimizer.solve_groups(cells, 20.0, 0.0015, 0.2)


def optimizer_backtest(spark: SparkSession, d: str) -> DataFrame:
    panel = Panel.of(spark, d)
    fwd1 = ev.forward_returns(panel.grid, 1)
    names = ("size", "volatility")
    styles = _styles(spark, d).persist()
    style_ret, residuals = risk.style_factor_returns(fwd1, styles, names, min_names=MIN_NAMES)
    style_ret, residuals = style_ret.persist(), residuals.persist()
    everyone = panel.grid.select("di", "code", F.col("close").isNotNull().alias("in_universe"))
    n = panel.bars.select("code").distinct().count()
    out = optimizer.optimizer_backtest(factors.evaluate("rev_5", panel.grid), fwd1, everyone, styles, style_ret, residuals, names, cap=max(0.05, 4 / n), tau=0.0015, warmup_obs=60, min_members=MIN_NAMES, periods=PERIODS)
    return out["series"]


def _strategies(spark: SparkSession, d: str) -> DataFrame:
    """Monthly spreads of brands: average discounted price of each brand over the month's mean, less one; months without all brands are left out, as the test needs every strategy."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_shipdate", (F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("p"))
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_brand").alias("strategy"))
    cells = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("t"), "strategy").agg(F.avg("p").alias("p"))
    full = cells.groupBy("t").agg(F.count(F.lit(1)).alias("k"), F.avg("p").alias("m"))
    most = cells.select("strategy").distinct().count()
    return cells.join(full.where(F.col("k") == most), "t").select("t", "strategy", (F.col("p") / F.col("m") - 1).alias("ret"))


def pbo_cscv(spark: SparkSession, d: str) -> DataFrame:
    """Eight blocks, as in the SQL twin; ``pbo_cscv_full`` has the operator's 16."""
    return rounded(discipline.pbo_cscv(_strategies(spark, d), 8), 6)


def pbo_cscv_full(spark: SparkSession, d: str) -> DataFrame:
    return rounded(discipline.pbo_cscv(_strategies(spark, d)), 6)


def noise_control(spark: SparkSession, d: str) -> DataFrame:
    """Eight arms, as in the SQL twin; ``noise_control_full`` has the operator's 20."""
    grid = Panel.of(spark, d).grid
    return rounded(discipline.noise_control(factors.evaluate("rev_5", grid), ev.forward_returns(grid, HORIZON), 8, MIN_NAMES))


def noise_control_full(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    return rounded(discipline.noise_control(factors.evaluate("rev_5", grid), ev.forward_returns(grid, HORIZON), min_names=MIN_NAMES))


def psr_dsr(spark: SparkSession, d: str) -> DataFrame:
    row = discipline.series_moments(_layered(spark, d).where("leg = 'ls'")).first()
    found = discipline.deflated_sharpe(row["sharpe"], 60, row["n"], row["skew"], row["kurt"])
    return spark.createDataFrame([found], "dsr double, sr0 double, psr_vs_zero double, n_trials int, n_periods long")


def admission_check(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    pool = {"vol_20": factors.evaluate("vol_20", grid)}
    found = discipline.admission_check("rev_5", factors.evaluate("rev_5", grid), grid, ev.forward_returns(grid, HORIZON), pool, HORIZON, MIN_NAMES)
    rows = [(k, c["value"], c["ok"], c["hard"], found["verdict"]) for k, c in found["checks"].items()]
    return rounded(spark.createDataFrame(rows, "gate string, value double, ok boolean, hard boolean, verdict string"), 6)


def model_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    grid = Panel.of(spark, d).grid
    parts = {name: factors.evaluate(name, grid) for name in ("rev_5", "vol_20")}
    return model.walk_forward(parts, ev.forward_returns(grid, HORIZON), embargo_days=10, min_days=100, min_rows=1000, trees=5, depth=3)


def _named() -> dict[str, Query]:
    out: dict[str, Query] = {
        "panel_weekly": panel_weekly, "panel_dense_grid": panel_dense_grid, "calendar_ordinal": calendar_ordinal,
        "fwd_returns_h5": lambda s, d: present(ev.forward_returns(Panel.of(s, d).grid, HORIZON)), "fwd_return_1d": lambda s, d: present(ev.forward_returns(Panel.of(s, d).grid, 1)),
        "xs_rank_pct": xs_rank_pct, "xs_winsorize_mad": xs_winsorize_mad, "xs_zscore": xs_zscore, "ic_daily": ic_daily, "ic_summary": ic_summary,
        "ic_yearly": ic_yearly, "ic_monthly_pivot": ic_monthly_pivot, "horizon_profile": horizon_profile, "rank_autocorr": rank_autocorr, "newey_west_t": newey_west_t,
        "quantile_returns": quantile_returns, "orient_sign": orient_sign, "coverage": coverage, "tear_sheet": tear_sheet, "neutralize_size": neutralize_size,
        "residualize_industry_size": residualize_industry_size, "residualize_multi_style": residualize_multi_style, "style_size": lambda s, d: present(risk.size_proxy(Panel.of(s, d).grid)),
        "pit_fundamental_asof": pit_fundamental_asof, "value_btop": value_btop, "membership_asof": membership_asof, "pit_universe": pit_universe,
        "tradability_masks": tradability_masks, "suspension_pollution": suspension_pollution, "factor_returns": factor_returns, "covariance_inputs": covariance_inputs,
        "ewm_cov": ewm_cov, "ewm_spec_var": ewm_spec_var, "composite_equal_weight": composite_equal_weight, "composite_icir": composite_icir,
        "layered_backtest_daily": layered_backtest_daily, "layered_metrics": layered_metrics, "layered_backtest_masked": layered_backtest_masked,
        "topn_buffer_weights": topn_buffer_weights, "turnover": turnover, "portfolio_returns": portfolio_returns, "target_holdings": target_holdings,
        "optimizer_solve": optimizer_solve, "optimizer_backtest": optimizer_backtest, "pbo_cscv": pbo_cscv, "noise_control": noise_control,
        "pbo_cscv_full": pbo_cscv_full, "noise_control_full": noise_control_full,
        "neutralize_two_styles": neutralize_two_styles, "overlay_metrics": overlay_metrics, "rolling_prior": rolling_prior, "prior_asof": prior_asof, "execution_days": execution_days,
        "upsert_periods": upsert_periods, "pollution_by_year": pollution_by_year, "ic_without_polluted": ic_without_polluted, "realisation_rate": realisation_rate,
        "attribution_windows": attribution_windows, "style_totals": style_totals, "universe_union": universe_union, "raw_with_adjusted": raw_with_adjusted,
        "normalised_fundamentals": normalised_fundamentals, "series_moments": series_moments, "portfolio_sweep": portfolio_sweep,
        "psr_dsr": psr_dsr, "admission_check": admission_check, "model_walk_forward": model_walk_forward,
    }
    out |= {f"factor_{name}": _factor(name) for name in factors.list_factors()}
    # ratios of sums of hundredths: at eight decimals some stand exactly between two roundings
    out["factor_turn_surge_5_60"] = lambda s, d: rounded(factors.evaluate("turn_surge_5_60", Panel.of(s, d).grid).where("value IS NOT NULL").select("date", "code", "value"), 11)
    out |= {f"style_{name}": _style(name) for name in risk.STYLES if name != "size"}
    return out


QUERIES = _named()


def flagship(spark: SparkSession, d: str, min_names: int = 5) -> DataFrame:
    """Order lines to weekly panel to reversal factor to daily rank information coefficients."""
    return rounded(_ic(spark, d, min_names).select("date", "ic").orderBy("date"))
