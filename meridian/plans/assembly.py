"""Whole runs put together from the operators: the research context, one factor's study, the composite book, the discipline block, and Markdown for reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import backtest, discipline, factors, risk, strategy, universe
from meridian.operators import evaluate as ev
from meridian.sources.panel import Panel, industries, membership


@dataclass(frozen=True)
class Context:
    """What every study of one panel shares. Frames are declared, not computed."""

    panel: Panel
    tradable: DataFrame
    universe: DataFrame
    label: DataFrame
    neutral_label: DataFrame
    fwd1: DataFrame
    styles: DataFrame
    horizon: int
    min_names: int
    periods: int


def build_context(spark: SparkSession, sf_dir: str, horizon: int = 5, min_names: int = 30, periods: int = 52, style_windows: dict | None = None, styles: tuple[str, ...] = ("size", "volatility"), top_n: int | None = None, growth_since: str = universe.GROWTH_SINCE) -> Context:
    """The context over a data folder; the neutral label is the forward return less what industry and styles explain."""
    panel = Panel.of(spark, sf_dir)
    exposures = risk.build_styles(panel.grid, **(style_windows or {}))
    label = ev.forward_returns(panel.grid, horizon)
    neutral = risk.residualize(label, exposures, styles, industries(spark, sf_dir))
    inside = universe.pit_universe(membership(panel.bars), panel.grid, panel.calendar, periods // 2, top_n=top_n)
    return Context(panel, universe.tradability(panel.grid, growth_since=growth_since), inside, label, neutral, ev.forward_returns(panel.grid, 1), exposures, horizon, min_names, periods)


def one_factor(ctx: Context, name: str, cache_dir: str | None = None) -> dict:
    """A factor within the universe, turned so that larger is better: its values, daily coefficients against the neutral label, and the tear sheet."""
    values = factors.compute(name, ctx.panel.grid, cache_dir) if cache_dir else factors.evaluate(name, ctx.panel.grid)
    values = values.join(ctx.universe.where("in_universe").select("di", "code"), ["di", "code"], "left_semi")
    values = ev.oriented(values, ctx.neutral_label)
    return {"values": values} | ev.run_panel(name, values, ctx.panel.grid, ctx.horizon, min_names=ctx.min_names, label=ctx.neutral_label, fwd1=ctx.fwd1, periods=ctx.periods)


def composite_and_portfolio(ctx: Context, names: tuple[str, ...], top_n: int, buffer_n: int, rebal_days: int, cost: float = 0.003, weighted: bool = False) -> dict:
    """The composite of several factors and its buffered book: weights, net returns, their metrics, and the overlay on the universe's equal-weight return."""
    parts = {n: one_factor(ctx, n)["values"] for n in names}
    signal = strategy.icir_weight(parts, ctx.neutral_label, ctx.panel.calendar, ctx.horizon, ctx.periods, ctx.periods // 2, min_names=ctx.min_names) if weighted else strategy.equal_weight(parts)
    weights = strategy.topn_buffer_weights(signal, ctx.panel.calendar, top_n, buffer_n, rebal_days)
    turns = strategy.turnover_series(weights, ctx.panel.grid)
    net = strategy.portfolio_returns(weights, ctx.fwd1).join(turns, "di", "left").select("di", (F.col("ret") - cost * F.coalesce("turnover", F.lit(0.0))).alias("ret"))
    market = ctx.fwd1.join(ctx.universe.where("in_universe").select("di", "code"), ["di", "code"], "left_semi").groupBy("di").agg(F.avg("value").alias("ret"))
    return {"signal": signal, "weights": weights, "net": net, "metrics": backtest.metrics(net, periods=ctx.periods), "overlay": backtest.overlay(net, market, ctx.periods)}


def discipline_block(net: DataFrame, strategies: DataFrame, n_trials: int, n_splits: int = 16) -> dict:
    """The deflated Sharpe ratio of a net series and the overfitting probability of the strategies (``t, strategy, ret``) that it was chosen from."""
    row = discipline.series_moments(net).first()
    return discipline.deflated_sharpe(row["sharpe"], n_trials, row["n"], row["skew"], row["kurt"]) | discipline.pbo_cscv(strategies, n_splits).first().asDict()


def guard(step: Callable[[], dict], name: str) -> dict:
    """A step's result, or what it raised, so that one failed study does not end a run."""
    try:
        return step()
    except Exception as error:  # noqa: BLE001 - the report says what failed
        return {"failed": name, "error": f"{type(error).__name__}: {error}"}


def md_table(df: DataFrame, digits: int = 4, rows: int = 1000) -> str:
    """A small table (at most ``rows`` rows are printed) as Markdown."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in df.limit(rows).collect()]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
