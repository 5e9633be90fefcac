"""Operators against plain numpy and pandas, hand-made scenarios, and the absence of look-ahead."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridian.operators import asof, backtest, discipline, factors, model, optimizer, risk, strategy, universe
from meridian.operators import evaluate as ev
from meridian.plans import queries
from meridian.sources import panel as panel_source

from .test_functions import START, long, same, wide

DAY = lambda n: START + dt.timedelta(days=n)


def calendar(spark, n):
    return spark.createDataFrame([(i, DAY(i)) for i in range(n)], "di int, date date")


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(7)
    n, codes = 140, [f"s{k:03}" for k in range(24)]
    close = pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0, 0.02, (n, 24)), axis=0)), columns=codes)
    close = close.mask(rng.random(close.shape) < 0.05)
    rows = []
    for i in range(n):
        for c in codes:
            p = close.at[i, c]
            v = float(rng.integers(1, 400))
            rows.append((i, DAY(i), c, *([None] * 8 if pd.isna(p) else [float(p)] * 5 + [float(v), float(v * p), v / 500]), 0, None if pd.isna(p) else 1))
    schema = "di int, date date, code string, open double, high double, low double, close double, adj_close double, volume double, amount double, turn double, is_st int, is_trading int"
    return spark.createDataFrame(rows, schema).cache(), close


def test_no_factor_looks_ahead(spark, grid):
    df, _ = grid
    cut = 100
    late = F.col("di") > cut
    changed = df.withColumns({c: F.when(late, F.col(c) * 3).otherwise(F.col(c)) for c in ("adj_close", "close", "amount", "turn")})
    for name in factors.list_factors():
        a, b = (factors.evaluate(name, x).where(~late) for x in (df, changed))
        assert a.exceptAll(b).isEmpty(), name
    a, b = (risk.build_styles(x, 30, 20, 40, 5, 20, 10, 8, 4).where(~late) for x in (df, changed))
    assert a.select("di", "code", "size", "momentum", "volatility", "liquidity").exceptAll(b.select("di", "code", "size", "momentum", "volatility", "liquidity")).isEmpty()


def test_factor_values(spark, grid):
    df, close = grid
    ret = close.pct_change(fill_method=None)
    same(wide(factors.evaluate("mom_20_5", df)), close.shift(5) / close.shift(25) - 1)
    same(wide(factors.evaluate("vol_20", df)), ret.rolling(20, min_periods=15).std())
    turn = wide(df, "turn")
    age, ages = 0, []
    for t in range(len(turn)):
        age = (1 - turn.iloc[t].fillna(0)) * (age + 1)
        ages.append(age)
    same(wide(factors.evaluate("chip_age", df)), pd.DataFrame(ages).reset_index(drop=True).where(close.notna() & (close.notna().cumsum() >= 60)))


def test_registry_and_materialisation(spark, grid, tmp_path):
    df, _ = grid
    assert factors.list_factors() == sorted(factors.list_factors()) and "chip_age" in factors.list_factors()
    with pytest.raises(KeyError):
        factors.factor("rev_5")(lambda p: p)
    calls = []

    @factors.factor("counted_factor")
    def counted(panel):
        calls.append(1)
        return panel.select("di", "date", "code", F.col("close").alias("value"))

    try:
        first = factors.compute("counted_factor", df, str(tmp_path))
        again = factors.compute("counted_factor", df, str(tmp_path))
        assert len(calls) == 1 and first.exceptAll(again).isEmpty()
        factors.compute("counted_factor", df.where("code <> 's000'"), str(tmp_path))
        factors.compute("counted_factor", df, str(tmp_path), use_cache=False)
        assert len(calls) == 3
        (tmp_path / "counted_factor.manifest" / "part-broken.txt").write_text("{")
        factors.compute("counted_factor", df, str(tmp_path))
        assert len(calls) == 4
    finally:
        factors._REGISTRY.pop("counted_factor")
    assert factors.get_meta("rev_5") is not factors.get_meta("rev_5")


def test_information_coefficient(spark, grid):
    df, close = grid
    f, y = -(close / close.shift(5) - 1), close.shift(-6) / close.shift(-1) - 1
    both = f.notna() & y.notna()
    expected = f.where(both).rank(axis=1).corrwith(y.where(both).rank(axis=1), axis=1)[both.sum(axis=1) >= 10].dropna()
    factor = factors.evaluate("rev_5", df).withColumn("value", -F.col("value"))
    ic = ev.ic_series(factor, ev.forward_returns(df, 5), 10)
    found = ic.toPandas().set_index("di")["ic"].sort_index()
    np.testing.assert_allclose(found, expected, atol=1e-12)
    x, n, lag = expected.to_numpy(), len(expected), 5
    d = x - x.mean()
    s = d @ d / n + sum(2 * (1 - k / (lag + 1)) * (d[k:] @ d[:-k]) / n for k in range(1, lag + 1))
    assert ev.newey_west(ic, lag).first()["nw_t"] == pytest.approx(x.mean() / math.sqrt(s / n))
    summary = ev.ic_summary(ic, 5).first()
    assert summary["ic_mean"] == round(float(x.mean()), 4) and summary["n"] == n
    # a factor that is the label scores one
    perfect = ev.ic_series(ev.forward_returns(df, 5), ev.forward_returns(df, 5), 10).agg(F.min("ic")).first()[0]
    assert perfect == pytest.approx(1.0)
    rows = ev.run_panel("rev_5", factor, df, 5, min_names=10)
    assert rows["summary"]["ic_mean"] == summary["ic_mean"] and rows["monthly"].count() == 1


def test_newey_west_edges(spark):
    one = spark.createDataFrame([(0, 0.5)], "di int, ic double")
    assert ev.newey_west(one, 5).first()["nw_t"] is None
    two = spark.createDataFrame([(0, 0.5), (4, 0.1)], "di int, ic double")
    assert ev.newey_west(two, 9).first()["n"] == 2
    assert ev.newey_west(one.limit(0), 5).first()["nw_t"] is None


def test_orient_and_quantiles(spark, grid):
    df, close = grid
    label = ev.forward_returns(df, 5)
    good, bad = label, label.withColumn("value", -F.col("value"))
    assert ev.orient(good, label).first()["sign"] == 1 and ev.orient(bad, label).first()["sign"] == -1 and ev.orient(good.limit(0), label).first()["sign"] == -1
    q = ev.quantile_returns(label, label).toPandas()
    assert (q["q5"] > q["q1"]).all() and np.allclose(q["ls"], q["q5"] - q["q1"])


def test_residuals_match_least_squares(spark):
    rng = np.random.default_rng(4)
    n, codes = 4, [f"c{k:02}" for k in range(90)]
    frames = {name: pd.DataFrame(rng.normal(size=(n, 90)), columns=codes) for name in ("value", "a", "b")}
    frames["value"] = (frames["value"] + 2 * frames["a"]).mask(rng.random((n, 90)) < 0.1)
    sector = {c: f"i{k % 5}" for k, c in enumerate(codes)}
    y = long(spark, frames["value"])
    styles = long(spark, frames["a"], "a").join(long(spark, frames["b"], "b").select("di", "code", "b"), ["di", "code"])
    industry = spark.createDataFrame(list(sector.items()), "code string, industry string")
    found, plain = wide(risk.residualize(y, styles, ("a", "b"), industry)), wide(risk.residualize(y, styles, ("a", "b")))
    coefficients, residuals = risk.style_factor_returns(y, styles, ("a", "b"), industry, min_names=50)
    coefficients, residuals = coefficients.toPandas().set_index("di"), wide(residuals)
    for d in range(n):
        x = []
        for name in ("a", "b"):
            s = frames[name].loc[d]
            m = s.median()
            mad = 5 * 1.4826 * (s - m).abs().median()
            s = s.clip(m - mad, m + mad)
            x.append((s - s.mean()) / s.std())
        keep = frames["value"].loc[d].dropna().index
        dummies = pd.get_dummies(pd.Series(sector))[sorted(set(sector.values()))].loc[keep].to_numpy(float)
        z = np.column_stack([s[keep] for s in x])
        target = frames["value"].loc[d, keep].to_numpy()
        for design, got in ((np.column_stack([dummies, z]), found), (np.column_stack([np.ones(len(keep)), z]), plain)):
            beta = np.linalg.lstsq(design, target, rcond=None)[0]
            np.testing.assert_allclose(got.loc[d, keep], target - design @ beta, atol=1e-9)
        beta = np.linalg.lstsq(np.column_stack([dummies, z]), target, rcond=None)[0]
        np.testing.assert_allclose(coefficients.loc[d, ["a", "b"]].astype(float), beta[-2:], atol=1e-9)
    np.testing.assert_allclose(residuals.to_numpy(), found.to_numpy(), atol=1e-9)
    collinear = styles.withColumn("b", F.col("a") * 2)
    one = wide(risk.residualize(y, collinear, ("a",)))
    same(wide(risk.residualize(y, collinear, ("a", "b"))), one)
    assert risk.residualize(y, styles, ("a", "b"), min_names=91).count() == 0


def test_covariances_match_pandas(spark):
    rng = np.random.default_rng(2)
    x = pd.DataFrame(rng.normal(size=(200, 2)), columns=["a", "b"])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x.to_numpy())], "di int, a double, b double")
    expected = x.ewm(halflife=30).cov().loc[199]
    for r in risk.ewm_cov(df, ("a", "b"), 30).collect():
        assert r["cov"] == pytest.approx(expected.at[r["a"], r["b"]])
    e = x.mask(rng.random(x.shape) < 0.3)
    spec = {r["code"]: r["var"] for r in risk.specific_variance(long(spark, e), 199, 40, 60).collect()}
    for c in ("a", "b"):
        assert spec[c] == pytest.approx((e[c] ** 2).ewm(halflife=40, min_periods=60).mean().iloc[199])


def test_bitemporal_events(spark):
    n = 10
    cells = spark.createDataFrame([(i, DAY(i), c) for i in range(n) for c in ("a", "b", "c")], "di int, date date, code string")
    events = [
        ("a", DAY(-30), DAY(-5), 1.0), ("a", DAY(-20), DAY(2), 2.0), ("a", DAY(-40), DAY(4), 9.0), ("a", DAY(-20), DAY(6), 3.0), ("a", DAY(-10), DAY(9), 4.0),
        ("b", None, DAY(1), 5.0), ("b", DAY(5), DAY(3), None), ("zz", DAY(0), DAY(0), 1.0), ("b", DAY(3), None, 7.0),
    ]
    events = spark.createDataFrame(events, "code string, report_date date, pub_date date, value double")
    found = wide(asof.pit_fill(events, calendar(spark, n), cells))
    assert found["a"].tolist() == [1, 1, 1, 2, 2, 2, 2, 3, 3, 3] and found["b"].fillna(0).tolist() == [0, 0, 5, 5, 5, 5, 5, 5, 5, 5] and found["c"].isna().all()
    assert wide(asof.pit_fill(events.limit(0), calendar(spark, n), cells)).isna().all().all()
    cached = spark.createDataFrame([("a", DAY(0), 1.0), ("a", DAY(1), 2.0)], "code string, report_date date, value double")
    fresh = spark.createDataFrame([("b", DAY(1), 3.0)], "code string, report_date date, value double")
    assert sorted((r["code"], r["value"]) for r in asof.upsert_periods(cached, fresh).collect()) == [("a", 1.0), ("b", 3.0)]


def test_whole_snapshots(spark):
    snaps = spark.createDataFrame([(DAY(2), "a"), (DAY(2), "b"), (DAY(5), "b"), (DAY(7), "unknown")], "snap_date date, code string")
    codes = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    found = {(r["di"], r["code"]) for r in asof.membership_asof(snaps, calendar(spark, 9), codes).collect()}
    assert found == {(d, "a") for d in (2, 3, 4)} | {(d, "b") for d in range(2, 9)}


def test_universe_gates(spark):
    n, rows = 60, []
    for i in range(n):
        for code, amount in (("rich", 100.0), ("poor", 10.0), ("st", 90.0), ("new", 95.0), ("idle", 80.0), ("ghost", 200.0)):
            live = code != "new" or i >= 40
            rows.append((i, DAY(i), code, 1.0 if live else None, amount if live else None, 1 if code == "st" else None, 0 if code == "idle" else 1 if live else None))
    cells = spark.createDataFrame(rows, "di int, date date, code string, close double, amount double, is_st int, is_trading int")
    snaps = spark.createDataFrame([(DAY(0), c) for c in ("rich", "poor", "st", "new", "idle")], "snap_date date, code string")
    run = lambda **k: {(r["di"], r["code"]) for r in universe.pit_universe(snaps, cells, calendar(spark, n), 10, days=8, least=4, **k).where("in_universe").collect()}
    one, all_names = run(top_n=1), run(top_n=9)
    assert one == {(d, "rich") for d in range(9, n)}
    assert {c for d, c in all_names if d == 59} == {"rich", "poor", "new"} and min(d for d, c in all_names if c == "new") == 49
    assert {c for d, c in run(top_n=9, exclude_st=False, require_trading=False) if d == 59} == {"rich", "poor", "new", "st", "idle"}
    with pytest.raises(ValueError):
        run(top_n=0)


def test_limit_boards(spark):
    before, cases = 100.0, [
        ("sh.600000", 110.0, 110.0, 0, False, True), ("sh.600001", 110.0, 111.0, 0, True, True), ("sz.000001", 90.0, 90.0, 0, True, False), ("sh.600002", 105.0, 105.0, 1, False, True),
        ("sz.300001", 110.0, 110.0, 0, True, True), ("sh.688001", 120.0, 120.0, 1, False, True), ("sh.600003", None, None, 0, True, True),
    ]
    rows = [(0, DAY(0), c, before, before, before, before, 0) for c, *_ in cases] + [(1, DAY(1), c, o, h, o, h, st) for c, o, h, st, _, _ in cases]
    cells = spark.createDataFrame(rows, "di int, date date, code string, open double, high double, low double, close double, is_st int")
    found = {r["code"]: (r["can_buy"], r["can_sell"]) for r in universe.tradability(cells).where("di = 1").collect()}
    assert found == {c: (b, s) for c, _, _, _, b, s in cases}


def test_buffered_portfolio(spark, grid):
    df, close = grid
    signal = factors.evaluate("rev_5", df)
    values = wide(signal)
    expected, held = {}, []
    for d in range(len(values)):
        if d % 5 == 0:
            row = values.loc[d].dropna() if d in values.index else pd.Series(dtype=float)
            order = sorted(row.index, key=lambda c: (-row[c], c))
            if len(order) >= 12:
                held = [c for c in held if c in order[:12]]
                held += [c for c in order if c not in held][: max(0, 6 - len(held))]
        expected |= {(d, c): 1 / len(held) for c in held}
    weights = strategy.topn_buffer_weights(signal, calendar(spark, len(values)), 6, 12, 5)
    assert {(r["di"], r["code"]): pytest.approx(r["weight"]) for r in weights.collect()} == expected
    w = pd.Series(expected).unstack(fill_value=0.0).reindex(range(len(values)), fill_value=0.0)
    turn = strategy.turnover_series(weights, df).toPandas().set_index("di")["turnover"].sort_index()
    np.testing.assert_allclose(turn, w.diff().abs().sum(axis=1) / 2, atol=1e-12)
    top = strategy.targets(weights, 139).collect()
    assert sum(r["weight"] for r in top) == pytest.approx(1.0)


def test_composites(spark, grid):
    df, _ = grid
    parts = {n: factors.evaluate(n, df) for n in ("rev_5", "vol_20")}
    ranks = [wide(p).rank(axis=1, pct=True) for p in parts.values()]
    mean = (ranks[0] + ranks[1]) / 2
    same(wide(strategy.equal_weight(parts)).reindex(index=mean.index, columns=mean.columns), mean)
    weighted = strategy.icir_weight(parts, ev.forward_returns(df, 5), calendar(spark, 140), 5, 40, 20, min_names=10)
    v = wide(weighted)
    assert ((v > 0) & (v <= 1) | v.isna()).all().all() and v.index.min() >= 5 + 20 + 7


def legs(df, leg):
    found = df.where(F.col("leg") == leg).toPandas().sort_values("di").set_index("di")
    return found


def test_layered_backtest(spark, grid):
    df, _ = grid
    signal, y = factors.evaluate("rev_5", df), ev.forward_returns(df, 1)
    pct, fwd = wide(signal).reindex(range(140)).rank(axis=1, pct=True), wide(y).reindex(range(140))
    held, expected = set(), {}
    for d in range(140):
        cost = 0.0
        if d % 5 == 0 and (target := set(pct.columns[pct.loc[d] > 0.8])):
            cost = 2 * 0.0015 * (1.0 if not held else 1 - len(held & target) / len(target))
            held = target
        if held and fwd.loc[d, sorted(held)].notna().any():
            expected[d] = fwd.loc[d, sorted(held)].mean() - cost
    found = legs(backtest.layered_backtest(signal, y), "top")["ret"].dropna()
    got = {d: v for d, v in found.items() if d in expected}
    assert got == pytest.approx(expected)
    free = legs(backtest.layered_backtest(signal, y, cost_bps=0), "top")["ret"].sum()
    assert free > found.sum()
    m = {r["leg"]: r for r in backtest.metrics(backtest.layered_backtest(signal, y), "ret", "leg").collect()}
    assert m["top"]["max_dd"] <= 0 and set(m) == {"top", "bottom", "ls"}
    assert backtest.average_turnover(backtest.layered_backtest(signal, y)).first()["n_rebalances"] == 27


def test_masked_backtest_scenario(spark):
    """Four names, two legs of one name each; the top name of day 3 can't be bought on day 4, the held one can't be sold until day 6."""
    n, codes = 9, ["a", "b", "c", "d"]
    first, second = [4.0, 3.0, 2.0, 1.0], [1.0, 3.0, 2.0, 4.0]
    factor = long(spark, pd.DataFrame([first] * 3 + [second] * 6, columns=codes))
    y = long(spark, pd.DataFrame([[0.01, 0.02, 0.03, 0.04]] * n, columns=codes))
    masks = [(i, c, not (c == "d" and i == 4), not (c == "a" and i in (4, 5))) for i in range(n) for c in codes]
    masks = spark.createDataFrame(masks, "di int, code string, can_buy boolean, can_sell boolean")
    found = legs(backtest.layered_backtest_masked(factor, y, masks, q=4, rebal_days=3, cost_bps=100), "top")
    # day 0 buys a; day 3: d can't be bought, a can't be sold; a leaves on day 5 (execution day 6), and day 6 buys d
    assert found["ret"].round(6).tolist() == [0.0, 0.01, 0.01, 0.01, 0.01, -0.01, 0.03, 0.04, 0.04]
    assert found["turnover"].dropna().to_dict() == {0: 0.5, 3: 0.0, 6: 0.5}


def slow_masked(pct, fwd, can_buy, can_sell, q, every, rate, leg):
    """One leg by plain bookkeeping, day by day."""
    held, stuck, out = set(), set(), {}
    for i in range(len(pct)):
        cost, turnover = None, None
        execution = min(i + 1, len(pct) - 1)
        blocked = lambda table, c: i + 1 < len(pct) and not table.at[execution, c]  # noqa: B023, E731
        leave = {c for c in stuck if not blocked(can_sell, c)}
        if leave:
            cost = rate * len(leave) / len(held)
            held, stuck = held - leave, stuck - leave
        row = pct.loc[i].dropna()
        target = set(row.index[row > 1 - 1 / q] if leg == "top" else row.index[row <= 1 / q])
        if i % every == 0 and target:
            buys = {c for c in target - held if not blocked(can_buy, c)}
            keep = {c for c in held - target if blocked(can_sell, c)}
            sells = held - target - keep
            after = (held & target) | buys | keep
            if after:
                n = len(buys) + len(sells)
                turnover, cost = n / (2 * len(after)), (cost or 0) + rate * n / len(after)
                held, stuck = after, keep
        got = fwd.loc[i, sorted(held)].dropna()
        if len(got) or cost is not None:
            out[i] = ((got.mean() if len(got) else 0) - (cost or 0), turnover)
    return out


@pytest.mark.parametrize("seed", [1])
def test_masked_backtest_against_bookkeeping(spark, seed):
    """Random masks; on some rebalances nothing can be bought and all that is held could be sold, so they are skipped."""
    rng = np.random.default_rng(seed)
    n, codes = 60, [f"s{k:02}" for k in range(15)]
    value = pd.DataFrame(rng.normal(size=(n, 15)), columns=codes).mask(rng.random((n, 15)) < 0.1)
    y = pd.DataFrame(rng.normal(0, 0.02, (n, 15)), columns=codes).mask(rng.random((n, 15)) < 0.1)
    buy, sell = (pd.DataFrame(rng.random((n, 15)) > 0.3, columns=codes) for _ in range(2))
    for i in (9, 17, 33, 34):
        buy.loc[i], sell.loc[i] = False, True
    masks = spark.createDataFrame([(i, c, bool(buy.at[i, c]), bool(sell.at[i, c])) for i in range(n) for c in codes], "di int, code string, can_buy boolean, can_sell boolean")
    found = backtest.layered_backtest_masked(long(spark, value), long(spark, y), masks, q=5, rebal_days=4, cost_bps=50).persist()
    for leg in ("top", "bottom"):
        expected = slow_masked(value.rank(axis=1, pct=True), y, buy, sell, 5, 4, 0.005, leg)
        got = {r["di"]: (r["ret"], r["turnover"]) for r in found.where(F.col("leg") == leg).collect()}
        assert got.keys() == expected.keys()
        for i, (ret, turnover) in expected.items():
            assert got[i] == (pytest.approx(ret), None if turnover is None else pytest.approx(turnover)), (leg, i)


def test_snapshots_do_not_look_ahead(spark):
    """No member's first bar of the month comes after the snapshot."""
    bars = panel_source.Panel.of(spark, "/root/testdata/sf0.001").bars
    snapshots = panel_source.membership(bars)
    first = bars.groupBy(F.trunc("date", "MM").alias("m"), "code").agg(F.min("date").alias("first"))
    assert snapshots.join(first, (F.trunc("snap_date", "MM") == F.col("m")) & (snapshots["code"] == first["code"])).where("first > snap_date").isEmpty()
    assert snapshots.groupBy(F.trunc("snap_date", "MM")).agg(F.count_distinct("snap_date").alias("k")).where("k > 1").isEmpty()


def test_overfitting_keeps_every_combination(spark):
    """Strategies without deviation in some blocks: infinite or missing ratios stay in the mean."""
    from itertools import combinations

    x = np.array([[0.01, 0.0, 0.02, -0.01]] * 8 + [[0.03, 0.0, -0.02, 0.01], [0.01, 0.0, 0.02, 0.02]] * 4)
    rows = [(t, f"s{k}", float(v)) for t, r in enumerate(x) for k, v in enumerate(r)]
    found = {r["mask"]: r["omega"] for r in discipline.pbo_combinations(spark.createDataFrame(rows, "t int, strategy string, ret double"), 4).collect()}
    assert len(found) == 6
    blocks = x.reshape(4, 4, 4)

    def ratios(chosen):
        z = np.concatenate([blocks[b] for b in chosen])
        sd, mean = z.std(0, ddof=1), z.mean(0)
        return np.array([np.nan if s < 1e-9 and abs(m) < 1e-12 else np.sign(m) * np.inf if s < 1e-9 else m / s for m, s in zip(mean, sd)])

    for c in combinations(range(4), 2):
        inn, out = ratios(c), ratios([b for b in range(4) if b not in c])
        star = out[np.argmax(np.nan_to_num(inn, nan=-np.inf, posinf=np.inf, neginf=-np.inf))]
        assert found[sum(1 << b for b in c)] == pytest.approx((out <= star).sum() / 5), c
    total = discipline.pbo_cscv(spark.createDataFrame(rows, "t int, strategy string, ret double"), 4).first()
    assert total["n_combinations"] == 6 and total["pbo"] is not None


def test_risk_inputs_of_many_days(spark):
    """All days at once give what each day alone gives."""
    rng = np.random.default_rng(3)
    n, codes = 90, [f"s{j:02}" for j in range(20)]
    style = long(spark, pd.DataFrame(rng.normal(size=(n, 20)), columns=codes), "one")
    y = long(spark, pd.DataFrame(rng.normal(0, 0.01, (n, 20)), columns=codes).mask(rng.random((n, 20)) < 0.2))
    ret, residuals = (x.cache() for x in risk.style_factor_returns(y, style, ("one",), min_names=10))
    days = spark.createDataFrame([(10,), (60,), (85,)], "di int")
    rows = risk.risk_inputs(days, style, ret, residuals, ("one",), min_obs=40).collect()
    assert {r["di"] for r in rows} == {60, 85}
    for di in (60, 85):
        cov = risk.ewm_cov(ret, ("one",), 90, di - 2).first()["cov"]
        spec = {r["code"]: r["var"] for r in risk.specific_variance(residuals, di - 2, 60, 20).collect()}
        for r in rows:
            if r["di"] == di:
                assert r["cov"][0] == pytest.approx(cov) and r["var"] == pytest.approx(spec[r["code"]])


def test_rebalance_days_are_the_signals_own(spark):
    """A signal that starts late or has holes rebalances on its own first, sixth, ... day."""
    x = pd.DataFrame(np.arange(48.0).reshape(12, 4), columns=list("abcd"))
    signal = long(spark, x).where("di IN (3, 4, 5, 7, 8, 9, 10)")
    weights = strategy.topn_buffer_weights(signal, calendar(spark, 12), 2, 3, 3)
    assert weights.agg(F.min("di")).first()[0] == 3
    ranks = ev.rank_autocorr(signal.withColumn("value", F.hash("di", "code").cast("double")), 4)
    assert ranks.first()[0] is not None


def test_projection_and_optimum():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(3, 40))
        v, center, cap, t = rng.normal(0, 0.3, n), rng.dirichlet(np.ones(n)), np.full(n, 3 / n), float(rng.choice([0, 0.01, 0.2]))
        w = optimizer.project(v, center, t, cap)
        assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all() and (w <= cap + 1e-12).all()
        cost = lambda x: 0.5 * ((x - v) ** 2).sum() + t * np.abs(x - center).sum()  # noqa: B023, E731
        for _ in range(200):  # no feasible move is better
            i, j = rng.integers(0, n, 2)
            step = min(w[i], cap[j] - w[j]) * rng.random()
            x = w.copy()
            x[i] -= step
            x[j] += step
            assert cost(x) >= cost(w) - 1e-10
    n = 60
    a = rng.normal(size=(n, n))
    sigma = 0.01 * a @ a.T + 0.005 * np.eye(n)
    alpha, base, before = rng.normal(0, 0.02, n), np.full(n, 1 / n), rng.dirichlet(np.ones(n))
    out = optimizer.solve(alpha, sigma, base, before, 10, 0.001, 3 / n, max_iter=20_000)
    assert out.converged and out.residual < 1e-5
    tracking = optimizer.solve(alpha, sigma, base, base, 1e6, 0, 3 / n, max_iter=20_000)
    assert np.abs(tracking.weights - base).max() < 1e-3
    moves = [np.abs(optimizer.solve(alpha, sigma, base, before, 10, t, 3 / n, max_iter=20_000).weights - before).sum() for t in (0.0, 0.002, 0.05)]
    assert moves[0] >= moves[1] >= moves[2]
    b = rng.normal(size=(n, 2))
    model_ = (b, 0.01 * np.eye(2), np.full(n, 0.2))
    dense = b @ (0.01 * np.eye(2)) @ b.T + 0.04 * np.eye(n)
    times, top = optimizer.covariance(model_)
    x = rng.normal(size=n)
    np.testing.assert_allclose(times(x), dense @ x)
    assert top >= np.linalg.eigvalsh(dense)[-1] - 1e-9
    loose, tight = (np.abs(optimizer.solve(alpha, model_, base, base, 1, 0, 3 / n, b, e, 5000).exposure).max() for e in (1.0, 0.01))
    assert tight < loose + 1e-9
    for bad in ({"cap": 0.5 / n}, {"lam": -1}, {"alpha": np.append(alpha[:-1], np.nan)}, {"base": base[:-1]}):
        args = {"alpha": alpha, "cov": sigma, "base": base, "before": before, "lam": 1, "tau": 0, "cap": 3 / n} | bad
        with pytest.raises(ValueError):
            optimizer.solve(**args)


def test_optimizer_backtest(spark):
    rng = np.random.default_rng(11)
    n, k = 120, 40
    codes = [f"s{j:02}" for j in range(k)]
    b = rng.normal(size=k)
    ret = rng.normal(0, 0.003, n)[:, None] * b + rng.normal(0, 0.01, (n, k))
    y, style = long(spark, pd.DataFrame(ret, columns=codes)), long(spark, pd.DataFrame([b] * n, columns=codes), "one")
    signal = long(spark, pd.DataFrame(rng.normal(size=(n, k)), columns=codes))
    style_ret, residuals = (x.cache() for x in risk.style_factor_returns(y, style, ("one",), min_names=30))
    everyone = y.select("di", "code", F.lit(True).alias("in_universe"))
    run = lambda tau: optimizer.optimizer_backtest(signal, y, everyone, style, style_ret, residuals, ("one",), rebal_days=30, cap=0.2, bound=0.5, tau=tau, warmup_obs=50, min_members=30, max_iter=3000)
    free, dear = run(0.0), run(0.005)
    sums = free["weights"].groupBy("di").agg(F.sum("weight").alias("s"), F.max("weight").alias("m")).collect()
    assert free["n_rebalances"] == 2 and all(abs(r["s"] - 1) < 1e-6 and r["m"] <= 0.2 + 1e-9 for r in sums) and dear["turnover_annual"] <= free["turnover_annual"]
    with pytest.raises(ValueError):
        risk.sigma_at(10, style, style_ret, residuals, ("one",), min_obs=50)


def test_sharpe_tests():
    assert discipline.expected_max_sharpe(1, 100) == 0 and discipline.expected_max_sharpe(100, 1250) == pytest.approx(0.0716, abs=2e-3)
    assert discipline.probabilistic_sharpe(0.1, 0.1, 500) == pytest.approx(0.5) and math.isnan(discipline.probabilistic_sharpe(0.1, 0, 1))
    lucky, skilled = discipline.deflated_sharpe(0.07, 100, 1250), discipline.deflated_sharpe(0.2, 100, 1250)
    assert lucky["dsr"] < 0.95 < skilled["dsr"] and lucky["psr_vs_zero"] > 0.95


def test_overfitting_probability(spark):
    def pbo(x):
        rows = [(t, f"s{k}", float(v)) for t, r in enumerate(x) for k, v in enumerate(r)]
        return discipline.pbo_cscv(spark.createDataFrame(rows, "t int, strategy string, ret double"), 8).first()

    rng = np.random.default_rng(9)
    noise = rng.normal(0, 0.01, (130, 8))
    skill = noise.copy()
    skill[:, 3] += 0.01
    found, best = pbo(noise), pbo(skill)
    assert found["n_combinations"] == 70 and best["pbo"] < 0.05 < found["pbo"]
    blocks = noise[:128].reshape(8, 16, 8)
    from itertools import combinations

    omegas = []
    for c in combinations(range(8), 4):
        sr = [(lambda z: z.mean(0) / z.std(0, ddof=1))(np.concatenate([blocks[b] for b in s])) for s in (c, [b for b in range(8) if b not in c])]
        omegas.append((sr[1] <= sr[1][np.argmax(sr[0])]).sum() / 9)
    assert found["oos_rank_mean"] == pytest.approx(np.mean(omegas)) and found["pbo"] == pytest.approx(np.mean(np.array(omegas) < 0.5))
    with pytest.raises(ValueError):
        pbo(noise[:10])


def test_permutation_control(spark, grid):
    df, _ = grid
    label = ev.forward_returns(df, 5)
    mixed = discipline.permuted(label, 2)
    a = mixed.where("arm = 0 AND di = 30").select("value").collect()
    b = label.where("di = 30 AND value IS NOT NULL").select("value").collect()
    assert sorted(a) == sorted(b) and mixed.where("arm = 0").select("di", "code").exceptAll(label.where("value IS NOT NULL").select("di", "code")).isEmpty()
    strong = discipline.noise_control(label, label, 9, 10).first()
    assert strong["p_value"] == pytest.approx(0.1) and strong["real"] > strong["noise_mean"]


def test_tickets_and_ledger(spark, tmp_path):
    path = discipline.create_ticket(tmp_path, "idea", "it works", {"sharpe": 0.5, "positive": True}, 3, "stop")
    assert discipline.judge(path, {"sharpe": 0.6, "positive": True}, 2)["verdict"] == "pass"
    assert discipline.judge(path, {"sharpe": 0.6, "positive": True}, 4)["verdict"] == "warn"
    assert discipline.judge(path, {"sharpe": 0.4, "positive": True})["verdict"] == "fail" and discipline.judge(path, {})["verdict"] == "fail"
    with pytest.raises(FileExistsError):
        discipline.create_ticket(tmp_path, "idea", "again", {}, 1, "")
    path.write_text(path.read_text().replace("0.5", "0.1"))
    assert discipline.judge(path, {"sharpe": 0.6, "positive": True})["verdict"] == "tampered"
    ledger = str(tmp_path / "ledger")
    assert discipline.trial_count(None) == 0
    for name in ("x", "x", "y"):
        discipline.log_run(spark, ledger, {"factor": name, "ic_mean": 0.1}, {"h": 5})
    runs = spark.read.parquet(ledger)
    assert discipline.trial_count(runs) == 3 and discipline.trial_count(runs, "x") == 2 and discipline.dsr_from_ledger(runs, 0.1, 250)["n_trials"] == 3


def test_admission(spark, grid):
    df, _ = grid
    label = ev.forward_returns(df, 5)
    oracle = label.withColumn("value", F.when(F.col("di") <= 133, F.col("value") + F.randn(1) * 0.02).otherwise(F.lit(0.0)))
    good = discipline.admission_check("rev_5", oracle, df, label, {"vol_20": factors.evaluate("vol_20", df)}, min_names=10, min_rank_autocorr=-1)
    assert good["verdict"] == "pass", good["checks"]
    noise = oracle.withColumn("value", F.rand(3))
    bad = discipline.admission_check("rev_5", noise, df, label, {"same": noise}, min_names=10)
    assert bad["verdict"] == "fail" and not bad["checks"]["pool_redundancy"]["ok"] and "FAIL" in discipline.format_report(bad)


def test_suspension_pollution(spark):
    turn = long(spark, pd.DataFrame({"a": [0.1, 0.1, 0.1, 0.0, 0.1, 0.1], "b": [0.1, np.nan, np.nan, np.nan, 0.1, 0.1]}), "turn")
    found = {(r["code"], r["di"]): r["polluted"] for r in factors.suspension_pollution(turn, 1).collect()}
    assert [found["a", d] for d in range(6)] == [False, True, True, False, False, False] and not any(found["b", d] for d in range(6))


def test_model_factor_is_out_of_sample(spark):
    rng = np.random.default_rng(5)
    n, k = 60, 30
    x = pd.DataFrame(rng.normal(size=(n, k)), columns=[f"s{j:02}" for j in range(k)])
    stretch = lambda df: df.withColumn("date", F.date_add(F.lit(START), F.col("di") * 15))  # noqa: E731 - several years
    feature, label = stretch(long(spark, x)), stretch(long(spark, x + rng.normal(0, 0.1, x.shape)))
    found = model.walk_forward({"x": feature}, label, 2, 2, min_days=10, min_rows=100, trees=3, depth=2)
    assert found.agg(F.min("di")).first()[0] >= 12
    assert ev.ic_series(found, label, 10).agg(F.avg("ic")).first()[0] > 0.5
    assert model.walk_forward({"x": feature}, label, 2, 2).count() == 0


def test_bars_and_panel(spark):
    ts = lambda d: dt.datetime(2000, 1, 3 + d)
    rows = [(1, 1, 4, 1, 2.0, 20.0, "R", ts(0)), (1, 1, 4, 2, 3.0, 36.0, "R", ts(1)), (2, 1, 5, 1, 10.0, 50.0, "N", ts(0)), (3, 1, 4, 1, 20.0, 100.0, "R", ts(14))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp")
    p = panel_source.Panel(panel_source.weekly_bars(lines))
    bars = {(str(r["date"]), r["code"]): r for r in p.grid.collect()}
    a = bars["2000-01-03", "sh.6000004"]
    assert (a["open"], a["close"], a["high"], a["low"], a["volume"], a["amount"], a["is_st"], a["is_trading"]) == (10.0, 12.0, 12.0, 10.0, 5.0, 56.0, 1, 0)
    assert len(bars) == 4 and bars["2000-01-17", "sz.0000005"]["close"] is None and str(p.end_date()) == "2000-01-17"
    assert p.wide("close").columns == ["date", "sh.6000004", "sz.0000005"] and p.field("turn").count() == 4
    with pytest.raises(KeyError):
        p.field("nothing")
    with pytest.raises(ValueError):
        panel_source.check_unique(p.bars.union(p.bars))
    assert panel_source.Panel(panel_source.weekly_bars(lines.limit(0))).grid.count() == 0


def test_optimizer_solve_takes_every_week(spark):
    """Every week with at least five names that have both factors is a problem, not only every fourth."""
    folder = "/root/testdata/sf0.001"
    grid = panel_source.Panel.of(spark, folder).grid
    alpha, vol = (factors.evaluate(name, grid).select("di", "code", "value") for name in ("rev_5", "vol_20"))
    cells = alpha.where("value IS NOT NULL").select("di", "code").join(vol.where("value > 0").select("di", "code"), ["di", "code"])
    weeks = {r["di"] for r in cells.groupBy("di").count().where("count >= 5").select("di").collect()}
    solved = {r["problem"] for r in queries.QUERIES["optimizer_solve"](spark, folder).select("problem").distinct().collect()}
    assert solved == weeks and any(di % 4 for di in weeks)


def test_full_discipline_queries(spark):
    """The operators' own 20 arms and 12,870 combinations."""
    assert queries.QUERIES["noise_control_full"](spark, "/root/testdata/sf0.01").first()["n_arms"] == 20
    assert queries.QUERIES["pbo_cscv_full"](spark, "/root/testdata/sf0.01").first()["n_combinations"] == 12870


def test_noise_control_deals_arms_where_the_day_is(spark):
    """No row is copied per arm, and every day's coefficients are those of the dealt values."""
    folder = "/root/testdata/sf0.01"
    grid = panel_source.Panel.of(spark, folder).grid
    factor, label = factors.evaluate("rev_5", grid), ev.forward_returns(grid, 5)
    plan = discipline.noise_control(factor, label)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Generate" in line and "arm#" in line]
    found = {(r["di"], r["arm"]): r["ic"] for r in discipline.control_series(factor, label, 3, 20).collect()}
    y = label.where("value IS NOT NULL").select("di", "code", F.col("value").alias("y"))
    dealt = ev.ic_of(discipline.permuted(factor, 3).withColumnRenamed("value", "f").join(y, ["di", "code"]), "arm", min_names=20).select("di", "arm", "ic")
    wanted = {(r["di"], r["arm"]): r["ic"] for r in dealt.union(ev.ic_series(factor, label, 20).select("di", F.lit(-1), "ic")).collect()}
    assert found == pytest.approx(wanted) and len(wanted) > 1000
    none = discipline.noise_control(factor, label, 3, 10**6).first()
    assert tuple(none) == (None, None, None, 1.0, 0)


def test_bars_are_not_dealt_out_again_for_the_grid(spark):
    """Bars are grouped by the keys of the grid's join, so the join exchanges only the grid's cells."""
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    plan = panel_source.weekly_bars(lines)._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert len(keys) == 1 and "l_suppkey" not in keys[0].split(")")[0]
