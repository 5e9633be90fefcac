"""DuckDB SQL twins of the queries, over the same tables.

``panel`` holds the common table expressions up to the dense grid; each query adds its own. Windows are
written out, so that the twins share nothing with the DataFrame code but the definitions.
"""

from __future__ import annotations

BARS = """
bars AS (
  SELECT date_trunc('week', l_shipdate)::DATE AS date,
    CASE l_suppkey % 4 WHEN 0 THEN 'sh.600' WHEN 1 THEN 'sz.000' WHEN 2 THEN 'sz.300' ELSE 'sh.688' END || lpad(l_suppkey::VARCHAR, greatest(4, length(l_suppkey::VARCHAR))::INT, '0') AS code,
    first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS close,
    sum(l_quantity) AS volume, sum(l_extendedprice) AS amount, min((l_returnflag = 'R')::INT)::TINYINT AS is_st
  FROM lineitem GROUP BY 1, l_suppkey),
long AS (SELECT *, close AS adj_close, least(1.0::DOUBLE, volume / 500) AS turn, (volume >= 10)::TINYINT AS is_trading FROM bars),
cal AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS di FROM (SELECT DISTINCT date FROM bars)),
grid AS (
  SELECT cal.di, cal.date, codes.code, open, high, low, close, adj_close, volume, amount, turn, is_st, is_trading
  FROM cal CROSS JOIN (SELECT DISTINCT code FROM bars) codes LEFT JOIN long ON long.date = cal.date AND long.code = codes.code)
"""

W = "PARTITION BY code ORDER BY di"


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER ({W})" if k >= 0 else f"lead({x}, {-k}) OVER ({W})"


def rolling(how: str, x: str, n: int, least: int) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {least} THEN {how}({x}) {frame} END"


def rank_average(x: str, day: str = "di") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {day}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {day}, {x}) - 1) / 2e0 END"


def rank_pct(x: str, day: str = "di") -> str:
    return f"({rank_average(x, day)}) / count({x}) OVER (PARTITION BY {day})"


def corr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) * var_pop({b})), 0)"


def bround(x: str, digits: int) -> str:
    return f"round_even({x}, {digits})"


def query(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join([BARS, *ctes]) + "\n" + select


def value(x: str, *ctes: str, source: str = "grid") -> str:
    """A query of all cells with a value."""
    return query(*ctes, f"v AS (SELECT date, code, {x} AS value FROM {source})", select="SELECT date, code, round(value, 8) AS value FROM v WHERE value IS NOT NULL")


RET = f"ret AS (SELECT *, adj_close / nullif({lag('adj_close', 1)}, 0) - 1 AS ret FROM grid)"
MOM = f"{lag('adj_close', 5)} / nullif({lag('adj_close', 25)}, 0) - 1"
REV = f"adj_close / nullif({lag('adj_close', 5)}, 0) - 1"


def ahead(h: int) -> str:
    return f"{lag('adj_close', -(1 + h))} / nullif({lag('adj_close', -1)}, 0) - 1"


VOL = rolling("stddev_samp", "ret", 20, 15)
AMIHUD = [RET, "imp AS (SELECT *, CASE WHEN amount > 0 THEN abs(ret) / amount * 1e9 END AS impact FROM ret)"]
SIZE = f"""raw_size AS (SELECT *, CASE WHEN turn > 1e-6 AND close * volume / turn > 0 THEN ln(close * volume / turn) END AS ls FROM grid),
size AS (SELECT di, date, code, last_value(ls IGNORE NULLS) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS value FROM raw_size)"""
#: The reversal factor with its five-day label: cells that have both, ranked by day.
IC = f"""
fy AS (SELECT di, date, code, {REV} AS f, {ahead(5)} AS y FROM grid),
pairs AS (SELECT *, count(*) OVER (PARTITION BY di) AS n FROM fy WHERE f IS NOT NULL AND y IS NOT NULL),
ranked AS (SELECT di, date, {rank_average("f")} AS a, {rank_average("y")} AS b FROM pairs WHERE n >= 30),
ic AS (SELECT * FROM (SELECT di, date, {corr("a", "b")} AS ic FROM ranked GROUP BY di, date) WHERE ic IS NOT NULL)
"""
QUANTILES = f"""
named AS (SELECT di, date, ceil(({rank_pct("f")}) * 5) AS bucket, y FROM (SELECT di, date, code, {REV} AS f, {ahead(1)} AS y FROM grid) WHERE f IS NOT NULL),
q AS (SELECT di, date, {", ".join(f"avg(y) FILTER (bucket = {k}) AS q{k}" for k in range(1, 6))} FROM named WHERE y IS NOT NULL GROUP BY di, date)
"""
LEGS = f"""
f AS (SELECT di, code, {REV} AS f, {ahead(1)} AS y FROM grid),
p AS (SELECT di, code, {rank_pct("f")} AS p FROM f WHERE f IS NOT NULL),
members AS (
  SELECT 'top' AS leg, di, code FROM p WHERE di % 5 = 0 AND p > 1 - 1 / 5e0
  UNION ALL SELECT 'bottom', di, code FROM p WHERE di % 5 = 0 AND p <= 1 / 5e0),
sched AS (SELECT leg, di, lag(di) OVER (PARTITION BY leg ORDER BY di) AS before, lead(di) OVER (PARTITION BY leg ORDER BY di) AS until FROM (SELECT DISTINCT leg, di FROM members)),
turns AS (
  SELECT s.leg, s.di, any_value(s.until) AS until, CASE WHEN any_value(s.before) IS NULL THEN 1 ELSE 1 - count(o.code) / count(*)::DOUBLE END::DOUBLE AS turnover
  FROM sched s JOIN members m ON m.leg = s.leg AND m.di = s.di LEFT JOIN members o ON o.leg = s.leg AND o.di = s.before AND o.code = m.code GROUP BY s.leg, s.di),
held AS (SELECT cal.di, t.leg, t.di AS since FROM cal JOIN turns t ON cal.di >= t.di AND (t.until IS NULL OR cal.di < t.until)),
gross AS (SELECT h.leg, h.di, avg(f.y) AS g FROM held h JOIN members m ON m.leg = h.leg AND m.di = h.since LEFT JOIN f ON f.di = h.di AND f.code = m.code GROUP BY h.leg, h.di),
legs AS (SELECT g.di, g.leg, CASE WHEN g IS NOT NULL THEN g - coalesce(t.turnover * 0.003::DOUBLE, 0) WHEN t.turnover IS NOT NULL THEN -t.turnover * 0.003::DOUBLE END AS ret, t.turnover FROM gross g LEFT JOIN turns t ON t.leg = g.leg AND t.di = g.di),
spread AS (SELECT di, max(ret) FILTER (leg = 'top') AS top, max(ret) FILTER (leg = 'bottom') AS bottom FROM legs GROUP BY di),
layered AS (SELECT * FROM legs UNION ALL SELECT di, 'ls', top - bottom, NULL FROM spread WHERE top IS NOT NULL AND bottom IS NOT NULL)
"""
STYLES = f"""{RET},
market AS (SELECT di, avg(ret) AS mkt FROM ret GROUP BY di),
rolled AS (SELECT di, mkt, CASE WHEN count(mkt) OVER w >= 26 THEN avg(mkt) OVER w END AS ey, CASE WHEN count(mkt) OVER w >= 26 THEN avg(mkt * mkt) OVER w END AS eyy FROM market WINDOW w AS (ORDER BY di ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)),
m AS (SELECT ret.*, mkt, ey, eyy, ret * mkt AS xy, CASE WHEN turn > 1e-6 AND close * volume / turn > 0 THEN ln(close * volume / turn) END AS ls FROM ret JOIN rolled USING (di)),
sm AS (SELECT *, {rolling("avg", "ret", 52, 26)} AS ex, {rolling("avg", "xy", 52, 26)} AS exy, {rolling("avg", "turn", 8, 4)} AS flow FROM m),
styles AS (SELECT di, date, code, last_value(ls IGNORE NULLS) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS size, (exy - ex * ey) / nullif(eyy - ey * ey, 0) AS beta,
  {lag("adj_close", 4)} / nullif({lag("adj_close", 52)}, 0) - 1 AS momentum, {rolling("stddev_samp", "ret", 26, 13)} AS volatility, CASE WHEN flow > 0 THEN ln(flow) END AS liquidity FROM sm)"""


def prepared(name: str, source: str = "styles") -> str:
    """A style winsorised and standardised by day, as ``p_<name>``."""
    return f"""w0_{name} AS (SELECT di, code, {name} AS x, median({name}) OVER (PARTITION BY di) AS md FROM {source}),
w1_{name} AS (SELECT *, 1.4826e0 * 5 * median(abs(x - md)) OVER (PARTITION BY di) AS dev FROM w0_{name}),
w2_{name} AS (SELECT di, code, CASE WHEN x IS NOT NULL THEN least(greatest(x, md - dev), md + dev) END AS x FROM w1_{name}),
p_{name} AS (SELECT di, code, (x - avg(x) OVER (PARTITION BY di)) / nullif(stddev_samp(x) OVER (PARTITION BY di), 0) AS {name} FROM w2_{name})"""


FUNDAMENTALS = """
events AS (
  SELECT CASE l_suppkey % 4 WHEN 0 THEN 'sh.600' WHEN 1 THEN 'sz.000' WHEN 2 THEN 'sz.300' ELSE 'sh.688' END || lpad(l_suppkey::VARCHAR, greatest(4, length(l_suppkey::VARCHAR))::INT, '0') AS code,
    report_date, (report_date + (10 + l_suppkey % 90)::INT)::DATE AS pub_date, value
  FROM (SELECT l_suppkey, last_day(date_trunc('quarter', l_shipdate)::DATE + INTERVAL 2 MONTH) AS report_date, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)),
fresh AS (SELECT * FROM (SELECT *, max(report_date) OVER (PARTITION BY code ORDER BY pub_date, report_date ROWS UNBOUNDED PRECEDING) AS newest FROM events) WHERE report_date = newest),
dated AS (SELECT code, value, pub_date, report_date, (SELECT min(di) FROM cal WHERE cal.date > fresh.pub_date) AS di FROM fresh),
lastly AS (SELECT di, code, last(value ORDER BY pub_date, report_date) AS event FROM dated WHERE di IS NOT NULL GROUP BY di, code),
known AS (SELECT g.di, g.date, g.code, g.close, last_value(event IGNORE NULLS) OVER (PARTITION BY g.code ORDER BY g.di) AS value FROM grid g LEFT JOIN lastly l ON l.di = g.di AND l.code = g.code)
"""
MEMBERS = """
snap AS (SELECT DISTINCT m.snap_date, b.code FROM bars b JOIN (SELECT date_trunc('month', date) AS month, max(date) AS snap_date FROM bars GROUP BY 1) m ON date_trunc('month', b.date) = m.month),
member AS (SELECT cal.di, cal.date, snap.code FROM cal JOIN snap ON snap.snap_date = (SELECT max(snap_date) FROM snap s WHERE s.snap_date <= cal.date))
"""
FACTOR_PARTS = f"""{RET}, imp AS (SELECT *, CASE WHEN amount > 0 THEN abs(ret) / amount * 1e9 END AS impact FROM ret),
fs AS (SELECT di, date, code, {REV} AS rev_5, {VOL} AS vol_20, {rolling("avg", "impact", 20, 12)} AS amihud_20, {ahead(5)} AS y FROM imp),
long_f AS (SELECT 'rev_5' AS factor, di, date, code, rev_5 AS v, y FROM fs UNION ALL SELECT 'vol_20', di, date, code, vol_20, y FROM fs UNION ALL SELECT 'amihud_20', di, date, code, amihud_20, y FROM fs),
r AS (SELECT factor, di, date, code, {rank_pct("v", "factor, di")} AS r FROM long_f WHERE v IS NOT NULL)"""

NW = """z AS (SELECT di, row_number() OVER (ORDER BY di) AS k, ic - avg(ic) OVER () AS d, avg(ic) OVER () AS m, count(*) OVER () AS n FROM ic),
s AS (SELECT any_value(a.n) AS n, any_value(a.m) AS m, sum(CASE WHEN b.k = a.k THEN 1 ELSE 2 * (1 - (a.k - b.k) / 6e0) END * a.d * b.d) / any_value(a.n) AS s FROM z a JOIN z b ON a.k - b.k BETWEEN 0 AND 5)"""
#: The buffered book: the names of each rebalance in order, and what is held after it, one rebalance after the other.
BOOK = f"""
size AS (SELECT greatest(2, count(DISTINCT code) // 10) AS top, greatest(3, count(DISTINCT code) // 6) AS buffer FROM bars),
picks AS (SELECT di, list(code ORDER BY v DESC, code) AS names FROM (SELECT di, code, {REV} AS v FROM grid) WHERE v IS NOT NULL AND di % 5 = 0 GROUP BY di),
steps AS (SELECT row_number() OVER (ORDER BY di) AS k, di, names[:buffer] AS near, names[:greatest(top, buffer)] AS names, top FROM picks, size WHERE len(names) >= buffer),
book AS (
  SELECT k, di, names[:top] AS held FROM steps WHERE k = 1
  UNION ALL SELECT k, di, list_concat(kept, list_filter(names, lambda x: NOT list_contains(kept, x))[:greatest(0, top - len(kept))])
  FROM (SELECT s.k, s.di, s.names, s.top, list_filter(b.held, lambda x: list_contains(s.near, x)) AS kept FROM book b JOIN steps s ON s.k = b.k + 1)),
spans AS (SELECT di AS since, lead(di) OVER (ORDER BY di) AS until, held FROM book),
weights AS (SELECT cal.di, cal.date, unnest(held) AS code, 1e0 / len(held) AS weight FROM cal JOIN spans ON cal.di >= since AND (until IS NULL OR cal.di < until))"""
TRADABLE = f"""limits AS (SELECT *, open / nullif({lag('close', 1)}, 0) - 1 AS move, open = high AND open = low AS one, CASE WHEN code[1:6] IN ('sz.300', 'sh.688') AND date >= DATE '1998-08-24' THEN 0.198 WHEN coalesce(is_st, 0) = 1 THEN 0.048 ELSE 0.098 END::DOUBLE AS lim FROM grid),
masks AS (SELECT di, code, NOT coalesce(one AND move >= lim, false) AS can_buy, NOT coalesce(one AND move <= -lim, false) AS can_sell FROM limits)"""
#: Holdings under masks, name by name and day by day: since when a name is held, and whether it waits to be sold.
MASKED = f"""{TRADABLE},
lives AS (SELECT n.leg, n.code, cal.di AS i, m.code IS NOT NULL AS wanted, a.di IS NOT NULL AS active, coalesce(k.can_buy, true) AS buy, coalesce(k.can_sell, true) AS sell
  FROM (SELECT DISTINCT leg, code FROM members) n CROSS JOIN cal LEFT JOIN members m ON m.leg = n.leg AND m.code = n.code AND m.di = cal.di
  LEFT JOIN (SELECT DISTINCT leg, di FROM members) a ON a.leg = n.leg AND a.di = cal.di LEFT JOIN masks k ON k.code = n.code AND k.di = cal.di + 1),
state AS (
  SELECT -1 AS i, leg, code, false AS held, false AS waits, 0 AS late, 0 AS sold, 0 AS bought FROM lives WHERE i = 0
  UNION ALL SELECT i, leg, code, (stays AND NOT (active AND NOT wanted AND sell)) OR (active AND wanted AND NOT stays AND buy), CASE WHEN active THEN stays AND NOT wanted AND NOT sell ELSE waits AND stays END,
    (held AND NOT stays)::INT, (stays AND active AND NOT wanted AND sell)::INT, (active AND wanted AND NOT stays AND buy)::INT
  FROM (SELECT l.*, s.held, s.waits, s.held AND NOT (s.waits AND l.sell) AS stays FROM state s JOIN lives l ON l.leg = s.leg AND l.code = s.code AND l.i = s.i + 1)),
moves AS (SELECT leg, i, sum(held::INT) AS n, sum(late) AS late, sum(sold) AS sold, sum(bought) AS bought FROM state GROUP BY leg, i),
costs AS (SELECT m.leg, m.i, m.late, m.sold + m.bought AS traded, m.n, lag(m.n) OVER (PARTITION BY m.leg ORDER BY m.i) AS before, a.di IS NOT NULL AND m.n > 0 AS turned FROM moves m LEFT JOIN (SELECT DISTINCT leg, di FROM members) a ON a.leg = m.leg AND a.di = m.i),
earned AS (SELECT s.leg, s.i, avg(f.y) AS gross FROM state s JOIN f ON f.di = s.i AND f.code = s.code WHERE held GROUP BY s.leg, s.i),
booked AS (SELECT c.leg, c.i AS di, gross, CASE WHEN turned THEN traded / (2e0 * n) END AS turnover, CASE WHEN c.late > 0 THEN 0.0015::DOUBLE * c.late / before END AS retry, CASE WHEN turned THEN 0.0015::DOUBLE * traded / n END AS now
  FROM costs c LEFT JOIN earned e ON e.leg = c.leg AND e.i = c.i WHERE c.i >= 0),
masked_legs AS (SELECT di, leg, coalesce(gross, 0) - coalesce(retry, 0) - coalesce(now, 0) AS ret, turnover FROM booked WHERE gross IS NOT NULL OR retry IS NOT NULL OR now IS NOT NULL),
masked_spread AS (SELECT di, max(ret) FILTER (leg = 'top') AS top, max(ret) FILTER (leg = 'bottom') AS bottom FROM masked_legs GROUP BY di),
masked AS (SELECT * FROM masked_legs UNION ALL SELECT di, 'ls', top - bottom, NULL FROM masked_spread WHERE top IS NOT NULL AND bottom IS NOT NULL)"""
POLLUTED = f"""still AS (SELECT di, date, code, (CASE WHEN is_trading = 1 THEN turn ELSE 0 END = 0)::INT AS z FROM grid),
bad AS (SELECT di, code, coalesce(max(z) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), 0) = 1 AS polluted FROM still)"""
AUTOCORR = f"""ra AS (SELECT di, code, {rank_pct('v')} AS r FROM (SELECT di, code, {REV} AS v FROM grid)), rb AS (SELECT di, r, {lag('r', 5)} AS before FROM ra),
rc AS (SELECT di, {corr('r', 'before')} AS c FROM rb WHERE r IS NOT NULL AND before IS NOT NULL GROUP BY di)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES: dict[str, str] = {
    "panel_weekly": query(select="SELECT date, code, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(adj_close, 8) AS adj_close, round(volume, 8) AS volume, round(amount, 8) AS amount, round(turn, 8) AS turn, is_st, is_trading FROM long"),
    "panel_dense_grid": query(select="SELECT di, date, code, round(close, 8) AS close, round(turn, 8) AS turn, is_trading FROM grid"),
    "calendar_ordinal": query(select="SELECT date, di FROM cal"),
    "fwd_returns_h5": value(ahead(5)),
    "fwd_return_1d": value(ahead(1)),
    "factor_mom_20_5": value(MOM),
    "factor_rev_5": value(REV),
    "factor_vol_20": value(VOL, RET, source="ret"),
    "factor_turn_surge_5_60": value(f"CASE WHEN {rolling('avg', 'turn', 60, 40)} > 1e-8 THEN ({rolling('avg', 'turn', 5, 3)}) / ({rolling('avg', 'turn', 60, 40)}) END").replace("round(value, 8)", "round(value, 11)"),
    "factor_amihud_20": value(rolling("avg", "impact", 20, 12), *AMIHUD, source="imp"),
    "factor_px_pos_250": value("CASE WHEN hi - lo > 1e-12 THEN (adj_close - lo) / (hi - lo) END", f"r250 AS (SELECT *, {rolling('max', 'adj_close', 250, 120)} AS hi, {rolling('min', 'adj_close', 250, 120)} AS lo FROM grid)", source="r250"),
    "factor_chip_age": query(
        f"cells AS (SELECT di, date, code, close, 1 - least(greatest(coalesce(turn, 0), 0), 1) AS k, count(close) OVER ({W} ROWS UNBOUNDED PRECEDING) AS seen FROM grid)",
        "age AS (SELECT di, code, (k * 1)::DOUBLE AS a FROM cells WHERE di = 0 UNION ALL SELECT c.di, c.code, c.k * (age.a + 1) FROM age JOIN cells c ON c.code = age.code AND c.di = age.di + 1)",
        select="SELECT c.date, c.code, round(a, 8) AS value FROM age JOIN cells c USING (di, code) WHERE close IS NOT NULL AND seen >= 60",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "xs_rank_pct": value(rank_pct("amount")),
    "xs_winsorize_mad": query(
        "a AS (SELECT *, median(amount) OVER (PARTITION BY di) AS md FROM grid)", "b AS (SELECT *, 1.4826e0 * 1.5 * median(abs(amount - md)) OVER (PARTITION BY di) AS dev FROM a)",
        select="SELECT date, code, round(least(greatest(amount, md - dev), md + dev), 8) AS value FROM b WHERE amount IS NOT NULL",
    ),
    "xs_zscore": value("(close - avg(close) OVER (PARTITION BY di)) / nullif(stddev_samp(close) OVER (PARTITION BY di), 0)"),
    "ic_daily": query(IC, select="SELECT date, round(ic, 8) AS ic FROM ic"),
    "ic_summary": query(IC, select=f"SELECT {bround('avg(ic)', 4)} AS ic_mean, {bround('avg(ic) / stddev_samp(ic)', 3)} AS icir, {bround('avg(ic) / stddev_samp(ic) * sqrt(greatest(count(*) / 5e0, 1))', 2)} AS t_cons, count(*) AS n FROM ic"),
    "ic_yearly": query(IC, select=f"SELECT year(date)::INT AS year, {bround('avg(ic)', 4)} AS ic_mean, {bround('avg(ic) / nullif(stddev_samp(ic), 0)', 3)} AS icir, count(*) AS n, avg(ic) > 0 AS positive FROM ic GROUP BY 1"),
    "ic_monthly_pivot": query(IC, select="SELECT year(date)::INT AS year, " + ", ".join(f"round(avg(ic) FILTER (month(date) = {m}), 8) AS m{m}" for m in range(1, 13)) + " FROM ic GROUP BY 1"),
    "newey_west_t": query(
        IC, "z AS (SELECT di, row_number() OVER (ORDER BY di) AS k, ic - avg(ic) OVER () AS d, avg(ic) OVER () AS m, count(*) OVER () AS n FROM ic)",
        "s AS (SELECT any_value(a.n) AS n, any_value(a.m) AS m, sum(CASE WHEN b.k = a.k THEN 1 ELSE 2 * (1 - (a.k - b.k) / 6e0) END * a.d * b.d) / any_value(a.n) AS s FROM z a JOIN z b ON a.k - b.k BETWEEN 0 AND 5)",
        select="SELECT n, round(m / sqrt(s / n), 8) AS nw_t FROM s",
    ),
    "horizon_profile": query(
        "h AS (SELECT unnest([1, 5, 10, 20])::INT AS h)",
        f"fy AS (SELECT di, date, code, {REV} AS f, {lag('adj_close', -1)} AS base, {', '.join(f'{lag("adj_close", -(1 + h))} AS a{h}' for h in (1, 5, 10, 20))} FROM grid)",
        "pairs AS (SELECT *, count(*) OVER (PARTITION BY h, di) AS n FROM (SELECT h, di, date, code, f, CASE h WHEN 1 THEN a1 WHEN 5 THEN a5 WHEN 10 THEN a10 ELSE a20 END / nullif(base, 0) - 1 AS y FROM fy, h) WHERE f IS NOT NULL AND y IS NOT NULL)",
        f"ranked AS (SELECT h, di, {rank_average('f', 'h, di')} AS a, {rank_average('y', 'h, di')} AS b FROM pairs WHERE n >= 30)",
        f"ic AS (SELECT * FROM (SELECT h, di, {corr('a', 'b')} AS ic FROM ranked GROUP BY h, di) WHERE ic IS NOT NULL)",
        select=f"SELECT h, {bround('avg(ic)', 4)} AS ic_mean, {bround('avg(ic) / stddev_samp(ic)', 3)} AS icir, {bround('avg(ic) / stddev_samp(ic) * sqrt(greatest(count(*) / h::DOUBLE, 1))', 2)} AS t_cons, count(*) AS n FROM ic GROUP BY h",
    ),
    "rank_autocorr": query(
        RET, f"v AS (SELECT di, code, {VOL} AS v FROM ret)", f"a AS (SELECT di, code, {rank_pct('v')} AS r FROM v)", f"b AS (SELECT di, r, {lag('r', 5)} AS before FROM a)",
        f"c AS (SELECT di, {corr('r', 'before')} AS c FROM b WHERE r IS NOT NULL AND before IS NOT NULL GROUP BY di)", select=f"SELECT {bround('avg(c)', 4)} AS rank_autocorr FROM c",
    ),
    "orient_sign": query(
        f"fy AS (SELECT di, code, {REV} AS f, {ahead(5)} AS y FROM grid)", f"r AS (SELECT di, {rank_pct('f')} AS a, {rank_pct('y')} AS b FROM fy)",
        f"c AS (SELECT di, {corr('a', 'b')} AS c FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY di)", select="SELECT CASE WHEN avg(c) >= 0 THEN 1 ELSE -1 END AS sign, round(avg(c), 8) AS mean_corr FROM c",
    ),
    "coverage": query(RET, f"v AS (SELECT di, {VOL} AS v, close FROM ret)", "d AS (SELECT di, count(v) / nullif(count(close), 0)::DOUBLE AS c FROM v WHERE di > (SELECT max(di) FROM cal) - 252 GROUP BY di)", select="SELECT round(avg(c), 8) AS coverage FROM d"),
    "quantile_returns": query(QUANTILES, select="SELECT date, " + ", ".join(f"round(q{k}, 8) AS q{k}" for k in range(1, 6)) + ", round(q5 - q1, 8) AS ls FROM q"),
    "style_size": value("value", SIZE, source="size"),
    **{f"style_{n}": value(n, STYLES, source="styles") for n in ("beta", "momentum", "volatility", "liquidity")},
    "neutralize_size": query(
        SIZE, f"fy AS (SELECT di, date, code, {REV} AS f FROM grid)", "c AS (SELECT fy.*, size.value AS x FROM fy JOIN size USING (di, code) WHERE f IS NOT NULL AND size.value IS NOT NULL)",
        "g AS (SELECT di, regr_slope(f, x) AS s, regr_intercept(f, x) AS i, count(*) AS n FROM c GROUP BY di)", select="SELECT date, code, round(f - i - s * x, 8) AS value FROM c JOIN g USING (di) WHERE n >= 11",
    ),
    "residualize_industry_size": query(
        SIZE, "styles AS (SELECT di, code, value AS size FROM size)", prepared("size"), f"fy AS (SELECT di, date, code, {REV} AS f FROM grid)",
        "ind AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'sh.600' WHEN 1 THEN 'sz.000' WHEN 2 THEN 'sz.300' ELSE 'sh.688' END || lpad(s_suppkey::VARCHAR, greatest(4, length(s_suppkey::VARCHAR))::INT, '0') AS code, n_name AS industry FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)",
        "c AS (SELECT fy.*, size AS x, industry, count(*) OVER (PARTITION BY di) AS n FROM fy JOIN p_size USING (di, code) JOIN ind USING (code) WHERE f IS NOT NULL AND size IS NOT NULL)",
        "e AS (SELECT *, f - avg(f) OVER (PARTITION BY di, industry) AS fd, x - avg(x) OVER (PARTITION BY di, industry) AS xd FROM c WHERE n >= greatest(50, (SELECT count(DISTINCT industry) FROM ind) + 12))",
        select="SELECT date, code, round(fd - xd * coalesce(sum(fd * xd) OVER (PARTITION BY di) / nullif(sum(xd * xd) OVER (PARTITION BY di), 0), 0), 8) AS value FROM e",
    ),
    "residualize_multi_style": query(
        STYLES, prepared("size"), prepared("volatility"), f"fy AS (SELECT di, date, code, {REV} AS f FROM grid)",
        "c AS (SELECT fy.*, size AS x, volatility AS z, count(*) OVER (PARTITION BY di) AS n FROM fy JOIN p_size USING (di, code) JOIN p_volatility USING (di, code) WHERE f IS NOT NULL AND size IS NOT NULL AND volatility IS NOT NULL)",
        "g AS (SELECT di, avg(f) AS mf, avg(x) AS mx, avg(z) AS mz, covar_pop(f, x) AS fx, covar_pop(f, z) AS fz, covar_pop(x, z) AS xz, var_pop(x) AS xx, var_pop(z) AS zz FROM c WHERE n >= 50 GROUP BY di)",
        select="SELECT date, code, round(f - mf - (fx * zz - fz * xz) / (xx * zz - xz * xz) * (x - mx) - (fz * xx - fx * xz) / (xx * zz - xz * xz) * (z - mz), 8) AS value FROM c JOIN g USING (di)",
    ),
    "covariance_inputs": query(
        STYLES, prepared("size"), prepared("volatility"), f"fy AS (SELECT di, code, {ahead(1)} AS f FROM grid)",
        "c AS (SELECT fy.*, size AS x, volatility AS z FROM fy JOIN p_size USING (di, code) JOIN p_volatility USING (di, code) WHERE f IS NOT NULL AND size IS NOT NULL AND volatility IS NOT NULL)",
        "g AS (SELECT di, count(*) AS n, covar_pop(f, x) AS fx, covar_pop(f, z) AS fz, covar_pop(x, z) AS xz, var_pop(x) AS xx, var_pop(z) AS zz FROM c GROUP BY di)",
        select="SELECT di, round((fx * zz - fz * xz) / (xx * zz - xz * xz), 8) AS size, round((fz * xx - fx * xz) / (xx * zz - xz * xz), 8) AS volatility FROM g WHERE n >= 30",
    ),
    "style_totals": query(
        STYLES, prepared("size"), prepared("volatility"), f"fy AS (SELECT di, code, {ahead(1)} AS f FROM grid)",
        "c AS (SELECT fy.*, size AS x, volatility AS z FROM fy JOIN p_size USING (di, code) JOIN p_volatility USING (di, code) WHERE f IS NOT NULL AND size IS NOT NULL AND volatility IS NOT NULL)",
        "g AS (SELECT di, count(*) AS n, covar_pop(f, x) AS fx, covar_pop(f, z) AS fz, covar_pop(x, z) AS xz, var_pop(x) AS xx, var_pop(z) AS zz FROM c GROUP BY di)",
        select="SELECT 'size' AS style, round(sum((fx * zz - fz * xz) / (xx * zz - xz * xz)), 6) AS total FROM g WHERE n >= 30 HAVING count(*) > 0 UNION ALL SELECT 'volatility', round(sum((fz * xx - fx * xz) / (xx * zz - xz * xz)), 6) FROM g WHERE n >= 30 HAVING count(*) > 0",
    ),
    "factor_returns": query(
        SIZE, "styles AS (SELECT di, code, value AS size FROM size)", prepared("size"), f"fy AS (SELECT di, date, code, {ahead(1)} AS f FROM grid)",
        select="SELECT date, round(regr_slope(f, size), 8) AS size FROM fy JOIN p_size USING (di, code) WHERE f IS NOT NULL AND size IS NOT NULL GROUP BY di, date HAVING count(*) >= 30",
    ),
    "pit_fundamental_asof": query(FUNDAMENTALS, select="SELECT date, code, round(value, 8) AS value FROM known WHERE value IS NOT NULL"),
    "value_btop": query(FUNDAMENTALS, select="SELECT date, code, round(value / close, 8) AS value FROM known WHERE value IS NOT NULL AND close > 1e-12"),
    "membership_asof": query(MEMBERS, select="SELECT date, code FROM member"),
    "pit_universe": query(
        MEMBERS, f"c AS (SELECT *, count(close) OVER ({W} ROWS UNBOUNDED PRECEDING) AS listed, {rolling('median', 'CASE WHEN amount > 0 THEN amount END', 26, 17)} AS liq FROM grid)",
        "e AS (SELECT c.*, m.code IS NOT NULL AND listed >= 26 AND close IS NOT NULL AND coalesce(is_st, 0) <> 1 AND coalesce(is_trading, 0) = 1 AND liq IS NOT NULL AS ok FROM c LEFT JOIN member m ON m.di = c.di AND m.code = c.code)",
        select="SELECT date, code, ok AND row_number() OVER (PARTITION BY di, ok ORDER BY liq DESC, code) <= greatest(5, (SELECT count(DISTINCT code) FROM bars) // 2) AS in_universe FROM e",
    ),
    "tradability_masks": query(
        f"c AS (SELECT *, open / nullif({lag('close', 1)}, 0) - 1 AS move, open = high AND open = low AS one, CASE WHEN code[1:6] IN ('sz.300', 'sh.688') AND date >= DATE '1998-08-24' THEN 0.198 WHEN coalesce(is_st, 0) = 1 THEN 0.048 ELSE 0.098 END::DOUBLE AS lim FROM grid)",
        select="SELECT date, code, NOT coalesce(one AND move >= lim, false) AS can_buy, NOT coalesce(one AND move <= -lim, false) AS can_sell FROM c",
    ),
    "suspension_pollution": query(
        "c AS (SELECT di, date, code, (CASE WHEN is_trading = 1 THEN turn ELSE 0 END = 0)::INT AS z FROM grid)",
        select=f"SELECT date, code, coalesce(max(z) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), 0) = 1 AS polluted FROM c",
    ),
    "ewm_cov": query(
        QUANTILES, "w AS (SELECT *, pow(0.5::DOUBLE, (row_number() OVER (ORDER BY di DESC) - 1) / 26e0) AS w FROM q WHERE q1 IS NOT NULL AND q5 IS NOT NULL)",
        "pairs AS (SELECT 'q1' AS a, 'q1' AS b, q1 AS x, q1 AS y, w FROM w UNION ALL SELECT 'q1', 'q5', q1, q5, w FROM w UNION ALL SELECT 'q5', 'q5', q5, q5, w FROM w)",
        select="SELECT a, b, round((sum(w * x * y) / sum(w) - sum(w * x) * sum(w * y) / (sum(w) * sum(w))) * (sum(w) * sum(w)) / (sum(w) * sum(w) - sum(w * w)), 8) AS cov FROM pairs GROUP BY a, b",
    ),
    "ewm_spec_var": query(
        f"fy AS (SELECT di, code, {ahead(1)} AS y FROM grid)", "l AS (SELECT max(di) - 2 AS l FROM cal)",
        "c AS (SELECT code, y, pow(0.5::DOUBLE, ((SELECT l FROM l) - di) / 26e0) AS w FROM fy WHERE di <= (SELECT l FROM l) AND y IS NOT NULL)",
        select="SELECT code, round(CASE WHEN count(*) >= 60 THEN sum(w * y * y) / sum(w) END, 8) AS var FROM c GROUP BY code",
    ),
    "composite_equal_weight": query(FACTOR_PARTS, select="SELECT date, code, round(avg(r), 8) AS value FROM r WHERE r IS NOT NULL GROUP BY di, date, code HAVING count(*) >= 2"),
    "composite_icir": query(
        FACTOR_PARTS, "pairs AS (SELECT *, count(*) OVER (PARTITION BY factor, di) AS n FROM long_f WHERE v IS NOT NULL AND y IS NOT NULL)",
        f"rk AS (SELECT factor, di, {rank_average('v', 'factor, di')} AS a, {rank_average('y', 'factor, di')} AS b FROM pairs WHERE n >= 30)",
        f"ic AS (SELECT factor, di, {corr('a', 'b')} AS ic FROM rk GROUP BY factor, di)",
        "fd AS (SELECT DISTINCT factor FROM long_f)", "k AS (SELECT fd.factor, cal.di, lag(ic, 7) OVER (PARTITION BY fd.factor ORDER BY cal.di) AS ic FROM fd CROSS JOIN cal LEFT JOIN ic ON ic.factor = fd.factor AND ic.di = cal.di)",
        "wt AS (SELECT factor, di, CASE WHEN count(ic) OVER w >= 26 THEN greatest(avg(ic) OVER w / nullif(stddev_samp(ic) OVER w, 0), 0) END AS w FROM k WINDOW w AS (PARTITION BY factor ORDER BY di ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))",
        select="SELECT date, code, round(sum(coalesce(w, 0) * r) / sum(coalesce(w, 0)), 8) AS value FROM r LEFT JOIN wt USING (factor, di) WHERE r IS NOT NULL GROUP BY di, date, code HAVING sum(coalesce(w, 0)) > 0 AND count(r) >= 2",
    ),
    "layered_backtest_daily": query(LEGS, select="SELECT di, leg, round(ret, 8) AS ret, round(turnover, 8) AS turnover FROM layered"),
    "layered_metrics": query(
        LEGS, "c AS (SELECT leg, di, ret, sum(ret) OVER (PARTITION BY leg ORDER BY di) AS cum FROM layered WHERE ret IS NOT NULL)", "dd AS (SELECT *, cum - max(cum) OVER (PARTITION BY leg ORDER BY di) AS dd FROM c)",
        select=f"SELECT leg, {bround('avg(ret) * 52', 4)} AS ann_ret, {bround('avg(ret) * 52 / (stddev_samp(ret) * sqrt(52e0))', 2)} AS sharpe, {bround('min(dd)', 3)} AS max_dd, count(*) AS n FROM dd GROUP BY leg",
    ),
    "tear_sheet": query(
        IC, QUANTILES, NW, AUTOCORR,
        select=f"SELECT 'rev_5' AS factor, {bround('avg(ic)', 4)} AS ic_mean, {bround('avg(ic) / stddev_samp(ic)', 3)} AS icir, {bround('avg(ic) / stddev_samp(ic) * sqrt(greatest(count(*) / 5e0, 1))', 2)} AS t_cons, "
        f"(SELECT {bround('m / sqrt(s / n)', 2)} FROM s) AS nw_t, count(*) AS n, (SELECT {bround('avg(c)', 4)} FROM rc) AS rank_autocorr, (SELECT avg(q5 - q1) * 52 FROM q) AS ls_annual FROM ic",
    ),
    "topn_buffer_weights": recursive(query(BOOK, select="SELECT date, code, round(weight, 8) AS weight FROM weights")),
    "turnover": recursive(query(
        BOOK, f"held AS (SELECT g.di, g.code, coalesce(weight, 0) AS w FROM grid g LEFT JOIN weights USING (di, code))", f"c AS (SELECT di, abs(w - {lag('w', 1)}) AS c FROM held)",
        select="SELECT di, round(coalesce(sum(c), 0) / 2, 8) AS turnover FROM c GROUP BY di",
    )),
    "portfolio_returns": recursive(query(BOOK, f"y AS (SELECT di, code, {ahead(1)} AS y FROM grid)", select="SELECT di, round(sum(weight * coalesce(y, 0)), 8) AS ret FROM weights LEFT JOIN y USING (di, code) GROUP BY di")),
    "target_holdings": recursive(query(BOOK, select="SELECT code, round(weight, 8) AS weight FROM weights WHERE di = (SELECT max(di) FROM cal)")),
    "layered_backtest_masked": recursive(query(LEGS, MASKED, select="SELECT di, leg, round(ret, 8) AS ret, round(turnover, 8) AS turnover FROM masked")),
    "series_moments": query(
        LEGS, "x AS (SELECT ret AS r, avg(ret) OVER () AS m FROM layered WHERE leg = 'ls' AND ret IS NOT NULL)", "mo AS (SELECT avg(r) AS m, stddev_samp(r) AS sd, avg(pow(r - m, 2)) AS m2, avg(pow(r - m, 3)) AS m3, avg(pow(r - m, 4)) AS m4, count(*) AS n FROM x)",
        select="SELECT round(m / sd, 6) AS sharpe, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2), 6) AS kurt, n FROM mo",
    ),
    "admission_check": query(
        IC, NW, AUTOCORR, RET, f"fv AS (SELECT di, code, close, {VOL} AS vol, adj_close / nullif({lag('adj_close', 5)}, 0) - 1 AS rev FROM ret)",
        "cov AS (SELECT avg(c) AS v FROM (SELECT di, count(rev) / nullif(count(close), 0)::DOUBLE AS c FROM fv WHERE di > (SELECT max(di) FROM cal) - 252 GROUP BY di))",
        "yr AS (SELECT avg((m > 0)::INT) AS v FROM (SELECT avg(ic) AS m FROM ic GROUP BY year(date)))",
        f"pr AS (SELECT di, {rank_average('rev')} AS a, {rank_average('vol')} AS b FROM fv WHERE di % 5 = 0)",
        f"pool AS (SELECT avg(c) AS v FROM (SELECT di, {corr('a', 'b')} AS c FROM pr WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY di))",
        """g AS (SELECT 'end_aligned' AS gate, (SELECT max(date) FROM bars WHERE close IS NOT NULL) - (SELECT max(date) FROM cal) + 0e0 AS value, true AS hard UNION ALL SELECT 'coverage_1y', (SELECT v FROM cov), true
  UNION ALL SELECT 'direction', (SELECT avg(ic) FROM ic), true UNION ALL SELECT 'yearly_consistency', (SELECT v FROM yr), true UNION ALL SELECT 'significance_nw', (SELECT m / sqrt(s / n) FROM s), true
  UNION ALL SELECT 'turnover_flag', (SELECT round_even(avg(c), 4) FROM rc), false UNION ALL SELECT 'pool_redundancy', (SELECT v FROM pool), false)""",
        "t AS (SELECT *, coalesce(CASE gate WHEN 'end_aligned' THEN value = 0 WHEN 'coverage_1y' THEN value >= 0.4 WHEN 'direction' THEN value > 0 WHEN 'yearly_consistency' THEN value >= 0.6 WHEN 'significance_nw' THEN value >= 3 WHEN 'turnover_flag' THEN value >= 0.5 ELSE abs(value) <= 0.7 END, gate = 'pool_redundancy') AS ok FROM g)",
        select="SELECT gate, round(value, 6) AS value, ok, hard, (SELECT CASE WHEN bool_or(hard AND NOT ok) THEN 'fail' WHEN bool_or(NOT ok) THEN 'warn' ELSE 'pass' END FROM t) AS verdict FROM t",
    ),
    "neutralize_two_styles": query(
        STYLES, f"fy AS (SELECT di, date, code, {REV} AS f FROM grid)",
        "c AS (SELECT fy.*, size AS x, volatility AS z, count(*) OVER (PARTITION BY di) AS n FROM fy JOIN (SELECT di, code, size, volatility FROM styles) USING (di, code) WHERE f IS NOT NULL AND size IS NOT NULL AND volatility IS NOT NULL)",
        "g AS (SELECT di, avg(f) AS mf, avg(x) AS mx, avg(z) AS mz, covar_pop(f, x) AS fx, covar_pop(f, z) AS fz, covar_pop(x, z) AS xz, var_pop(x) AS xx, var_pop(z) AS zz FROM c WHERE n >= 12 GROUP BY di)",
        select="SELECT date, code, round(f - mf - (fx * zz - fz * xz) / (xx * zz - xz * xz) * (x - mx) - (fz * xx - fx * xz) / (xx * zz - xz * xz) * (z - mz), 8) AS value FROM c JOIN g USING (di)",
    ),
    "overlay_metrics": query(
        LEGS, "market AS (SELECT di, avg(y) AS b FROM f GROUP BY di)", "x AS (SELECT ret - b AS x FROM legs JOIN market USING (di) WHERE leg = 'top')",
        select="SELECT round(avg(x) * 52, 8) AS excess, round(stddev_samp(x) * sqrt(52e0), 8) AS tracking_error, round(avg(x) * 52 / (stddev_samp(x) * sqrt(52e0)), 8) AS information_ratio, count(x) AS n FROM x",
    ),
    "rolling_prior": query(
        IC, "k AS (SELECT cal.di, lag(ic, 7) OVER (ORDER BY cal.di) AS ic FROM cal LEFT JOIN ic USING (di))",
        select="SELECT di, round(CASE WHEN count(ic) OVER w >= 26 THEN greatest(avg(ic) OVER w, 0) END, 8) AS ic FROM k WINDOW w AS (ORDER BY di ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)",
    ),
    "prior_asof": query(IC, select="SELECT di, round(greatest(coalesce((SELECT arg_max(ic.ic, ic.di) FROM ic WHERE ic.di <= cal.di), 0), 0), 8) AS ic FROM cal WHERE di % 20 = 0"),
    "execution_days": query(select="SELECT di, CASE WHEN di < (SELECT max(di) FROM cal) THEN di + 1 END AS next_di FROM cal"),
    "upsert_periods": query(FUNDAMENTALS, select="SELECT code, report_date, pub_date, round(CASE WHEN year(report_date) = 1998 THEN value * 2 ELSE value END, 8) AS value FROM events"),
    "pollution_by_year": query(
        POLLUTED, f"fy AS (SELECT di, date, code, {REV} AS f, {ahead(5)} AS y FROM grid)", "c AS (SELECT date, y, polluted FROM fy JOIN bad USING (di, code) WHERE f IS NOT NULL AND y IS NOT NULL)",
        select="SELECT year(date)::INT AS year, count(*) AS scored, count(*) FILTER (polluted) AS polluted, round(count(*) FILTER (polluted) / count(*)::DOUBLE, 8) AS share, round(median(abs(y)) FILTER (polluted), 8) AS median_polluted, "
        "round(median(abs(y)) FILTER (NOT polluted), 8) AS median_clean, round(count(*) FILTER (polluted AND y = 0) / nullif(count(*) FILTER (polluted), 0)::DOUBLE, 8) AS zero_share FROM c GROUP BY 1",
    ),
    "ic_without_polluted": query(
        POLLUTED, f"fy AS (SELECT di, date, code, {REV} AS f, {ahead(5)} AS y FROM grid)", "pairs AS (SELECT fy.*, count(*) OVER (PARTITION BY di) AS n FROM fy JOIN bad USING (di, code) WHERE f IS NOT NULL AND y IS NOT NULL AND NOT polluted)",
        f"ranked AS (SELECT di, date, {rank_average('f')} AS a, {rank_average('y')} AS b FROM pairs WHERE n >= 10)", f"ic AS (SELECT date, {corr('a', 'b')} AS ic FROM ranked GROUP BY date)",
        select="SELECT date, round(ic, 8) AS ic FROM ic WHERE ic IS NOT NULL",
    ),
    "realisation_rate": query(
        SIZE, f"fy AS (SELECT g.di, g.date, g.code, f, y, x FROM (SELECT di, date, code, {REV} AS f, {ahead(5)} AS y FROM grid) g LEFT JOIN (SELECT di, code, value AS x FROM size) USING (di, code))",
        "fit AS (SELECT di, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS k FROM fy WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY di)",
        "two AS (SELECT 'raw' AS w, di, date, f, y FROM fy UNION ALL SELECT 'residual', di, date, f, y - i - s * x FROM fy JOIN fit USING (di) WHERE k >= 11)",
        "pairs AS (SELECT *, count(*) OVER (PARTITION BY w, di) AS n FROM two WHERE f IS NOT NULL AND y IS NOT NULL)", f"ranked AS (SELECT w, di, date, {rank_average('f', 'w, di')} AS a, {rank_average('y', 'w, di')} AS b FROM pairs WHERE n >= 30)",
        f"ic AS (SELECT * FROM (SELECT w, date, {corr('a', 'b')} AS ic FROM ranked GROUP BY w, date) WHERE ic IS NOT NULL)",
        "yr AS (SELECT year(date) AS yr, avg(ic) FILTER (w = 'residual') AS a, avg(ic) FILTER (w = 'raw') AS b FROM ic GROUP BY 1)", "t AS (SELECT avg(ic) FILTER (w = 'residual') AS a, avg(ic) FILTER (w = 'raw') AS b FROM ic)",
        select="SELECT round(a, 6) AS ic_residual, round(b, 6) AS ic_raw, round(b / a, 6) AS rate, (SELECT count(*) FILTER (sign(a) <> sign(b)) FROM yr WHERE a IS NOT NULL AND b IS NOT NULL) AS flips, (SELECT count(*) FROM yr WHERE a IS NOT NULL AND b IS NOT NULL) AS years FROM t",
    ),
    "attribution_windows": query(
        IC, "w AS (SELECT * FROM (VALUES ('first half of 1998', DATE '1998-01-01', DATE '1998-06-30'), ('1998', DATE '1998-01-01', DATE '1998-12-31'), ('autumn 2000', DATE '2000-09-01', DATE '2000-11-30'), ('never', DATE '1980-01-01', DATE '1980-12-31')) v(w, a, b))",
        select='SELECT w AS "window", round(avg(ic), 8) AS mean, round(sum(ic), 8) AS total, count(*) AS n FROM ic JOIN w ON date BETWEEN a AND b GROUP BY w',
    ),
    "universe_union": """
SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'sh.600' WHEN 1 THEN 'sz.000' WHEN 2 THEN 'sz.300' ELSE 'sh.688' END || lpad(s_suppkey::VARCHAR, greatest(4, length(s_suppkey::VARCHAR))::INT, '0') AS code
FROM supplier WHERE s_nationkey < 5 OR s_acctbal > 5000
""",
    "raw_with_adjusted": query(select="SELECT date, code, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 8) AS volume, round(amount, 8) AS amount, round(CASE WHEN is_trading = 1 AND is_st = 0 THEN turn ELSE 0 END, 8) AS turn, round(CASE WHEN is_trading = 1 THEN close END, 8) AS adj_close, is_st, is_trading FROM long"),
    "normalised_fundamentals": """
WITH c AS (SELECT translate(lpad(c_custkey::VARCHAR, 6, '0'), '12', '63') AS code, c_acctbal::DOUBLE AS value, (DATE '1998-04-01' + (c_custkey % 60)::INT)::DATE AS pub_date FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0)
SELECT CASE WHEN code[1] = '6' THEN 'sh.' ELSE 'sz.' END || code AS code, DATE '1998-03-31' AS report_date, pub_date, round(value, 8) AS value FROM c WHERE code[1] IN ('6', '0', '3')
""",
    "pbo_cscv": """
WITH cells AS (SELECT date_trunc('month', l_shipdate)::DATE AS t, p_brand AS s, avg(l_extendedprice * (1 - l_discount) / l_quantity) AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
full_t AS (SELECT t, avg(p) AS m FROM cells GROUP BY t HAVING count(*) = (SELECT count(DISTINCT s) FROM cells)),
x AS (SELECT t, s, p / m - 1 AS r FROM cells JOIN full_t USING (t)),
o AS (SELECT t, ((row_number() OVER (ORDER BY t) - 1) // (SELECT count(*) // 8 FROM full_t))::INT AS b FROM full_t),
bl AS (SELECT b, s, sum(r) AS a, sum(r * r) AS q FROM x JOIN o USING (t) WHERE b < 8 GROUP BY b, s),
masks AS (SELECT m::INT AS m FROM range(256) r(m) WHERE bit_count(m::INT) = 4),
sides AS (SELECT m, s, sum(CASE WHEN (m >> b) & 1 = 1 THEN a ELSE 0 END) AS ia, sum(CASE WHEN (m >> b) & 1 = 1 THEN q ELSE 0 END) AS iq, sum(CASE WHEN (m >> b) & 1 = 0 THEN a ELSE 0 END) AS oa, sum(CASE WHEN (m >> b) & 1 = 0 THEN q ELSE 0 END) AS oq FROM masks, bl GROUP BY m, s),
n AS (SELECT (count(*) // 8 * 4)::DOUBLE AS n FROM full_t),
sr AS (SELECT m, s, (ia / n) / sqrt((iq - ia * ia / n) / (n - 1)) AS i, (oa / n) / sqrt((oq - oa * oa / n) / (n - 1)) AS o FROM sides, n),
star AS (SELECT m, first(o ORDER BY i DESC, s) AS star FROM sr GROUP BY m),
om AS (SELECT m, count(*) FILTER (o <= star) / (count(*) + 1.0)::DOUBLE AS omega FROM sr JOIN star USING (m) GROUP BY m)
SELECT round(avg((omega < 0.5)::INT), 6) AS pbo, count(*) AS n_combinations, round(avg(omega), 6) AS oos_rank_mean, round(avg(ln(omega / (1 - omega))), 6) AS lambda_mean FROM om
""",
    "noise_control": query(
        IC, "cells AS (SELECT di, code, f, arm FROM fy, (SELECT unnest(range(0, 8)) AS arm) WHERE f IS NOT NULL)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY arm, di ORDER BY code) AS place, row_number() OVER (PARTITION BY arm, di ORDER BY md5(arm::VARCHAR || '|7|' || di::VARCHAR || '|' || code), code) AS deal FROM cells)",
        "mixed AS (SELECT a.arm, a.di, a.code, b.f FROM placed a JOIN placed b ON a.arm = b.arm AND a.di = b.di AND a.place = b.deal)",
        "np AS (SELECT mixed.arm, mixed.di, mixed.f, fy.y, count(*) OVER (PARTITION BY mixed.arm, mixed.di) AS n FROM mixed JOIN fy USING (di, code) WHERE y IS NOT NULL)",
        f"nr AS (SELECT arm, di, {rank_average('f', 'arm, di')} AS a, {rank_average('y', 'arm, di')} AS b FROM np WHERE n >= 30)",
        f"nd AS (SELECT arm, di, {corr('a', 'b')} AS c FROM nr GROUP BY arm, di)", "arms AS (SELECT arm, abs(avg(c)) AS noise FROM nd GROUP BY arm)", "re AS (SELECT abs(avg(ic)) AS r FROM ic)",
        select="SELECT round(any_value(r), 8) AS real, round(avg(noise), 8) AS noise_mean, round(stddev_pop(noise), 8) AS noise_std, round((1 + count(*) FILTER (noise >= r)) / (count(*) + 1.0)::DOUBLE, 8) AS p_value, count(*) AS n_arms FROM arms, re",
    ),
}
