"""The fixtures and shared steps as SQL common table expressions, for the oracle queries."""

from __future__ import annotations

import math

_R = "round((l_extendedprice*(1-l_discount)-50000)/50000, 8)"
_COLUMNS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"

F1 = f"""f1 AS (SELECT {_R} AS r, l_shipdate AS entry, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS exit_day, l_suppkey AS asset,
  l_returnflag AS regime, 0 - l_discount*10 AS mae, abs({_R}) + l_tax*10 AS mfe, l_quantity AS risk, {_R}*l_quantity AS pnl, l_tax AS cost,
  l_discount, {_COLUMNS} FROM lineitem)"""
B1 = f"{F1}, b1 AS (SELECT *, row_number() OVER (ORDER BY entry, {_COLUMNS}) - 1 AS idx FROM f1)"
F2 = "f2 AS (SELECT o_orderdate AS ts, (avg(o_totalprice)-250000)/250000*0.05 AS ret FROM orders GROUP BY 1)"
B2 = f"{F2}, b2 AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS idx, ts, ret AS r FROM f2)"
F3 = "f3 AS (SELECT l_shipdate AS ts, (avg(l_extendedprice)-52500)/52500*0.05 AS bench FROM lineitem GROUP BY 1)"
F4 = "f4 AS (SELECT o_orderpriority AS strategy, o_orderdate AS ts, (avg(o_totalprice)-250000)/250000*0.05 AS ret FROM orders GROUP BY 1, 2)"
F5 = """f5raw AS (SELECT date_trunc('month', o_orderdate) AS m, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS config,
    (avg(o_totalprice)-250000)/250000*0.05 AS ret FROM orders GROUP BY 1, 2),
  f5cell AS (SELECT CAST((year(m)-year((SELECT min(m) FROM f5raw)))*12 + month(m) - month((SELECT min(m) FROM f5raw)) AS BIGINT) AS t, config, ret FROM f5raw),
  f5 AS (SELECT a.t, c.config, coalesce(x.ret, 0.0) AS ret FROM (SELECT CAST(g AS BIGINT) AS t FROM range(0, 400) r(g) WHERE g <= (SELECT max(t) FROM f5cell)) a
    CROSS JOIN (SELECT DISTINCT config FROM f5cell) c LEFT JOIN f5cell x ON x.t = a.t AND x.config = c.config)"""
F6 = f"""f6 AS (SELECT l_quantity AS score, l_discount AS coarse, l_extendedprice AS price, {_R} AS fwd, l_discount >= 0.05 AS signal, {_R} > 0 AS event FROM lineitem)"""
F7 = f"""f7 AS (SELECT CAST(ceil(l_quantity/5) AS INTEGER) AS param, round(avg({_R}) + 0.05, 8) AS value FROM lineitem GROUP BY 1)"""

_RUN = "(ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DD = f"""{F2}, cap AS (SELECT ts, ret, product(1+ret) OVER {_RUN} AS capital FROM f2),
  dd AS (SELECT ts, ret, capital, capital / max(capital) OVER {_RUN} - 1 AS dd FROM cap)"""
EPISODES = f"""{DD}, isl AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER {_RUN} AS island FROM dd),
  ends AS (SELECT island - 1 AS island, min(ts) AS recovery FROM isl WHERE dd >= 0 GROUP BY 1),
  ep AS (SELECT i.island, min(i.ts) AS start, arg_min(i.ts, (i.dd, i.ts)) AS trough, min(i.dd) AS depth, min(e.recovery) AS recovery
    FROM isl i LEFT JOIN ends e ON e.island = i.island WHERE i.dd < 0 GROUP BY 1)"""


def hashed(*parts: str) -> str:
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def uniform(seed: int, name: str, row: str = "id") -> str:
    return f"(({hashed(repr(f'{seed}{name}'), row)} + 0.5)/4294967296.0)"


def normal(seed: int, name: str, mean: float = 0.0, sd: float = 1.0, row: str = "id") -> str:
    return f"({mean!r} + {sd!r}*sqrt(-2*ln({uniform(seed, name + 'a', row)}))*cos(2*pi()*{uniform(seed, name + 'b', row)}))"


def business_day(monday: str, shift: int, i: str) -> str:
    k = f"({i} + {shift})"
    return f"CAST(DATE '{monday}' + CAST(({k} // 5)*7 + {k} % 5 AS INTEGER) AS TIMESTAMP)"


def _strategy(seed: int = 42, trades: int = 420, payoff: float = 1.9) -> str:
    """The generated strategy: gt, a row a trade, and gd, a row a day."""
    u, z = lambda k, row="id": uniform(seed, k, row), lambda k, *a: normal(seed, k, *a)
    days = int(trades * 6.5)
    return f"""gw AS (SELECT CAST(i AS BIGINT) AS id FROM range(0, {trades}) t(i)), gv AS (SELECT id, {u('win')} < 0.42 AS won FROM gw),
  gr AS (SELECT id, won, CASE WHEN won THEN exp({z('gain', math.log(payoff) - 0.18, 0.6)}) ELSE -abs({z('loss', 1.0, 0.28)}) END - {0.0008 / 0.01!r} AS r, CAST(floor({u('entry')}*{days - 12}) AS BIGINT) AS day_in FROM gv),
  gx AS (SELECT *, CAST(least(day_in + CASE WHEN won THEN 4 + floor({u('held')}*26) ELSE 2 + floor({u('held')}*10) END, {days - 1}) AS BIGINT) AS day_out, row_number() OVER (ORDER BY day_in, id) - 1 AS idx FROM gr),
  gy AS (SELECT *, CAST(idx // 25 AS BIGINT) AS block FROM gx),
  gt AS (SELECT idx, {business_day('2012-01-02', 0, 'day_in')} AS entry, {business_day('2012-01-02', 0, 'day_out')} AS exit, r, r*0.01 AS ret, 'ASSET' || CAST(CAST(floor({u('asset')}*12) + 1 AS BIGINT) AS VARCHAR) AS asset,
    ['up', 'flat', 'down'][CAST(floor({u('regime', 'block')}*3) + 1 AS INTEGER)] AS regime, -abs({z('mae', 0.45, 0.25)}) AS mae, CASE WHEN r > 0 THEN r*(1.05 + 0.85*{u('mfe')}) ELSE abs({z('mfe0', 0.35, 0.22)}) END AS mfe FROM gy),
  gd AS (SELECT {business_day('2012-01-02', 0, 'n.id')} AS ts, n.noise + coalesce(p.posted, 0.0) AS ret FROM (SELECT CAST(i AS BIGINT) AS id, {z('day', 0.11 / 252, 0.009)} AS noise FROM (SELECT i, CAST(i AS BIGINT) AS id FROM range(0, {days}) t(i))) n
    LEFT JOIN (SELECT day_out, sum(r*0.01) AS posted FROM gy GROUP BY 1) p ON p.day_out = n.id)"""


#: The generated strategy, and its trades and days under the names that the fixtures have.
GENERATED = _strategy()
G1 = f"{GENERATED}, f1 AS (SELECT idx, r FROM gt)"
GB1 = f"{G1}, b1 AS (SELECT idx, r FROM f1)"
G2 = f"{GENERATED}, f2 AS (SELECT ts, ret FROM gd)"


def draws(reps: int, base: str = "b2", seed: int = 0, length: int | None = None) -> str:
    """dr(rep, pos, r): the resample core over base(idx, r)."""
    pos = f"(SELECT idx AS pos FROM {base})" if length is None else f"(SELECT CAST(g AS BIGINT) AS pos FROM range(0, {length}) q(g))"
    return f"""dr AS (SELECT d.rep, d.pos, b.r FROM (SELECT rep, pos, {hashed(str(seed), "rep", "pos")} % (SELECT count(*) FROM {base}) AS idx
    FROM (SELECT CAST(g AS BIGINT) AS rep FROM range(0, {reps}) t(g)) CROSS JOIN {pos}) d JOIN {base} b ON b.idx = d.idx)"""


def normal_cdf(z: str, steps: int = 2000) -> str:
    """Simpson's rule from 0 to z."""
    return f"(0.5 + ({z})/{3 * steps}.0 * list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(({z})*i/{steps}.0, 2)/2))) / sqrt(2*pi()))"


def safe_corr(x: str, y: str) -> str:
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    return f"(covar_pop({y}, {x}) / nullif(stddev_pop({x}) FILTER (WHERE {both}) * stddev_pop({y}) FILTER (WHERE {both}), 0))"
