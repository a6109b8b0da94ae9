"""All registered queries: each name with its Spark function and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import clean, normal_cdf, normal_quantile
from ..operators import evidence, ordered, resample, risk, trade
from ..sources import fixtures
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Replicates: the operators' own numbers, of simulations and distributions, of bootstrap intervals, of the
#: comparison of methods and of drawn equity paths.
REPS, CI, COMPARED, DRAWN = 5_000, 10_000, 500, 500


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = fn
    if oracle:
        ORACLES[name] = oracle


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def frame(name: str, fn, ctes: str, select: str, places: int = 6) -> None:
    """A query whose doubles are rounded on both sides; select rounds its own."""
    add(name, lambda s, d: rounded(fn(s, d), places), f"WITH {ctes} {select}" if ctes else select)


def scalar(name: str, source, column: Callable[[], Column], ctes: str, table: str, expression: str) -> None:
    """One value: an aggregate column over a fixture."""
    add(name, lambda s, d: source(s, d).agg(F.round(column().cast("double"), 6).alias("value")), f"WITH {ctes} SELECT round(CAST({expression} AS DOUBLE), 6) AS value FROM {table}")


def base1(s, d):
    return resample.indexed(fixtures.trades(s, d), fixtures.ORDER, "month")


def base2(s, d):
    return resample.indexed(fixtures.daily(s, d).withColumnRenamed("ret", "r"), ("ts",))


def drawn(s, d):
    return ordered.drawdown(fixtures.daily(s, d), "ret", ("ts",))


def _rows(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# Trades ---------------------------------------------------------------------------------------

_W, _L = "(avg(r) FILTER (WHERE r > 0))", "(-(avg(r) FILTER (WHERE r < 0)))"
_BE = f"({_L}/({_W}+{_L}))"
_PF = "((sum(r) FILTER (WHERE r > 0))/(-(sum(r) FILTER (WHERE r < 0))))"
_SKEW = "((avg(r*r*r) - 3*avg(r)*avg(r*r) + 2*pow(avg(r),3))/pow(var_pop(r),1.5))"
_KURT = "((avg(r*r*r*r) - 4*avg(r)*avg(r*r*r) + 6*pow(avg(r),2)*avg(r*r) - 3*pow(avg(r),4))/pow(var_pop(r),2) - 3)"
_MAD = "(SELECT median(abs(r - (SELECT median(r) FROM f1))) FROM f1)"
TRADE = {
    "expectancy": "avg(r)", "win_rate": "avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)", "loss_rate": "avg(CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END)", "payoff": f"{_W}/{_L}", "break_even_win_rate": _BE,
    "edge_margin": f"avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) - {_BE}", "profit_factor": _PF, "average_winner": _W, "average_loser": f"-{_L}", "median": "median(r)", "largest_winner": "max(r)", "largest_loser": "min(r)",
    "skewness": _SKEW, "excess_kurtosis": _KURT, "tail_ratio": "quantile_cont(r, 0.95)/abs(quantile_cont(r, 0.05))", "iqr": "quantile_cont(r, 0.75) - quantile_cont(r, 0.25)",
}


def tall_sql(ctes: str, table: str, parts: dict[str, str]) -> str:
    one = ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in parts.items())
    rows = " UNION ALL ".join(f"SELECT {i} AS ord, '{k}' AS metric, round({k}, 6) AS value FROM one" for i, k in enumerate(parts, 1))
    return f"WITH {ctes}, one AS (SELECT {one} FROM {table}) {rows}"


add("trade_summary", lambda s, d: rounded(trade.summary(fixtures.trades(s, d))), tall_sql(sql.F1, "f1", {**TRADE, "mad": _MAD}))
for _k, _e in TRADE.items():
    scalar(f"trade_{_k}", fixtures.trades, lambda k=_k: trade.SUMMARY[k](F.col("r")), sql.F1, "f1", _e)
scalar("trade_expectancy_of_risk", fixtures.trades, lambda: trade.expectancy_of_risk(F.col("pnl"), F.col("risk")), sql.F1, "f1", "avg(pnl/nullif(risk, 0))")
frame("trade_mad", lambda s, d: trade.mad(fixtures.trades(s, d)), sql.F1, f"SELECT round({_MAD}, 6) AS mad")
frame("trade_mad_by_regime", lambda s, d: trade.mad(fixtures.trades(s, d), by=("regime",)), sql.F1 + ", m AS (SELECT regime, median(r) AS m FROM f1 GROUP BY 1)", "SELECT f1.regime, round(median(abs(r - m)), 6) AS mad FROM f1 JOIN m USING (regime) GROUP BY 1")
frame("trade_clean", lambda s, d: clean(fixtures.trades(s, d).withColumn("x", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") > 1, F.col("r"))), "x").agg(F.count("*").alias("n"), F.avg("x").alias("mean")), sql.F1, "SELECT count(*) AS n, round(avg(r), 6) AS mean FROM f1 WHERE l_linenumber > 1")
frame("trade_by_asset", lambda s, d: fixtures.trades(s, d).groupBy("asset").agg(trade.expectancy(F.col("r")).alias("expectancy"), trade.win_rate(F.col("r")).alias("win_rate"), trade.profit_factor(F.col("r")).alias("profit_factor"), trade.median_trade(F.col("r")).alias("median")), sql.F1, f"SELECT asset, round(avg(r), 6) AS expectancy, round({TRADE['win_rate']}, 6) AS win_rate, round({_PF}, 6) AS profit_factor, round(median(r), 6) AS median FROM f1 GROUP BY 1")

# Returns and drawdowns ------------------------------------------------------------------------

_CAGR = "(pow(product(1+ret), 252.0/count(ret)) - 1)"
_DDEV = "(sqrt(avg(pow(least(ret, 0.0), 2)))*sqrt(252.0))"
_MDD, _ULCER = "abs(min(dd))", "sqrt(avg(dd*dd))"
_ES = "(SELECT avg(ret) FROM dd WHERE ret <= (SELECT quantile_cont(ret, 0.05) FROM dd))"
_BURKE = f"({_CAGR}/(SELECT sqrt(sum(depth*depth)) FROM ep))"
RISK = {
    "cagr": _CAGR, "volatility": "stddev_samp(ret)*sqrt(252.0)", "sharpe": "avg(ret)/stddev_samp(ret)*sqrt(252.0)", "sortino": f"avg(ret)*252/{_DDEV}", "omega": "sum(greatest(ret, 0.0))/sum(greatest(-ret, 0.0))",
    "gain_to_pain": "sum(ret)/(-(sum(ret) FILTER (WHERE ret < 0)))", "max_drawdown": "min(dd)", "average_drawdown": "coalesce(avg(dd) FILTER (WHERE dd < 0), 0.0)", "time_under_water": "avg(CASE WHEN dd < 0 THEN 1.0 ELSE 0.0 END)",
    "ulcer_index": _ULCER, "calmar": f"{_CAGR}/{_MDD}", "burke": _BURKE, "recovery_factor": f"(product(1+ret)-1)/{_MDD}", "martin": f"{_CAGR}/{_ULCER}", "value_at_risk": "quantile_cont(ret, 0.05)", "expected_shortfall": _ES,
}
add("risk_summary", lambda s, d: rounded(risk.summary(fixtures.daily(s, d))), tall_sql(sql.EPISODES, "dd", {k: RISK[k] for k in risk.SUMMARY}))
_risk_columns = {
    "cagr": lambda: risk.cagr(F.col("ret")), "volatility": lambda: risk.volatility(F.col("ret")), "sharpe": lambda: risk.sharpe(F.col("ret")), "sortino": lambda: risk.sortino(F.col("ret")), "omega": lambda: risk.omega(F.col("ret")), "gain_to_pain": lambda: risk.gain_to_pain(F.col("ret")),
    "max_drawdown": lambda: risk.max_drawdown(F.col("dd")), "average_drawdown": lambda: risk.average_drawdown(F.col("dd")), "time_under_water": lambda: risk.time_under_water(F.col("dd")), "ulcer_index": lambda: risk.ulcer_index(F.col("dd")), "calmar": lambda: risk.calmar(F.col("ret"), F.col("dd")),
    "recovery_factor": lambda: risk.recovery_factor(F.col("ret"), F.col("dd")), "martin": lambda: risk.martin(F.col("ret"), F.col("dd")), "value_at_risk": lambda: risk.value_at_risk(F.col("ret")),
}
for _k, _c in _risk_columns.items():
    scalar(f"risk_{_k}", drawn, _c, sql.DD, "dd", RISK[_k])
scalar("risk_mar", drawn, lambda: risk.mar(F.col("ret"), F.col("dd")), sql.DD, "dd", RISK["calmar"])
scalar("risk_downside_deviation", drawn, lambda: risk.downside_deviation(F.col("ret")), sql.DD, "dd", _DDEV)
scalar("risk_median_drawdown", drawn, lambda: risk.median_drawdown(F.col("dd")), sql.DD, "dd", "coalesce(median(dd) FILTER (WHERE dd < 0), 0.0)")
scalar("risk_sterling", drawn, lambda: risk.sterling(F.col("ret"), F.col("dd")), sql.DD, "dd", f"{_CAGR}/({_MDD}+0.1)")
scalar("risk_total_return", drawn, lambda: risk.total_return(F.col("ret")), sql.DD, "dd", "product(1+ret)-1")
scalar("risk_sqn", fixtures.trades, lambda: risk.sqn(F.col("r")), sql.F1, "f1", "sqrt(count(r))*avg(r)/stddev_samp(r)")
scalar("risk_kelly_fraction", fixtures.trades, lambda: risk.kelly_fraction(F.col("r")), sql.F1, "f1", f"({TRADE['win_rate']}*({_W}/{_L}) - (1-{TRADE['win_rate']}))/({_W}/{_L})")
frame("risk_burke", lambda s, d: risk.burke(drawn(s, d)), sql.EPISODES, f"SELECT round({_BURKE}, 6) AS burke FROM dd")
frame("risk_expected_shortfall", lambda s, d: risk.expected_shortfall(fixtures.daily(s, d)), sql.DD, f"SELECT round({_ES}, 6) AS expected_shortfall")
frame("risk_return_on_exposure", lambda s, d: risk.return_on_exposure(fixtures.daily(s, d), fixtures.trades(s, d).select(F.col("l_discount").alias("exposure"))), f"{sql.F1}, {sql.F2}", "SELECT round((SELECT product(1+ret)-1 FROM f2)/(SELECT avg(l_discount) FROM f1), 6) AS return_on_exposure")
frame("risk_capital_curve", lambda s, d: ordered.capital_curve(fixtures.daily(s, d)).select("ts", "capital"), sql.DD, "SELECT ts, round(capital, 9) AS capital FROM dd", 9)
frame("risk_drawdown_series", lambda s, d: drawn(s, d).select("ts", "dd"), sql.DD, "SELECT ts, round(dd, 11) AS dd FROM dd", 11)
frame("risk_drawdown_episodes", lambda s, d: risk.drawdown_episodes(drawn(s, d)), sql.EPISODES, "SELECT start, trough, recovery, round(depth, 9) AS depth, date_diff('day', CAST(start AS DATE), CAST(recovery AS DATE)) AS duration_days, date_diff('day', CAST(trough AS DATE), CAST(recovery AS DATE)) AS recovery_days FROM ep", 9)
frame("risk_recovery_profile", lambda s, d: risk.recovery_profile(drawn(s, d)), sql.EPISODES, """SELECT CASE WHEN depth <= -0.2 THEN 0 WHEN depth <= -0.1 THEN 1 WHEN depth <= -0.05 THEN 2 ELSE 3 END AS bucket, count(*) AS episodes, count(recovery) AS closed,
  round(avg(date_diff('day', CAST(trough AS DATE), CAST(recovery AS DATE))), 6) AS mean_days, max(date_diff('day', CAST(trough AS DATE), CAST(recovery AS DATE))) AS longest_days FROM ep GROUP BY 1""")


def _bins_sql(unit: str, table: str = "f2") -> str:
    return f"""(SELECT s.b, coalesce(x.ret, 0.0) AS ret FROM (SELECT CAST(unnest(generate_series((SELECT date_trunc('{unit}', min(ts)) FROM {table}), (SELECT date_trunc('{unit}', max(ts)) FROM {table}), INTERVAL 1 {unit})) AS TIMESTAMP) AS b) s
    LEFT JOIN (SELECT CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS b, product(1+ret)-1 AS ret FROM {table} GROUP BY 1) x ON x.b = s.b)"""


frame("risk_worst_periods", lambda s, d: risk.worst_periods(fixtures.daily(s, d)), sql.F2, " UNION ALL ".join(f"SELECT '{u}' AS unit, round(min(ret), 6) AS worst FROM {_bins_sql(u)}" for u in ("day", "week", "month", "year")))
_STREAK = "SELECT coalesce(max(n), 0) AS streak FROM (SELECT island, count(*) FILTER (WHERE {c}) AS n FROM (SELECT r, sum(CASE WHEN {c} THEN 0 ELSE 1 END) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM b1) GROUP BY 1)"
frame("risk_max_losing_streak", lambda s, d: risk.max_streak(base1(s, d), order=("idx",), block="month"), sql.B1, _STREAK.format(c="r < 0"))
frame("risk_max_winning_streak", lambda s, d: risk.max_streak(base1(s, d), order=("idx",), block="month", winning=True), sql.B1, _STREAK.format(c="r > 0"))
_PATHS = "p AS (SELECT rep, pos, product(1+r) OVER (PARTITION BY rep ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM dr), q AS (SELECT rep, pos, c, c/max(c) OVER (PARTITION BY rep ORDER BY pos ROWS UNBOUNDED PRECEDING)-1 AS dd FROM p)"
frame("risk_of_ruin", lambda s, d: risk.risk_of_ruin(base2(s, d), fraction=1.0, ruin=0.85, n_trades=500, n_sim=REPS), f"{sql.B2}, {sql.draws(REPS, length=500)}, {_PATHS}", "SELECT round(avg(CASE WHEN low <= 0.85 THEN 1.0 ELSE 0.0 END), 6) AS risk_of_ruin FROM (SELECT rep, min(c) AS low FROM p GROUP BY 1)")
frame("risk_monte_carlo_drawdown", lambda s, d: risk.monte_carlo_drawdown(base2(s, d), fraction=1.0, n_sim=REPS), f"{sql.B2}, {sql.draws(REPS)}, {_PATHS}", "SELECT round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.05), 6) AS p95, round(quantile_cont(m, 0.01), 6) AS p99 FROM (SELECT rep, min(dd) AS m FROM q GROUP BY 1)")
frame("risk_monte_carlo_streak", lambda s, d: risk.monte_carlo_streak(base2(s, d), n_sim=REPS), f"{sql.B2}, {sql.draws(REPS)}, " + """i AS (SELECT rep, r, sum(CASE WHEN r < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY rep ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM dr),
  m AS (SELECT rep, max(n) AS n FROM (SELECT rep, island, count(*) FILTER (WHERE r < 0) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
  o AS (SELECT max(n) AS n FROM (SELECT island, count(*) FILTER (WHERE r < 0) AS n FROM (SELECT r, sum(CASE WHEN r < 0 THEN 0 ELSE 1 END) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM b2) GROUP BY 1))""", """SELECT CAST((SELECT n FROM o) AS DOUBLE) AS observed, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99 FROM m""")
frame("risk_monte_carlo_loss_probability", lambda s, d: risk.monte_carlo_loss_probability(base2(s, d), fraction=1.0, n_sim=REPS), f"{sql.B2}, {sql.draws(REPS)}", "SELECT round(avg(CASE WHEN e < 1 THEN 1.0 ELSE 0.0 END), 6) AS loss_probability FROM (SELECT rep, product(1+r) AS e FROM dr GROUP BY 1)")

# Evidence -------------------------------------------------------------------------------------

_DIST = "v AS (SELECT rep, avg(r) AS v FROM dr GROUP BY 1)"
_BOOT = f"{sql.B2}, {sql.draws(REPS)}, {_DIST}"
_BOOT_CI = _BOOT.replace(f"range(0, {REPS})", f"range(0, {CI})")
_ACF = "ac AS (SELECT k AS lag, " + sql.safe_corr("x", "y") + " AS rho FROM (SELECT a.r AS x, b.r AS y, a.idx - b.idx AS k FROM {b} a JOIN {b} b ON a.idx - b.idx BETWEEN 1 AND 10) GROUP BY 1)"
_NW = """g AS (SELECT a.idx - b.idx AS k, avg((a.r - m)*(b.r - m)) AS g FROM {b} a JOIN {b} b ON a.idx - b.idx BETWEEN 0 AND (SELECT CAST(floor(4*pow(count(*)/100.0, 2.0/9)) AS BIGINT) FROM {b}) CROSS JOIN (SELECT avg(r) AS m FROM {b}) GROUP BY 1)"""
_NWT = "(SELECT (SELECT avg(r) FROM {b})/sqrt(sum(CASE WHEN k = 0 THEN 1.0 ELSE 2*(1 - k/(1.0 + floor(4*pow((SELECT count(*) FROM {b})/100.0, 2.0/9)))) END * g)/(SELECT count(*) FROM {b})) FROM g)"
scalar("evidence_t_stat", fixtures.trades, lambda: evidence.t_stat(F.col("r")), sql.F1, "f1", "avg(r)*sqrt(count(r))/stddev_samp(r)")
frame("evidence_bootstrap_ci", lambda s, d: evidence.bootstrap_ci(base2(s, d), reps=CI), _BOOT_CI, "SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v")
frame("evidence_bootstrap_ci_median", lambda s, d: evidence.bootstrap_ci(base2(s, d), statistic="median", reps=CI), f"{sql.B2}, {sql.draws(CI)}, v AS (SELECT rep, median(r) AS v FROM dr GROUP BY 1)", "SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v")
frame("evidence_probability_positive", lambda s, d: evidence.probability_positive(base2(s, d), reps=CI), _BOOT_CI, "SELECT round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS probability FROM v")
frame("evidence_bootstrap_se", lambda s, d: evidence.bootstrap_se(base2(s, d), reps=CI), _BOOT_CI, "SELECT round(stddev_samp(v), 6) AS se FROM v")
_SR = "(avg(ret)/stddev_samp(ret))"
_MOMENTS = f"{sql.F2}, mo AS (SELECT {_SR} AS sr, count(ret) AS n, ((avg(ret*ret*ret) - 3*avg(ret)*avg(ret*ret) + 2*pow(avg(ret),3))/pow(var_pop(ret),1.5)) AS sk, ((avg(ret*ret*ret*ret) - 4*avg(ret)*avg(ret*ret*ret) + 6*pow(avg(ret),2)*avg(ret*ret) - 3*pow(avg(ret),4))/pow(var_pop(ret),2)) AS ku FROM f2)"
_V = "sqrt(1 - sk*sr + (ku-1)/4*sr*sr)"


def _moments(s, d):
    return fixtures.daily(s, d).agg(F.try_divide(F.avg(F.col("ret")), F.stddev_samp(F.col("ret"))).alias("sr"), F.count(F.col("ret")).alias("n"), F.skewness(F.col("ret")).alias("sk"), (F.kurtosis(F.col("ret")) + 3).alias("ku"))


frame("evidence_probabilistic_sharpe", lambda s, d: _moments(s, d).select(evidence.probabilistic_sharpe(F.col("sr"), F.col("n"), F.col("sk"), F.col("ku")).alias("psr")), _MOMENTS, f"SELECT round({sql.normal_cdf(f'sr*sqrt(n-1)/{_V}')}, 6) AS psr FROM mo")
frame("evidence_min_track_record_length", lambda s, d: _moments(s, d).select(evidence.min_track_record_length(F.abs(F.col("sr")), F.col("sk"), F.col("ku")).alias("rows")), _MOMENTS, "SELECT round(1 + (1 - sk*abs(sr) + (ku-1)/4*sr*sr)*pow(1.6448536269514722/abs(sr), 2), 3) AS rows FROM mo", 3)
frame("evidence_deflated_sharpe", lambda s, d: _moments(s, d).select(evidence.deflated_sharpe(F.col("sr"), F.col("n"), F.lit(20), F.lit(0.0001), F.col("sk"), F.col("ku")).alias("dsr")), _MOMENTS, f"SELECT round({sql.normal_cdf(f'(sr - 0.01*((1-0.5772156649)*1.6448536269514722 + 0.5772156649*2.0881096572142206))*sqrt(n-1)/{_V}')}, 6) AS dsr FROM mo")
frame("evidence_autocorrelation", lambda s, d: evidence.autocorrelation(base2(s, d)).select(F.col("lag").cast("long").alias("lag"), "rho"), f"{sql.B2}, {_ACF.format(b='b2')}", "SELECT lag, round(rho, 6) AS rho FROM ac")
frame("evidence_autocorrelation_trades", lambda s, d: evidence.autocorrelation(base1(s, d)).select(F.col("lag").cast("long").alias("lag"), "rho"), f"{sql.B1}, {_ACF.format(b='b1')}", "SELECT lag, round(rho, 6) AS rho FROM ac")
_NEFF = "(SELECT count(*) FROM {b})/(1 + 2*(SELECT coalesce(sum(rho) FILTER (WHERE rho > 0), 0.0) FROM ac))"
_Q = "((SELECT count(*) FROM {b})*((SELECT count(*) FROM {b})+2.0)*(SELECT sum(rho*rho/((SELECT count(*) FROM {b})-lag)) FROM ac))"
frame("evidence_effective_sample_size", lambda s, d: evidence.effective_sample_size(base2(s, d)), f"{sql.B2}, {_ACF.format(b='b2')}", f"SELECT round({_NEFF.format(b='b2')}, 6) AS n_eff")
_PVAL = f"1 - {sql.normal_cdf('z')}"
frame("evidence_ljung_box", lambda s, d: evidence.ljung_box(base2(s, d)), f"{sql.B2}, {_ACF.format(b='b2')}, lq AS (SELECT {_Q.format(b='b2')} AS q), lz AS (SELECT q, (pow(q/10, 1.0/3) - (1 - 2.0/90))/sqrt(2.0/90) AS z FROM lq)", f"SELECT round(q, 6) AS q, round({_PVAL}, 6) AS p FROM lz")
frame("evidence_newey_west_t", lambda s, d: evidence.newey_west_t(base2(s, d)), f"{sql.B2}, {_NW.format(b='b2')}", f"SELECT round({_NWT.format(b='b2')}, 6) AS t")
frame("evidence_iid_bootstrap", lambda s, d: resample.distribution(base2(s, d), reps=REPS), _BOOT, "SELECT rep, round(v, 6) AS value FROM v")
_BLOCKS = f"""bl AS (SELECT c.rep, c.blk*20 + o.o AS pos, {sql.hashed('0', 'c.rep', 'c.blk')} % ((SELECT count(*) FROM b2) - 20) + o.o AS idx
  FROM (SELECT CAST(g AS BIGINT) AS rep, CAST(h AS BIGINT) AS blk FROM range(0, {REPS}) t(g) CROSS JOIN range(0, 1000) u(h) WHERE h*20 < (SELECT count(*) FROM b2)) c CROSS JOIN (SELECT CAST(k AS BIGINT) AS o FROM range(0, 20) w(k)) o)"""
_MB = f"{sql.B2}, {_BLOCKS}, v AS (SELECT rep, avg(b2.r) AS v FROM bl JOIN b2 ON b2.idx = bl.idx WHERE bl.pos < (SELECT count(*) FROM b2) GROUP BY 1)"
frame("evidence_moving_block_bootstrap", lambda s, d: resample.distribution(base2(s, d), reps=REPS, method="moving_block"), _MB, "SELECT rep, round(v, 6) AS value FROM v")
_ST = f"""{sql.B2}, cells AS (SELECT CAST(g AS BIGINT) AS rep, b2.idx AS pos FROM range(0, {REPS}) t(g) CROSS JOIN b2),
  jumps AS (SELECT rep, pos, (pos = 0 OR {sql.hashed("'0j'", 'rep', 'pos')} < {int(2**32 / 20)}) AS j, {sql.hashed('0', 'rep', 'pos')} % (SELECT count(*) FROM b2) AS s FROM cells),
  lj AS (SELECT rep, pos, max(CASE WHEN j THEN pos*4294967296 + s END) OVER (PARTITION BY rep ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ps FROM jumps),
  v AS (SELECT a.rep, avg(b2.r) AS v FROM (SELECT rep, (ps % 4294967296 + pos - ps // 4294967296) % (SELECT count(*) FROM b2) AS idx FROM lj) a JOIN b2 ON b2.idx = a.idx GROUP BY 1)"""
frame("evidence_stationary_bootstrap", lambda s, d: resample.distribution(base2(s, d), reps=REPS, method="stationary"), _ST, "SELECT rep, round(v, 6) AS value FROM v")
_CI = "SELECT '{m}' AS method, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v"
frame("evidence_bootstrap_sensitivity", lambda s, d: evidence.bootstrap_sensitivity(base2(s, d), reps=COMPARED), "", " UNION ALL ".join(f"SELECT * FROM (WITH {c.replace(f'range(0, {REPS})', f'range(0, {COMPARED})')} {_CI.format(m=m)})" for m, c in (("iid", _BOOT), ("moving_block", _MB), ("stationary", _ST))))
frame("evidence_monte_carlo_equity", lambda s, d: evidence.monte_carlo_equity(base2(s, d), fraction=1.0, n_sim=DRAWN), f"{sql.B2}, {sql.draws(DRAWN)}, {_PATHS}", "SELECT rep, pos, round(c, 6) AS equity FROM p")
frame("evidence_monte_carlo_terminal", lambda s, d: evidence.monte_carlo_terminal(base2(s, d), fraction=1.0, n_sim=REPS), f"{sql.B2}, {sql.draws(REPS)}, e AS (SELECT rep, product(1+r) AS e FROM dr GROUP BY 1)", " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(e, {q}), 6) AS equity FROM e" for q in evidence.TERMINAL))
add("evidence_summary", lambda s, d: rounded(evidence.summary(fixtures.daily(s, d), "ret", ("ts",), REPS)), tall_sql(
    f"{_BOOT}, {_ACF.format(b='b2')}, {_NW.format(b='b2')}, lq AS (SELECT {_Q.format(b='b2')} AS q), lz AS (SELECT q, (pow(q/10, 1.0/3) - (1 - 2.0/90))/sqrt(2.0/90) AS z FROM lq)", "b2",
    {"t": "avg(r)*sqrt(count(r))/stddev_samp(r)", "newey_west_t": _NWT.format(b="b2"), "ci_low": "(SELECT quantile_cont(v, 0.025) FROM v)", "ci_high": "(SELECT quantile_cont(v, 0.975) FROM v)", "p_positive": "(SELECT avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) FROM v)",
     "n": "count(r)", "n_eff": _NEFF.format(b="b2"), "ljung_box_q": "(SELECT q FROM lq)", "ljung_box_p": f"(SELECT {_PVAL} FROM lz)", "autocorrelation_1": "(SELECT rho FROM ac WHERE lag = 1)"},
))
_GRID = "SELECT CAST(g AS DOUBLE)/4 - 5 AS z FROM range(0, 41) t(g)"
frame("function_normal_cdf", lambda s, d: s.range(41).select((F.col("id") / 4 - 5).alias("z")).select("z", normal_cdf(F.col("z")).alias("p")), f"gr AS ({_GRID})", f"SELECT z, round({sql.normal_cdf('z')}, 6) AS p FROM gr")
frame("function_normal_quantile", lambda s, d: s.range(1, 20).select((F.col("id") / 20).alias("p")).select("p", normal_cdf(normal_quantile(F.col("p"))).alias("back")), "", "SELECT CAST(g AS DOUBLE)/20 AS p, round(CAST(g AS DOUBLE)/20, 6) AS back FROM range(1, 20) t(g)")

from . import registry_more  # noqa: E402, F401  the other chapters add themselves
