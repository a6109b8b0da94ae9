"""The registered queries of generalization, signals, execution, the scorecard, sources, charts,
formats and live trading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour, formats
from ..operators import charts, execution, generalization, ordered, risk, scorecard, signal
from ..sources import fixtures, generators, published
from ..streaming import live
from . import programme, sql
from .registry import _BOOT_CI, _NEFF, _NW, _NWT, _PATHS, _PF, _ACF, CI, RISK, TRADE, _bins_sql, add, base1, base2, drawn, frame, rounded, scalar

# Generalization -------------------------------------------------------------------------------

_SPLIT = f"{sql.B1}, sp AS (SELECT r, idx >= floor((SELECT count(*) FROM b1)*0.7) AS oos FROM b1)"
_IS, _OOS = "avg(r) FILTER (WHERE NOT oos)", "avg(r) FILTER (WHERE oos)"
frame("generalization_split", lambda s, d: generalization.split(base1(s, d)).groupBy("is_oos").agg(F.count("*").alias("n"), F.avg("r").alias("mean")), _SPLIT, "SELECT oos AS is_oos, count(*) AS n, round(avg(r), 6) AS mean FROM sp GROUP BY 1")
frame("generalization_oos_ratio", lambda s, d: generalization.oos_ratio(base1(s, d)), _SPLIT, f"SELECT round({_IS}, 6) AS in_sample, round({_OOS}, 6) AS out_of_sample, round(({_OOS})/({_IS}), 6) AS ratio, round(1 - ({_OOS})/({_IS}), 6) AS degradation FROM sp")
frame("generalization_oos_ratio_median", lambda s, d: generalization.oos_ratio(base1(s, d), metric="median"), _SPLIT, f"SELECT round({_IS}, 6) AS in_sample, round({_OOS}, 6) AS out_of_sample, round(({_OOS})/({_IS}), 6) AS ratio, round(1 - ({_OOS})/({_IS}), 6) AS degradation FROM sp".replace("avg(r)", "median(r)"))
_WF = f"{sql.B1}, wb AS (SELECT CAST(floor(idx/floor((SELECT count(*) FROM b1)/6)) AS INTEGER) AS bucket, r FROM b1), wf AS (SELECT k.k AS w, avg(r) FILTER (WHERE bucket < k.k) AS train, avg(r) FILTER (WHERE bucket = k.k) AS test, count(r) FILTER (WHERE bucket < k.k) AS n_train, count(r) FILTER (WHERE bucket = k.k) AS n_test FROM wb CROSS JOIN (SELECT CAST(g AS INTEGER) AS k FROM range(1, 6) t(g)) k WHERE bucket < 6 GROUP BY 1)"
frame("generalization_walk_forward", lambda s, d: generalization.walk_forward(base1(s, d)), _WF, "SELECT w AS \"window\", round(train, 6) AS train, round(test, 6) AS test, n_train, n_test FROM wf")
frame("generalization_walk_forward_median", lambda s, d: generalization.walk_forward(base1(s, d), metric="median"), _WF.replace("avg(r) FILTER", "median(r) FILTER"), "SELECT w AS \"window\", round(train, 6) AS train, round(test, 6) AS test, n_train, n_test FROM wf")
_WFE = "SELECT round(avg(test)/avg(train), 6) AS efficiency, round(avg(CASE WHEN test > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM wf"
frame("generalization_walk_forward_efficiency", lambda s, d: generalization.walk_forward_efficiency(base1(s, d)).select("efficiency"), _WF, "SELECT efficiency FROM (" + _WFE + ")")
frame("generalization_positive_oos_windows", lambda s, d: generalization.walk_forward_efficiency(base1(s, d)).select("positive"), _WF, "SELECT positive FROM (" + _WFE + ")")
_PBO = f"""{sql.F5}, np AS (SELECT max(t)+1 AS n FROM f5), bk AS (SELECT t, config, ret, CAST(CASE WHEN t < (n % 10)*((n // 10)+1) THEN t // ((n // 10)+1) ELSE (n % 10) + (t - (n % 10)*((n // 10)+1)) // (n // 10) END AS INTEGER) AS b FROM f5 CROSS JOIN np),
  cell AS (SELECT b, config, sum(ret) AS s, count(ret) AS k FROM bk GROUP BY 1, 2),
  combo AS (SELECT CAST(g AS INTEGER) AS c FROM range(0, 1024) t(g) WHERE bit_count(CAST(g AS INTEGER)) = 5),
  mm AS (SELECT c, config, sum(s) FILTER (WHERE (c >> b) & 1 = 1)/sum(k) FILTER (WHERE (c >> b) & 1 = 1) AS a, sum(s) FILTER (WHERE (c >> b) & 1 = 0)/sum(k) FILTER (WHERE (c >> b) & 1 = 0) AS o FROM combo CROSS JOIN cell GROUP BY 1, 2),
  ch AS (SELECT c, config, o FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY a DESC, config) AS k FROM mm) WHERE k = 1),
  rk AS (SELECT mm.c, count(*) FILTER (WHERE mm.o <= ch.o)/(count(*)+1.0) AS w FROM mm JOIN ch ON ch.c = mm.c GROUP BY 1),
  lg AS (SELECT ln(least(greatest(w, 1e-6), 1-1e-6)/(1-least(greatest(w, 1e-6), 1-1e-6))) AS l FROM rk)"""
frame("generalization_pbo_cscv", lambda s, d: generalization.pbo_cscv(fixtures.matrix(s, d)), _PBO, "SELECT round(avg(CASE WHEN l <= 0 THEN 1.0 ELSE 0.0 END), 6) AS pbo, round(avg(l), 6) AS mean_logit, count(*) AS splits FROM lg")
_MROWS = f"""{sql.F5}, np AS (SELECT max(t)+1 AS n FROM f5), mi AS (SELECT config, avg(ret) AS m, stddev_samp(ret) AS sd FROM f5 GROUP BY 1),
  kd AS (SELECT rep, {sql.hashed('0', 'rep', 'pos')} % (SELECT n FROM np) AS t FROM (SELECT CAST(g AS BIGINT) AS rep FROM range(0, 2000) q(g)) CROSS JOIN (SELECT DISTINCT t AS pos FROM f5)),
  bm AS (SELECT kd.rep, f5.config, sum(f5.ret)/(SELECT n FROM np) AS b FROM kd JOIN f5 ON f5.t = kd.t GROUP BY 1, 2)"""
frame("generalization_reality_check", lambda s, d: generalization.reality_check(fixtures.matrix(s, d)), f"{_MROWS}, st AS (SELECT sqrt((SELECT n FROM np))*max(m) AS v FROM mi), nl AS (SELECT rep, sqrt((SELECT n FROM np))*max(b - m) AS v FROM bm JOIN mi ON mi.config = bm.config GROUP BY 1)", "SELECT round((SELECT v FROM st), 6) AS statistic, round(avg(CASE WHEN nl.v >= (SELECT v FROM st) THEN 1.0 ELSE 0.0 END), 6) AS p FROM nl")
frame("generalization_hansen_spa", lambda s, d: generalization.hansen_spa(fixtures.matrix(s, d)), f"""{_MROWS}, gi AS (SELECT config, m, sd, CASE WHEN m >= -sqrt(2*ln(ln((SELECT n FROM np))))*sd/sqrt((SELECT n FROM np)) THEN m ELSE 0.0 END AS g FROM mi WHERE sd > 0),
  st AS (SELECT greatest(max(sqrt((SELECT n FROM np))*m/sd), 0.0) AS v FROM gi), nl AS (SELECT rep, greatest(max(sqrt((SELECT n FROM np))*(b - g)/sd), 0.0) AS v FROM bm JOIN gi ON gi.config = bm.config GROUP BY 1)""", "SELECT round((SELECT v FROM st), 6) AS statistic, round(avg(CASE WHEN nl.v >= (SELECT v FROM st) THEN 1.0 ELSE 0.0 END), 6) AS p FROM nl")
frame("generalization_research_trials", lambda s, d: generalization.research_trials(fixtures.read(s, d, "orders").select(F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority")).alias("family"))), "fam AS (SELECT CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderpriority ELSE 'undeclared' END AS family FROM orders)", "SELECT family, count(*) AS trials, false AS total FROM fam GROUP BY 1 UNION ALL SELECT NULL, count(*), true FROM fam")
frame("generalization_parameter_stability", lambda s, d: generalization.parameter_stability(fixtures.responses(s, d)), f"{sql.F7}, nb AS (SELECT param, value, lag(value) OVER (ORDER BY param) AS a, lead(value) OVER (ORDER BY param) AS b FROM f7), tp AS (SELECT * FROM nb ORDER BY value DESC, param LIMIT 1)", "SELECT param AS best_param, round(value, 6) AS best, round((coalesce(a, 0) + coalesce(b, 0))/((a IS NOT NULL)::INT + (b IS NOT NULL)::INT), 6) AS neighbours, round((coalesce(a, 0) + coalesce(b, 0))/((a IS NOT NULL)::INT + (b IS NOT NULL)::INT)/value, 6) AS ratio FROM tp")
frame("generalization_plateau_width", lambda s, d: generalization.plateau_width(fixtures.responses(s, d)), sql.F7, "SELECT round(avg(CASE WHEN value >= 0.9*(SELECT max(value) FROM f7) THEN 1.0 ELSE 0.0 END), 6) AS plateau_width FROM f7")
scalar("generalization_neighbourhood_robustness", fixtures.responses, lambda: generalization.neighbourhood_robustness(F.col("value")), sql.F7, "f7", "max(value)/avg(value)")
frame("generalization_parameter_drift", lambda s, d: generalization.parameter_drift(fixtures.responses(s, d).select(F.col("param").alias("value"))), sql.F7, "SELECT round(avg(param), 6) AS mean, round(stddev_samp(param), 6) AS sd, round(stddev_samp(param)/abs(avg(param)), 6) AS cv, CAST(min(param) AS DOUBLE) AS min, CAST(max(param) AS DOUBLE) AS max FROM f7")
frame("generalization_lag_robustness", lambda s, d: generalization.lag_robustness(fixtures.responses(s, d), "param"), f"{sql.F7}, lr AS (SELECT value, row_number() OVER (ORDER BY param) AS k FROM f7)", "SELECT round(max(value) FILTER (WHERE k = 1), 6) AS first, round(max(value) FILTER (WHERE k = 2), 6) AS second, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, round(max(value) FILTER (WHERE k = 2)/max(value) FILTER (WHERE k = 1), 6) AS retention FROM lr")
_U = lambda tag: f"(({sql.hashed(chr(39) + '0' + tag + chr(39), 'rep', 'idx')} + 0.5)/4294967296.0)"
frame("generalization_price_perturbation", lambda s, d: generalization.price_perturbation(base2(s, d), 0.0001), f"{sql.B2}, pp AS (SELECT rep, avg(r - abs(0.0001 + 0.00004*sqrt(-2*ln({_U('a')}))*cos(2*pi()*{_U('b')}))) AS m FROM b2 CROSS JOIN (SELECT CAST(g AS BIGINT) AS rep FROM range(0, 200) t(g)) GROUP BY 1)", "SELECT round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.05), 6) AS p05, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM pp")
scalar("generalization_robustness_pass_rate", lambda s, d: fixtures.trades(s, d).groupBy("asset").agg((F.avg("r") > 0).alias("passed")), lambda: generalization.robustness_pass_rate(F.col("passed")), f"{sql.F1}, pr AS (SELECT asset, avg(r) > 0 AS passed FROM f1 GROUP BY 1)", "pr", "avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END)")
_GRIDS = "gr AS (SELECT CAST(ceil(l_quantity/5) AS INTEGER) AS x, l_linenumber AS y, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"


def _grid(s, d):
    return fixtures.read(s, d, "lineitem").groupBy(F.ceil(F.col("l_quantity") / 5).cast("int").alias("x"), F.col("l_linenumber").alias("y")).agg(F.avg("l_extendedprice").alias("value"))


frame("generalization_surface_smoothness", lambda s, d: generalization.surface_smoothness(_grid(s, d)), f"{_GRIDS}, st AS (SELECT abs(value - lead(value) OVER (PARTITION BY y ORDER BY x)) AS d FROM gr UNION ALL SELECT abs(value - lead(value) OVER (PARTITION BY x ORDER BY y)) FROM gr)", "SELECT round(avg(d), 6) AS smoothness FROM st")
_SSE = "(regr_syy(r, idx) FILTER (WHERE {c}) - pow(regr_sxy(r, idx) FILTER (WHERE {c}), 2)/(regr_sxx(r, idx) FILTER (WHERE {c})))"
_HALF = "floor((SELECT count(*) FROM b2)*0.5)"
_SA, _SB, _SP = _SSE.format(c=f"idx < {_HALF}"), _SSE.format(c=f"idx >= {_HALF}"), _SSE.format(c="true")
frame("generalization_structural_break", lambda s, d: generalization.structural_break(base2(s, d)), sql.B2, f"SELECT round((({_SP} - {_SA} - {_SB})/2)/(({_SA} + {_SB})/(count(r) - 4)), 6) AS f, count(r) AS n FROM b2")

# Signals --------------------------------------------------------------------------------------

_PREC, _BASE = "avg(CASE WHEN event THEN 1.0 ELSE 0.0 END) FILTER (WHERE signal)", "avg(CASE WHEN event THEN 1.0 ELSE 0.0 END)"
scalar("signal_precision", fixtures.signals, lambda: signal.precision(F.col("signal"), F.col("event")), sql.F6, "f6", _PREC)
scalar("signal_recall", fixtures.signals, lambda: signal.recall(F.col("signal"), F.col("event")), sql.F6, "f6", "avg(CASE WHEN signal THEN 1.0 ELSE 0.0 END) FILTER (WHERE event)")
scalar("signal_lift", fixtures.signals, lambda: signal.lift(F.col("signal"), F.col("event")), sql.F6, "f6", f"({_PREC})/({_BASE})")
scalar("signal_coverage", fixtures.signals, lambda: signal.coverage(F.col("signal")), sql.F6, "f6", "avg(CASE WHEN signal THEN 1.0 ELSE 0.0 END)")
frame("signal_conditional_forward_return", lambda s, d: signal.conditional_forward_return(fixtures.signals(s, d)), sql.F6, "SELECT round(avg(fwd) FILTER (WHERE signal), 6) AS with_signal, round(avg(fwd) FILTER (WHERE NOT signal), 6) AS without_signal, round(avg(fwd), 6) AS overall, count(*) FILTER (WHERE signal) AS n_signal, round(avg(fwd) FILTER (WHERE signal) - avg(fwd) FILTER (WHERE NOT signal), 6) AS difference FROM f6")
scalar("signal_information_coefficient", fixtures.signals, lambda: signal.information_coefficient(F.col("score"), F.col("fwd")), sql.F6, "f6", "corr(fwd, score)")
_HOR = f"{sql.F2}, hb AS (SELECT row_number() OVER (ORDER BY ts) AS i, ret FROM f2), hz AS (SELECT CAST(h AS INTEGER) AS horizon, a.ret AS score, b.ret AS fwd FROM hb a CROSS JOIN (SELECT unnest([1, 3, 5, 10, 21]) AS h) JOIN hb b ON b.i = a.i + h)"


def _horizons(s, d):
    b = base2(s, d).select("idx", F.col("r").alias("score"))
    lagged = b.select(F.col("score"), F.explode(F.array(*map(F.lit, (1, 3, 5, 10, 21)))).alias("horizon"), "idx").withColumn("idx", F.col("idx") + F.col("horizon"))
    return lagged.join(b.select("idx", F.col("score").alias("fwd")), "idx")


frame("signal_decay", lambda s, d: signal.signal_decay(_horizons(s, d)), _HOR, "SELECT horizon, round(corr(fwd, score), 6) AS ic FROM hz GROUP BY 1")
frame("signal_rank_ic", lambda s, d: signal.rank_ic(fixtures.signals(s, d)), f"{sql.F6}, rk AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1)/2.0 AS a, rank() OVER (ORDER BY fwd) + (count(*) OVER (PARTITION BY fwd) - 1)/2.0 AS b FROM f6)", "SELECT round(corr(a, b), 6) AS rank_ic FROM rk")
scalar("signal_ic_information_ratio", lambda s, d: signal.signal_decay(_horizons(s, d)), lambda: signal.ic_information_ratio(F.col("ic")), f"{_HOR}, ics AS (SELECT corr(fwd, score) AS ic FROM hz GROUP BY horizon)", "ics", "avg(ic)/stddev_samp(ic)")


def _buckets_sql(x: str) -> str:
    return f"{sql.F6}, ed AS (SELECT list_distinct([quantile_cont({x}, 0.0), quantile_cont({x}, 0.2), quantile_cont({x}, 0.4), quantile_cont({x}, 0.6), quantile_cont({x}, 0.8), quantile_cont({x}, 1.0)]) AS e FROM f6), qb AS (SELECT fwd, CAST(greatest(len(list_filter(e, lambda v: v < {x})), 1) AS INTEGER) AS bucket FROM f6 CROSS JOIN ed), qa AS (SELECT bucket, avg(fwd) AS mean, median(fwd) AS median, stddev_samp(fwd) AS sd, count(fwd) AS n FROM qb GROUP BY 1)"


for _x in ("score", "coarse", "price"):
    frame(f"signal_quantile_analysis_{_x}", lambda s, d, x=_x: signal.quantile_analysis(fixtures.signals(s, d), x), _buckets_sql(_x), "SELECT bucket, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd, n FROM qa")
frame("signal_monotonicity", lambda s, d: signal.monotonicity(fixtures.signals(s, d), "price"), f"{_buckets_sql('price')}, mr AS (SELECT rank() OVER (ORDER BY bucket) AS a, rank() OVER (ORDER BY mean) AS b FROM qa)", "SELECT round(corr(a, b), 6) AS monotonicity FROM mr")
_RES = f"{sql.F6}, ols AS (SELECT regr_slope(fwd, score) AS b, regr_intercept(fwd, score) AS a FROM f6), rs AS (SELECT coarse, fwd, fwd - a - b*score AS e FROM f6 CROSS JOIN ols)"
frame("signal_incremental_value", lambda s, d: signal.incremental_value(fixtures.signals(s, d), "coarse", ["score"]), _RES, "SELECT round(corr(coarse, fwd), 6) AS ic, round(corr(coarse, e), 6) AS incremental_ic FROM rs")
frame("signal_regime_performance", lambda s, d: signal.regime_performance(fixtures.trades(s, d)), sql.F1, "SELECT regime, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(stddev_samp(r), 6) AS sd, count(r) AS n, round(sum(r), 6) AS total FROM f1 GROUP BY 1")
frame("signal_regime_dependency", lambda s, d: signal.regime_dependency(fixtures.trades(s, d)), sql.F1, "SELECT round(max(s)/sum(s), 6) AS regime_dependency FROM (SELECT sum(r) AS s FROM f1 GROUP BY regime)")
frame("signal_positive_periods", lambda s, d: signal.positive_periods(fixtures.daily(s, d)), sql.F2, f"SELECT round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_periods FROM {_bins_sql('month')}")
_ROLL = {"mean": "avg(ret) OVER w", "std": "stddev_samp(ret) OVER w", "median": "quantile_cont(ret, 0.5) OVER w", "sharpe": "(avg(ret) OVER w)/(stddev_samp(ret) OVER w)*sqrt(252.0)", "profit_factor": "(sum(CASE WHEN ret > 0 THEN ret END) OVER w)/(-(sum(CASE WHEN ret < 0 THEN ret END) OVER w))"}


def _roll_sql(expr: str) -> str:
    return f"{sql.F2}, ro AS (SELECT ts, CASE WHEN row_number() OVER (ORDER BY ts) >= 60 THEN {expr} END AS rolling FROM f2 WINDOW w AS (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"


for _k, _x in _ROLL.items():
    frame(f"signal_rolling_{_k}", lambda s, d, k=_k: signal.rolling_metric(fixtures.daily(s, d), window=60, metric=k).select("ts", "rolling"), _roll_sql(_x), "SELECT ts, round(rolling, 14) AS rolling FROM ro", 14)
frame("signal_rolling_stability", lambda s, d: signal.rolling_stability(fixtures.daily(s, d), window=60), _roll_sql(_ROLL["mean"]), "SELECT round(avg(rolling), 6) AS mean, round(stddev_samp(rolling), 6) AS sd, round(avg(CASE WHEN rolling > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, round(min(rolling), 6) AS min, round(max(rolling), 6) AS max FROM ro WHERE rolling IS NOT NULL")
frame("signal_edge_decay", lambda s, d: signal.edge_decay(base1(s, d)), sql.B1, "SELECT round(regr_slope(r, idx), 6) AS slope, round(regr_slope(r, idx)/sqrt((regr_syy(r, idx) - pow(regr_sxy(r, idx), 2)/regr_sxx(r, idx))/(count(r)-2)/regr_sxx(r, idx)), 6) AS t, count(r) AS n FROM b1")
_TOP = f"{sql.F1}, tk AS (SELECT r, row_number() OVER (ORDER BY r DESC) AS k FROM f1), gn AS (SELECT count(r) AS n, sum(r) FILTER (WHERE r > 0) AS gross, sum(r) AS net FROM f1)"
frame("signal_pnl_concentration", lambda s, d: signal.pnl_concentration(fixtures.trades(s, d)), _TOP, " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS top, round(sum(r)/max(gross), 6) AS of_gross, CASE WHEN max(net) > 0 THEN round(sum(r)/max(net), 6) END AS of_net FROM tk CROSS JOIN gn WHERE k <= ceil(n*CAST({p} AS DOUBLE))" for p in ("0.01", "0.05", "0.1")))
frame("signal_remove_best_trades", lambda s, d: signal.without_best(fixtures.trades(s, d)), _TOP, "SELECT round(avg(r), 6) AS expectancy FROM tk WHERE k > 5")
frame("signal_remove_worst_trades", lambda s, d: signal.without_worst(fixtures.trades(s, d)), _TOP, "SELECT round(avg(r), 6) AS expectancy FROM (SELECT r, row_number() OVER (ORDER BY r) AS k FROM f1) WHERE k > 5")
frame("signal_hhi", lambda s, d: signal.hhi(fixtures.trades(s, d)), sql.F1, "SELECT round(sum(r*r)/pow(sum(r), 2), 6) AS hhi FROM f1 WHERE r > 0")
_GHHI = "sum(x*x)/pow(sum(x), 2) FROM (SELECT sum(r) AS x FROM f1 GROUP BY asset) WHERE x > 0"
frame("signal_hhi_by_asset", lambda s, d: signal.hhi(fixtures.trades(s, d), group="asset"), sql.F1, f"SELECT round(h, 6) AS hhi FROM (SELECT {_GHHI.replace(' FROM (', ' AS h FROM (', 1)})")
frame("signal_breadth", lambda s, d: signal.breadth(fixtures.trades(s, d), group="asset"), sql.F1, f"SELECT round(1/h, 6) AS breadth FROM (SELECT {_GHHI.replace(' FROM (', ' AS h FROM (', 1)})")

_PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
frame("function_exact_quantiles", lambda s, d: ordered.quantiles(fixtures.trades(s, d), "r", _PROBS), sql.F1, " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS p, round(quantile_cont(r, {p}), 6) AS value FROM f1" for p in _PROBS))
frame("function_exact_quantiles_by_regime", lambda s, d: ordered.quantiles(fixtures.trades(s, d), "r", _PROBS, ("regime",)), sql.F1, " UNION ALL ".join(f"SELECT regime, CAST({p} AS DOUBLE) AS p, round(quantile_cont(r, {p}), 6) AS value FROM f1 GROUP BY 1" for p in _PROBS))

# Execution ------------------------------------------------------------------------------------

_HELD = "date_diff('day', CAST(entry AS DATE), exit_day)"
frame("execution_slippage_sensitivity", lambda s, d: execution.slippage_sensitivity(fixtures.trades(s, d)), sql.F1, " UNION ALL ".join(f"SELECT CAST({c} AS DOUBLE) AS cost, round(avg(r) - {c}, 6) AS expectancy FROM f1" for c in (0.0, 0.05, 0.1, 0.2, 0.4)))
scalar("execution_break_even_cost", fixtures.trades, lambda: execution.break_even_cost(F.col("r")), sql.F1, "f1", "avg(r)")
scalar("execution_cost_safety_margin", fixtures.trades, lambda: execution.cost_safety_margin(F.col("r"), 0.05), sql.F1, "f1", "avg(r)/0.05")
scalar("execution_turnover", fixtures.trades, lambda: execution.turnover(F.col("l_extendedprice"), 1e9), sql.F1, "f1", "sum(l_extendedprice)/1e9")
scalar("execution_exposure", fixtures.trades, lambda: execution.exposure(F.col("l_discount")), sql.F1, "f1", "avg(CASE WHEN abs(l_discount) > 0 THEN 1.0 ELSE 0.0 END)")
frame("execution_capital_utilization", lambda s, d: execution.capital_utilization(fixtures.trades(s, d), "l_quantity", "l_extendedprice"), f"{sql.F1}, cu AS (SELECT l_quantity/nullif(l_extendedprice, 0) AS u FROM f1)", "SELECT round(avg(u), 6) AS mean, round(quantile_cont(u, 0.95), 6) AS p95, round(max(u), 6) AS max FROM cu")
scalar("execution_trades_per_year", fixtures.trades, lambda: execution.trades_per_year(F.col("entry")), sql.F1, "f1", "count(entry)/(date_diff('day', CAST(min(entry) AS DATE), CAST(max(entry) AS DATE))/365.25)")
frame("execution_holding_period", lambda s, d: execution.holding_period(fixtures.trades(s, d)).withColumn("max", F.col("max").cast("long")), sql.F1, f"SELECT round(avg({_HELD}), 6) AS mean, round(median({_HELD}), 6) AS median, round(quantile_cont({_HELD}, 0.95), 6) AS p95, max({_HELD}) AS max FROM f1")
frame("execution_winner_loser_holding", lambda s, d: execution.winner_loser_holding(fixtures.trades(s, d)), sql.F1, f"SELECT round(avg({_HELD}) FILTER (WHERE r > 0), 6) AS winners, round(avg({_HELD}) FILTER (WHERE r < 0), 6) AS losers FROM f1")
frame("execution_mae_mfe", lambda s, d: execution.mae_mfe(fixtures.trades(s, d)), sql.F1, "SELECT round(mae, 9) AS mae, round(mfe, 9) AS mfe, round(r, 9) AS r, CASE WHEN r > 0 THEN 'winner' ELSE 'loser' END AS outcome FROM f1", 9)
scalar("execution_mfe_capture_ratio", fixtures.trades, lambda: execution.mfe_capture(F.col("r"), F.col("mfe")), sql.F1, "f1", "avg(r/mfe) FILTER (WHERE r > 0 AND mfe > 0)")
frame("execution_mae_efficiency", lambda s, d: execution.mae_efficiency(fixtures.trades(s, d)), sql.F1, "SELECT round(avg(abs(mae)), 6) AS mean, round(quantile_cont(abs(mae), 0.95), 6) AS p95, 1.0::DOUBLE AS stop, round(1 - quantile_cont(abs(mae), 0.95), 6) AS slack FROM f1 WHERE r > 0")
scalar("execution_fill_probability", lambda s, d: fixtures.read(s, d, "orders"), lambda: execution.fill_probability(F.count("*"), F.count(F.when(F.col("o_orderstatus") == "F", 1))), "oo AS (SELECT * FROM orders)", "oo", "count(*) FILTER (WHERE o_orderstatus = 'F')*1.0/count(*)")
frame("execution_slippage_distribution", lambda s, d: fixtures.trades(s, d).agg(*execution.slippage_distribution(F.col("cost"))), sql.F1, "SELECT round(avg(cost), 6) AS mean, round(median(cost), 6) AS median, round(quantile_cont(cost, 0.95), 6) AS p95, round(quantile_cont(cost, 0.99), 6) AS p99, round(max(cost), 6) AS max FROM f1")
scalar("execution_participation_rate", fixtures.trades, lambda: execution.participation_rate(F.col("l_quantity"), F.col("l_extendedprice")), sql.F1, "f1", "sum(l_quantity)/sum(l_extendedprice)")
scalar("execution_capacity", fixtures.trades, lambda: execution.capacity(F.avg(F.col("r")), F.avg("cost")), sql.F1, "f1", "avg(r)/avg(cost)")
frame("execution_capacity_adjusted", lambda s, d: fixtures.trades(s, d).agg(F.avg(F.col("r")).alias("e"), F.avg("cost").alias("i")).withColumn("millions", F.explode(F.array(*map(F.lit, (0.0, 1.0, 5.0))))).select("millions", execution.capacity_adjusted(F.col("e"), F.col("i"), F.col("millions")).alias("expectancy")), sql.F1, " UNION ALL ".join(f"SELECT CAST({m} AS DOUBLE) AS millions, round(avg(r) - avg(cost)*{m}, 6) AS expectancy FROM f1" for m in (0, 1, 5)))
frame("execution_cross_market_transfer", lambda s, d: execution.cross_market_transfer(fixtures.trades(s, d).groupBy(F.col("regime").alias("market")).agg(F.avg("r").alias("value")), "A"), f"{sql.F1}, mk AS (SELECT regime AS market, avg(r) AS value FROM f1 GROUP BY 1), ba AS (SELECT value AS b FROM mk WHERE market = 'A')", "SELECT round((SELECT b FROM ba), 6) AS base, round(avg(value), 6) AS others, round(avg(value/nullif((SELECT b FROM ba), 0)), 6) AS retention, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM mk WHERE market <> 'A'")


def _declared(s, d):
    """Audits declared by nation: the audit at the nation's key passes if its region is not 0."""
    n = fixtures.read(s, d, "nation").where("n_nationkey < 7")
    return n.select(F.element_at(F.array(*map(F.lit, execution.AUDITS)), F.col("n_nationkey") + 1).alias("key"), F.when(F.col("n_nationkey") != 3, F.col("n_regionkey") != 0).alias("passed"))


_AUD = "dm AS (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS ord, unnest([" + ", ".join(f"'{a}'" for a in execution.AUDITS) + "]) AS audit, unnest([" + ", ".join(f"'{q}'" for q in execution.AUDITS.values()) + "]) AS question), de AS (SELECT n_nationkey + 1 AS ord, CASE WHEN n_nationkey <> 3 THEN n_regionkey <> 0 END AS p FROM nation WHERE n_nationkey < 7), au AS (SELECT dm.ord, audit, CASE WHEN p THEN 'PASS' WHEN NOT p THEN 'FAIL' ELSE 'NOT AUDITED' END AS status, coalesce(p, false) AS passed, question FROM dm LEFT JOIN de ON de.ord = dm.ord)"
frame("execution_integrity_audit", lambda s, d: execution.integrity_audit(s, _declared(s, d)), _AUD, "SELECT ord, audit, question, status, passed FROM au")
frame("execution_live_gap", lambda s, d: fixtures.trades(s, d).agg(F.avg(F.when(F.year("entry") >= 1998, F.col("r"))).alias("l"), F.avg(F.when(F.year("entry") < 1998, F.col("r"))).alias("b")).select(*execution.live_gap(F.col("l"), F.col("b"), F.lit(-0.05), F.lit(0.05))), sql.F1, "SELECT round(l - b, 6) AS gap, l BETWEEN -0.05 AND 0.05 AS inside FROM (SELECT avg(r) FILTER (WHERE year(entry) >= 1998) AS l, avg(r) FILTER (WHERE year(entry) < 1998) AS b FROM f1)")
frame("execution_ci_breach_rate", lambda s, d: execution.breach_rate(fixtures.trades(s, d).select(F.col("regime").alias("strategy"), F.col("r").alias("value")), fixtures.trades(s, d).groupBy(F.col("regime").alias("strategy")).agg(F.percentile("r", 0.25).alias("low"), F.percentile("r", 0.75).alias("high"))), f"{sql.F1}, iv AS (SELECT regime, quantile_cont(r, 0.25) AS low, quantile_cont(r, 0.75) AS high FROM f1 GROUP BY 1)", "SELECT f1.regime AS strategy, round(avg(CASE WHEN r BETWEEN low AND high THEN 0.0 ELSE 1.0 END), 6) AS breach_rate, count(r) AS n FROM f1 JOIN iv USING (regime) GROUP BY 1")
frame("execution_live_slippage_gap", lambda s, d: execution.live_slippage_gap(fixtures.trades(s, d).where("regime = 'A'"), fixtures.trades(s, d).where("regime = 'N'"), "cost"), sql.F1, "SELECT round((avg(cost) FILTER (WHERE regime = 'A')) - (avg(cost) FILTER (WHERE regime = 'N')), 6) AS gap FROM f1")
frame("execution_kill_switch", lambda s, d: execution.kill_switch(fixtures.daily(s, d), -0.3), sql.DD, "SELECT count(ret) AS n, round(min(dd), 6) AS max_drawdown, round(avg(ret), 6) AS expectancy, count(ret) >= 30 AS enough, (min(dd) <= -0.3 OR (count(ret) >= 30 AND avg(ret) < 0)) AS trigger FROM dd")
frame("execution_gross_vs_net", lambda s, d: execution.gross_vs_net(fixtures.trades(s, d), "r", "cost"), sql.F1, "SELECT round(avg(r), 6) AS gross, round(avg(r - cost), 6) AS net, round(avg(cost), 6) AS cost, round(avg(cost)/avg(r), 6) AS consumed FROM f1")
_XY = f"{sql.F2}, {sql.F3}, xy AS (SELECT ret AS y, bench AS x FROM f2 JOIN f3 USING (ts)), se AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2)/regr_sxx(y, x))/(count(*)-2)/regr_sxx(y, x)) AS seb, sum(x*x) AS x2, count(*) AS n FROM xy)"
frame("execution_beta_alpha", lambda s, d: execution.beta_alpha(fixtures.daily(s, d).join(fixtures.benchmark(s, d), "ts")), _XY, "SELECT round(a, 6) AS alpha, round(a/(seb*sqrt(x2/n)), 6) AS t_alpha, round(b, 6) AS beta, round(b/seb, 6) AS t_beta, round(r2, 6) AS r2, n FROM se")
frame("execution_strategy_correlation", lambda s, d: execution.strategy_correlation(fixtures.strategies(s, d)), sql.F4, f"SELECT a.strategy AS a, b.strategy AS b, round({sql.safe_corr('a.ret', 'b.ret')}, 6) AS correlation, count(*) AS n FROM f4 a JOIN f4 b ON a.ts = b.ts AND a.strategy <= b.strategy GROUP BY 1, 2")
_DDB = sql.DD + f", {sql.F3}, capb AS (SELECT ts, product(1+bench) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM f3), ddb AS (SELECT ts, c/max(c) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)-1 AS ddb FROM capb)"
frame("execution_drawdown_overlap", lambda s, d: execution.drawdown_overlap(drawn(s, d), ordered.drawdown(fixtures.benchmark(s, d), "bench", ("ts",))), _DDB, "SELECT round(avg(CASE WHEN dd <= -0.05 AND ddb <= -0.05 THEN 1.0 ELSE 0.0 END), 6) AS overlap FROM dd JOIN ddb USING (ts)")

# Scorecard ------------------------------------------------------------------------------------

_Q = {
    "expectancy": f"WITH {sql.F1} SELECT avg(r) FROM f1", "profit_factor": f"WITH {sql.F1} SELECT {_PF} FROM f1", "edge_margin": f"WITH {sql.F1} SELECT {TRADE['edge_margin']} FROM f1", "cost_margin": f"WITH {sql.F1} SELECT avg(r)/0.05 FROM f1",
    "newey_west_t": f"WITH {sql.B1}, {_NW.format(b='b1')} SELECT {_NWT.format(b='b1')}", "n_eff": f"WITH {sql.B1}, {_ACF.format(b='b1')} SELECT {_NEFF.format(b='b1')}",
    "oos_ratio": f"WITH {_SPLIT} SELECT ({_OOS})/({_IS}) FROM sp", "walk_forward_efficiency": f"WITH {_WF} SELECT avg(test)/avg(train) FROM wf", "positive_windows": f"WITH {_WF} SELECT avg(CASE WHEN test > 0 THEN 1.0 ELSE 0.0 END) FROM wf",
    "pbo": f"WITH {_PBO} SELECT avg(CASE WHEN l <= 0 THEN 1.0 ELSE 0.0 END) FROM lg", "max_drawdown": f"WITH {sql.DD} SELECT min(dd) FROM dd", "sortino": f"WITH {sql.DD} SELECT {RISK['sortino']} FROM dd",
    "retention_at_double_cost": f"WITH {sql.F1} SELECT (avg(r)-0.1)/avg(r) FROM f1", "expectancy_at_double_cost": f"WITH {sql.F1} SELECT avg(r)-0.1 FROM f1",
}
#: The operators' own numbers of resamples, of simulated paths and of trades that ruin is simulated over.
_RESAMPLES, _SIMULATED, _RUIN = 10_000, 5_000, 500
_PATHS1 = _PATHS.replace("(1+r)", "(1+r*0.01)")
_B1D = f"{sql.B1}, {sql.draws(_RESAMPLES, 'b1')}"
_Q |= {
    "ci_low": f"WITH {_B1D}, v AS (SELECT rep, avg(r) AS v FROM dr GROUP BY 1) SELECT quantile_cont(v, 0.025) FROM v", "p_positive": f"WITH {_B1D}, v AS (SELECT rep, avg(r) AS v FROM dr GROUP BY 1) SELECT avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) FROM v",
    "mdd_p95": f"WITH {sql.B1}, {sql.draws(_SIMULATED, 'b1')}, {_PATHS1} SELECT quantile_cont(m, 0.05) FROM (SELECT rep, min(dd) AS m FROM q GROUP BY 1)",
    "risk_of_ruin": f"WITH {sql.B1}, {sql.draws(_SIMULATED, 'b1', length=_RUIN)}, {_PATHS1} SELECT avg(CASE WHEN low <= 0.5 THEN 1.0 ELSE 0.0 END) FROM (SELECT rep, min(c) AS low FROM p GROUP BY 1)",
}
# The scorecard judges the generated strategy: 420 trades, 2,730 days.
_Q = {c: q.replace(sql.B1, sql.GB1).replace(sql.F1, sql.G1).replace(sql.F2, sql.G2) for c, q in _Q.items()}
_LIM = [(g, i + 1, c, op, -0.3 if x is None else x) for i, (g, c, op, x) in enumerate(scorecard.LIMITS)]
_CRIT = f"WITH {_AUD}, cr AS (SELECT 0 AS gate, ord, audit AS criterion, CASE WHEN status <> 'NOT AUDITED' THEN CAST(passed AS DOUBLE) END AS value, 'bool' AS cmp, 1.0::DOUBLE AS lim, passed FROM au " + "".join(
    f"UNION ALL SELECT {g}, {i}, '{c}', v, '{op}', {x}::DOUBLE, coalesce(v {op} {x}, false) FROM (SELECT CAST(({_Q[c]}) AS DOUBLE) AS v) " for g, i, c, op, x in _LIM) + ")"
_GATE = "gn AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS gate, unnest([" + ", ".join(f"'{n}'" for _, n, _ in scorecard.GATES) + "]) AS name, unnest([" + ", ".join(str(x).lower() for *_, x in scorecard.GATES) + "]) AS decisive), gt AS (SELECT gn.gate, name, decisive, count(*) AS criteria, avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) AS rate, bool_and(passed) AS passed FROM gn JOIN cr ON cr.gate = gn.gate GROUP BY 1, 2, 3)"


_NOTES = "SELECT unnest([" + ", ".join(f"'{c}'" for c in (*scorecard.NOTES, *execution.AUDITS)) + "]) AS criterion, unnest([" + ", ".join(f"'{n}'" for n in (*scorecard.NOTES.values(), *execution.AUDITS.values())) + "]) AS note"


def evaluated(s, d):
    """At the operators' own counts."""
    made = generators.strategy(s)
    return scorecard.evaluate(made.trades, made.daily, _declared(s, d), fixtures.matrix(s, d), order=("idx",), reps=_RESAMPLES, paths=_SIMULATED)


add("scorecard_criteria", lambda s, d: rounded(evaluated(s, d)), f"{_CRIT} SELECT gate, ord, criterion, round(value, 6) AS value, cmp, lim AS \"limit\", passed FROM cr")
add("scorecard_table", lambda s, d: rounded(scorecard.table(evaluated(s, d))), f"{_CRIT} SELECT gate, ord, criterion, round(value, 6) AS value, cmp, lim AS \"limit\", passed, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status, note FROM cr JOIN ({_NOTES}) USING (criterion)")
add("scorecard_gates", lambda s, d: rounded(scorecard.gate_table(evaluated(s, d))), f"{_CRIT}, {_GATE} SELECT gate, name, decisive, criteria, round(rate, 6) AS rate, passed FROM gt")
add("scorecard_verdict", lambda s, d: scorecard.verdict(scorecard.gate_table(evaluated(s, d))), f"{_CRIT}, {_GATE} SELECT CASE WHEN bool_or(NOT passed AND decisive) THEN 'REJECTED' WHEN bool_and(passed) THEN 'APPROVED' ELSE 'RESERVATIONS' END AS verdict, string_agg(CAST(gate AS VARCHAR), ',' ORDER BY gate) FILTER (WHERE NOT passed) AS failed_gates FROM gt")
add("scorecard_composite", lambda s, d: rounded(scorecard.composite(scorecard.gate_table(evaluated(s, d)))), f"{_CRIT}, {_GATE} SELECT CASE WHEN bool_or(NOT passed AND decisive) THEN 0.0 ELSE round(avg(rate), 6) END AS score FROM gt")

# Sources --------------------------------------------------------------------------------------


def _yearly(s, d):
    """Results by year in the published layout: growth and sessions."""
    y = fixtures.daily(s, d).groupBy(F.year("ts").cast("string").alias("janela")).agg(F.count("*").cast("int").alias("pregoes"), risk.cagr(F.col("ret")).alias("cagr"), F.avg("ret").alias("alpha"), (F.avg("ret") * 100).alias("t_alpha"))
    full = fixtures.daily(s, d).agg(F.lit(published.FULL_SAMPLE).alias("janela"), F.count("*").cast("int").alias("pregoes"), risk.cagr(F.col("ret")).alias("cagr"), F.avg("ret").alias("alpha"), (F.avg("ret") * 100).alias("t_alpha"))
    return y.unionByName(full).withColumn("reservada", (F.col("janela") == "1997").cast("int"))


_PUB = f"{sql.F2}, pu AS (SELECT CAST(year(ts) AS VARCHAR) AS janela, CAST(count(*) AS INTEGER) AS pregoes, {RISK['cagr']} AS cagr, avg(ret) AS alpha, CAST(year(ts) = 1997 AS INTEGER) AS reservada FROM f2 GROUP BY year(ts) UNION ALL SELECT '{published.FULL_SAMPLE}', CAST(count(*) AS INTEGER), {RISK['cagr']}, avg(ret), 0 FROM f2)"
_PCOLS = "janela, pregoes, round(cagr, 6) AS cagr, round(alpha, 6) AS alpha, reservada"
for _n, _f, _w in (("windows", published.windows, f"janela <> '{published.FULL_SAMPLE}'"), ("reserved", published.reserved, "reservada = 1"), ("full_sample", published.full_sample, f"janela = '{published.FULL_SAMPLE}'")):
    frame(f"published_{_n}", lambda s, d, f=_f: f(_yearly(s, d)).select("janela", "pregoes", "cagr", "alpha", "reservada"), _PUB, f"SELECT {_PCOLS} FROM pu WHERE {_w}")
frame("published_weighted_cagr", lambda s, d: published.weighted_cagr(published.windows(_yearly(s, d))), _PUB, f"SELECT round(exp(sum(pregoes*ln(1+cagr))/sum(pregoes))-1, 6) AS cagr FROM pu WHERE janela <> '{published.FULL_SAMPLE}'")
add("published_headline", lambda s, d: published.headline(_yearly(s, d)), f"WITH {_PUB}, hl AS (SELECT max(alpha) FILTER (WHERE janela = '{published.FULL_SAMPLE}') AS fa, max(alpha) FILTER (WHERE reservada = 1) AS ra FROM pu) SELECT printf('Full sample: excess %+.2f%% (t = %.2f). Reserved window: %+.2f%% (t = %.2f).', fa*100, fa*100, ra*100, ra*100) AS headline FROM hl")
frame("generated_strategy_trades", lambda s, d: generators.strategy(s).trades, sql.GENERATED, "SELECT idx, entry, exit, round(r, 6) AS r, round(ret, 6) AS ret, asset, regime, round(mae, 6) AS mae, round(mfe, 6) AS mfe FROM gt")
frame("generated_strategy_capital", lambda s, d: generators.strategy(s).capital(), sql.GENERATED, "SELECT ts, round(ret, 6) AS ret, round(product(1+ret) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS capital FROM gd")
frame("generated_benchmark", lambda s, d: generators.benchmark(generators.strategy(s).daily), sql.GENERATED, f"SELECT ts, round(0.55*ret + {1 - 0.55!r}*{sql.normal(7, 'bench', 0.09 / 252, 0.011, 'ts')}, 6) AS bench FROM gd")
_PAIR = f"""ga AS (SELECT id, {sql.normal(5, 'a', 0.0006, 0.005)} AS a, {sql.normal(5, 'b', 0.0006, 0.016)} - CASE WHEN id >= {int(252 * 0.45)} AND id < {int(252 * 0.58)} THEN 0.010 ELSE 0.0 END AS b FROM (SELECT CAST(i AS BIGINT) AS id FROM range(0, 252) t(i))),
  gs AS (SELECT sum(ln(1+a)) AS la, sum(ln(1+b)) AS lb FROM ga)"""
frame("generated_comparable_pair", lambda s, d: generators.comparable_pair(s), _PAIR, f"SELECT {sql.business_day('2025-12-29', 4, 'id')} AS ts, round(exp(ln(1+a) + (ln(1.15) - la)/252) - 1, 6) AS a, round(exp(ln(1+b) + (ln(1.15) - lb)/252) - 1, 6) AS b FROM ga CROSS JOIN gs")
frame("generated_signal", lambda s, d: generators.signal(s), f"gs AS (SELECT {sql.normal(11, 'score')} AS score, {sql.normal(11, 'noise')} AS e FROM (SELECT CAST(i AS BIGINT) AS id FROM range(0, 3000) t(i)))", "SELECT round(score, 6) AS score, round(0.02*(0.045*score + sqrt(1 - 0.045*0.045)*e), 6) AS fwd FROM gs")
frame("generated_business_days", lambda s, d: s.range(300).select("id", generators.business_day("2012-01-02", F.col("id")).alias("day")), "", "SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS BIGINT) AS id, CAST(day AS TIMESTAMP) AS day FROM (SELECT CAST(unnest(generate_series(DATE '2012-01-02', DATE '2013-12-31', INTERVAL 1 DAY)) AS DATE) AS day) WHERE isodow(day) < 6 QUALIFY row_number() OVER (ORDER BY day) <= 300")



def _portfolio(s, d):
    """Nations as positions of equal weight, and a cash row."""
    n = fixtures.read(s, d, "nation").select(F.col("n_name").alias("ticker"), F.when(F.col("n_nationkey") == 3, F.lit("Perfil X")).otherwise(F.lit("")).alias("label"), (F.lit(0.5) / 25 + F.col("n_nationkey") / 10000 - 0.0012).alias("weight"), F.lit(False).alias("is_cash"))
    return n.unionByName(s.createDataFrame([(published.CASH, "", 0.5, True)], n.schema))


_POS = "po AS (SELECT n_name AS ticker, CASE WHEN n_nationkey = 3 THEN 'Perfil X' ELSE '' END AS label, 0.5/25 + n_nationkey/10000.0 - 0.0012 AS weight, false AS cash FROM nation UNION ALL SELECT 'CAIXA', '', 0.5, true)"
frame("portfolio_card", lambda s, d: published.portfolio_card(_portfolio(s, d).withColumn("label", F.lit(""))), _POS, "SELECT CAST(row_number() OVER (ORDER BY cash, weight DESC, ticker) AS INTEGER) AS ord, ticker, '' AS label, round(weight, 6) AS weight FROM po")
frame("portfolio_label_check", lambda s, d: published.check_labels(_portfolio(s, d)).select("ticker", F.array_join("terms", ",").alias("terms")), _POS, "SELECT ticker, array_to_string(t, ',') AS terms FROM (SELECT ticker, list_filter([" + ", ".join(f"'{t}'" for t in published.LABEL_BANNED) + "], lambda x: contains(lower(ticker || ' ' || label), x)) AS t FROM po WHERE NOT cash) WHERE len(t) > 0")
frame("programme_caveats", lambda s, d: programme.caveats(s), "", " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS ord, '{c}' AS caveat, '{e}' AS effect, CAST({'NULL' if x is None else x} AS DOUBLE) AS floor" for i, (c, e, x) in enumerate(programme.CAVEATS, 1)))
frame("programme_growth", lambda s, d: programme.growth(fixtures.daily(s, d), fixtures.benchmark(s, d)), f"{sql.F2}, {sql.F3}", f"SELECT round((SELECT {RISK['cagr']} FROM f2), 6) AS cagr, round((SELECT avg(ret)*252 FROM f2), 6) AS arithmetic, round((SELECT {RISK['cagr'].replace('ret', 'bench')} FROM f3), 6) AS reference_cagr")
frame("programme_pain", lambda s, d: programme.pain(fixtures.daily(s, d)), sql.EPISODES, f"SELECT round(min(dd), 6) AS max_drawdown, round({RISK['time_under_water']}, 6) AS time_under_water, round({RISK['ulcer_index']}, 6) AS ulcer_index, (SELECT count(*) FROM ep) AS episodes, (SELECT count(recovery) FROM ep) AS closed FROM dd")
frame("programme_ratios", lambda s, d: programme.ratios(fixtures.daily(s, d)), sql.DD, f"SELECT round({RISK['sharpe']}, 6) AS sharpe, round({RISK['sortino']}, 6) AS sortino, round({RISK['calmar']}, 6) AS calmar FROM dd")
frame("programme_excess", lambda s, d: programme.excess(fixtures.daily(s, d), fixtures.benchmark(s, d), CI), f"{_BOOT_CI}, {sql.F3}, xy AS (SELECT b2.r AS y, bench AS x FROM b2 JOIN f3 ON f3.ts = b2.ts), se AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2)/regr_sxx(y, x))/(count(*)-2)/regr_sxx(y, x)) AS seb, sum(x*x) AS x2, count(*) AS n FROM xy)", "SELECT round(a, 6) AS alpha, round(a/(seb*sqrt(x2/n)), 6) AS t_alpha, round(b, 6) AS beta, round(b/seb, 6) AS t_beta, round(r2, 6) AS r2, n, round((SELECT quantile_cont(v, 0.025) FROM v), 6) AS low, round((SELECT quantile_cont(v, 0.975) FROM v), 6) AS high FROM se")

# Charts, formats, colours ---------------------------------------------------------------------

_HIST = "SELECT bin, round(a + bin*(b-a)/{n}, 6) AS lo, round(a + (bin+1)*(b-a)/{n}, 6) AS hi, count(*) AS n FROM (SELECT CAST(least(floor((x-a)/((b-a)/{n})), {n}-1) AS INTEGER) AS bin, a, b FROM {t} CROSS JOIN (SELECT min(x) AS a, max(x) AS b FROM {t})) GROUP BY bin, a, b"
frame("chart_equity", lambda s, d: charts.equity(fixtures.daily(s, d)), sql.DD, "SELECT ts, round(100*capital, 7) AS capital FROM dd", 7)
frame("chart_drawdown", lambda s, d: charts.drawdown_curve(fixtures.daily(s, d)), sql.DD, "SELECT ts, round(dd, 11) AS dd, ts = (SELECT arg_min(ts, (dd, ts)) FROM dd) AS is_worst FROM dd", 11)
frame("chart_trade_histogram", lambda s, d: charts.histogram(fixtures.trades(s, d), "r"), f"{sql.F1}, hx AS (SELECT r AS x FROM f1)", _HIST.format(n=40, t="hx"))
frame("chart_monte_carlo_band", lambda s, d: charts.monte_carlo_band(base2(s, d), fraction=1.0), f"{sql.B2}, {sql.draws(400)}, {_PATHS}", "SELECT pos, round(quantile_cont(c, 0.05), 6) AS p5, round(quantile_cont(c, 0.5), 6) AS p50, round(quantile_cont(c, 0.95), 6) AS p95 FROM p GROUP BY 1")
frame("chart_drawdown_histogram", lambda s, d: charts.drawdown_histogram(base2(s, d), fraction=1.0), f"{sql.B2}, {sql.draws(3000)}, {_PATHS}, hx AS (SELECT min(dd) AS x FROM q GROUP BY rep)", _HIST.format(n=50, t="hx"))
frame("chart_bootstrap_histogram", lambda s, d: charts.bootstrap_histogram(base2(s, d)), f"{_BOOT_CI}, hx AS (SELECT v AS x FROM v)", _HIST.format(n=60, t="hx"))
frame("chart_surface", lambda s, d: charts.surface(_grid(s, d), "x", "y", "value", [1, 2, 3]).withColumnsRenamed({"1": "x1", "2": "x2", "3": "x3"}), _GRIDS, "SELECT y, round(max(value) FILTER (WHERE x = 1), 6) AS x1, round(max(value) FILTER (WHERE x = 2), 6) AS x2, round(max(value) FILTER (WHERE x = 3), 6) AS x3 FROM gr GROUP BY 1")
frame("chart_lorenz", lambda s, d: charts.lorenz(fixtures.trades(s, d)), f"{sql.F1}, lw AS (SELECT r, count(*) AS n FROM f1 WHERE r > 0 GROUP BY 1)", "SELECT round(CAST(sum(n) OVER w AS DOUBLE)/(SELECT sum(n) FROM lw), 6) AS share_of_winners, round(sum(n*r) OVER w/(SELECT sum(n*r) FROM lw), 6) AS share_of_gross FROM lw WINDOW w AS (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)")
frame("format_numbers", lambda s, d: fixtures.read(s, d, "customer").select("c_custkey", formats.fixed(F.col("c_acctbal")).alias("fixed"), formats.number_text(F.col("c_acctbal"), 2, False).alias("grouped"), formats.signed_percent(F.col("c_acctbal") / 1000, 3).alias("signed"), formats.unsigned_percent(F.col("c_acctbal") / 1000, 3).alias("unsigned")), "", "SELECT c_custkey, translate(printf('%.2f', c_acctbal), '.-', ',−') AS fixed, translate(format('{:,.2f}', c_acctbal), ',.-', ' ,−') AS grouped, translate(printf('%+.3f%%', c_acctbal/1000*100), '.-', ',−') AS signed, ltrim(translate(printf('%+.3f%%', c_acctbal/1000*100), '.-', ',−'), '+') AS unsigned FROM customer")
frame("format_disclosure", lambda s, d: fixtures.read(s, d, "region").select(formats.disclosure(F.lit("2024-01-31"), F.col("r_name"), F.lit("CVM"), F.lit("2024-02-01"), F.lit("nenhum")).alias("line")), "", "SELECT 'Data-base: 2024-01-31 | Posição do autor: ' || r_name || ' | Natureza: educacional | Principais fontes: CVM | Última revisão: 2024-02-01 | Conflitos relevantes: nenhum' AS line FROM region")
_TERMS = ("the", "en", "io")
frame("format_banned_terms", lambda s, d: fixtures.read(s, d, "documents").select("doc_id", F.array_join(published.banned_terms(F.coalesce("text", F.lit("")), (*_TERMS, *published.TITLE_BANNED)), ",").alias("terms")), "", "SELECT doc_id, coalesce(array_to_string(list_filter([" + ", ".join(f"'{t}'" for t in (*_TERMS, *published.TITLE_BANNED)) + "], lambda t: contains(lower(coalesce(text, '')), t)), ','), '') AS terms FROM documents")


#: The palette of the pairwise check: the eight colours of Okabe and Ito.
PALETTE = ("#000000", "#e69f00", "#56b4e9", "#009e73", "#f0e442", "#0072b2", "#d55e00", "#cc79a7")


def _colours(s, d):
    """Colours from part keys: six hexadecimal digits of a hash."""
    return fixtures.read(s, d, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("#"), F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 6)).alias("colour"))


def _lin(i: int) -> str:
    c = f"(CAST('0x' || substr(colour, {i}, 2) AS BIGINT)/255.0)"
    return f"CASE WHEN {c} <= 0.04045 THEN {c}/12.92 ELSE pow(({c}+0.055)/1.055, 2.4) END"


_COL = f"cl AS (SELECT p_partkey AS pos, '#' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 6) AS colour FROM part), li AS (SELECT pos, colour, {_lin(2)} AS r, {_lin(4)} AS g, {_lin(6)} AS b FROM cl), "
_COL += "lm AS (SELECT *, " + ", ".join(f"cbrt({x[0]}*r + {x[1]}*g + {x[2]}*b) AS {n}" for n, x in zip("lms", colour.TO_LMS, strict=True)) + " FROM li), "
_COL += "lab AS (SELECT *, " + ", ".join(f"({x[0]}*l + {x[1]}*m + {x[2]}*s) AS {n}" for n, x in zip(("ll", "aa", "bb"), colour.TO_LAB, strict=True)) + ", 0.2126*r + 0.7152*g + 0.0722*b AS lu FROM lm)"
frame("colour_oklch", lambda s, d: _colours(s, d).select("pos", *(c.alias(n) for n, c in zip(("lightness", "chroma", "hue"), colour.oklch(F.col("colour")), strict=True)), colour.luminance(F.col("colour")).alias("luminance"), colour.contrast(F.col("colour"), F.lit("#ffffff")).alias("contrast")), _COL, "SELECT pos, round(ll, 6) AS lightness, round(sqrt(aa*aa + bb*bb), 6) AS chroma, round(CASE WHEN atan2(bb, aa) < 0 THEN degrees(atan2(bb, aa)) + 360 ELSE degrees(atan2(bb, aa)) END, 6) AS hue, round(lu, 6) AS luminance, round(1.05/(lu + 0.05), 6) AS contrast FROM lab")
frame("colour_delta_e", lambda s, d: _colours(s, d).select("pos", colour.delta_e(F.col("colour"), F.lit("#000000")).alias("delta_e")), _COL, "SELECT pos, round(100*sqrt(ll*ll + aa*aa + bb*bb), 6) AS delta_e FROM lab")


def _lab(kind: str | None) -> str:
    """[lightness, a, b] of linear r, g, b as seen with a deficiency, or with none."""
    rgb = [f"least(1.0, greatest(0.0, {x[0]}*r + {x[1]}*g + {x[2]}*b))" for x in colour.DEFICIENCY[kind]] if kind else ["r", "g", "b"]
    lms = [f"cbrt({x[0]}*({rgb[0]}) + {x[1]}*({rgb[1]}) + {x[2]}*({rgb[2]}))" for x in colour.TO_LMS]
    return "[" + ", ".join(f"{x[0]}*{lms[0]} + {x[1]}*{lms[1]} + {x[2]}*{lms[2]}" for x in colour.TO_LAB) + "]"


def _apart(a: str, b: str) -> str:
    return f"100*sqrt(pow({a}[1]-{b}[1], 2) + pow({a}[2]-{b}[2], 2) + pow({a}[3]-{b}[3], 2))"


_SEEN = f"{_COL}, sm AS (SELECT pos, " + ", ".join(f"{_lab(k)} AS {k}" for k in colour.DEFICIENCY) + " FROM li)"
frame("colour_simulated", lambda s, d: _colours(s, d).select("pos", *(colour.delta_e(F.col("colour"), F.lit("#000000"), k).alias(k) for k in colour.DEFICIENCY)), _SEEN, "SELECT pos, " + ", ".join(f"round({_apart(k, '[0.0, 0.0, 0.0]')}, 6) AS {k}" for k in colour.DEFICIENCY) + " FROM sm")
_SURFACE = "(SELECT 0.2126*r + 0.7152*g + 0.0722*b FROM (SELECT " + ", ".join(f"{_lin(i)} AS {n}" for i, n in ((2, "r"), (4, "g"), (6, "b"))) + f" FROM (SELECT '{colour.SURFACE['light']}' AS colour)))"
_CHECK = "pl AS (SELECT unnest(range(1, 9)) AS pos, unnest([" + ", ".join(f"'{c}'" for c in PALETTE) + f"]) AS colour), pr AS (SELECT pos, {_lin(2)} AS r, {_lin(4)} AS g, {_lin(6)} AS b FROM pl), pv AS (SELECT pos, 0.2126*r + 0.7152*g + 0.0722*b AS lu, {_SURFACE} AS su, {_lab(None)} AS normal, " + ", ".join(f"{_lab(k)} AS {k}" for k in ("protan", "deutan", "tritan")) + " FROM pr), "
_CHECK += f"p1 AS (SELECT sum(CASE WHEN normal[1] BETWEEN {colour.BAND['light'][0]} AND {colour.BAND['light'][1]} THEN 0 ELSE 1 END) AS band, min(sqrt(pow(normal[2], 2) + pow(normal[3], 2))) AS chroma, min((greatest(lu, su) + 0.05)/(least(lu, su) + 0.05)) AS contrast FROM pv), "
_CHECK += "p2 AS (SELECT min(least(" + ", ".join(_apart(f"a.{k}", f"b.{k}") for k in ("protan", "deutan")) + f")) AS cvd, min({_apart('a.normal', 'b.normal')}) AS normal FROM pv a JOIN pv b ON a.pos < b.pos)"
frame("colour_palette_check", lambda s, d: colour.validate(s.createDataFrame(list(enumerate(PALETTE, 1)), "pos long, colour string"), pairs="all"), _CHECK, " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS ord, '{n}' AS \"check\", CASE WHEN {c} THEN 'pass' {more} END AS status, round(CAST({w} AS DOUBLE), 6) AS worst FROM p1 CROSS JOIN p2" for i, (n, c, more, w) in enumerate((
    ("lightness band", "band = 0", "ELSE 'fail'", "band"), ("chroma floor", f"chroma >= {colour.CHROMA_FLOOR}", "ELSE 'fail'", "chroma"), ("deficiency separation", f"cvd >= {colour.CVD_TARGET}", f"WHEN cvd >= {colour.CVD_FLOOR} THEN 'floor' ELSE 'fail'", "cvd"),
    ("normal separation", f"normal >= {colour.NORMAL_FLOOR}", "ELSE 'fail'", "normal"), ("contrast", f"contrast >= {colour.CONTRAST_MIN}", "ELSE 'relief'", "contrast")), 1)))

# Live trading ---------------------------------------------------------------------------------


def _events(s, d):
    return fixtures.read(s, d, "events").select((F.col("user_id") % 10).cast("string").alias("strategy"), "ts", ((F.col("value") - 50) / 50).alias("r"))


_EV = "ev AS (SELECT CAST(user_id % 10 AS VARCHAR) AS strategy, ts, (value - 50)/50 AS r FROM events)"
frame("live_windowed_metrics", lambda s, d: live.windowed_metrics(_events(s, d), "1 day", "1 day").select("strategy", F.col("start").cast("timestamp_ntz").alias("start"), "n", "expectancy"), _EV, "SELECT strategy, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(r) AS n, round(avg(r), 6) AS expectancy FROM ev GROUP BY 1, 2")
frame("live_interval_breaches", lambda s, d: live.breaches(_events(s, d), _events(s, d).groupBy("strategy").agg(F.percentile("r", 0.1).alias("low"), F.percentile("r", 0.9).alias("high"))).groupBy("strategy").agg(F.count(F.when(F.col("breach"), 1)).alias("breaches"), F.count("*").alias("n")), f"{_EV}, iv AS (SELECT strategy, quantile_cont(r, 0.1) AS low, quantile_cont(r, 0.9) AS high FROM ev GROUP BY 1)", "SELECT ev.strategy, count(*) FILTER (WHERE NOT r BETWEEN low AND high) AS breaches, count(*) AS n FROM ev JOIN iv USING (strategy) GROUP BY 1")
_LIVE = f"{_EV}, le AS (SELECT strategy, r, ts, row_number() OVER (PARTITION BY strategy ORDER BY ts, r) AS k FROM ev), lc AS (SELECT strategy, k, r, product(1+r*0.01) OVER (PARTITION BY strategy ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM le), ld AS (SELECT strategy, r, c/max(c) OVER (PARTITION BY strategy ORDER BY k ROWS UNBOUNDED PRECEDING)-1 AS dd FROM lc)"
frame("live_kill_switch_batch", lambda s, d: execution.kill_switch(_events(s, d).withColumn("ret", F.col("r") * 0.01), -0.2, order=("ts", "r"), by=("strategy",)).select("strategy", "n", "max_drawdown", "trigger"), _LIVE, "SELECT strategy, count(r) AS n, round(min(dd), 6) AS max_drawdown, (min(dd) <= -0.2 OR (count(r) >= 30 AND avg(r*0.01) < 0)) AS trigger FROM ld GROUP BY 1")


def _streamed(s, d):
    """The stateful kill switch, run over the events as a stream into memory: each strategy's last state."""
    import uuid

    name = f"live_{uuid.uuid4().hex}"
    schema = s.read.parquet(f"{d}/events.parquet").schema
    # A stream reads a folder: the table's own, narrowed to its file.
    source = s.readStream.schema(schema).option("pathGlobFilter", "*events*").parquet(d)
    rows = source.select((F.col("user_id") % 10).cast("string").alias("strategy"), "ts", ((F.col("value") - 50) / 50).alias("r"))
    run = live.kill_switch(rows).writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    last = s.table(name).groupBy("strategy").agg(F.max_by(F.struct("n", "expectancy", "max_drawdown", "trigger"), "n").alias("x"))
    return last.select("strategy", "x.*")


# All events come in one micro-batch, so the stream ends where the batch does.
frame("live_kill_switch_stream", _streamed, _LIVE, "SELECT strategy, count(r) AS n, round(avg(r), 6) AS expectancy, round(min(dd), 6) AS max_drawdown, (min(dd) <= -0.2 OR (count(r) >= 30 AND avg(r) < 0)) AS trigger FROM ld GROUP BY 1")
