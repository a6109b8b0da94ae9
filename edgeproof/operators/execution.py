"""Costs, execution, capacity, integrity, live trading, and relation to a market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import INF, correlation, ratio, share
from . import ordered

#: The integrity audits, in order, each with the question that it answers.
AUDITS = {
    "lookahead": "does a decision use what was not yet known when its order was sent?", "repainting": "does a past value of an indicator change once later bars arrive?",
    "same_bar": "where stop and target lie in one bar, which was reached first?", "intrabar": "does the result change over other plausible paths within the bars?",
    "timestamp": "do clocks, sessions and time zones match the real market?", "corporate_action": "do adjusted prices or rolls make returns that nobody earned?",
    "survivorship": "does the universe hold the assets that have disappeared since?", "data_snooping": "how many decisions were taken on the same history?",
}


def slippage_sensitivity(df: DataFrame, value: str = "r", costs: tuple[float, ...] = (0.0, 0.05, 0.1, 0.2, 0.4), by: tuple[str, ...] = ()) -> DataFrame:
    """(cost, expectancy): the mean less each cost, from one mean. Fees, spreads and funding are
    costs like any."""
    mean = df.groupBy(*by).agg(F.avg(value).alias("__m"))
    return mean.select(*by, "__m", F.explode(F.array(*map(F.lit, costs))).alias("cost")).select(*by, "cost", (F.col("__m") - F.col("cost")).alias("expectancy"))


def break_even_cost(r: Column) -> Column:
    """The cost a trade that leaves nothing: the mean."""
    return F.avg(r)


def cost_safety_margin(r: Column, expected: float) -> Column:
    return F.lit(INF) if expected == 0 else F.avg(r) / F.lit(expected)


def turnover(volume: Column, average_equity: float) -> Column:
    return ratio(F.sum(volume), F.lit(float(average_equity)))


def exposure(position: Column) -> Column:
    return share(F.abs(position) > 0)


def capital_utilization(df: DataFrame, allocated: str, total: str) -> DataFrame:
    """mean, p95 and max of allocated over total."""
    u = ratio(F.col(allocated), F.col(total))
    return df.agg(F.avg(u).alias("mean"), F.percentile(u, 0.95).alias("p95"), F.max(u).alias("max"))


def trades_per_year(entry: Column) -> Column:
    """Rows over the years between the first and the last entry; NULL if that is 0."""
    return ratio(F.count(entry).cast("double"), F.datediff(F.max(entry), F.min(entry)) / F.lit(365.25))


def holding_period(df: DataFrame, entry: str = "entry", exit_: str = "exit", by: tuple[str, ...] = ()) -> DataFrame:
    """mean, median, p95 and max days held."""
    d = F.datediff(exit_, entry)
    return df.groupBy(*by).agg(F.avg(d).alias("mean"), F.median(d).alias("median"), F.percentile(d, 0.95).alias("p95"), F.max(d).alias("max"))


def winner_loser_holding(df: DataFrame, r: str = "r", entry: str = "entry", exit_: str = "exit", by: tuple[str, ...] = ()) -> DataFrame:
    d = F.datediff(exit_, entry)
    return df.groupBy(*by).agg(F.avg(F.when(F.col(r) > 0, d)).alias("winners"), F.avg(F.when(F.col(r) < 0, d)).alias("losers"))


def mae_mfe(df: DataFrame, mae: str = "mae", mfe: str = "mfe", r: str = "r") -> DataFrame:
    """(mae, mfe, r, outcome): a result of 0 is a loser."""
    return df.select(F.col(mae).alias("mae"), F.col(mfe).alias("mfe"), F.col(r).alias("r"), F.when(F.col(r) > 0, F.lit("winner")).otherwise(F.lit("loser")).alias("outcome"))


def mfe_capture(r: Column, mfe: Column) -> Column:
    """Mean of result over best excursion, of winners."""
    return F.avg(F.when((r > 0) & (mfe > 0), ratio(r, mfe)))


def mae_efficiency(df: DataFrame, mae: str = "mae", r: str = "r", stop: float = 1.0) -> DataFrame:
    """mean and p95 adverse excursion of winners, the stop, and the room it leaves."""
    x = F.when(F.col(r) > 0, F.abs(F.col(mae)))
    return df.agg(F.avg(x).alias("mean"), F.percentile(x, 0.95).alias("p95"), F.lit(stop).alias("stop")).withColumn("slack", F.col("stop") - F.col("p95"))


def fill_probability(sent: Column, filled: Column) -> Column:
    return ratio(filled.cast("double"), sent.cast("double"))


def slippage_distribution(x: Column) -> list[Column]:
    """mean, median, p95, p99 and max."""
    return [F.avg(x).alias("mean"), F.median(x).alias("median"), F.percentile(x, 0.95).alias("p95"), F.percentile(x, 0.99).alias("p99"), F.max(x).alias("max")]


def participation_rate(order: Column, market: Column) -> Column:
    return ratio(F.sum(order), F.sum(market))


def capacity(expectancy: Column, impact_per_million: Column) -> Column:
    """Millions until impact takes the expectancy; infinite without impact."""
    return F.when(impact_per_million == 0, F.lit(INF)).otherwise(ratio(expectancy, impact_per_million))


def capacity_adjusted(expectancy: Column, impact_per_million: Column, millions: Column) -> Column:
    """What is left of the expectancy at so much capital."""
    return expectancy - impact_per_million * millions


def cross_market_transfer(df: DataFrame, base: str, market: str = "market", value: str = "value") -> DataFrame:
    """base, others (mean), retention (mean of other over base) and share positive of other markets."""
    ours = df.where(F.col(market) == base).agg(F.max(value).alias("base"))
    others = df.where(F.col(market) != base).crossJoin(F.broadcast(ours))
    out = others.agg(F.avg(value).alias("others"), F.avg(ratio(F.col(value), F.col("base"))).alias("retention"), F.avg((F.col(value) > 0).cast("double")).alias("positive"))
    return ours.crossJoin(out)


def integrity_audit(spark, declared: DataFrame, key: str = "key", passed: str = "passed") -> DataFrame:
    """(ord, audit, question, status, passed): PASS and FAIL as declared, NOT AUDITED if absent or unknown."""
    dim = spark.createDataFrame([(i, a, q) for i, (a, q) in enumerate(AUDITS.items(), 1)], "ord int, audit string, question string")
    known = declared.groupBy(F.col(key).alias("audit")).agg(F.min(F.col(passed).cast("int")).alias("__p"))
    status = F.when(F.col("__p") == 1, F.lit("PASS")).when(F.col("__p") == 0, F.lit("FAIL")).otherwise(F.lit("NOT AUDITED"))
    return dim.join(known, "audit", "left").select("ord", "audit", "question", status.alias("status"), F.coalesce(F.col("__p") == 1, F.lit(False)).alias("passed"))


def live_gap(live: Column, backtest: Column, low: Column, high: Column) -> list[Column]:
    """gap and whether live lies inside the backtest's interval."""
    return [(live - backtest).alias("gap"), live.between(low, high).alias("inside")]


def breach_rate(live: DataFrame, intervals: DataFrame, on: tuple[str, ...] = ("strategy",), value: str = "value") -> DataFrame:
    """Share of live values outside their strategy's interval (low, high)."""
    x = F.col(value)
    return live.join(intervals, list(on)).groupBy(*on).agg(F.avg((~x.between(F.col("low"), F.col("high"))).cast("double")).alias("breach_rate"), F.count(x).alias("n"))


def live_slippage_gap(live: DataFrame, backtest: DataFrame, value: str = "slippage") -> DataFrame:
    """Difference of mean slippage."""
    return live.agg(F.avg(value).alias("a")).crossJoin(backtest.agg(F.avg(value).alias("b"))).select((F.col("a") - F.col("b")).alias("gap"))


def kill_switch(df: DataFrame, mdd_limit: float, ret: str = "ret", order: tuple[str, ...] = ("ts",), by: tuple[str, ...] = (), block: str | None = None, least: int = 30, expectancy_limit: float = 0.0) -> DataFrame:
    """n, enough, max_drawdown, expectancy and trigger: a drawdown at the limit, or enough trades with a
    mean below the limit."""
    frame = ordered.drawdown(df, ret, order, by, block)
    out = frame.groupBy(*by).agg(F.count(ret).alias("n"), F.min("dd").alias("max_drawdown"), F.avg(ret).alias("expectancy")).withColumn("enough", F.col("n") >= least)
    hit = (F.col("max_drawdown") <= F.lit(mdd_limit)) | (F.col("enough") & (F.col("expectancy") < F.lit(expectancy_limit)))
    return out.withColumn("trigger", F.coalesce(hit, F.lit(False)))


def gross_vs_net(df: DataFrame, gross: str = "gross", cost: str = "cost") -> DataFrame:
    """gross, net, cost (means) and consumed, over rows where both are known."""
    ok = df.where(F.col(gross).isNotNull() & F.col(cost).isNotNull())
    one = ok.agg(F.avg(gross).alias("gross"), F.avg(F.col(gross) - F.col(cost)).alias("net"), F.avg(cost).alias("cost"))
    return one.withColumn("consumed", ratio(F.col("cost"), F.col("gross")))


def beta_alpha(df: DataFrame, y: str = "ret", x: str = "bench") -> DataFrame:
    """alpha, t_alpha, beta, t_beta, r2 and n of y on x with intercept; no row under 3 pairs. df is
    the two series joined on their dates."""
    a, b = F.col(y), F.col(x)
    one = df.agg(F.regr_slope(a, b).alias("beta"), F.regr_intercept(a, b).alias("alpha"), F.regr_r2(a, b).alias("r2"), F.regr_sxx(a, b).alias("sxx"), F.regr_syy(a, b).alias("syy"), F.regr_sxy(a, b).alias("sxy"), F.sum(F.when(a.isNotNull(), b * b)).alias("x2"), F.regr_count(a, b).alias("n")).where("n >= 3")
    s2 = F.greatest(F.col("syy") - ratio(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0)) / (F.col("n") - 2)
    se_b = F.sqrt(ratio(s2, F.col("sxx")))
    return one.select("alpha", ratio(F.col("alpha"), se_b * F.sqrt(F.col("x2") / F.col("n"))).alias("t_alpha"), "beta", ratio(F.col("beta"), se_b).alias("t_beta"), "r2", "n")


def strategy_correlation(df: DataFrame, key: str = "strategy", ts: str = "ts", ret: str = "ret") -> DataFrame:
    """(a, b, correlation, n) of strategies a <= b over the dates both have."""
    left = df.select(F.col(key).alias("a"), F.col(ts).alias("__t"), F.col(ret).alias("x"))
    right = df.select(F.col(key).alias("b"), F.col(ts).alias("__t"), F.col(ret).alias("y"))
    return left.join(right, "__t").where("a <= b").groupBy("a", "b").agg(correlation(F.col("x"), F.col("y"), 2).alias("correlation"), F.count("x").alias("n"))


def drawdown_overlap(a: DataFrame, b: DataFrame, limit: float = -0.05, ts: str = "ts") -> DataFrame:
    """Share of dates, of those both have, with both drawdowns at or below the limit."""
    both = a.select(ts, F.col("dd").alias("__a")).join(b.select(ts, F.col("dd").alias("__b")), ts)
    return both.agg(F.avg(((F.col("__a") <= limit) & (F.col("__b") <= limit)).cast("double")).alias("overlap"))
