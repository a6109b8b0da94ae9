"""Return series, drawdowns and survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import PERIODS, clean, gain_over_loss, ratio, tall
from . import ordered, resample
from .trade import average_loser, average_winner

# Aggregate columns over one return a row -----------------------------------------------------


def cagr(ret: Column, periods: int = PERIODS) -> Column:
    """Compounded annual growth; NULL if the capital ends at or under 0."""
    total = F.product(F.lit(1.0) + ret)
    return F.when(total > 0, F.pow(total, F.lit(float(periods)) / F.count(ret)) - 1)


def total_return(ret: Column) -> Column:
    return F.product(F.lit(1.0) + ret) - 1


def volatility(ret: Column, periods: int = PERIODS) -> Column:
    return F.stddev_samp(ret) * F.sqrt(F.lit(float(periods)))


def downside_deviation(ret: Column, target: float = 0.0, periods: int = PERIODS) -> Column:
    """Root mean square of what falls short of the target, over all rows."""
    return F.sqrt(F.avg(F.pow(F.least(ret - F.lit(target), F.lit(0.0)), F.lit(2.0)))) * F.sqrt(F.lit(float(periods)))


def sharpe(ret: Column, rf: float = 0.0, periods: int = PERIODS) -> Column:
    excess = ret - F.lit(rf / periods)
    return ratio(F.avg(excess), F.stddev_samp(excess)) * F.sqrt(F.lit(float(periods)))


def sortino(ret: Column, target: float = 0.0, periods: int = PERIODS) -> Column:
    """The target is a period's in the denominator and a year's in the numerator."""
    return ratio(F.avg(ret) * periods - F.lit(target), downside_deviation(ret, target, periods))


def omega(ret: Column, threshold: float = 0.0) -> Column:
    over = ret - F.lit(threshold)
    return gain_over_loss(F.coalesce(F.sum(F.greatest(over, F.lit(0.0))), F.lit(0.0)), F.coalesce(F.sum(F.greatest(-over, F.lit(0.0))), F.lit(0.0)))


def gain_to_pain(ret: Column) -> Column:
    """Sum over the size of the sum of losses; infinite without losses if the sum is positive."""
    return gain_over_loss(F.sum(ret), F.coalesce(-F.sum(F.when(ret < 0, ret)), F.lit(0.0)))


def sqn(r: Column) -> Column:
    return F.when(F.count(r) >= 2, F.sqrt(F.count(r)) * ratio(F.avg(r), F.stddev_samp(r)))


def value_at_risk(ret: Column, level: float = 0.05) -> Column:
    """The empirical quantile, interpolated linearly."""
    return F.percentile(ret, level)


def kelly_fraction(r: Column) -> Column:
    """(p b - (1 - p)) / b with p the share of wins and b the payoff; NULL unless both sides exist."""
    p, b = F.avg((r > 0).cast("double")), ratio(average_winner(r), F.abs(average_loser(r)))
    return ratio(p * b - (1 - p), b)


# Aggregate columns over drawdown frames (ordered.drawdown) ------------------------------------


def max_drawdown(dd: Column) -> Column:
    return F.min(dd)


def average_drawdown(dd: Column) -> Column:
    """Mean over all periods under water; 0 without any."""
    return F.coalesce(F.avg(F.when(dd < 0, dd)), F.when(F.count(F.lit(1)) > 0, F.lit(0.0)))


def median_drawdown(dd: Column) -> Column:
    return F.coalesce(F.median(F.when(dd < 0, dd)), F.when(F.count(F.lit(1)) > 0, F.lit(0.0)))


def time_under_water(dd: Column) -> Column:
    return F.avg((dd < 0).cast("double"))


def ulcer_index(dd: Column) -> Column:
    return F.sqrt(F.avg(dd * dd))


def calmar(ret: Column, dd: Column, periods: int = PERIODS) -> Column:
    return ratio(cagr(ret, periods), F.abs(F.min(dd)))


#: Managed account ratio: another name.
mar = calmar


def sterling(ret: Column, dd: Column, margin: float = 0.1, periods: int = PERIODS) -> Column:
    return ratio(cagr(ret, periods), F.abs(F.min(dd)) + F.lit(margin))


def recovery_factor(ret: Column, dd: Column) -> Column:
    return ratio(total_return(ret), F.abs(F.min(dd)))


def martin(ret: Column, dd: Column, rf: float = 0.0, periods: int = PERIODS) -> Column:
    return ratio(cagr(ret, periods) - F.lit(rf), ulcer_index(dd))


# Frames ---------------------------------------------------------------------------------------


def drawdown_episodes(frame: DataFrame, ts: str = "ts", by: tuple[str, ...] = (), block: str | None = None) -> DataFrame:
    """One row for each run under water: start, trough (the first least), recovery, depth, and days
    from start to recovery and from trough to recovery. An open run has NULL recovery and days.

    frame has ts and dd. Runs are islands; a run's recovery is the first row after it.
    """
    rows = ordered.islands(frame, F.col("dd") < 0, (ts,), by, block)
    # The row that opens an island (not under water) stands before its run and recovers the one before.
    runs = rows.where("dd < 0").groupBy(*by, "island").agg(F.min(ts).alias("start"), F.min_by(ts, F.struct("dd", F.col(ts))).alias("trough"), F.min("dd").alias("depth"))
    ends = rows.where("dd >= 0").groupBy(*by, (F.col("island") - 1).alias("island")).agg(F.min(ts).alias("recovery"))
    out = runs.join(ends, [*by, "island"], "left").drop("island")
    return out.withColumn("duration_days", F.datediff("recovery", "start")).withColumn("recovery_days", F.datediff("recovery", "trough")).select(*by, "start", "trough", "recovery", "depth", "duration_days", "recovery_days")


def burke(frame: DataFrame, ret: str = "ret", ts: str = "ts", by: tuple[str, ...] = (), block: str | None = None, periods: int = PERIODS) -> DataFrame:
    """Growth over the root of the episodes' squared depths: by..., burke."""
    growth = frame.groupBy(*by).agg(cagr(F.col(ret), periods).alias("__g"))
    depth = drawdown_episodes(frame, ts, by, block).groupBy(*by).agg(F.sqrt(F.sum(F.col("depth") * F.col("depth"))).alias("__d"))
    both = growth.join(depth, list(by), "left") if by else growth.crossJoin(depth)
    return both.select(*by, ratio(F.col("__g"), F.col("__d")).alias("burke"))


def return_on_exposure(returns: DataFrame, exposure: DataFrame, ret: str = "ret", pos: str = "exposure") -> DataFrame:
    """Total return over mean exposure: two inputs, one row each, not aligned."""
    a = returns.agg(total_return(F.col(ret)).alias("__t"))
    b = exposure.agg(F.avg(pos).alias("__e"))
    return a.crossJoin(b).select(ratio(F.col("__t"), F.col("__e")).alias("return_on_exposure"))


def expected_shortfall(df: DataFrame, ret: str = "ret", level: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the returns at or below the quantile: by..., expected_shortfall."""
    if not by:
        limit = ordered.exact_quantiles(df, ret, (level,))[0]
        return df.agg(F.avg(F.when(F.col(ret) <= F.lit(limit), F.col(ret))).alias("expected_shortfall"))
    both = df.join(df.groupBy(*by).agg(value_at_risk(F.col(ret), level).alias("__q")), list(by))
    return both.groupBy(*by).agg(F.avg(F.when(F.col(ret) <= F.col("__q"), F.col(ret))).alias("expected_shortfall"))


def worst_periods(df: DataFrame, units: tuple[str, ...] = ("day", "week", "month", "year"), ts: str = "ts", ret: str = "ret", by: tuple[str, ...] = ()) -> DataFrame:
    """The least compounded return by calendar unit: by..., unit, worst. Empty bins count as 0."""
    out = None
    for unit in units:
        one = ordered.calendar_returns(df, unit, ts, ret, by).groupBy(*by).agg(F.min("ret").alias("worst")).select(*by, F.lit(unit).alias("unit"), "worst")
        out = one if out is None else out.unionByName(one)
    return out


def recovery_profile(frame: DataFrame, edges: tuple[float, ...] = (-0.2, -0.1, -0.05), ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Episodes by depth bucket (0 the deepest): number, closed, mean and longest days to recover."""
    bucket = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        bucket = F.when(F.col("depth") <= e, F.lit(i)).otherwise(bucket)
    return drawdown_episodes(frame, ts, by).groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("episodes"), F.count("recovery").alias("closed"), F.avg("recovery_days").alias("mean_days"), F.max("recovery_days").alias("longest_days"))


def max_streak(df: DataFrame, r: str = "r", order: tuple[str, ...] = ("idx",), by: tuple[str, ...] = (), block: str | None = None, winning: bool = False) -> DataFrame:
    """The longest run of losses (or wins): by..., streak. Zeros end a run."""
    inside = F.col(r) > 0 if winning else F.col(r) < 0
    rows = ordered.islands(df, inside, order, by, block)
    runs = rows.groupBy(*by, "island").agg(F.count(F.when(inside, 1)).alias("__n"))
    return runs.groupBy(*by).agg(F.coalesce(F.max("__n"), F.lit(0)).alias("streak"))


# Simulations ----------------------------------------------------------------------------------


def _paths(base: DataFrame, r: str, fraction: float, n_trades: int | None, n_sim: int, seed: int) -> DataFrame:
    draws = resample.iid(base, n_sim, seed, n_trades).withColumn("__f", F.col(r) * F.lit(fraction))
    return ordered.drawdown(draws, "__f", ("pos",), ("rep",))


def risk_of_ruin(base: DataFrame, r: str = "r", fraction: float = 0.01, ruin: float = 0.5, n_trades: int = 500, n_sim: int = 5000, seed: int = 0) -> DataFrame:
    """Share of resampled paths whose capital ever is at or below ruin. base: resample.indexed."""
    paths = _paths(base, r, fraction, n_trades, n_sim, seed).groupBy("rep").agg(F.min("capital").alias("low"))
    return paths.agg(F.avg((F.col("low") <= ruin).cast("double")).alias("risk_of_ruin"))


def survival(base: DataFrame, r: str = "r", fraction: float = 0.01, ruin: float = 0.5, n_trades: int | None = None, n_ruin: int = 500, n_sim: int = 5000, seed: int = 0) -> DataFrame:
    """mdd_p95 (as monte_carlo_drawdown over n_trades) and risk_of_ruin (over n_ruin trades) of the same
    paths: a draw depends on replicate and place only, so the shorter path begins the longer one."""
    length = n_trades or base.count()
    at = F.col("pos")
    ends = _paths(base, r, fraction, max(length, n_ruin), n_sim, seed).groupBy("rep").agg(F.min(F.when(at < length, F.col("dd"))).alias("mdd"), F.min(F.when(at < n_ruin, F.col("capital"))).alias("low"))
    return ends.agg(F.percentile("mdd", 0.05).alias("mdd_p95"), F.avg((F.col("low") <= ruin).cast("double")).alias("risk_of_ruin"))


def monte_carlo_drawdown(base: DataFrame, r: str = "r", fraction: float = 0.01, n_trades: int | None = None, n_sim: int = 5000, seed: int = 0) -> DataFrame:
    """p50, p95 and p99 (bad) of the resampled paths' maximum drawdown."""
    low = _paths(base, r, fraction, n_trades, n_sim, seed).groupBy("rep").agg(F.min("dd").alias("mdd"))
    return low.agg(F.percentile("mdd", 0.5).alias("p50"), F.percentile("mdd", 0.05).alias("p95"), F.percentile("mdd", 0.01).alias("p99"))


def monte_carlo_streak(base: DataFrame, r: str = "r", n_sim: int = 5000, seed: int = 0) -> DataFrame:
    """The observed longest losing run, and p50, p95, p99 of it in resampled orders."""
    seen = max_streak(base, r).select(F.col("streak").cast("double").alias("observed"))
    runs = max_streak(resample.iid(base, n_sim, seed), r, ("pos",), ("rep",))
    return seen.crossJoin(runs.agg(F.percentile("streak", 0.5).alias("p50"), F.percentile("streak", 0.95).alias("p95"), F.percentile("streak", 0.99).alias("p99")))


def monte_carlo_loss_probability(base: DataFrame, r: str = "r", fraction: float = 0.01, n_trades: int | None = None, n_sim: int = 5000, seed: int = 0) -> DataFrame:
    """Share of resampled paths that end below where they began."""
    ends = resample.iid(base, n_sim, seed, n_trades).groupBy("rep").agg(F.product(F.lit(1.0) + F.col(r) * F.lit(fraction)).alias("end"))
    return ends.agg(F.avg((F.col("end") < 1).cast("double")).alias("loss_probability"))


# Summary --------------------------------------------------------------------------------------

SUMMARY = ("cagr", "volatility", "sharpe", "sortino", "omega", "gain_to_pain", "max_drawdown", "average_drawdown", "time_under_water", "ulcer_index", "calmar", "burke", "recovery_factor", "martin", "value_at_risk", "expected_shortfall")


def summary(df: DataFrame, ret: str = "ret", ts: str = "ts", by: tuple[str, ...] = (), block: str | None = None, periods: int = PERIODS) -> DataFrame:
    """(by..., ord, metric, value): one pass over the drawdown frame, and one each for shortfall and episodes."""
    frame = ordered.drawdown(clean(df, ret), ret, (ts,), by, block)
    r, dd = F.col(ret), F.col("dd")
    one = frame.groupBy(*by).agg(
        cagr(r, periods).alias("cagr"), volatility(r, periods).alias("volatility"), sharpe(r, 0.0, periods).alias("sharpe"), sortino(r, 0.0, periods).alias("sortino"),
        omega(r).alias("omega"), gain_to_pain(r).alias("gain_to_pain"), max_drawdown(dd).alias("max_drawdown"), average_drawdown(dd).alias("average_drawdown"), time_under_water(dd).alias("time_under_water"),
        ulcer_index(dd).alias("ulcer_index"), calmar(r, dd, periods).alias("calmar"), recovery_factor(r, dd).alias("recovery_factor"), martin(r, dd, 0.0, periods).alias("martin"), *([value_at_risk(r).alias("value_at_risk")] if by else []),
    )
    both = one if by else one.withColumn("value_at_risk", F.lit(ordered.exact_quantiles(clean(df, ret), ret, (0.05,))[0]).cast("double"))
    for other in (expected_shortfall(clean(df, ret), ret, by=by), burke(frame, ret, ts, by, block, periods)):
        both = both.join(other, list(by)) if by else both.crossJoin(other)
    return tall(both, list(SUMMARY), by)
