"""Statistical evidence: intervals, dependence, and Sharpe ratios after many trials."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import INF, clean, correlation, normal_cdf, normal_quantile, ratio, tall
from . import ordered, resample

EULER = 0.5772156649


def t_stat(r: Column) -> Column:
    return F.when(F.count(r) >= 2, ratio(F.avg(r) * F.sqrt(F.count(r)), F.stddev_samp(r)))


def bootstrap_ci(base: DataFrame, value: str = "r", statistic="mean", level: float = 0.95, reps: int = 10_000, seed: int = 0) -> DataFrame:
    """low, high: the percentile interval of resampled statistics."""
    dist = resample.distribution(base, value, statistic, reps, seed)
    a = (1 - level) / 2
    return dist.agg(F.percentile("value", a).alias("low"), F.percentile("value", 1 - a).alias("high"))


def probability_positive(base: DataFrame, value: str = "r", reps: int = 10_000, seed: int = 0) -> DataFrame:
    """Share of resampled means above 0."""
    return resample.distribution(base, value, "mean", reps, seed).agg(F.avg((F.col("value") > 0).cast("double")).alias("probability"))


def bootstrap_se(base: DataFrame, value: str = "r", statistic="mean", reps: int = 10_000, seed: int = 0) -> DataFrame:
    return resample.distribution(base, value, statistic, reps, seed).agg(F.stddev_samp("value").alias("se"))


def _spread(sr: Column, skew: Column, kurt: Column) -> Column:
    return F.lit(1.0) - skew * sr + (kurt - 1) / 4 * sr * sr


def probabilistic_sharpe(sr: Column, n: Column, skew: Column = F.lit, kurt: Column = F.lit, reference: Column | float = 0.0) -> Column:
    """Probability that the true Sharpe ratio exceeds the reference; kurt is not in excess of 3."""
    skew, kurt = F.lit(0.0) if skew is F.lit else skew, F.lit(3.0) if kurt is F.lit else kurt
    ref = reference if isinstance(reference, Column) else F.lit(float(reference))
    v = _spread(sr, skew, kurt)
    return F.when((n >= 2) & (v > 0), normal_cdf((sr - ref) * F.sqrt(n - 1) / F.sqrt(v)))


def min_track_record_length(sr: Column, skew: Column, kurt: Column, reference: float = 0.0, confidence: float = 0.95) -> Column:
    """Rows needed to be that confident; infinite if the ratio isn't above the reference."""
    z = NormalDist().inv_cdf(confidence)
    gap = sr - F.lit(float(reference))
    return F.when(gap > 0, F.lit(1.0) + _spread(sr, skew, kurt) * F.pow(F.lit(z) / gap, F.lit(2.0))).when(gap.isNotNull(), F.lit(INF))


def deflated_sharpe(sr: Column, n: Column, trials: Column, variance: Column, skew: Column, kurt: Column) -> Column:
    """Probabilistic Sharpe ratio against the best that so many trials would find by luck."""
    one = F.lit(1.0)
    best = F.sqrt(variance) * ((1 - EULER) * normal_quantile(one - one / trials) + EULER * normal_quantile(one - one / (trials * F.lit(math.e))))
    return F.when((trials >= 2) & (variance > 0), probabilistic_sharpe(sr, n, skew, kurt, best))


def _lagged(df: DataFrame, value: str, order: tuple[str, ...], lags: int, by: tuple[str, ...], demean: bool) -> DataFrame:
    """(by..., lag, x, y): each row with the row lag places before it; a join on places, so a long
    series is spread over tasks. df has idx."""
    keys = [*by, "idx"]
    rows = df.select(*by, F.col("idx"), F.col(value).alias("x"))
    if demean:
        mean = rows.groupBy(*by).agg(F.avg("x").alias("__m"))
        rows = (rows.join(mean, list(by)) if by else rows.crossJoin(F.broadcast(mean))).select(*keys, (F.col("x") - F.col("__m")).alias("x"))
    moved = rows.select(*by, F.col("x").alias("y"), F.explode(F.sequence(F.lit(0 if demean else 1), F.lit(lags))).alias("lag"), "idx").withColumn("idx", F.col("idx") + F.col("lag"))
    return rows.join(moved, keys)


def autocorrelation(df: DataFrame, value: str = "r", lags: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., lag, rho): correlation of the rows with those lag places before, with means of
    their own; NULL under 3 pairs or without variance. df has idx (resample.indexed)."""
    pairs = _lagged(df, value, ("idx",), lags, by, False)
    return pairs.groupBy(*by, "lag").agg(correlation(F.col("x"), F.col("y"), 2).alias("rho"))


def effective_sample_size(df: DataFrame, value: str = "r", lags: int = 10) -> DataFrame:
    """n / (1 + 2 x sum of the positive autocorrelations up to min(lags, n - 2)); NULL under 3."""
    n = df.agg(F.count(value).alias("n"))
    rho = autocorrelation(df, value, lags).crossJoin(F.broadcast(n)).where(F.col("lag") <= F.col("n") - 2)
    total = rho.agg(F.coalesce(F.sum(F.when(F.col("rho") > 0, F.col("rho"))), F.lit(0.0)).alias("s"))
    return n.crossJoin(total).select(F.when(F.col("n") >= 3, F.col("n") / (1 + 2 * F.col("s"))).alias("n_eff"))


def ljung_box(df: DataFrame, value: str = "r", lags: int = 10) -> DataFrame:
    """q and p (by Wilson and Hilferty's normal approximation); NULL under lags + 2 rows."""
    n = df.agg(F.count(value).alias("n"))
    rho = autocorrelation(df, value, lags).crossJoin(F.broadcast(n))
    q = rho.agg(F.max("n").alias("n"), F.sum(F.pow("rho", F.lit(2.0)) / (F.col("n") - F.col("lag"))).alias("s")).select(F.when(F.col("n") >= lags + 2, F.col("n") * (F.col("n") + 2) * F.col("s")).alias("q"))
    k = 2.0 / (9 * lags)
    z = (F.pow(F.col("q") / lags, F.lit(1.0 / 3)) - (1 - k)) / math.sqrt(k)
    return q.select("q", (F.lit(1.0) - normal_cdf(z)).alias("p"))


def newey_west_lags(n: int) -> int:
    return math.floor(4 * (n / 100) ** (2 / 9)) if n else 0


def newey_west_t(df: DataFrame, value: str = "r", lags: int | None = None) -> DataFrame:
    """t of the mean with Bartlett-weighted autocovariances, each a mean over its own overlap."""
    n = df.count()
    k = newey_west_lags(n) if lags is None else lags
    gamma = _lagged(df, value, ("idx",), k, (), True).groupBy("lag").agg(F.avg(F.col("x") * F.col("y")).alias("g"))
    weight = F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(2 * (1 - F.col("lag") / (k + 1)))
    var = gamma.agg(F.sum(weight * F.col("g")).alias("v"))
    mean = df.agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    return mean.crossJoin(var).select(F.when((F.col("n") >= 3) & (F.col("v") > 0), F.col("m") / F.sqrt(F.when(F.col("v") > 0, F.col("v")) / F.col("n"))).alias("t"))


def monte_carlo_equity(base: DataFrame, value: str = "r", fraction: float = 0.01, n_sim: int = 500, seed: int = 0) -> DataFrame:
    """(rep, pos, equity): resampled capital paths, long."""
    draws = resample.iid(base, n_sim, seed).withColumn("__f", F.lit(1.0) + F.col(value) * F.lit(fraction))
    return ordered.running_product(draws, F.col("__f"), "equity", ("pos",), ("rep",)).select("rep", "pos", "equity")


TERMINAL = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def monte_carlo_terminal(base: DataFrame, value: str = "r", fraction: float = 0.01, n_sim: int = 5000, seed: int = 0) -> DataFrame:
    """(q, equity): quantiles of where the paths end."""
    ends = resample.iid(base, n_sim, seed).groupBy("rep").agg(F.product(F.lit(1.0) + F.col(value) * F.lit(fraction)).alias("e"))
    one = ends.agg(F.percentile("e", F.array(*map(F.lit, TERMINAL))).alias("p"))
    return one.select(F.explode(F.arrays_zip(F.array(*map(F.lit, TERMINAL)).alias("q"), F.col("p").alias("equity"))).alias("x")).select(F.col("x.q").alias("q"), F.col("x.equity").alias("equity"))


def bootstrap_sensitivity(base: DataFrame, value: str = "r", reps: int = 500, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(method, low, high): the mean's interval by each way of resampling."""
    out, a = None, (1 - level) / 2
    for m in resample.METHODS:
        one = resample.distribution(base, value, "mean", reps, seed, m).agg(F.percentile("value", a).alias("low"), F.percentile("value", 1 - a).alias("high")).select(F.lit(m).alias("method"), "low", "high")
        out = one if out is None else out.unionByName(one)
    return out


SUMMARY = ("t", "newey_west_t", "ci_low", "ci_high", "p_positive", "n", "n_eff", "ljung_box_q", "ljung_box_p", "autocorrelation_1")


def summary(df: DataFrame, value: str = "r", order: tuple[str, ...] = ("ts",), reps: int = 5000, seed: int = 0, block: str | None = None) -> DataFrame:
    """(ord, metric, value) of the chapter; the bootstrap rows share one distribution."""
    base = resample.indexed(clean(df, value), order, block)
    dist = resample.distribution(base, value, "mean", reps, seed)
    boot = dist.agg(F.percentile("value", 0.025).alias("ci_low"), F.percentile("value", 0.975).alias("ci_high"), F.avg((F.col("value") > 0).cast("double")).alias("p_positive"))
    one = base.agg(F.count(value).alias("n"), t_stat(F.col(value)).alias("t"))
    lb = ljung_box(base, value).select(F.col("q").alias("ljung_box_q"), F.col("p").alias("ljung_box_p"))
    first = autocorrelation(base, value, 1).agg(F.max("rho").alias("autocorrelation_1"))
    nw = newey_west_t(base, value).withColumnRenamed("t", "newey_west_t")
    return tall(one.crossJoin(boot).crossJoin(effective_sample_size(base, value)).crossJoin(lb).crossJoin(nw).crossJoin(first), list(SUMMARY))
