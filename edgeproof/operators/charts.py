"""The data under each figure; drawing is left to whoever has a plotting library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evidence, ordered, resample, risk


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """(bin, lo, hi, n) of equal bins; the largest value lies in the last; empty bins are left out."""
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    x, a, b = F.col(value), F.col("a"), F.col("b")
    width = (b - a) / bins
    bin_ = F.when(b > a, F.least(F.floor((x - a) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    out = df.where(x.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    return out.select("bin", (a + F.col("bin") * width).alias("lo"), (a + (F.col("bin") + 1) * width).alias("hi"), "n")


def equity(df: DataFrame, ret: str = "ret", ts: str = "ts") -> DataFrame:
    """(ts, capital) from base 100."""
    return ordered.capital_curve(df, ret, (ts,), base=100.0).select(ts, "capital")


def drawdown_curve(df: DataFrame, ret: str = "ret", ts: str = "ts") -> DataFrame:
    """(ts, dd, is_worst)."""
    frame = ordered.drawdown(df, ret, (ts,)).select(ts, "dd")
    low = frame.agg(F.min_by(ts, F.struct("dd", F.col(ts))).alias("__w"))
    return frame.crossJoin(F.broadcast(low)).select(ts, "dd", (F.col(ts) == F.col("__w")).alias("is_worst"))


def monte_carlo_band(base: DataFrame, value: str = "r", fraction: float = 0.01, n_sim: int = 400, seed: int = 0) -> DataFrame:
    """(pos, p5, p50, p95) of resampled capital paths."""
    paths = evidence.monte_carlo_equity(base, value, fraction, n_sim, seed)
    return paths.groupBy("pos").agg(F.percentile("equity", 0.05).alias("p5"), F.percentile("equity", 0.5).alias("p50"), F.percentile("equity", 0.95).alias("p95"))


def drawdown_histogram(base: DataFrame, value: str = "r", fraction: float = 0.01, n_sim: int = 3000, bins: int = 50, seed: int = 0) -> DataFrame:
    low = risk._paths(base, value, fraction, None, n_sim, seed).groupBy("rep").agg(F.min("dd").alias("mdd"))
    return histogram(low, "mdd", bins)


def bootstrap_histogram(base: DataFrame, value: str = "r", reps: int = 10_000, bins: int = 60, seed: int = 0) -> DataFrame:
    return histogram(resample.distribution(base, value, "mean", reps, seed), "value", bins)


def surface(df: DataFrame, x: str, y: str, value: str, xs: list) -> DataFrame:
    """A row for each y and a column for each of the given x."""
    return df.groupBy(y).pivot(x, xs).agg(F.first(value))


def lorenz(df: DataFrame, value: str = "r") -> DataFrame:
    """(share_of_winners, share_of_gross) by distinct winning result, the best first."""
    counts = df.where(F.col(value) > 0).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")).withColumn("s", F.col("n") * F.col("v"))
    run = ordered.sums_before(counts, "v", ("n", "s"), descending=True)
    total = counts.agg(F.sum("n").alias("kn"), F.sum("s").alias("sn"))
    return run.crossJoin(F.broadcast(total)).select(((F.col("before_n") + F.col("n")) / F.col("kn")).alias("share_of_winners"), ((F.col("before_s") + F.col("s")) / F.col("sn")).alias("share_of_gross"))
