"""Signals, stability over time, and concentration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import correlation, ratio, share
from . import ordered

# Signals: a NULL flag is no signal -----------------------------------------------------------


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def precision(signal: Column, event: Column) -> Column:
    return F.avg(F.when(_flag(signal), _flag(event).cast("double")))


def recall(signal: Column, event: Column) -> Column:
    return F.avg(F.when(_flag(event), _flag(signal).cast("double")))


def lift(signal: Column, event: Column) -> Column:
    return ratio(precision(signal, event), F.avg(_flag(event).cast("double")))


def coverage(signal: Column) -> Column:
    return share(_flag(signal))


def conditional_forward_return(df: DataFrame, signal: str = "signal", fwd: str = "fwd", by: tuple[str, ...] = ()) -> DataFrame:
    """with_signal, without_signal, overall, difference, n_signal."""
    s, y = _flag(F.col(signal)), F.col(fwd)
    one = df.groupBy(*by).agg(F.avg(F.when(s, y)).alias("with_signal"), F.avg(F.when(~s, y)).alias("without_signal"), F.avg(y).alias("overall"), F.count(F.when(s, 1)).alias("n_signal"))
    return one.withColumn("difference", F.col("with_signal") - F.col("without_signal"))


def information_coefficient(score: Column, fwd: Column) -> Column:
    """Pearson over complete pairs; NULL under 3."""
    return correlation(score, fwd)


def signal_decay(df: DataFrame, score: str = "score", fwd: str = "fwd", horizon: str = "horizon") -> DataFrame:
    """(horizon, ic) of a long table."""
    return df.groupBy(horizon).agg(information_coefficient(F.col(score), F.col(fwd)).alias("ic"))


def average_rank(df: DataFrame, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Add the rank with ties averaged, without sorting the rows in one task: distinct values are
    counted, their counts accumulate in value order, and the ranks are joined back."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranks = ordered.sums_before(counts, "__v", ("__n",), by).select(*by, "__v", (F.col("before___n") + (F.col("__n") + 1) / 2).alias(name))
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by]
    joined = df.alias("a").join(ranks.alias("b"), [*keys, F.col(f"a.{value}") == F.col("b.__v")], "left")
    return joined.select("a.*", F.col(f"b.{name}"))


def rank_ic(df: DataFrame, score: str = "score", fwd: str = "fwd") -> DataFrame:
    """Correlation of average ranks, each taken over its whole column before incomplete pairs go."""
    ranked = average_rank(average_rank(df, score, "__rs"), fwd, "__rf")
    return ranked.agg(correlation(F.col("__rs"), F.col("__rf")).alias("rank_ic"))


def ic_information_ratio(ics: Column) -> Column:
    return ratio(F.avg(ics), F.stddev_samp(ics))


def quantile_buckets(df: DataFrame, score: str = "score", k: int = 5) -> DataFrame:
    """Add bucket 1..k by interpolated quantile edges, right-closed, repeated edges once. The edges of a
    column of any size are k + 1 numbers."""
    edges = dict.fromkeys(ordered.exact_quantiles(df, score, tuple(i / k for i in range(k + 1))))
    x = F.col(score)
    above = sum(((F.lit(e) < x).cast("int") for e in edges if e is not None), F.lit(0))
    return df.withColumn("bucket", F.when(x.isNotNull(), F.greatest(above, F.lit(1))))


def quantile_analysis(df: DataFrame, score: str = "score", fwd: str = "fwd", k: int = 5) -> DataFrame:
    """(bucket, mean, median, sd, n) of complete pairs."""
    y = F.col(fwd)
    pairs = df.where(F.col(score).isNotNull() & y.isNotNull())
    return quantile_buckets(pairs, score, k).groupBy("bucket").agg(F.avg(y).alias("mean"), F.median(y).alias("median"), F.stddev_samp(y).alias("sd"), F.count(y).alias("n"))


def monotonicity(df: DataFrame, score: str = "score", fwd: str = "fwd", k: int = 5) -> DataFrame:
    """Rank correlation of bucket number and bucket mean; NULL under 3 buckets."""
    table = average_rank(average_rank(quantile_analysis(df, score, fwd, k).select(F.col("bucket").cast("double").alias("bucket"), "mean"), "bucket", "__a"), "mean", "__b")
    return table.agg(correlation(F.col("__a"), F.col("__b")).alias("monotonicity"))


def least_squares(df: DataFrame, xs: list[str], y: str) -> list[float]:
    """Intercept and coefficients, from one pass of sums of products; only those reach the driver."""
    names = ["__one", *xs]
    rows = df.withColumn("__one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs), *(F.sum(F.col(n) * F.col(y)).alias(f"h{i}") for i, n in enumerate(names))).first()
    g, h = np.zeros((len(names), len(names))), np.array([float(sums[f"h{i}"] or 0.0) for i in range(len(names))])
    for i, j in pairs:
        g[i, j] = g[j, i] = float(sums[f"g{i}_{j}"] or 0.0)
    return np.linalg.lstsq(g, h, rcond=None)[0].tolist()


def incremental_value(df: DataFrame, new: str, existing: list[str], fwd: str = "fwd") -> DataFrame:
    """ic of the new score with the outcome, and incremental_ic with what existing scores leave of it."""
    rows = df.where(" and ".join(f"{c} is not null" for c in (new, *existing, fwd)))
    b = least_squares(rows, existing, fwd)
    rest = F.col(fwd) - F.lit(b[0]) - sum((F.lit(c) * F.col(x) for c, x in zip(b[1:], existing, strict=True)), F.lit(0.0))
    return rows.agg(correlation(F.col(new), F.col(fwd)).alias("ic"), correlation(F.col(new), rest).alias("incremental_ic"))


# Stability -------------------------------------------------------------------------------------


def regime_performance(df: DataFrame, value: str = "r", regime: str = "regime") -> DataFrame:
    """(regime, mean, median, sd, n, total)."""
    x = F.col(value)
    return df.groupBy(F.col(regime).alias("regime")).agg(F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"), F.sum(x).alias("total"))


def regime_dependency(df: DataFrame, value: str = "r", regime: str = "regime") -> DataFrame:
    """The largest regime total over the sum of totals."""
    return df.groupBy(regime).agg(F.sum(value).alias("s")).agg(ratio(F.max("s"), F.sum("s")).alias("regime_dependency"))


def positive_periods(df: DataFrame, unit: str = "month", ts: str = "ts", ret: str = "ret") -> DataFrame:
    """Share of calendar bins with a gain; empty bins have none."""
    return ordered.calendar_returns(df, unit, ts, ret).agg(F.avg((F.col("ret") > 0).cast("double")).alias("positive_periods"))


#: Metrics of a sliding frame by name: a function of (column, window).
ROLLING = {
    "mean": lambda x, w: F.avg(x).over(w),
    "sum": lambda x, w: F.sum(x).over(w),
    "std": lambda x, w: F.stddev_samp(x).over(w),
    "median": lambda x, w: F.percentile(x, 0.5).over(w),
    "sharpe": lambda x, w: ratio(F.avg(x).over(w), F.stddev_samp(x).over(w)) * math.sqrt(252),
    "profit_factor": lambda x, w: ratio(F.sum(F.when(x > 0, x)).over(w), -F.sum(F.when(x < 0, x)).over(w)),
}


#: Rows of a stretch that a long rolling metric is cut into.
STRETCH = 100_000


def rolling_metric(df: DataFrame, value: str = "ret", window: int = 252, metric: str = "mean", order: tuple[str, ...] = ("ts",), by: tuple[str, ...] = (), block: str | None = None) -> DataFrame:
    """Add rolling: the metric of the last `window` rows, NULL until there are so many.

    With a block (a column that rises with the order) a single series is cut into stretches of rows, each
    led in by the window - 1 rows before it, so no task sorts the whole series.
    """
    if block:
        size = max(STRETCH, window)
        rows = ordered.with_position(df, order, by, block).withColumn("__s", F.floor(F.col("idx") / size)).withColumn("__own", F.lit(True))
        lead = rows.where(F.pmod("idx", F.lit(size)) > size - window).withColumn("__s", F.col("__s") + 1).withColumn("__own", F.lit(False))
        frame = Window.partitionBy(*by, "__s").orderBy("idx").rowsBetween(-(window - 1), 0)
        out = rows.unionByName(lead).withColumn("rolling", F.when(F.col("idx") >= window - 1, ROLLING[metric](F.col(value), frame)))
        return out.where("__own").select(*df.columns, "rolling")
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    frame = w.rowsBetween(-(window - 1), 0)
    return df.withColumn("rolling", F.when(F.row_number().over(w) >= window, ROLLING[metric](F.col(value), frame)))


def rolling_stability(df: DataFrame, value: str = "ret", window: int = 252, metric: str = "mean", order: tuple[str, ...] = ("ts",), by: tuple[str, ...] = ()) -> DataFrame:
    x = F.col("rolling")
    return rolling_metric(df, value, window, metric, order, by).where(x.isNotNull()).groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.avg((x > 0).cast("double")).alias("positive"), F.min(x).alias("min"), F.max(x).alias("max"))


def edge_decay(df: DataFrame, value: str = "r") -> DataFrame:
    """slope of value on idx and its t with n - 2 degrees of freedom; no row under 10."""
    x, y = F.col("idx").cast("double"), F.col(value)
    one = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.count(y).alias("n")).where("n >= 10")
    se = F.sqrt(F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx"))
    return one.select("slope", ratio(F.col("slope"), se).alias("t"), "n")


# Concentration ---------------------------------------------------------------------------------


def _best(df: DataFrame, value: str, k: int, descending: bool = True) -> DataFrame:
    """The k largest (or smallest) values: a top-k, kept sorted in every task, k rows each."""
    return df.select(F.col(value).alias("v")).orderBy(F.col("v").desc() if descending else F.col("v").asc()).limit(k)


def pnl_concentration(df: DataFrame, value: str = "r", tops: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """(top, of_gross, of_net): what the best ceil(n x top) trades are of gross profit, and of the net if
    that is positive. No rows without gross profit.

    The threshold value comes from counts of distinct values, so the table is never sorted whole.
    """
    x = F.col(value)
    counts = df.groupBy(value).agg(F.count("*").alias("c"))
    total = df.agg(F.count(value).alias("n"), F.sum(F.when(x > 0, x)).alias("gross"), F.sum(value).alias("net")).where("gross > 0")
    run = ordered.sums_before(counts, value, ("c",), descending=True).withColumnRenamed("before_c", "before")
    grid = total.withColumn("top", F.explode(F.array(*map(F.lit, tops)))).withColumn("k", F.ceil(F.col("n") * F.col("top")))
    taken = F.greatest(F.lit(0), F.least(F.col("c"), F.col("k") - F.col("before")))
    return run.crossJoin(F.broadcast(grid)).groupBy("top").agg(ratio(F.sum(taken * F.col(value)), F.first("gross")).alias("of_gross"), F.when(F.first("net") > 0, ratio(F.sum(taken * F.col(value)), F.first("net"))).alias("of_net"))


def without_best(df: DataFrame, value: str = "r", n: int = 5) -> DataFrame:
    """Mean without the n best; NULL if none are left; n = 0 leaves an empty set, hence NULL."""
    return _without(df, value, n, True)


def without_worst(df: DataFrame, value: str = "r", n: int = 5) -> DataFrame:
    """Mean without the n worst; NULL if none are left."""
    return _without(df, value, n, False)


def _without(df: DataFrame, value: str, n: int, best: bool) -> DataFrame:
    whole = df.agg(F.sum(value).alias("s"), F.count(value).alias("k"))
    cut = _best(df, value, n, best).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("x"))
    left = F.col("k") > n
    if best and n == 0:
        left = F.lit(False)
    return whole.crossJoin(cut).select(F.when(left, ratio(F.col("s") - F.col("x"), F.col("k") - n)).alias("expectancy"))


def hhi(df: DataFrame, value: str = "r", group: str | None = None) -> DataFrame:
    """Sum of squared shares, of positive trades or of positive group sums; NULL with none."""
    parts = df.groupBy(group).agg(F.sum(value).alias("x")) if group else df.select(F.col(value).alias("x"))
    return parts.where("x > 0").agg(ratio(F.sum(F.col("x") * F.col("x")), F.pow(F.sum("x"), F.lit(2.0))).alias("hhi"))


def breadth(df: DataFrame, value: str = "r", group: str | None = None) -> DataFrame:
    """1 / hhi: the number of equal parts that would be as concentrated."""
    return hhi(df, value, group).select(ratio(F.lit(1.0), F.col("hhi")).alias("breadth"))
