"""Conventions that every operator shares.

NULL means undefined, Infinity stays infinite and NaN never leaves an operator. Inputs lose NULL
and NaN rows first; divisions by zero give NULL unless a metric says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trading periods in a year.
PERIODS = 252
INF = float("inf")


def clean(df: DataFrame, *columns: str) -> DataFrame:
    """Cast to double and drop rows where any of the columns is NULL or NaN (pairwise complete)."""
    out = df.withColumns({c: F.col(c).cast("double") for c in columns})
    for c in columns:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c))
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def gain_over_loss(gain: Column, loss: Column) -> Column:
    """gain / loss; infinite with a gain and no loss, NULL with neither."""
    return F.when(loss > 0, gain / loss).when(gain > 0, F.lit(INF))


def mean_where(x: Column, cond: Column) -> Column:
    return F.avg(F.when(cond, x))


def share(cond: Column) -> Column:
    """Share of rows where cond holds."""
    return F.avg(cond.cast("double"))


def correlation(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson over rows where both are known; NULL under `least` pairs or without variance."""
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x), F.when(ok, y)
    r = ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a) >= least, r)


def tall(df: DataFrame, metrics: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row a metric: (by..., ord, metric, value), from one row a group."""
    cells = F.array(*(F.struct(F.lit(i + 1).alias("ord"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for i, m in enumerate(metrics)))
    return df.select(*by, F.explode(cells).alias("x")).select(*by, "x.*")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function to about 1e-12, in built-in expressions.

    Near 0, by the series of odd powers over double factorials; in the tails, by a continued
    fraction for the complement.
    """
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    near = F.lit(0.5) + density * F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(x.alias("t"), x.alias("s")), lambda acc, k: F.struct((acc["t"] * x * x / (2 * k + 1)).alias("t"), (acc["s"] + acc["t"] * x * x / (2 * k + 1)).alias("s")), lambda acc: acc["s"])
    frac = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / acc)
    upper = F.when(x < 4, F.lit(1.0) - near).otherwise(density / frac)
    return F.when(z.isNull(), None).when(z < 0, upper).otherwise(F.lit(1.0) - upper)


def normal_quantile(p: Column) -> Column:
    """Inverse of normal_cdf for 0 < p < 1, by halving an interval; NULL outside."""
    halves = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(-12.0).alias("lo"), F.lit(12.0).alias("hi")),
        lambda acc, _: F.when(normal_cdf((acc["lo"] + acc["hi"]) / 2) < p, F.struct(((acc["lo"] + acc["hi"]) / 2).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), ((acc["lo"] + acc["hi"]) / 2).alias("hi"))),
        lambda acc: (acc["lo"] + acc["hi"]) / 2,
    )
    return F.when((p > 0) & (p < 1), halves)
