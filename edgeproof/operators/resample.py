"""Resampling: random places from a hash, gathered by a join, reduced a replicate.

A draw depends on (seed, replicate, position) only: not on partitions, retries or row order, and
any SQL engine with md5 draws the same. Replicates are spread over tasks; the base series is joined
by position, and Spark broadcasts it only while its size allows that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def hashed(*parts: Column) -> Column:
    """32 hashed bits as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def indexed(df: DataFrame, order: tuple[str, ...], block: str | None = None) -> DataFrame:
    """Give every row its place idx in the order: what all resampling draws from."""
    return ordered.with_position(df, order, (), block)


def grid(spark, reps: int, positions: int, step: int = 1) -> DataFrame:
    """rep x pos (every step-th): one range of cells, so no row is large and no task has more than a share
    of a replicate, however long the series is."""
    each = math.ceil(positions / step)
    parts = max(1, math.ceil(reps * each / 250_000))
    at = F.col("id")
    return spark.range(0, reps * each, 1, parts).select(F.expr(f"id div {each}").alias("rep"), (F.pmod(at, F.lit(each)) * step).alias("pos"))


def _gather(draws: DataFrame, base: DataFrame) -> DataFrame:
    return draws.join(base, "idx")


def iid(base: DataFrame, reps: int, seed: int = 0, length: int | None = None) -> DataFrame:
    """(rep, pos, base columns): places drawn evenly, with replacement."""
    n = base.count()
    if not n:
        return base.select(F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("pos"), "*").limit(0)
    draws = grid(base.sparkSession, reps, length or n).withColumn("idx", hashed(F.lit(seed), F.col("rep"), F.col("pos")) % n)
    return _gather(draws, base)


def moving_blocks(base: DataFrame, reps: int, seed: int = 0, block: int = 20) -> DataFrame:
    """Blocks of neighbours; starts lie in [0, n - block), so the last block is never drawn. Falls
    back to single draws under two blocks' length."""
    n = base.count()
    if n < 2 * block:
        return iid(base, reps, seed)
    # A cell a place, each with its block's start: Spark does not see rows that an explode would add, and sends
    # them all to the driver as a small table.
    cells = grid(base.sparkSession, reps, n)
    start = hashed(F.lit(seed), F.col("rep"), F.expr(f"pos div {block}")) % (n - block)
    draws = cells.withColumn("idx", start + F.col("pos") % block)
    return _gather(draws, base)


def stationary(base: DataFrame, reps: int, seed: int = 0, mean_block: int = 20) -> DataFrame:
    """Blocks of geometric length around a circle: at each place a jump with probability 1 / mean,
    else the next row. Falls back to single draws under 4 rows."""
    n = base.count()
    if n < 4:
        return iid(base, reps, seed)
    cells = grid(base.sparkSession, reps, n)
    jump = (F.col("pos") == 0) | (hashed(F.lit(f"{seed}j"), F.col("rep"), F.col("pos")) < int(2**32 / mean_block))
    cells = cells.withColumn("__at", F.when(jump, F.struct(F.col("pos").alias("p"), (hashed(F.lit(seed), F.col("rep"), F.col("pos")) % n).alias("s"))))
    last = F.last("__at", ignorenulls=True).over(Window.partitionBy("rep").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    draws = cells.withColumn("__l", last).select("rep", "pos", ((F.col("__l.s") + F.col("pos") - F.col("__l.p")) % n).alias("idx"))
    return _gather(draws, base)


METHODS = {"iid": iid, "moving_block": moving_blocks, "stationary": stationary}

#: Statistics by name: an aggregate of one column.
STATISTICS = {"mean": F.avg, "median": F.median, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max, "sharpe": lambda x: F.try_divide(F.avg(x), F.stddev_samp(x))}


def distribution(base: DataFrame, value: str = "r", statistic="mean", reps: int = 5000, seed: int = 0, method: str = "iid", **options) -> DataFrame:
    """(rep, value): the statistic (a name or a function of a column) in each replicate."""
    f = STATISTICS[statistic] if isinstance(statistic, str) else statistic
    return METHODS[method](base, reps, seed, **options).groupBy("rep").agg(f(F.col(value)).alias("value"))
