"""Out of sample, walk-forward, overfitting and robustness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import ratio
from . import resample
from .resample import STATISTICS


#: Blocks of a cross-validation: their combinations are a table of at most C(20, 10) x 20 rows.
MOST_BLOCKS = 20


def _stat(metric):
    return STATISTICS[metric] if isinstance(metric, str) else metric


def split(df: DataFrame, fraction: float = 0.7) -> DataFrame:
    """Add is_oos: false for the first floor(n x fraction) rows by idx."""
    n = df.agg(F.count("*").alias("__n"))
    return df.crossJoin(F.broadcast(n)).withColumn("is_oos", F.col("idx") >= F.floor(F.col("__n") * F.lit(fraction))).drop("__n")


def oos_ratio(df: DataFrame, value: str = "r", fraction: float = 0.7, metric="mean") -> DataFrame:
    """in_sample, out_of_sample, ratio and degradation (1 - ratio) of a metric over the split."""
    f, x = _stat(metric), F.col(value)
    one = split(df, fraction).agg(f(F.when(~F.col("is_oos"), x)).alias("in_sample"), f(F.when(F.col("is_oos"), x)).alias("out_of_sample"))
    return one.withColumn("ratio", ratio(F.col("out_of_sample"), F.col("in_sample"))).withColumn("degradation", 1 - F.col("ratio"))


def walk_forward(df: DataFrame, value: str = "r", windows: int = 6, metric="mean") -> DataFrame:
    """(window, train, test, n_train, n_test) for windows 1..windows - 1: train is everything before
    the window, of equal windows of floor(n / windows) rows; rows left over are dropped. Fewer than
    10 rows a window is an error."""
    n = df.count()
    if n < 10 * windows:
        raise ValueError(f"{n} rows are too few for {windows} windows")
    size, f = n // windows, _stat(metric)
    rows = df.select(F.floor(F.col("idx") / size).cast("int").alias("bucket"), F.col(value).alias("x")).where(F.col("bucket") < windows)
    if metric == "mean":  # sums add up: no row is copied
        cells = rows.groupBy("bucket").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
        before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        out = cells.select(F.col("bucket").alias("window"), (F.sum("s").over(before) / F.sum("n").over(before)).alias("train"), (F.col("s") / F.col("n")).alias("test"), F.sum("n").over(before).alias("n_train"), F.col("n").alias("n_test"))
        return out.where("window >= 1")
    copies = rows.withColumn("window", F.explode(F.sequence(F.col("bucket"), F.lit(windows - 1)))).where("window >= 1")
    own = F.col("bucket") == F.col("window")
    return copies.groupBy("window").agg(f(F.when(~own, F.col("x"))).alias("train"), f(F.when(own, F.col("x"))).alias("test"), F.count(F.when(~own, 1)).alias("n_train"), F.count(F.when(own, 1)).alias("n_test"))


def walk_forward_efficiency(df: DataFrame, value: str = "r", windows: int = 6, metric="mean") -> DataFrame:
    """efficiency: mean test over mean train; positive: share of windows with test above 0."""
    return walk_forward(df, value, windows, metric).agg(ratio(F.avg("test"), F.avg("train")).alias("efficiency"), F.avg((F.col("test") > 0).cast("double")).alias("positive"))


def pbo_cscv(matrix: DataFrame, blocks: int = 10, t: str = "t", config: str = "config", value: str = "ret") -> DataFrame:
    """pbo, mean_logit, splits: combinatorially symmetric cross-validation.

    matrix is long: one row a period (t = 0..T-1) and configuration. Blocks have floor(T / blocks)
    periods, the first T mod blocks one more. Of each way to choose half the blocks, the champion is the
    first configuration with the best mean there; its rank among means of the other half is put on
    a logit scale. With fewer than two configurations pbo and mean_logit are NULL. An odd number of
    blocks, or more than 20, is an error.
    """
    if blocks % 2:
        raise ValueError("blocks must be even")
    if blocks > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks are too many combinations")
    spark = matrix.sparkSession
    periods = matrix.agg((F.max(t) + 1).alias("n")).first()["n"] or 0
    size, extra = divmod(periods, blocks)
    cut = extra * (size + 1)
    block = F.when(F.col(t) < cut, F.floor(F.col(t) / (size + 1))).otherwise(extra + F.floor((F.col(t) - cut) / max(size, 1))).cast("int")
    cells = matrix.groupBy(block.alias("block"), F.col(config).alias("config")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    # A combination is a number whose bits are the blocks chosen: at most C(20, 10) x 20 rows.
    chosen = spark.range(1 << blocks).where(F.bit_count("id") == blocks // 2)
    sides = chosen.select(F.col("id").alias("combo"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).withColumn("inside", F.expr("shiftright(combo, block) & 1") == 1)
    inside = F.col("inside")
    means = cells.join(F.broadcast(sides), "block").groupBy("combo", "config").agg(
        ratio(F.sum(F.when(inside, F.col("s"))), F.sum(F.when(inside, F.col("n")))).alias("is_mean"), ratio(F.sum(F.when(~inside, F.col("s"))), F.sum(F.when(~inside, F.col("n")))).alias("oos_mean"),
    )
    best = means.groupBy("combo").agg(F.max_by("oos_mean", F.struct("is_mean", -F.col("config"))).alias("champion"), F.count("*").alias("configs"))
    rank = means.join(best, "combo").groupBy("combo").agg((F.count(F.when(F.col("oos_mean") <= F.col("champion"), 1)) / (F.first("configs") + 1)).alias("w"), F.first("configs").alias("configs"))
    logit = rank.withColumn("w", F.least(F.greatest("w", F.lit(1e-6)), F.lit(1 - 1e-6))).withColumn("logit", F.log(F.col("w") / (1 - F.col("w"))))
    out = logit.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.avg("logit").alias("mean_logit"), F.count("*").alias("splits"), F.max("configs").alias("__c"))
    enough = F.col("__c") >= 2  # one configuration is not a choice
    return out.select(F.when(enough, F.col("pbo")).alias("pbo"), F.when(enough, F.col("mean_logit")).alias("mean_logit"), "splits")


def _row_draws(matrix: DataFrame, periods: int, reps: int, seed: int, t: str) -> DataFrame:
    """How often each replicate draws each period: (rep, t, k). Rows of the matrix are drawn whole,
    so the join carries counts, not copies."""
    draws = resample.grid(matrix.sparkSession, reps, periods).select("rep", (resample.hashed(F.lit(seed), F.col("rep"), F.col("pos")) % periods).alias(t))
    return draws.groupBy("rep", t).agg(F.count("*").alias("k"))


def reality_check(matrix: DataFrame, reps: int = 2000, seed: int = 0, t: str = "t", config: str = "config", value: str = "ret") -> DataFrame:
    """statistic and p of the best mean among configurations, against resampled rows, centred."""
    periods = matrix.agg((F.max(t) + 1).alias("n")).first()["n"] or 0
    means = matrix.groupBy(config).agg((F.sum(value) / periods).alias("__m"))
    seen = means.agg((F.sqrt(F.lit(float(periods))) * F.max("__m")).alias("statistic"))
    boot = _row_draws(matrix, periods, reps, seed, t).join(matrix, t).groupBy("rep", config).agg((F.sum(F.col("k") * F.col(value)) / periods).alias("__b"))
    null = boot.join(means, config).groupBy("rep").agg((F.sqrt(F.lit(float(periods))) * F.max(F.col("__b") - F.col("__m"))).alias("v"))
    return null.crossJoin(F.broadcast(seen)).agg(F.first("statistic").alias("statistic"), F.avg((F.col("v") >= F.col("statistic")).cast("double")).alias("p"))


def hansen_spa(matrix: DataFrame, reps: int = 2000, seed: int = 0, t: str = "t", config: str = "config", value: str = "ret") -> DataFrame:
    """statistic and p of superior predictive ability: means over their deviations, the null centred
    at the mean unless it is far below 0; configurations without variance are left out."""
    periods = matrix.agg((F.max(t) + 1).alias("n")).first()["n"] or 0
    root = math.sqrt(periods) if periods else 1.0
    limit = -math.sqrt(2 * math.log(math.log(max(periods, 3))))
    m = F.sum(value) / periods
    stats = matrix.groupBy(config).agg(m.alias("__m"), F.sqrt(F.greatest((F.sum(F.col(value) * F.col(value)) - periods * m * m) / max(1, periods - 1), F.lit(0.0))).alias("__sd")).where("__sd > 0")
    stats = stats.withColumn("__g", F.when(F.col("__m") >= F.lit(limit) * F.col("__sd") / root, F.col("__m")).otherwise(F.lit(0.0)))
    seen = stats.agg(F.greatest(F.max(F.lit(root) * F.col("__m") / F.col("__sd")), F.lit(0.0)).alias("statistic"))
    boot = _row_draws(matrix, periods, reps, seed, t).join(matrix, t).groupBy("rep", config).agg((F.sum(F.col("k") * F.col(value)) / periods).alias("__b"))
    null = boot.join(stats, config).groupBy("rep").agg(F.greatest(F.max(F.lit(root) * (F.col("__b") - F.col("__g")) / F.col("__sd")), F.lit(0.0)).alias("v"))
    return null.crossJoin(F.broadcast(seen)).agg(F.first("statistic").alias("statistic"), F.avg((F.col("v") >= F.col("statistic")).cast("double")).alias("p"))


def research_trials(registry: DataFrame, family: str = "family") -> DataFrame:
    """(family, trials): all trials (family NULL, total true) and by family, an unnamed one being
    'undeclared'."""
    named = registry.select(F.coalesce(F.col(family), F.lit("undeclared")).alias("family"))
    return named.rollup("family").agg(F.count("*").alias("trials"), F.grouping("family").cast("boolean").alias("total"))


def parameter_stability(df: DataFrame, param: str = "param", value: str = "value") -> DataFrame:
    """best_param (the first best by parameter), best, neighbours (mean of those next to it) and
    their ratio; no row under 3 parameters."""
    w = Window.orderBy(param)  # one row a parameter of one strategy
    rows = df.select(F.col(param).alias("p"), F.col(value).alias("v"), F.lag(value).over(w).alias("a"), F.lead(value).over(w).alias("b"), F.count("*").over(Window.partitionBy()).alias("n"))
    top = rows.where("n >= 3").agg(F.max_by(F.struct("p", "v", "a", "b"), F.struct("v", -F.col("p").cast("double"))).alias("x")).where("x is not null")
    near = (F.coalesce(F.col("x.a"), F.lit(0.0)) + F.coalesce(F.col("x.b"), F.lit(0.0))) / (F.col("x.a").isNotNull().cast("int") + F.col("x.b").isNotNull().cast("int"))
    return top.select(F.col("x.p").alias("best_param"), F.col("x.v").alias("best"), near.alias("neighbours")).withColumn("ratio", ratio(F.col("neighbours"), F.col("best")))


def plateau_width(df: DataFrame, value: str = "value", tolerance: float = 0.9) -> DataFrame:
    """Share of parameters with at least tolerance x the best; NULL if the best isn't positive."""
    best = df.agg(F.max(value).alias("__b"))
    return df.crossJoin(F.broadcast(best)).agg(F.when(F.max("__b") > 0, F.avg((F.col(value) >= tolerance * F.col("__b")).cast("double"))).alias("plateau_width"))


def neighbourhood_robustness(value: Column) -> Column:
    """Best over mean."""
    return ratio(F.max(value), F.avg(value))


def parameter_drift(df: DataFrame, value: str = "value") -> DataFrame:
    """mean, sd, cv, min and max of the best parameter by window."""
    x = F.col(value).cast("double")
    return df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), ratio(F.stddev_samp(x), F.abs(F.avg(x))).alias("cv"), F.min(x).alias("min"), F.max(x).alias("max"))


def lag_robustness(df: DataFrame, lag: str = "lag", value: str = "value") -> DataFrame:
    """first, second (by lag), retention (second over first) and share positive."""
    rows = df.withColumn("__k", F.row_number().over(Window.orderBy(lag)))  # one row a lag
    return rows.agg(F.max(F.when(F.col("__k") == 1, F.col(value))).alias("first"), F.max(F.when(F.col("__k") == 2, F.col(value))).alias("second"), F.avg((F.col(value) > 0).cast("double")).alias("positive")).withColumn("retention", ratio(F.col("second"), F.col("first")))


def price_perturbation(base: DataFrame, worse: float, value: str = "r", reps: int = 200, seed: int = 0) -> DataFrame:
    """p50, p05 and share positive of the mean after every trade loses |N(worse, 0.4 worse)|."""
    u = lambda tag: (resample.hashed(F.lit(f"{seed}{tag}"), F.col("rep"), F.col("idx")) + F.lit(0.5)) / F.lit(2.0**32)
    rows = base.select("idx", F.col(value).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    z = F.sqrt(-2 * F.log(u("a"))) * F.cos(F.lit(2 * math.pi) * u("b"))
    means = rows.groupBy("rep").agg(F.avg(F.col("x") - F.abs(F.lit(worse) + F.lit(0.4 * worse) * z)).alias("m"))
    return means.agg(F.percentile("m", 0.5).alias("p50"), F.percentile("m", 0.05).alias("p05"), F.avg((F.col("m") > 0).cast("double")).alias("positive"))


def robustness_pass_rate(passed: Column) -> Column:
    """Share of tests passed."""
    return F.avg(passed.cast("double"))


def surface_smoothness(df: DataFrame, x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """Mean size of the difference to the next grid point, along both axes."""
    right = F.abs(F.col(value) - F.lead(value).over(Window.partitionBy(y).orderBy(x)))
    up = F.abs(F.col(value) - F.lead(value).over(Window.partitionBy(x).orderBy(y)))
    steps = df.select(right.alias("__r"), up.alias("__u")).select(F.explode(F.array("__r", "__u")).alias("d"))
    return steps.agg(F.avg("d").alias("smoothness"))


def structural_break(df: DataFrame, value: str = "r", at: float = 0.5) -> DataFrame:
    """Chow's F for a change of the linear trend at a share of the rows: f, n. df has idx."""
    n = df.count()
    x, y, first = F.col("idx").cast("double"), F.col(value), F.col("idx") < math.floor(n * at)

    def sse(cond: Column | None) -> Column:
        a, b = (x, y) if cond is None else (F.when(cond, x), F.when(cond, y))
        return F.regr_syy(b, a) - ratio(F.pow(F.regr_sxy(b, a), F.lit(2.0)), F.regr_sxx(b, a))

    one = df.agg(sse(None).alias("p"), sse(first).alias("a"), sse(~first).alias("b"), F.count(y).alias("n"))
    return one.select(F.when(F.col("n") > 4, ratio((F.col("p") - F.col("a") - F.col("b")) / 2, (F.col("a") + F.col("b")) / (F.col("n") - 4))).alias("f"), "n")
