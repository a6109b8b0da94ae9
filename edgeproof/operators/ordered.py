"""Order-dependent building blocks: positions, running products and drawdowns, islands, calendars.

A long series is never sorted in one task. Rows carry a block (a calendar period, or any column
that rises with the order); windows run within blocks, blocks are summed up in one row each, a
window over those few rows gives what each block starts from, and a join brings it back.
Cumulative products and running maxima compose this way exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _local(by: tuple[str, ...], block: str | None, order: tuple[str, ...]) -> WindowSpec:
    keys = [*by, *([block] if block else [])]
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return w.orderBy(*order)


def _before(by: tuple[str, ...], block: str) -> WindowSpec:
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return w.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)




def with_position(df: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = (), block: str | None = None) -> DataFrame:
    """Add idx, 0, 1, 2... in the given order, which must be total."""
    at = F.row_number().over(_local(by, block, order)).cast("long") - 1
    if not block:
        return df.withColumn("idx", at)
    sizes = df.groupBy(*by, block).agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(_before(by, block)), F.lit(0))).drop("__n")
    return df.withColumn("__at", at).join(sizes, [*by, block]).withColumn("idx", F.col("__at") + F.col("__base")).drop("__at", "__base")


def running_product(df: DataFrame, factor: Column, name: str, order: tuple[str, ...], by: tuple[str, ...] = (), block: str | None = None) -> DataFrame:
    """Add the cumulative product of factor."""
    w = _local(by, block, order).rowsBetween(Window.unboundedPreceding, 0)
    if not block:
        return df.withColumn(name, F.product(factor).over(w))
    whole = df.groupBy(*by, block).agg(F.product(factor).alias("__p")).withColumn("__base", F.coalesce(F.product("__p").over(_before(by, block)), F.lit(1.0))).drop("__p")
    return df.withColumn("__own", F.product(factor).over(w)).join(whole, [*by, block]).withColumn(name, F.col("__own") * F.col("__base")).drop("__own", "__base")


def running_max(df: DataFrame, value: str, name: str, order: tuple[str, ...], by: tuple[str, ...] = (), block: str | None = None) -> DataFrame:
    """Add the running maximum of value."""
    w = _local(by, block, order).rowsBetween(Window.unboundedPreceding, 0)
    if not block:
        return df.withColumn(name, F.max(value).over(w))
    whole = df.groupBy(*by, block).agg(F.max(value).alias("__p")).withColumn("__base", F.max("__p").over(_before(by, block))).drop("__p")
    return df.withColumn("__own", F.max(value).over(w)).join(whole, [*by, block]).withColumn(name, F.greatest("__own", "__base")).drop("__own", "__base")


def capital_curve(df: DataFrame, ret: str = "ret", order: tuple[str, ...] = ("ts",), by: tuple[str, ...] = (), block: str | None = None, base: float = 1.0) -> DataFrame:
    """Add capital = base x running product of 1 + return."""
    return running_product(df, F.lit(1.0) + F.col(ret), "capital", order, by, block).withColumn("capital", F.lit(base) * F.col("capital"))


def drawdown(df: DataFrame, ret: str = "ret", order: tuple[str, ...] = ("ts",), by: tuple[str, ...] = (), block: str | None = None) -> DataFrame:
    """Add capital, peak and dd = capital / peak - 1. The first peak is the first capital, not the
    base, so a loss in the first period shows no drawdown."""
    curve = capital_curve(df, ret, order, by, block)
    return running_max(curve, "capital", "peak", order, by, block).withColumn("dd", F.col("capital") / F.col("peak") - 1)


def islands(df: DataFrame, inside: Column, order: tuple[str, ...], by: tuple[str, ...] = (), block: str | None = None) -> DataFrame:
    """Add island: the number of rows up to here that are not inside; a run of inside rows shares it."""
    outside = (~inside).cast("long")
    w = _local(by, block, order).rowsBetween(Window.unboundedPreceding, 0)
    if not block:
        return df.withColumn("island", F.sum(outside).over(w))
    whole = df.groupBy(*by, block).agg(F.sum(outside).alias("__p")).withColumn("__base", F.coalesce(F.sum("__p").over(_before(by, block)), F.lit(0))).drop("__p")
    return df.withColumn("__own", F.sum(outside).over(w)).join(whole, [*by, block]).withColumn("island", F.col("__own") + F.col("__base")).drop("__own", "__base")


#: Ranges that values are cut into for running sums by value.
RANGES = 64


def sums_before(df: DataFrame, value: str, columns: tuple[str, ...], by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """Add before_c for each column c: its sum over rows whose value comes earlier in the order.

    df has one row a value (and group). Values are cut into ranges at approximate quantiles, so any
    number of them is spread over tasks; only the ranges' totals meet in one small window.
    """
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, F.array(*(F.lit(k / RANGES) for k in range(1, RANGES))), 10_000).alias("__cuts"))
    x = F.col(value)
    below = F.size(F.filter("__cuts", lambda e: e < x))
    ranged = (df.join(cuts, list(by)) if by else df.crossJoin(F.broadcast(cuts))).withColumn("__range", -below if descending else below).drop("__cuts")
    local = Window.partitionBy(*by, "__range").orderBy(x.desc() if descending else x.asc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__s_{c}") for c in columns))
    bases = whole.select(*by, "__range", *(F.coalesce(F.sum(f"__s_{c}").over(_before(by, "__range")), F.lit(0)).alias(f"__b_{c}") for c in columns))
    out = ranged.withColumns({f"__o_{c}": F.coalesce(F.sum(c).over(local), F.lit(0)) for c in columns}).join(bases, [*by, "__range"])
    return out.select(*df.columns, *((F.col(f"__o_{c}") + F.col(f"__b_{c}")).alias(f"before_{c}") for c in columns))


#: Accuracy of the approximate quantiles that bracket exact ones; most rows of a bracket that are sorted.
ACCURACY, BRACKET = 10_000, 200_000


def exact_quantiles(df: DataFrame, value: str, probs: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles, interpolated linearly, of a column of any size, as numbers on the driver.

    Approximate quantiles bracket each wanted rank with certainty; a pass counts what lies before and
    within the brackets, and brackets narrow until few rows are in them, which are sorted. So no task
    ever holds the column, and a pass is a plain aggregation.
    """
    x = df.select(F.col(value).cast("double").alias("x")).where("x is not null")
    n = x.count()
    if not n:
        return [None] * len(probs)
    ranks = sorted({min(n - 1, math.floor((n - 1) * p) + d) for p in probs for d in (0, 1)})
    found: dict[int, float] = {}
    todo = {k: (-math.inf, math.inf, 0, n) for k in ranks}  # rank: bounds of its value, rows before and within
    while todo:
        for lo, hi, before, size in sorted(set(todo.values())):
            inside = x.where((F.col("x") >= lo) & (F.col("x") <= hi)) if size < n else x
            own = [k for k, b in todo.items() if b == (lo, hi, before, size)]
            if size <= BRACKET or lo == hi:
                # Ranks of distinct values: ties stand together.
                counts = inside.groupBy("x").agg(F.count("*").alias("c")).withColumn("e", F.sum("c").over(Window.orderBy("x")))
                want = F.array(*(F.lit(k - before) for k in own))
                for r in counts.where(F.exists(want, lambda w: (w < F.col("e")) & (w >= F.col("e") - F.col("c")))).collect():
                    found |= {k: r["x"] for k in own if r["e"] - r["c"] <= k - before < r["e"]}
                for k in own:
                    del todo[k]
                continue
            at = [(k - before + 0.5) / size for k in own]
            marks = sorted({min(1.0, max(0.0, a + d / ACCURACY)) for a in at for d in (-2, 2)})
            edges = dict(zip(marks, inside.agg(F.percentile_approx("x", F.array(*map(F.lit, marks)), ACCURACY).alias("e")).first()["e"], strict=True))
            pairs = [(edges[min(1.0, max(0.0, a - 2 / ACCURACY))], edges[min(1.0, max(0.0, a + 2 / ACCURACY))]) for a in at]
            sums = inside.agg(*(F.count(F.when(F.col("x") < a, 1)).alias(f"b{i}") for i, (a, _) in enumerate(pairs)), *(F.count(F.when(F.col("x").between(a, b), 1)).alias(f"w{i}") for i, (a, b) in enumerate(pairs))).first()
            for i, k in enumerate(own):
                a, b, c = *pairs[i], sums[f"b{i}"]
                if not c <= k - before < c + sums[f"w{i}"]:
                    raise RuntimeError("a quantile lies outside its bracket")
                todo[k] = (a, b, before + c, sums[f"w{i}"])
    out = []
    for p in probs:
        h = (n - 1) * p
        a, b = found[min(n - 1, math.floor(h))], found[min(n - 1, math.floor(h) + 1)]
        out.append(a if a == b or h == math.floor(h) else a + (h - math.floor(h)) * (b - a))
    return out


def quantiles(df: DataFrame, value: str, probs: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., p, value): exact quantiles, interpolated linearly, of a column of any size.

    percentile() keeps all distinct values of a group in one task; here they are spread over ranges
    and only the rows at the wanted ranks come together.
    """
    if not by:
        rows = [(float(p), v) for p, v in zip(probs, exact_quantiles(df, value, probs), strict=True) if v is not None]
        return df.sparkSession.createDataFrame(rows, "p double, value double")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    run = sums_before(counts, "v", ("n",), by)
    h = (F.col("total") - 1) * F.col("p")
    want = counts.groupBy(*by).agg(F.sum("n").alias("total")).where("total > 0").withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in probs))))
    want = want.select(*by, "p", F.floor(h).alias("lo"), F.least(F.floor(h) + 1, F.col("total") - 1).alias("hi"), (h - F.floor(h)).alias("part"))
    both = run.join(want, list(by)) if by else run.crossJoin(F.broadcast(want))
    at = lambda rank: F.max(F.when((F.col("before_n") <= F.col(rank)) & (F.col(rank) < F.col("before_n") + F.col("n")), F.col("v")))
    ends = both.groupBy(*by, "p").agg(at("lo").alias("a"), at("hi").alias("b"), F.first("part").alias("part"))
    return ends.select(*by, "p", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("value"))


def calendar_returns(df: DataFrame, unit: str, ts: str = "ts", ret: str = "ret", by: tuple[str, ...] = ()) -> DataFrame:
    """by..., bin, ret: compounded by day, week (Monday), month or year; bins without rows between
    the first and the last are there too, with return 0."""
    bins = df.groupBy(*by, F.date_trunc(unit, F.col(ts)).alias("bin")).agg((F.product(F.lit(1.0) + F.col(ret)) - 1).alias("ret"))
    span = bins.groupBy(*by).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    spine = span.select(*by, F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {unit}"))).alias("bin"))
    return spine.join(bins, [*by, "bin"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
