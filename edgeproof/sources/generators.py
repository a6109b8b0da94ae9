"""Seeded synthetic strategies whose true parameters are known.

Every number comes from a hash of (seed, name, row): generation is a projection of a range, the
same on any cluster, and as large as asked for.
"""

from __future__ import annotations

import datetime
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import capital_curve, with_position
from ..operators.resample import hashed


def uniform(seed: int, name: str, row: str = "id") -> Column:
    return (hashed(F.lit(f"{seed}{name}"), F.col(row)) + F.lit(0.5)) / F.lit(2.0**32)


def normal(seed: int, name: str, mean: float = 0.0, sd: float = 1.0, row: str = "id") -> Column:
    z = F.sqrt(-2 * F.log(uniform(seed, name + "a", row))) * F.cos(F.lit(2 * math.pi) * uniform(seed, name + "b", row))
    return F.lit(mean) + F.lit(sd) * z


def business_day(start: str, i: Column) -> Column:
    """The i-th weekday from start on."""
    day = datetime.date.fromisoformat(start)
    while day.weekday() > 4:
        day += datetime.timedelta(days=1)
    monday = day - datetime.timedelta(days=day.weekday())
    k = i + F.lit(day.weekday())
    return F.date_add(F.lit(monday), (F.floor(k / 5) * 7 + k % 5).cast("int")).cast("timestamp_ntz")


@dataclass
class Strategy:
    trades: DataFrame
    daily: DataFrame
    name: str = "strategy"
    meta: dict[str, float] = field(default_factory=dict)

    def capital(self) -> DataFrame:
        """daily with its capital curve."""
        return capital_curve(self.daily, "ret", ("ts",))


def strategy(spark: SparkSession, n_trades: int = 420, win_rate: float = 0.42, payoff: float = 1.9, cost: float = 0.0008, daily_vol: float = 0.009, drift: float = 0.11, start: str = "2012-01-02", seed: int = 42, name: str = "strategy") -> Strategy:
    """Trades with lognormal wins and concentrated losses, less costs, in regimes of 25 trades, and a
    daily series that takes each result on its exit day."""
    days = int(n_trades * 6.5)
    u, z = lambda k: uniform(seed, k), lambda k, m=0.0, s=1.0: normal(seed, k, m, s)
    won = F.col("won")
    rows = spark.range(n_trades).withColumn("won", u("win") < win_rate)
    rows = rows.withColumn("r", F.when(won, F.exp(z("gain", math.log(payoff) - 0.18, 0.6))).otherwise(-F.abs(z("loss", 1.0, 0.28))) - F.lit(cost / 0.01))
    rows = rows.withColumn("at", F.floor(u("entry") * (days - 12)).cast("long"))
    held = F.when(won, 4 + F.floor(u("held") * 26)).otherwise(2 + F.floor(u("held") * 10))
    rows = rows.withColumn("out", F.least(F.col("at") + held, F.lit(days - 1)).cast("long"))
    rows = with_position(rows.withColumn("year", F.floor(F.col("at") / 250)), ("at", "id"), block="year").withColumn("block", F.floor(F.col("idx") / 25))
    regime = F.element_at(F.array(F.lit("up"), F.lit("flat"), F.lit("down")), (F.floor(uniform(seed, "regime", "block") * 3) + 1).cast("int"))
    trades = rows.select(
        "idx", business_day(start, F.col("at")).alias("entry"), business_day(start, F.col("out")).alias("exit"), "r", (F.col("r") * 0.01).alias("ret"),
        F.concat(F.lit("ASSET"), (F.floor(u("asset") * 12) + 1).cast("string")).alias("asset"), regime.alias("regime"), (-F.abs(z("mae", 0.45, 0.25))).alias("mae"),
        F.when(F.col("r") > 0, F.col("r") * (1.05 + 0.85 * u("mfe"))).otherwise(F.abs(z("mfe0", 0.35, 0.22))).alias("mfe"),
    )
    posted = rows.groupBy(F.col("out").alias("id")).agg(F.sum(F.col("r") * 0.01).alias("posted"))
    base = spark.range(days).withColumn("noise", normal(seed, "day", drift / 252, daily_vol))
    daily = base.join(posted, "id", "left").select(business_day(start, F.col("id")).alias("ts"), (F.col("noise") + F.coalesce("posted", F.lit(0.0))).alias("ret"))
    return Strategy(trades, daily, name, {"win_rate": win_rate, "payoff": payoff, "cost": cost, "seed": float(seed)})


def benchmark(daily: DataFrame, beta: float = 0.55, daily_vol: float = 0.011, drift: float = 0.09, seed: int = 7) -> DataFrame:
    """(ts, bench): beta x return + (1 - beta) x noise."""
    return daily.select("ts", (F.lit(beta) * F.col("ret") + F.lit(1 - beta) * normal(seed, "bench", drift / 252, daily_vol, "ts")).alias("bench"))


def comparable_pair(spark: SparkSession, total_return: float = 0.15, days: int = 252, seed: int = 5) -> DataFrame:
    """(ts, a, b): two paths of very different risk that end at the same total return."""
    shock = (F.col("id") >= int(days * 0.45)) & (F.col("id") < int(days * 0.58))
    rows = spark.range(days).select("id", normal(seed, "a", 0.0006, 0.005).alias("a"), (normal(seed, "b", 0.0006, 0.016) - F.when(shock, 0.010).otherwise(0.0)).alias("b"))
    now = rows.agg(F.sum(F.log1p("a")).alias("la"), F.sum(F.log1p("b")).alias("lb"))
    fix = lambda x, total: F.expm1(F.log1p(F.col(x)) + (F.lit(math.log1p(total_return)) - F.col(total)) / days)
    return rows.crossJoin(F.broadcast(now)).select(business_day("2026-01-02", F.col("id")).alias("ts"), fix("a", "la").alias("a"), fix("b", "lb").alias("b"))


def signal(spark: SparkSession, n: int = 3000, ic: float = 0.045, seed: int = 11) -> DataFrame:
    """(score, fwd) with a known correlation."""
    rows = spark.range(n).select(normal(seed, "score").alias("score"), normal(seed, "noise").alias("e"))
    return rows.select("score", (0.02 * (ic * F.col("score") + math.sqrt(max(0.0, 1 - ic * ic)) * F.col("e"))).alias("fwd"))
