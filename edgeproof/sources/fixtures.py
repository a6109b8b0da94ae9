"""Trades, daily returns, matrices and signals derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The total order of trades, and the block (a month) that rises with it.
ORDER = ("entry", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade a line item, with its order columns and month."""
    r = F.round((F.col("l_extendedprice") * (1 - F.col("l_discount")) - 50000) / 50000, 8)
    return read(spark, sf_dir, "lineitem").select(
        r.alias("r"), F.col("l_shipdate").alias("entry"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")).alias("exit"), F.col("l_suppkey").alias("asset"), F.col("l_returnflag").alias("regime"),
        (F.lit(0) - F.col("l_discount") * 10).alias("mae"), (F.abs(r) + F.col("l_tax") * 10).alias("mfe"), F.col("l_quantity").alias("risk"), (r * F.col("l_quantity")).alias("pnl"), F.col("l_tax").alias("cost"),
        F.date_trunc("month", "l_shipdate").alias("month"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, ret) a day of orders."""
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(((F.avg("o_totalprice") - 250000) / 250000 * 0.05).alias("ret"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, bench) a day of shipments."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(((F.avg("l_extendedprice") - 52500) / 52500 * 0.05).alias("bench"))


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy, ts, ret) a day and order priority."""
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("strategy"), F.col("o_orderdate").alias("ts")).agg(((F.avg("o_totalprice") - 250000) / 250000 * 0.05).alias("ret"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, config, ret) a month and order priority; every cell is there, an empty one with return 0."""
    orders = read(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("m"), F.substring("o_orderpriority", 1, 1).cast("int").alias("config"), "o_totalprice")
    cells = orders.groupBy("m", "config").agg(((F.avg("o_totalprice") - 250000) / 250000 * 0.05).alias("ret"))
    first = orders.agg(F.min("m").alias("lo"))
    placed = cells.crossJoin(F.broadcast(first)).withColumn("t", ((F.year("m") - F.year("lo")) * 12 + F.month("m") - F.month("lo")).cast("long"))
    span = placed.agg(F.max("t").alias("hi"))
    axes = span.select(F.explode(F.sequence(F.lit(0).cast("long"), "hi")).alias("t")).crossJoin(placed.select("config").distinct())
    return axes.join(placed.select("t", "config", "ret"), ["t", "config"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(score, coarse, fwd, signal, event) a line item."""
    t = trades(spark, sf_dir)
    return t.select(F.col("l_quantity").alias("score"), F.col("l_discount").alias("coarse"), F.col("l_extendedprice").alias("price"), F.col("r").alias("fwd"), (F.col("l_discount") >= 0.05).alias("signal"), (F.col("r") > 0).alias("event"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(param, value): the mean result by line number and quantity decile, a parameter response."""
    t = trades(spark, sf_dir)
    return t.groupBy((F.ceil(F.col("l_quantity") / 5)).cast("int").alias("param")).agg(F.round(F.avg("r") + 0.05, 8).alias("value"))
