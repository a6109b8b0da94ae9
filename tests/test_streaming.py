"""Streams give what the same rows give at once."""

import datetime

from edgeproof.operators import execution
from edgeproof.streaming import live


def rows(spark):
    t0 = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(f"s{i % 2}", t0 + datetime.timedelta(hours=7 * i), (-1.0 if i % 3 else 1.2) * (1 + i % 2)) for i in range(90)], "strategy string, ts timestamp_ntz, r double")


def run(spark, df, build, tmp_path, name, mode):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_windows(spark, tmp_path):
    df = rows(spark)
    want = {(r["strategy"], r["start"]): (r["n"], round(r["expectancy"], 9)) for r in live.windowed_metrics(df, "5 days", "1 day").collect()}
    got = run(spark, df, lambda s: live.windowed_metrics(s, "5 days", "1 day"), tmp_path, "windows", "complete")
    assert {(r["strategy"], r["start"]): (r["n"], round(r["expectancy"], 9)) for r in got.collect()} == want


def test_kill_switch_state(spark, tmp_path):
    df = rows(spark)
    want = {r["strategy"]: (r["n"], round(r["max_drawdown"], 9), r["trigger"]) for r in execution.kill_switch(df.selectExpr("strategy", "ts", "r * 0.01 AS ret"), -0.2, by=("strategy",)).collect()}
    got = run(spark, df, live.kill_switch, tmp_path, "switch", "update")
    assert {r["strategy"]: (r["n"], round(r["max_drawdown"], 9), r["trigger"]) for r in got.collect()} == want


def test_breaches(spark, tmp_path):
    bounds = spark.createDataFrame([("s0", -1.5, 1.5)], "strategy string, low double, high double")
    got = run(spark, rows(spark), lambda s: live.breaches(s, bounds), tmp_path, "breaches", "append")
    assert got.count() == 90 and got.where("breach is null").count() == 45  # no interval: unknown
