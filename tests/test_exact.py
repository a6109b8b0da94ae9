"""Exact quantiles of whole columns, shared simulations, and undefined results."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeproof.operators import execution, generalization, ordered, resample, risk, scorecard, trade
from edgeproof.sources import generators


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "r double")


@pytest.mark.parametrize("kind", ["spread", "ties", "constant", "two", "one", "infinite"])
def test_exact_quantiles(spark, monkeypatch, kind):
    """Against numpy, with brackets that must narrow more than once."""
    rng = random.Random(3)
    values = {"spread": [rng.gauss(0, 1) for _ in range(5000)], "ties": [float(rng.randrange(7)) for _ in range(3000)], "constant": [2.5] * 900, "two": [1.0, 4.0], "one": [3.0], "infinite": [-math.inf, *[rng.random() for _ in range(400)], math.inf]}[kind]
    probs = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    monkeypatch.setattr(ordered, "ACCURACY", 60)
    monkeypatch.setattr(ordered, "BRACKET", 40)
    got = ordered.exact_quantiles(numbers(spark, [*values, None]), "r", probs)
    want = [-math.inf, *np.quantile(values, probs[1:-1]), math.inf] if kind == "infinite" else np.quantile(values, probs).tolist()
    assert got == pytest.approx(want)
    assert ordered.exact_quantiles(numbers(spark, [None]), "r", probs) == [None] * len(probs)


def test_mad_and_summary_of_a_whole_table(spark):
    values = [math.sin(i) * (i % 9) for i in range(700)]
    m = np.median(values)
    assert trade.mad(numbers(spark, values)).first()["mad"] == pytest.approx(np.median(np.abs(np.array(values) - m)))
    whole = {r["metric"]: r["value"] for r in trade.summary(numbers(spark, values)).collect()}
    group = {r["metric"]: r["value"] for r in trade.summary(numbers(spark, values).withColumn("g", F.lit(1)), by=("g",)).collect()}
    assert whole.keys() == group.keys() and all(whole[k] == pytest.approx(group[k]) for k in whole)
    assert trade.mad(numbers(spark, [])).first()["mad"] is None
    assert risk.expected_shortfall(numbers(spark, values), "r").first()[0] == pytest.approx(np.mean([v for v in values if v <= np.quantile(values, 0.05)]))
    assert risk.expected_shortfall(numbers(spark, []), "r").first()[0] is None


def test_grid(spark):
    got = sorted(tuple(r) for r in resample.grid(spark, 3, 10, 4).collect())
    assert got == [(rep, pos) for rep in range(3) for pos in (0, 4, 8)]
    long = resample.grid(spark, 1, 3_000_000)
    assert long.rdd.getNumPartitions() == 12 and long.agg(F.max("pos")).first()[0] == 2_999_999


def test_moving_block_draws_are_no_small_table(spark):
    """The draws by definition, and as large to Spark as they are: it sends no tables of millions of rows to all."""
    n, reps, block = 47, 30, 20
    base = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * 1.5).alias("r"))
    got = {(r["rep"], r["pos"]): (r["idx"], r["r"]) for r in resample.moving_blocks(base, reps, 3, block).collect()}
    start = lambda rep, b: int(hashlib.md5(f"3:{rep}:{b}".encode()).hexdigest()[:8], 16) % (n - block)
    want = {(rep, pos): start(rep, pos // block) + pos % block for rep in range(reps) for pos in range(n)}
    assert got == {at: (i, i * 1.5) for at, i in want.items()}
    node = resample.moving_blocks(spark.range(2400).withColumnRenamed("id", "idx"), 5000)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    assert node.left().stats().sizeInBytes() >= 5000 * 2400 * 16


def test_survival_shares_paths(spark):
    base = resample.indexed(generators.strategy(spark).trades, ("idx",))
    for n in (None, 100, 700):
        both = risk.survival(base, fraction=0.2, n_trades=n, n_ruin=500, n_sim=60).first()
        assert both["mdd_p95"] == pytest.approx(risk.monte_carlo_drawdown(base, fraction=0.2, n_trades=n, n_sim=60).first()["p95"])
        assert both["risk_of_ruin"] == risk.risk_of_ruin(base, fraction=0.2, n_trades=500, n_sim=60).first()[0]


def test_overfitting_needs_a_choice(spark):
    one = spark.range(60).select(F.col("id").alias("t"), F.lit(0).alias("config"), F.sin("id").alias("ret"))
    got = generalization.pbo_cscv(one).first()
    assert got["pbo"] is None and got["mean_logit"] is None and got["splits"] == 252
    assert generalization.pbo_cscv(one.unionByName(one.withColumn("config", F.lit(1)).withColumn("ret", F.cos("t")))).first()["pbo"] is not None
    for bad in (7, 22):
        with pytest.raises(ValueError):
            generalization.pbo_cscv(one, bad)


def test_hansen_limit_of_few_periods(spark):
    """Up to three periods the limit is that of three."""
    rows = [(t, c, r) for t, rs in enumerate(([0.1, -0.1], [0.2, -0.3], [0.1, -0.05])) for c, r in enumerate(rs)]
    m = np.array([r for _, _, r in rows]).reshape(3, 2)
    limit = -math.sqrt(2 * math.log(math.log(3)))
    assert (math.sqrt(3) * m.mean(0) / m.std(0, ddof=1) < limit).tolist() == [False, True]
    got = generalization.hansen_spa(spark.createDataFrame(rows, "t long, config int, ret double"), reps=200).first()
    assert got["statistic"] == pytest.approx(max(0, (math.sqrt(3) * m.mean(0) / m.std(0, ddof=1)).max())) and 0 <= got["p"] <= 1


def test_every_criterion_has_a_note(spark):
    notes = {r["criterion"]: r["note"] for r in scorecard.notes(spark).collect()}
    assert set(notes) == {c for _, c, *_ in scorecard.LIMITS} | set(execution.AUDITS) and all(notes.values())


def test_entry_does_not_hide_faults():
    """Only a missing subpackage is passed over."""
    import pathlib

    text = (pathlib.Path(__file__).parent.parent / "__spark_entry__.py").read_text()
    assert "except ImportError" not in text and "find_spec" in text


def test_rolling_over_stretches(spark, monkeypatch):
    """A series in stretches has the rolling metric of the whole."""
    from edgeproof.operators import signal

    monkeypatch.setattr(signal, "STRETCH", 40)
    rows = spark.range(333).select(F.col("id").alias("ts"), F.floor(F.col("id") / 50).alias("m"), F.sin(F.col("id") * 1.7).alias("ret"), F.lit("idx").alias("note"))
    for metric in ("mean", "std", "median", "profit_factor"):
        for window in (1, 7, 40, 60):
            want = {r["ts"]: r["rolling"] for r in signal.rolling_metric(rows, window=window, metric=metric).collect()}
            got = {r["ts"]: r["rolling"] for r in signal.rolling_metric(rows, window=window, metric=metric, block="m").collect()}
            assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or got[k] == pytest.approx(want[k])) for k in want)
