"""Edge fixtures: empty, one row, all wins, all losses, zeros, constants, open drawdowns, ties."""

import math

import pytest
from pyspark.sql import functions as F

from edgeproof.functions.semantics import clean
from edgeproof.operators import evidence, execution, generalization, ordered, resample, risk, scorecard, signal, trade
from edgeproof.plans import programme
from edgeproof.sources import generators, published

R = lambda: F.col("r")


def frame(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "idx long, r double")


def one(df, **columns):
    return df.agg(*(c.alias(k) for k, c in columns.items())).first().asDict()


def returns(spark, values, start="2024-01-01"):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, ret double")
    return df.select(F.date_add(F.lit(start).cast("date"), F.col("i").cast("int")).cast("timestamp_ntz").alias("ts"), "ret")


def test_empty(spark):
    got = {r["metric"]: r["value"] for r in trade.summary(frame(spark, [])).collect()}
    assert len(got) == 17 and set(got.values()) == {None}
    assert {r["value"] for r in risk.summary(returns(spark, [])).collect()} == {None}
    assert resample.iid(frame(spark, []), 5).count() == 0


def test_one_row(spark):
    got = one(frame(spark, [0.5]), t=evidence.t_stat(R()), sqn=risk.sqn(R()), skew=trade.skewness(R()), tail=trade.tail_ratio(R()), mean=trade.expectancy(R()))
    assert got == {"t": None, "sqn": None, "skew": None, "tail": None, "mean": 0.5}


def test_one_sided(spark):
    wins = one(frame(spark, [1, 2]), pf=trade.profit_factor(R()), payoff=trade.payoff_ratio(R()), omega=risk.omega(R()), gp=risk.gain_to_pain(R()))
    assert wins == {"pf": math.inf, "payoff": None, "omega": math.inf, "gp": math.inf}
    losses = one(frame(spark, [-1, -2]), pf=trade.profit_factor(R()), kelly=risk.kelly_fraction(R()), wr=trade.win_rate(R()))
    assert losses == {"pf": 0.0, "kelly": None, "wr": 0.0}
    assert one(frame(spark, [0, 0]), pf=trade.profit_factor(R()))["pf"] is None


def test_zeros_and_nan(spark):
    df = frame(spark, [1, 0, -1, 0, -1, -1, float("nan"), None])
    assert clean(df, "r").count() == 6
    got = one(clean(df, "r"), w=trade.win_rate(R()), lo=trade.loss_rate(R()))
    assert got["w"] == pytest.approx(1 / 6) and got["lo"] == pytest.approx(0.5)
    assert risk.max_streak(clean(df, "r")).first()["streak"] == 2
    assert risk.max_streak(clean(df, "r"), winning=True).first()["streak"] == 1
    assert execution.mae_mfe(df.limit(2).withColumn("mae", R()).withColumn("mfe", R())).orderBy("r").first()["outcome"] == "loser"


def test_constant(spark):
    df = frame(spark, [0.5] * 30)
    assert set(one(df, t=evidence.t_stat(R()), s=trade.skewness(R()), k=trade.excess_kurtosis(R()), sharpe=risk.sharpe(R())).values()) == {None}
    assert {r["rho"] for r in evidence.autocorrelation(df, lags=3).collect()} == {None}
    assert evidence.effective_sample_size(df).first()["n_eff"] == 30 and evidence.newey_west_t(df).first()["t"] is None


def test_drawdowns(spark):
    frame_ = ordered.drawdown(returns(spark, [-0.5, 0.1, -0.2, 0.0, 0.5, -0.1, -0.1]))
    dd = [round(r["dd"], 6) for r in frame_.orderBy("ts").collect()]
    assert dd == [0.0, 0.0, -0.2, -0.2, 0.0, -0.1, -0.19]  # the first loss is no drawdown
    eps = risk.drawdown_episodes(frame_).orderBy("start").collect()
    assert [(e["start"].day, e["trough"].day, e["recovery"] and e["recovery"].day, e["duration_days"], e["recovery_days"]) for e in eps] == [(3, 3, 5, 2, 2), (6, 7, None, None, None)]


def test_blocks_compose(spark):
    """Blocked running products, maxima, positions and islands equal plain ones."""
    df = spark.range(500).select(F.col("id").alias("ts"), ((F.pmod(F.xxhash64("id"), F.lit(1000)) - 480) / 20000).alias("ret"), F.floor(F.col("id") / 37).alias("b"))
    plain = {r["ts"]: (r["capital"], r["dd"]) for r in ordered.drawdown(df).collect()}
    for r in ordered.drawdown(df, block="b").collect():
        assert r["capital"] == pytest.approx(plain[r["ts"]][0], rel=1e-12) and r["dd"] == pytest.approx(plain[r["ts"]][1], abs=1e-12)
    assert [r["ts"] for r in ordered.with_position(df, ("ts",), block="b").orderBy("idx").collect()] == list(range(500))
    assert risk.max_streak(df, "ret", ("ts",)).first() == risk.max_streak(df, "ret", ("ts",), block="b").first()


def test_empty_bins(spark):
    df = returns(spark, [0.1]).unionByName(returns(spark, [-0.1], "2024-03-10"))
    got = {r["bin"].month: r["ret"] for r in ordered.calendar_returns(df, "month").collect()}
    assert got[2] == 0.0 and len(got) == 3
    assert signal.positive_periods(df).first()["positive_periods"] == pytest.approx(1 / 3)


def test_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (None, 1.0)], "score double, fwd double")
    ranks = [r["k"] for r in signal.average_rank(df, "fwd", "k").orderBy("fwd", "score").collect()]
    assert ranks == [1.5, 1.5, 3.5, 3.5, 5.0]
    assert signal.quantile_buckets(spark.createDataFrame([(1.0,)] * 8 + [(2.0,)], "score double")).select("bucket").distinct().count() <= 2
    peak = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 5.0), (4, 1.0)], "param int, value double")
    assert generalization.parameter_stability(peak).first()["best_param"] == 2
    assert generalization.parameter_stability(peak.limit(2)).count() == 0
    assert signal.without_best(frame(spark, [1, 2, 3]), n=0).first()["expectancy"] is None
    assert signal.without_best(frame(spark, [1, 2, 3]), n=1).first()["expectancy"] == 1.5
    assert signal.without_worst(frame(spark, [1, 2, 3]), n=3).first()["expectancy"] is None


def test_exact_quantiles(spark):
    df = frame(spark, [3, 1, 2, 2, None, 10])
    got = {r["p"]: r["value"] for r in ordered.quantiles(df, "r", (0.0, 0.3, 0.5, 1.0)).collect()}
    assert got == {0.0: 1.0, 0.3: pytest.approx(2.0), 0.5: 2.0, 1.0: 10.0}
    assert ordered.quantiles(frame(spark, []), "r", (0.5,)).count() == 0
    assert ordered.quantiles(frame(spark, [7]), "r", (0.25,)).first()["value"] == 7.0


def test_errors(spark):
    with pytest.raises(ValueError):
        generalization.walk_forward(frame(spark, range(59)))
    assert generalization.walk_forward(frame(spark, range(60))).count() == 5
    with pytest.raises(ValueError):
        generalization.pbo_cscv(spark.createDataFrame([(0, 0, 1.0)], "t long, config int, ret double"), 3)


def test_noise_has_no_champion(spark):
    noise = spark.range(600 * 40).select((F.col("id") % 600).alias("t"), F.floor(F.col("id") / 600).cast("int").alias("config"), generators.normal(1, "noise", 0.0, 0.01).alias("ret"))
    assert 0.2 < generalization.pbo_cscv(noise).first()["pbo"] < 0.9
    assert generalization.reality_check(noise, reps=100).first()["p"] > 0.02


def test_disguised_signal(spark):
    df = spark.range(4000).select(generators.normal(1, "a").alias("a"), generators.normal(2, "e").alias("e"), generators.normal(3, "y").alias("y"))
    df = df.select("a", (0.9 * F.col("a") + 0.1 * F.col("e")).alias("new"), (0.3 * F.col("a") + F.col("y")).alias("fwd"))
    got = signal.incremental_value(df, "new", ["a"]).first()
    assert got["ic"] > 0.2 and abs(got["incremental_ic"]) < 0.05


def test_known_strategy(spark):
    s = generators.strategy(spark, n_trades=3000)
    got = one(s.trades, wr=trade.win_rate(R()), e=trade.expectancy(R()), n=F.count("*"))
    assert got["n"] == 3000 and abs(got["wr"] - 0.42) < 0.03 and 0.02 < got["e"] < 0.3
    assert s.daily.count() == 19500 and s.capital().where("capital > 0").count() == 19500
    pair = generators.comparable_pair(spark).agg((F.product(1 + F.col("a")) - 1).alias("a"), (F.product(1 + F.col("b")) - 1).alias("b"), F.stddev("a").alias("va"), F.stddev("b").alias("vb")).first()
    assert pair["a"] == pytest.approx(0.15) and pair["b"] == pytest.approx(0.15) and pair["vb"] > 2 * pair["va"]
    ic = generators.signal(spark, 20_000, 0.2).agg(signal.information_coefficient(F.col("score"), F.col("fwd")).alias("ic")).first()["ic"]
    assert abs(ic - 0.2) < 0.03


def test_scorecard_outcomes(spark):
    s = generators.strategy(spark, n_trades=400, win_rate=0.6, payoff=2.5)
    good = spark.createDataFrame([(a, True) for a in execution.AUDITS], "key string, passed boolean")
    scored = scorecard.evaluate(s.trades, s.daily, good, None, order=("idx",), reps=200, paths=100)
    assert scored.count() == 26
    gates = scorecard.gate_table(scored).cache()
    by = {r["gate"]: r for r in gates.collect()}
    assert by[0]["passed"] and by[1]["passed"] and not by[3]["passed"]  # no matrix: overfitting not shown
    assert scorecard.verdict(gates).first()["verdict"] == "RESERVATIONS" and 0 < scorecard.composite(gates).first()["score"] < 1
    missing = scorecard.gate_table(scorecard.evaluate(s.trades, s.daily, good.limit(7), None, order=("idx",), reps=20, paths=20)).cache()
    assert scorecard.verdict(missing).first()["verdict"] == "REJECTED" and scorecard.composite(missing).first()["score"] == 0.0
    gates.unpersist()
    missing.unpersist()


def test_csv_sources(spark, tmp_path):
    text = ",".join(published.RESULT_COLUMNS) + "\nA,100,0.1,0.05,0.05,0.02,1.5,0,0.1,0.5,0.1,1,-0.1,0.3,5,0\nB,300,0.2,0.05,0.15,0.03,2.0,0,0.1,0.5,0.1,1,-0.1,0.3,5,1\namostra-cheia,400,0.17,,,0.04,2.5,,,,,,,,,0\n"
    (tmp_path / "r.csv").write_text(text)
    results = published.load_results(spark, str(tmp_path / "r.csv"))
    assert published.windows(results).count() == 2 and published.windows(results, True).count() == 3
    assert published.reserved(results).first()["janela"] == "B" and published.full_sample(results).first()["beta"] is None
    assert published.weighted_cagr(published.windows(results)).first()["cagr"] == pytest.approx(math.exp((100 * math.log(1.1) + 300 * math.log(1.2)) / 400) - 1)
    assert published.headline(results).first()["headline"] == "Full sample: excess +4.00% (t = 2.50). Reserved window: +3.00% (t = 2.00)."
    (tmp_path / "p.csv").write_text("\ufeffticker,nota,peso\n petr4 ,,0.3\nvale3,ok,0.2\nCAIXA,,0.5\n", encoding="utf-8")
    card = published.portfolio_card(published.load_portfolio(spark, str(tmp_path / "p.csv"))).orderBy("ord").collect()
    assert [(r["ticker"], r["weight"]) for r in card] == [("PETR4", 0.3), ("VALE3", 0.2), ("CAIXA", 0.5)]
    for bad in ("ticker,nota,peso,extra\nA,,1,2\n", "ticker,nota,peso\nA,,1\n"):
        (tmp_path / "b.csv").write_text(bad)
        with pytest.raises(ValueError):
            published.load_portfolio(spark, str(tmp_path / "b.csv"))
    for bad in ("ticker,nota,peso\nA,MoS 18%,0.5\nCAIXA,,0.5\n", "ticker,nota,peso\nA,,0.2\nCAIXA,,0.5\n"):
        (tmp_path / "c.csv").write_text(bad)
        with pytest.raises(ValueError):
            published.portfolio_card(published.load_portfolio(spark, str(tmp_path / "c.csv")))


def test_programme(spark, tmp_path):
    s = generators.strategy(spark)
    pieces = programme.catalogue(s.daily, generators.benchmark(s.daily), reps=50)
    manifest = programme.run(spark, pieces, f"file://{tmp_path}/out")
    listed = spark.read.json(f"file://{tmp_path}/out/manifest").collect()
    assert len(listed) == manifest.count() == 5
    for r in listed:
        assert spark.read.parquet(r["path"]).columns == list(r["columns"])
    with pytest.raises(ValueError):
        programme.run(spark, {"x": programme.Piece("Hot Signals today", dict)}, f"file://{tmp_path}/no")
    assert not (tmp_path / "no").exists()


def test_nothing_outside_needs_llm():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "edgeproof"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert ".llm" not in f.read_text() and "import llm" not in f.read_text()
