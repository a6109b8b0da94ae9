"""The six gates, the verdict, and the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import clean
from . import evidence, execution, generalization, ordered, resample, risk, trade

#: Gate, its name, whether failing it decides, and each criterion's comparison and limit
#: (a limit of None is an argument).
GATES = ((0, "integrity", True), (1, "edge", True), (2, "evidence", False), (3, "generalization", False), (4, "survival", False), (5, "execution", False))
LIMITS = (
    (1, "expectancy", ">=", 0.0), (1, "profit_factor", ">=", 1.2), (1, "edge_margin", ">=", 0.02), (1, "cost_margin", ">=", 2.0),
    (2, "newey_west_t", ">=", 2.0), (2, "ci_low", ">=", 0.0), (2, "p_positive", ">=", 0.95), (2, "n_eff", ">=", 100.0),
    (3, "oos_ratio", ">=", 0.5), (3, "walk_forward_efficiency", ">=", 0.5), (3, "positive_windows", ">=", 0.6), (3, "pbo", "<=", 0.5),
    (4, "max_drawdown", ">=", None), (4, "mdd_p95", ">=", None), (4, "risk_of_ruin", "<=", 0.01), (4, "sortino", ">=", 0.5),
    (5, "retention_at_double_cost", ">=", 0.5), (5, "expectancy_at_double_cost", ">=", 0.0),
)


def passed(value: Column, cmp: Column, limit: Column) -> Column:
    """>=, <= or bool (value 1); an undefined value fails."""
    test = F.when(cmp == ">=", value >= limit).when(cmp == "<=", value <= limit).otherwise(value == 1)
    return F.coalesce(~F.isnan(value) & test, F.lit(False))


def criteria(values: DataFrame, limits: DataFrame) -> DataFrame:
    """(gate, ord, criterion, value, cmp, limit, passed): values(criterion, value) against limits."""
    both = limits.join(values, "criterion", "left")
    return both.select("gate", "ord", "criterion", "value", "cmp", "limit", passed(F.col("value"), F.col("cmp"), F.col("limit")).alias("passed"))


def limits_table(spark: SparkSession, mdd_tolerance: float = -0.3) -> DataFrame:
    rows = [(g, i + 1, c, op, float(mdd_tolerance if x is None else x)) for i, (g, c, op, x) in enumerate(LIMITS)]
    return spark.createDataFrame(rows, "gate int, ord int, criterion string, cmp string, limit double")


def evaluate(trades: DataFrame, daily: DataFrame, integrity: DataFrame, matrix: DataFrame | None = None, expected_cost: float = 0.05, mdd_tolerance: float = -0.3, r: str = "r", order: tuple[str, ...] = ("ts",), block: str | None = None, ret: str = "ret", reps: int = 10_000, paths: int = 5_000, n_trades: int | None = None, seed: int = 0) -> DataFrame:
    """All 26 criteria of trades(r), daily(ts, ret), integrity(key, passed) and a matrix(t, config,
    ret) of configurations; without a matrix the overfitting criterion fails.

    Each frame gives a row of values. The trades are put in order once and kept, as ten frames read them;
    the two bootstrap criteria share one distribution, and both simulated criteria of survival share
    their paths. Fewer than 60 trades is an error.
    """
    spark = trades.sparkSession
    base = resample.indexed(clean(trades, r).select(r, *order, *([block] if block else [])), order, block).select("idx", r).persist()
    x = F.col(r)
    edge = base.agg(
        trade.expectancy(x).alias("expectancy"), trade.profit_factor(x).alias("profit_factor"), trade.edge_margin(x).alias("edge_margin"), execution.cost_safety_margin(x, expected_cost).alias("cost_margin"),
        F.try_divide(F.avg(x) - 2 * expected_cost, F.avg(x)).alias("retention_at_double_cost"), (F.avg(x) - 2 * expected_cost).alias("expectancy_at_double_cost"),
    )
    dist = resample.distribution(base, r, "mean", reps, seed)
    boot = dist.agg(F.percentile("value", 0.025).alias("ci_low"), F.avg((F.col("value") > 0).cast("double")).alias("p_positive"))
    hac = evidence.newey_west_t(base, r).select(F.col("t").alias("newey_west_t"))
    neff = evidence.effective_sample_size(base, r)
    oos = generalization.oos_ratio(base, r).select(F.col("ratio").alias("oos_ratio"))
    wf = generalization.walk_forward_efficiency(base, r).select(F.col("efficiency").alias("walk_forward_efficiency"), F.col("positive").alias("positive_windows"))
    pbo = generalization.pbo_cscv(matrix).select("pbo") if matrix is not None else spark.range(1).select(F.lit(None).cast("double").alias("pbo"))
    frame = ordered.drawdown(clean(daily, ret), ret, ("ts",))
    survival = frame.agg(F.min("dd").alias("max_drawdown"), risk.sortino(F.col(ret)).alias("sortino"))
    simulated = risk.survival(base, r, n_trades=n_trades, n_ruin=n_trades or 500, n_sim=paths, seed=seed)
    values = None
    for frame_ in (edge, boot, hac, neff, oos, wf, pbo, survival, simulated):
        one = frame_.select(F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("value")) for c in frame_.columns))).alias("x")).select("x.*")
        values = one if values is None else values.unionByName(one)
    audit = execution.integrity_audit(spark, integrity).select(F.lit(0).alias("gate"), "ord", F.col("audit").alias("criterion"), F.when(F.col("status") != "NOT AUDITED", F.col("passed").cast("double")).alias("value"), F.lit("bool").alias("cmp"), F.lit(1.0).alias("limit"), "passed")
    return audit.unionByName(criteria(values, limits_table(spark, mdd_tolerance)))


#: What each criterion says, for the printed table.
NOTES = {
    "expectancy": "mean result of a trade, after costs", "profit_factor": "gross profit over gross loss", "edge_margin": "win rate above what the payoff needs to break even", "cost_margin": "how many times the expected cost the mean result bears",
    "newey_west_t": "t of the mean, robust to autocorrelation", "ci_low": "lower end of the 95 % bootstrap interval of the mean", "p_positive": "share of bootstrap means above zero", "n_eff": "observations left after autocorrelation",
    "oos_ratio": "out of sample over in sample", "walk_forward_efficiency": "mean test over mean train window", "positive_windows": "share of test windows above zero", "pbo": "probability that the champion is overfitted, by symmetric cross-validation",
    "max_drawdown": "deepest fall seen, against the tolerated one", "mdd_p95": "fall that 5 % of resampled orders exceed", "risk_of_ruin": "share of resampled paths that lose half of the capital", "sortino": "yearly return over downside deviation",
    "retention_at_double_cost": "share of the mean result left at twice the cost", "expectancy_at_double_cost": "mean result at twice the cost",
}


def notes(spark: SparkSession) -> DataFrame:
    """(criterion, note): what each criterion says; of an audit, the question that it answers."""
    return spark.createDataFrame([*NOTES.items(), *execution.AUDITS.items()], "criterion string, note string")


def gate_table(scored: DataFrame) -> DataFrame:
    """(gate, name, decisive, criteria, rate, passed); a gate without criteria fails."""
    spark = scored.sparkSession
    names = spark.createDataFrame(list(GATES), "gate int, name string, decisive boolean")
    rates = scored.groupBy("gate").agg(F.count("*").alias("criteria"), F.avg(F.col("passed").cast("double")).alias("rate"), F.bool_and("passed").alias("passed"))
    return names.join(rates, "gate", "left").select("gate", "name", "decisive", F.coalesce("criteria", F.lit(0)).alias("criteria"), F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("passed", F.lit(False)).alias("passed"))


def table(*scored: DataFrame) -> DataFrame:
    """All criteria of several evaluations, with what was found as text and what each one says."""
    out = scored[0]
    for s in scored[1:]:
        out = out.unionByName(s)
    told = out.withColumn("status", F.when(F.col("passed"), F.lit("PASS")).otherwise(F.lit("FAIL")))
    return told.join(F.broadcast(notes(told.sparkSession)), "criterion", "left").select(*told.columns, "note")  # 26 fixed rows


def verdict(gates: DataFrame) -> DataFrame:
    """verdict and the failed gates: REJECTED if a decisive gate fails, APPROVED if none fails, else
    RESERVATIONS."""
    bad = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate"))))  # six rows at most
    one = gates.agg(F.bool_or(~F.col("passed") & F.col("decisive")).alias("out"), F.bool_and("passed").alias("all"), bad.alias("bad"))
    return one.select(F.when(F.col("out"), F.lit("REJECTED")).when(F.col("all"), F.lit("APPROVED")).otherwise(F.lit("RESERVATIONS")).alias("verdict"), F.array_join(F.transform("bad", lambda g: g.cast("string")), ",").alias("failed_gates"))


def composite(gates: DataFrame) -> DataFrame:
    """0 if a decisive gate fails, else the mean of the gates' rates."""
    return gates.agg(F.when(F.bool_or(~F.col("passed") & F.col("decisive")), F.lit(0.0)).otherwise(F.avg("rate")).alias("score"))
