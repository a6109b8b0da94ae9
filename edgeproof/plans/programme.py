"""A publishing job: named frames are checked, written, and listed in a manifest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import PERIODS
from ..operators import evidence, execution, ordered, resample, risk
from ..sources import published


@dataclass(frozen=True)
class Piece:
    """One publication: its title and the frames it shows."""

    title: str
    frames: Callable[[], dict[str, DataFrame]]


def growth(daily: DataFrame, reference: DataFrame) -> DataFrame:
    """Compound growth of a strategy and its reference, and the arithmetic mean a year."""
    a = daily.agg(risk.cagr(F.col("ret")).alias("cagr"), (F.avg("ret") * PERIODS).alias("arithmetic"))
    return a.crossJoin(reference.agg(risk.cagr(F.col("bench")).alias("reference_cagr")))


def pain(daily: DataFrame) -> DataFrame:
    """Maximum drawdown, time under water, ulcer index and the number of episodes."""
    frame = ordered.drawdown(daily, "ret", ("ts",))
    one = frame.agg(risk.max_drawdown(F.col("dd")).alias("max_drawdown"), risk.time_under_water(F.col("dd")).alias("time_under_water"), risk.ulcer_index(F.col("dd")).alias("ulcer_index"))
    return one.crossJoin(risk.drawdown_episodes(frame).agg(F.count("*").alias("episodes"), F.count("recovery").alias("closed")))


def ratios(daily: DataFrame) -> DataFrame:
    frame, r = ordered.drawdown(daily, "ret", ("ts",)), F.col("ret")
    return frame.agg(risk.sharpe(r).alias("sharpe"), risk.sortino(r).alias("sortino"), risk.calmar(r, F.col("dd")).alias("calmar"))


def excess(daily: DataFrame, reference: DataFrame, reps: int = 10_000, seed: int = 0) -> DataFrame:
    """Excess and beta against the reference, with a resampled interval of the mean return."""
    base = resample.indexed(daily.withColumnRenamed("ret", "r"), ("ts",))
    return execution.beta_alpha(daily.join(reference, "ts")).crossJoin(evidence.bootstrap_ci(base, reps=reps, seed=seed))


#: What published results do not say; where a floor was measured, the change of compound
#: growth that interventions without economic content made.
CAVEATS = (
    ("historical simulation", "no account was traded", None), ("survivorship", "the universe favours what is left", None), ("noise floor of recomposition", "a smaller difference says nothing", 0.005), ("noise floor of cached calculations", "a smaller difference says nothing", 0.024),
    ("sector exposure", "part of the excess is not selection", None), ("choice among candidates", "overfitting is likely, so the reserved window counts", None),
)


def caveats(spark: SparkSession) -> DataFrame:
    """(ord, caveat, effect, floor) beside any published result."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CAVEATS, 1)], "ord int, caveat string, effect string, floor double")


def catalogue(daily: DataFrame, reference: DataFrame, results: DataFrame | None = None, reps: int = 10_000) -> dict[str, Piece]:
    """The usual pieces; those about published results need the results."""
    out = {
        "m01": Piece("Compound growth and the mean", lambda: {"growth": growth(daily, reference)}),
        "m02": Piece("Drawdown", lambda: {"pain": pain(daily), "episodes": risk.drawdown_episodes(ordered.drawdown(daily, "ret", ("ts",)))}),
        "m03": Piece("Three ratios", lambda: {"ratios": ratios(daily)}),
        "m04": Piece("Excess over a reference", lambda: {"excess": excess(daily, reference, reps)}),
    }
    if results is not None:
        out["r00"] = Piece("Results, all windows", lambda: {"cagr": published.weighted_cagr(published.windows(results))})
        out["r01"] = Piece("Results by window", lambda: {"windows": published.windows(results)})
        out["r02"] = Piece("What the results do not say", lambda: {"caveats": caveats(results.sparkSession)})
    return out


def run(spark: SparkSession, pieces: dict[str, Piece], path: str) -> DataFrame:
    """Write every frame to path/piece/frame and the manifest (piece, title, frame, columns, path) to
    path/manifest as JSON. A title with a banned term stops the job before anything is written."""
    titles = spark.createDataFrame([(k, p.title) for k, p in pieces.items()], "piece string, title string")
    bad = titles.withColumn("terms", published.banned_terms(F.col("title"))).where(F.size("terms") > 0).collect()
    if bad:
        raise ValueError(f"title of {bad[0]['piece']} contains {bad[0]['terms']}")
    rows = []
    for key, piece in pieces.items():
        for name, frame in piece.frames().items():
            target = f"{path}/{key}/{name}"
            frame.write.mode("overwrite").parquet(target)
            rows.append((key, piece.title, name, frame.columns, target))
    manifest = spark.createDataFrame(rows, "piece string, title string, frame string, columns array<string>, path string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest
