"""Live trades as a stream: windowed metrics, interval breaches, and a kill switch with state.

A stream has columns strategy, ts and r. Windows are of time, not of rows. Every function also
takes a static table, which gives the same rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import trade


def windowed_metrics(live: DataFrame, length: str = "30 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """(strategy, start, end, n, expectancy, profit_factor) by sliding window of time."""
    x = F.col("r")
    rows = live.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if live.isStreaming else live
    out = rows.groupBy("strategy", F.window("ts", length, slide).alias("w")).agg(F.count(x).alias("n"), trade.expectancy(x).alias("expectancy"), trade.profit_factor(x).alias("profit_factor"))
    return out.select("strategy", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "expectancy", "profit_factor")


def breaches(live: DataFrame, intervals: DataFrame) -> DataFrame:
    """Live rows with whether they breach their strategy's interval (low, high): a stream-static join."""
    return live.join(intervals, "strategy", "left").withColumn("breach", ~F.col("r").between(F.col("low"), F.col("high")))


_OUT = "strategy string, n long, expectancy double, max_drawdown double, trigger boolean"
_STATE = "n long, total double, capital double, peak double, low double"


def kill_switch(live: DataFrame, mdd_limit: float = -0.2, least: int = 30, expectancy_limit: float = 0.0, fraction: float = 0.01) -> DataFrame:
    """One row a strategy and micro-batch: its state over all it has seen, and the trigger.

    State is five numbers a strategy. Rows of a batch are taken in order of time, then of result; what comes in a
    later batch is taken later, whatever its time.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, capital, peak, low = state.get if state.exists else (0, 0.0, 1.0, float("-inf"), 0.0)
        # What comes in a batch is put in time order whole: a strategy's rows of one micro-batch, whose
        # size the trigger bounds.
        r = pd.concat(list(frames)).sort_values(["ts", "r"], kind="stable")["r"].dropna().to_numpy(dtype=float)
        if len(r):
            curve = capital * np.cumprod(1 + r * fraction)
            peaks = np.maximum(np.maximum.accumulate(curve), peak)
            n, total, capital, peak, low = n + len(r), total + float(r.sum()), float(curve[-1]), float(peaks[-1]), min(low, float((curve / peaks - 1).min()))
        state.update((n, total, capital, peak, low))
        mean = total / n if n else None
        yield pd.DataFrame({"strategy": [key[0]], "n": [n], "expectancy": [mean], "max_drawdown": [low], "trigger": [low <= mdd_limit or (n >= least and mean is not None and mean < expectancy_limit)]})

    return live.groupBy("strategy").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
