"""Per-trade metrics: aggregate columns over a column of trade results.

Each function returns an aggregate expression, so any set of them is one pass, for the whole table
or by any grouping: df.groupBy("strategy").agg(trade.expectancy(r), trade.win_rate(r)).
Use semantics.clean first; zeros are neither wins nor losses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import clean, gain_over_loss, mean_where, ratio, share, tall
from . import ordered


def expectancy(r: Column) -> Column:
    """Mean result."""
    return F.avg(r)


def expectancy_of_risk(pnl: Column, risk: Column) -> Column:
    """Mean of profit over initial risk; rows without risk are left out."""
    return F.avg(ratio(pnl, risk))


def win_rate(r: Column) -> Column:
    return share(r > 0)


def loss_rate(r: Column) -> Column:
    """Share of losses; with zeros this is not 1 - win rate."""
    return share(r < 0)


def average_winner(r: Column) -> Column:
    return mean_where(r, r > 0)


def average_loser(r: Column) -> Column:
    """Mean of the losses, a negative number."""
    return mean_where(r, r < 0)


def payoff_ratio(r: Column) -> Column:
    return ratio(average_winner(r), F.abs(average_loser(r)))


def break_even_win_rate(r: Column) -> Column:
    """L / (W + L) of the mean win and the mean loss."""
    loss = F.abs(average_loser(r))
    return ratio(loss, average_winner(r) + loss)


def edge_margin(r: Column) -> Column:
    return win_rate(r) - break_even_win_rate(r)


def profit_factor(r: Column) -> Column:
    """Gross profit over gross loss; infinite without losses, NULL with neither."""
    return gain_over_loss(F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(-F.sum(F.when(r < 0, r)), F.lit(0.0)))


def median_trade(r: Column) -> Column:
    return F.median(r)


def largest_winner(r: Column) -> Column:
    return F.max(r)


def largest_loser(r: Column) -> Column:
    return F.min(r)


def skewness(r: Column) -> Column:
    """Population skewness of at least 3 rows that vary."""
    return F.when((F.count(r) >= 3) & (F.stddev_pop(r) > 0), F.skewness(r))


def excess_kurtosis(r: Column) -> Column:
    """Population excess kurtosis of at least 4 rows that vary."""
    return F.when((F.count(r) >= 4) & (F.stddev_pop(r) > 0), F.kurtosis(r))


def tail_ratio(r: Column, q: float = 0.05) -> Column:
    """Upper over lower quantile in size; NULL under 20 rows."""
    return F.when(F.count(r) >= 20, ratio(F.percentile(r, 1 - q), F.abs(F.percentile(r, q))))


def iqr(r: Column) -> Column:
    return F.percentile(r, 0.75) - F.percentile(r, 0.25)


def mad(df: DataFrame, r: str = "r", by: tuple[str, ...] = ()) -> DataFrame:
    """Median distance from the median: by..., mad. The medians are one row a group; those of a whole
    table of any size come from ordered.exact_quantiles."""
    if not by:
        centre = ordered.exact_quantiles(df, r, (0.5,))[0]
        away = df.select(F.abs(F.col(r) - F.lit(centre)).alias("away"))
        return df.sparkSession.createDataFrame([(None if centre is None else ordered.exact_quantiles(away, "away", (0.5,))[0],)], "mad double")
    centre = df.groupBy(*by).agg(F.median(r).alias("__m"))
    joined = df.join(centre, list(by))
    return joined.groupBy(*by).agg(F.median(F.abs(F.col(r) - F.col("__m"))).alias("mad"))


SUMMARY = {
    "expectancy": expectancy, "win_rate": win_rate, "loss_rate": loss_rate, "payoff": payoff_ratio,
    "break_even_win_rate": break_even_win_rate, "edge_margin": edge_margin, "profit_factor": profit_factor, "average_winner": average_winner,
    "average_loser": average_loser, "median": median_trade, "largest_winner": largest_winner, "largest_loser": largest_loser,
    "skewness": skewness, "excess_kurtosis": excess_kurtosis, "tail_ratio": tail_ratio, "iqr": iqr,
}


#: Of the summary, what comes from one list of quantiles instead of a percentile each.
_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


def summary(df: DataFrame, r: str = "r", by: tuple[str, ...] = ()) -> DataFrame:
    """The whole chapter: (by..., ord, metric, value). One aggregation, and the quantiles and the MAD: by
    group from one list of values, of a whole table from ordered.exact_quantiles."""
    rows, x = clean(df, r), F.col(r)
    plain = [f(x).alias(k) for k, f in SUMMARY.items() if f not in (median_trade, tail_ratio, iqr)]
    q = lambda i: F.col("__q")[i]
    if by:
        found = F.percentile(x, F.array(*map(F.lit, _PROBS)))
    else:
        found = F.array(*(F.lit(v).cast("double") for v in ordered.exact_quantiles(rows, r, _PROBS)))
    one = rows.groupBy(*by).agg(*plain, F.count(x).alias("__n"), *([found.alias("__q")] if by else []))
    one = one if by else one.withColumn("__q", found)
    one = one.withColumns({"median": q(2), "iqr": q(3) - q(1), "tail_ratio": F.when(F.col("__n") >= 20, ratio(q(4), F.abs(q(0))))})
    other = mad(rows, r, by)
    both = one.join(other, list(by)) if by else one.crossJoin(other)
    return tall(both, [*SUMMARY, "mad"], by)
