"""CSV sources: published results by window, and a public portfolio with an exact column list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column names of the files as published, and the row of the whole sample.
RESULT_COLUMNS = ("janela", "pregoes", "cagr", "cdi", "excesso", "alpha", "t_alpha", "ic95_inf", "ic95_sup", "beta", "volatilidade", "sharpe", "pior_queda", "caixa_medio", "posicoes", "reservada")
FULL_SAMPLE, CASH = "amostra-cheia", "CAIXA"
PORTFOLIO_COLUMNS = ["ticker", "nota", "peso"]
#: What a position's label must not say.
LABEL_BANNED = ("valor justo", "mos", "margem de seguran", "p50", "upside", "desconto", "grid", "portao", "portão", "manga", "perfil", "subsetor", "score", "filtro", "alvo", "tese")
#: What a title must not say.
TITLE_BANNED = ("trading", "signals", "calls", "alpha", "preço-alvo garantido", "vai explodir", "antes que seja tarde")


def result_schema() -> T.StructType:
    kinds = {"janela": T.StringType(), "pregoes": T.IntegerType(), "reservada": T.IntegerType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.DoubleType()), True) for c in RESULT_COLUMNS])


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(result_schema()).option("header", True).option("enforceSchema", False).csv(path)


def windows(results: DataFrame, include_full: bool = False) -> DataFrame:
    return results if include_full else results.where(F.col("janela") != FULL_SAMPLE)


def reserved(results: DataFrame) -> DataFrame:
    """The reserved window (the first by name, if there were several)."""
    return results.where("reservada = 1").orderBy("janela").limit(1)


def full_sample(results: DataFrame) -> DataFrame:
    return results.where(F.col("janela") == FULL_SAMPLE)


def headline(results: DataFrame) -> DataFrame:
    """One line that contrasts the whole sample with the reserved window."""
    a = full_sample(results).select(F.col("alpha").alias("fa"), F.col("t_alpha").alias("ft"))
    b = reserved(results).select(F.col("alpha").alias("ra"), F.col("t_alpha").alias("rt"))
    text = F.format_string("Full sample: excess %+.2f%% (t = %.2f). Reserved window: %+.2f%% (t = %.2f).", F.col("fa") * 100, "ft", F.col("ra") * 100, "rt")
    return a.crossJoin(b).select(text.alias("headline"))


def weighted_cagr(results: DataFrame, cagr: str = "cagr", sessions: str = "pregoes") -> DataFrame:
    """The sessions-weighted geometric mean of growth."""
    return results.agg((F.exp(F.try_divide(F.sum(F.col(sessions) * F.log1p(cagr)), F.sum(sessions))) - 1).alias("cagr"))


def load_portfolio(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, label, weight, is_cash). Other columns than exactly ticker, nota, peso are an error, as
    is a file without a cash row."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    if [c.lstrip("\ufeff") for c in raw.columns] != PORTFOLIO_COLUMNS:
        raise ValueError(f"columns must be exactly {PORTFOLIO_COLUMNS}, not {raw.columns}")
    raw = raw.toDF(*PORTFOLIO_COLUMNS)
    ticker = F.upper(F.trim("ticker"))
    rows = raw.select(ticker.alias("ticker"), F.coalesce("nota", F.lit("")).alias("label"), F.col("peso").cast("double").alias("weight"), (ticker == CASH).alias("is_cash"))
    if rows.where("is_cash").isEmpty():
        raise ValueError(f"a {CASH} row is needed")
    return rows


def banned_terms(text: Column, terms: tuple[str, ...] = TITLE_BANNED) -> Column:
    """The terms that a text contains, letter case aside."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t))


def check_labels(portfolio: DataFrame) -> DataFrame:
    """Positions whose ticker and label say what they must not: none is good."""
    text = F.concat_ws(" ", "ticker", "label")
    return portfolio.where("not is_cash").withColumn("terms", banned_terms(text, LABEL_BANNED)).where(F.size("terms") > 0)


def portfolio_card(portfolio: DataFrame, tolerance: float = 0.015) -> DataFrame:
    """(ord, ticker, label, weight): positions by weight, cash last. Weights that don't sum to 1 and
    banned labels are errors."""
    total = portfolio.agg(F.sum("weight").alias("s")).first()["s"]
    if total is None or abs(total - 1) > tolerance:
        raise ValueError(f"weights sum to {total}")
    if bad := check_labels(portfolio).limit(1).collect():
        raise ValueError(f"label of {bad[0]['ticker']} contains {bad[0]['terms']}")
    from pyspark.sql import Window

    order = F.row_number().over(Window.orderBy("is_cash", F.col("weight").desc(), "ticker"))  # a portfolio's few rows
    return portfolio.select(order.alias("ord"), "ticker", "label", "weight")
