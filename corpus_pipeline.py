"""A corpus pipeline of the training-data operators, stage by stage.

Each stage gets what its predecessor kept, as read back from Parquet, and returns documents with
the same columns; the last one returns packed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeproof.llm import decontaminate, mixing, neardup, packing, toxicity
from edgeproof.llm.common import cut, sweep, table, written
from edgeproof.llm.queries import toxic_field


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxic-span field scores 0.3 or more go."""
    return toxicity.keep_clean(docs, toxic_field(spark, sf_dir, docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    return mixing.realise(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("packing", pack_tokens)]

#: The trained stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(spark, docs, before)  # what the stage wrote on its way, and the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
