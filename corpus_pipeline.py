"""From raw documents to sharded training data: quality, near duplicates, leaks, mix, shards.

Defined cases, in every stage: null texts and ids, repeated rows, empty and very long texts and
empty tables as its operator states them; extra columns are passed on, whatever their names,
by all stages but the last, which returns the sharded rows with text, lang and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from icx.llm import decontaminate, mix, quality, shard, simjoin
from icx.llm.common import written

#: Words of a shingle and per cent of shared shingles from which two documents are near duplicates.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    return simjoin.one_of_each(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix.mixture(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, with its text, lang and source."""
    return shard.sharded(docs, carry=("text", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The mix draws documents by hashed chance, which SQL cannot express.
ORACLE_SQL = None
