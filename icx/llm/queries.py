"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icx.llm import ann, audit, decontaminate, fim, mix, pii, quality, shard, simjoin, suffixdedup, tokcount, tokenbin, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("key")


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.sharded(table(spark, sf_dir, "documents"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents")).withColumn("kinds", F.array_join("kinds", ","))


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixed_copies(table(spark, sf_dir, "documents")).drop("copies", "key")


def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.joined(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokcount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.verdicts(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.deduplicated(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.searched(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_string_tiling": op1_string_tiling,
    "op2_quality_rules": op2_quality_rules,
    "op3_histogram_shards": op3_histogram_shards,
    "op4_surrogates": op4_surrogates,
    "op5_token_codes": op5_token_codes,
    "op6_source_mix": op6_source_mix,
    "op7_jaccard_components": op7_jaccard_components,
    "op8_token_counts": op8_token_counts,
    "op9_url_rules": op9_url_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality.SQL,
    "op7_jaccard_components": simjoin.SQL,
    "op9_url_rules": urlfilter.SQL,
    "op10_suffix_dedup": suffixdedup.SQL,
    "op11_filter_audit": audit.SQL,
    "op12_nearest_neighbours": ann.SQL,
    "op13_fill_in_middle": fim.SQL,
}
