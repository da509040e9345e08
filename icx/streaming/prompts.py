"""Stateless few-shot prompt composition over a streaming test table.

The demonstration draw depends only on (seed, row key, pool size), and fetching the
demonstrations is k equi-joins against the static, indexed pool (broadcast while the
measured pool is below the broadcast threshold, else by shuffle) — no aggregation and no
state, so every micro-batch is independent and replays give the
same prompts. Runs with `trigger(availableNow=True)` into a file sink whose
checkpoint lives in the cluster's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icx.operators import demos as D
from icx.operators import prompts as P
from icx.sources.io import scratch_dir


def stream_few_shot(test_stream: DataFrame, pool: D.Pool, k: int, seed: int, src_lang: str, tgt_lang: str,
                    kind: str = "standard") -> DataFrame:
    drawn = D.draw(test_stream, "row_id", pool.size, k, seed)
    with_demos = D.attach(drawn, pool, k, force="broadcast" if pool.broadcastable() else "joins")
    return P.few_shot(with_demos, src_lang, tgt_lang, kind=kind, seed=seed).select(
        "row_id", "prompt", F.col("tgt").alias("reference")
    )


def run_available_now(spark: SparkSession, test_dir: str, schema: str, pool: D.Pool, k: int, seed: int,
                      src_lang: str, tgt_lang: str, out_dir: str | None = None) -> DataFrame:
    """Process every file present in `test_dir` once; returns the written prompts (batch read)."""
    out_dir = out_dir or scratch_dir(spark, "stream-out")
    pool = pool.fixed()
    stream = spark.readStream.schema(schema).parquet(test_dir)
    q = (
        stream_few_shot(stream, pool, k, seed, src_lang, tgt_lang)
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", out_dir + "-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(out_dir)
