"""Pivot (transitivity) study: JOIN-1, SMP-3, PRM-11..16.

`misaligned` draws, for every row i, one row j whose key (pivot or source text)
differs from row i's, uniformly over all such rows. Instead of filtering the whole
table per row (O(T^2)) it uses a skip-own-block index:

  * dense index over (key hash, row keys), without the texts: rows sharing a key form one
    contiguous block;
  * per key, (start, cnt) by a partially aggregated group-by;
  * r = hash(row) mod (D - cnt); j = r if r < start else r + cnt  — a uniform draw
    over the D - cnt rows outside the block;
  * one equi-join on j finds the other row's keys, and only then its texts are fetched.

Blocks with more than D / P rows (P shuffle partitions: fewer than P blocks can be that
large) are broadcast, so a hot key never gathers in one task; all others are joined by
key. A row whose key covers the whole table has no valid j; its texts come back null
(kept, so it can be counted).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icx.functions.scripts import language_name
from icx.functions.seeded import u60
from icx.operators.prompts import pivot_prompt
from icx.sources.index import dense_index

VARIANTS = ("I", "II", "III", "IV")
ROW_KEYS = ["sp_id", "pt_id"]


def with_blocks(idx: DataFrame, size: int, key: str) -> DataFrame:
    """Rows of a dense index with `start` and `cnt` of their key's block."""
    parts = int(idx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = idx.groupBy(key).agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("cnt"))
    large = F.col("cnt") * parts > size
    heavy = F.broadcast(blocks.filter(large).select(F.col(key).alias("_k"), "start", "cnt"))  # fewer than `parts` rows
    marked = idx.join(heavy, F.col(key) == F.col("_k"), "left").drop("_k")
    light = marked.filter(F.col("cnt").isNull()).drop("start", "cnt").join(blocks.filter(~large), key)
    return marked.filter(F.col("cnt").isNotNull()).unionByName(light)


def misaligned(triples: DataFrame, key: str, seed: int, row_keys: list[str] = ROW_KEYS) -> DataFrame:
    """Add j_src, j_pivot, j_tgt from a uniformly drawn row with a different `key`."""
    narrow = triples.select(F.md5(key).alias("k"), *row_keys)
    idx, d, _ = dense_index(narrow, ["k", *row_keys], name="idx")
    outside = F.lit(d) - F.col("cnt")
    r = F.when(outside > 0, u60(seed, f"misaligned_{key}", *[F.col(k) for k in row_keys]) % outside)
    drawn = with_blocks(idx, d, "k").withColumn("j", F.when(r < F.col("start"), r).otherwise(r + F.col("cnt"))).select(*row_keys, "j")
    other = idx.select(F.col("idx").alias("j"), *[F.col(k).alias(f"j_{k}") for k in row_keys])
    found = drawn.join(other, "j", "left").drop("j")
    texts = triples.select(*[F.col(c).alias(f"j_{c}") for c in (*row_keys, "src", "pivot", "tgt")])
    full = found.join(texts, [f"j_{k}" for k in row_keys], "left").drop(*[f"j_{k}" for k in row_keys])
    return triples.join(full, row_keys)


def variant_texts(triples: DataFrame, variant: str, seed: int) -> DataFrame:
    """(row keys, src, pivot, tgt) as shown in the prompt for a variant."""
    if variant == "I":
        return triples
    if variant == "II":
        m = misaligned(triples, "pivot", seed)
        return m.select(*ROW_KEYS, "src", F.col("j_pivot").alias("pivot"), "tgt")
    if variant in ("III", "IV"):
        m = misaligned(triples, "src", seed)
        pivot = F.col("j_pivot") if variant == "III" else F.col("pivot")
        return m.select(*ROW_KEYS, "src", pivot.alias("pivot"), F.col("j_tgt").alias("tgt"))
    raise ValueError(f"unknown variant {variant!r}")


def prompts(triples: DataFrame, src_lang: str, pivot_lang: str, tgt_lang: str, variant: str, seed: int,
            chat: bool = False, names: dict | None = None) -> DataFrame:
    s, p, t = (language_name(x, names) for x in (src_lang, pivot_lang, tgt_lang))
    v = variant_texts(triples, variant, seed)
    return v.withColumn("prompt", pivot_prompt(F.col("src"), F.col("pivot"), F.col("tgt"), s, p, t, chat))
