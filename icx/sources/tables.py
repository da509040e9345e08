"""Parallel-text views over the given tables.

The studied code reads pair files `{sentence_A, sentence_B}`; here the same shapes are
derived from the `conversations` and `documents` tables so that every query's work
grows with the data:

  pairs      (row_id, src, tgt, split)   user turn t -> assistant turn t+1
  aux_pairs  (row_id, src, tgt, split)   assistant turn t -> user turn t+1
  triples    (sp_id, pt_id, src, pivot, tgt)  pairs joined with aux_pairs on the pivot text
  lines      (row_id, text, lang, code)  one document per row
  sentences  (row_id, code, text)        documents numbered per language

Joins are on composite keys (conversation, turn), so one very long conversation is
spread over many tasks instead of landing in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icx.sources.index import stored_index

# Two-letter codes of `documents.lang` and their lang_Script codes.
DOC_LANG_CODES = {
    "ar": "arb_Arab", "bg": "bul_Cyrl", "bn": "ben_Beng", "cs": "ces_Latn", "da": "dan_Latn", "de": "deu_Latn",
    "el": "ell_Grek", "en": "eng_Latn", "es": "spa_Latn", "fi": "fin_Latn", "fr": "fra_Latn", "gu": "guj_Gujr",
    "he": "heb_Hebr", "hi": "hin_Deva", "hu": "hun_Latn", "id": "ind_Latn", "it": "ita_Latn", "ja": "jpn_Jpan",
    "kn": "kan_Knda", "ko": "kor_Hang", "ml": "mal_Mlym", "mr": "mar_Deva", "nl": "nld_Latn", "pa": "pan_Guru",
    "pl": "pol_Latn", "pt": "por_Latn", "ro": "ron_Latn", "ru": "rus_Cyrl", "si": "sin_Sinh", "sv": "swe_Latn",
    "ta": "tam_Taml", "te": "tel_Telu", "th": "tha_Thai", "tr": "tur_Latn", "uk": "ukr_Cyrl", "ur": "urd_Arab",
    "vi": "vie_Latn", "zh": "zho_Hans",
}

TEST_EVERY = 4  # conversations with conv_id % 4 == 0 form the test split


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TURN_BITS = 20


def turn_key(conv_id, turn):
    """One bigint per (conversation, turn): the turn takes the lower 20 bits.

    Ids outside what 63 bits can hold fail the job instead of meeting another row's key.
    """
    fits = (turn >= 0) & (turn < 1 << TURN_BITS) & (conv_id >= 0) & (conv_id < 1 << (63 - TURN_BITS))
    wrong = F.raise_error(F.concat(F.lit("no key for conversation and turn "), F.concat_ws(", ", conv_id.cast("string"), turn.cast("string"))))
    return F.when(fits, conv_id * (1 << TURN_BITS) + turn).otherwise(wrong.cast("bigint"))


def _turn_pairs(conv: DataFrame, first_role: str, second_role: str) -> DataFrame:
    a = conv.filter(F.col("role") == first_role).select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("text").alias("src")
    )
    b = conv.filter(F.col("role") == second_role).select(
        F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("text").alias("tgt")
    )
    j = a.join(b, (F.col("c") == F.col("c2")) & (F.col("t") + 1 == F.col("t2")), "inner")
    return j.select(
        turn_key(F.col("c"), F.col("t")).alias("row_id"),
        "src",
        "tgt",
        F.when(F.col("c") % TEST_EVERY == 0, F.lit("test")).otherwise(F.lit("dev")).alias("split"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user turn -> next assistant turn."""
    return _turn_pairs(read(spark, sf_dir, "conversations"), "user", "assistant")


def aux_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assistant turn -> next user turn (the 'other originality' / allied pool)."""
    return _turn_pairs(read(spark, sf_dir, "conversations"), "assistant", "user")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source->pivot pairs joined with pivot->target pairs on the pivot text (JOIN-1).

    Duplicate pivot texts multiply rows, as an inner equi-join on text does. Hot pivot
    texts are split by AQE's skew-join handling.
    """
    sp = pairs(spark, sf_dir).select(F.col("row_id").alias("sp_id"), "src", F.col("tgt").alias("pivot"))
    pt = aux_pairs(spark, sf_dir).select(F.col("row_id").alias("pt_id"), F.col("src").alias("pivot2"), "tgt")
    return sp.join(pt, sp.pivot == pt.pivot2, "inner").select("sp_id", "pt_id", "src", "pivot", "tgt")


def lang_code_col(lang):
    """lang_Script code of a language column.

    A two-letter code is looked up, a code that already names its script stays, and any
    other value becomes a language of its own in the undetermined script (`xx_Zyyy`;
    a null one is `und_Zyyy`), so no row is lost: `unknown_languages` reports those.
    """
    known = F.create_map(*[F.lit(x) for kv in DOC_LANG_CODES.items() for x in kv])
    lang = F.coalesce(lang, F.lit("und"))
    return F.coalesce(known[lang], F.when(lang.rlike("^[a-z]{3}_[A-Z][a-z]{3}$"), lang), F.concat(lang, F.lit("_Zyyy")))


def spread(df: DataFrame, *keys: str, basis: DataFrame | None = None) -> DataFrame:
    """Hash-spread rows over the cluster when the source scan yields fewer splits than cores.

    Per-row text operators cost CPU per character; a corpus stored as one large row
    group would otherwise run in a single task. On a large corpus the scan already has
    many more splits than cores and nothing is shuffled. The decision looks at the
    split count of `basis` (a plain scan; defaults to `df`), which needs no job.
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    if (basis if basis is not None else df).rdd.getNumPartitions() >= par:
        return df
    return df.repartition(2 * par, *keys)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    out = d.select(F.col("doc_id").alias("row_id"), "text", "lang", lang_code_col(F.col("lang")).alias("code"))
    return spread(out, "row_id")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents numbered 0.. within each language (the key of a multilingual table).

    A per-language `row_number` window would put the largest language into one task;
    a global dense index over (code, doc_id) minus each language's first index gives
    the same numbers with range-partitioned work.
    """
    d = read(spark, sf_dir, "documents").select(
        "doc_id", lang_code_col(F.col("lang")).alias("code"), "text"
    )
    idx = stored_index(d, ["code", "doc_id"], name="gidx")
    first = idx.groupBy("code").agg(F.min("gidx").alias("first"))
    return idx.join(F.broadcast(first), "code").select(
        (F.col("gidx") - F.col("first")).alias("row_id"), "code", "text"
    )
