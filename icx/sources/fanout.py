"""Corpus fan-out (SRC-1) and the pair-split catalogue (SRC-7).

A multilingual table (row_id, code, text) becomes one pair table per ordered language
pair: sentences of the wanted languages are gathered by row id, which every language has once at
most, and paired inside the row; the wanted pairs (bounded by the language list, broadcast) are
kept. Each text is exchanged once and kept in a checkpoint, whatever the number of pairs, waves and
tries; rows in one language only have no pair and are left out before. A pair whose target is missing simply has no rows, and `missing_pairs`
reports wanted pairs without any row. `write_fan_out` writes the pairs in a way that can be
started again: finished pairs are not written twice, and one that fails leaves the others.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icx.session import ensure_checkpoint_dir

# Dataset short names and split-name maps.
DATASET_SHORT = {"facebook/flores": "flores", "ai4bharat/IN22-Gen": "in22"}
SPLITS = {"facebook/flores": {"dev": "dev", "test": "devtest"}, "ai4bharat/IN22-Gen": {"test": "gen"}}

PAIR = ["src_lang", "tgt_lang"]


def gathered(sentences: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row_id, in_all: array<struct<code, text>>) of the rows that have a wanted pair's languages; no row in one language only."""
    spoken = wanted.select(F.explode(F.array(*PAIR)).alias("code")).distinct()
    own = sentences.filter(F.col("row_id").isNotNull()).join(F.broadcast(spoken), "code", "left_semi")
    rows = own.groupBy("row_id").agg(F.collect_list(F.struct("code", "text")).alias("in_all"))
    if wanted.filter(F.col("src_lang") == F.col("tgt_lang")).isEmpty():  # else a text pairs with itself
        rows = rows.filter(F.size("in_all") > 1)
    return rows


def fan_out(sentences: DataFrame, wanted: DataFrame) -> DataFrame:
    """(src_lang, tgt_lang, row_id, src, tgt) for every wanted pair with both sides present."""
    ensure_checkpoint_dir(sentences.sparkSession)
    rows = gathered(sentences, wanted).checkpoint(eager=True)
    each = rows.select("row_id", "in_all", F.explode("in_all").alias("s")).select("row_id", "s", F.explode("in_all").alias("t"))
    named = each.select(F.col("s.code").alias("src_lang"), F.col("t.code").alias("tgt_lang"), "row_id", F.col("s.text").alias("src"), F.col("t.text").alias("tgt"))
    return named.join(F.broadcast(wanted), PAIR).select("src_lang", "tgt_lang", "row_id", "src", "tgt")


def missing_pairs(fanned: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted pairs without any row (the 'failed download' report)."""
    have = fanned.select("src_lang", "tgt_lang").distinct()
    return wanted.join(have, ["src_lang", "tgt_lang"], "left_anti")


#: The sentence pairs of a fan-out, and its manifest: what became of each pair.
ROWS = "src_lang string, tgt_lang string, row_id long, src string, tgt string"
REPORT = "src_lang string, tgt_lang string, status string, n_rows long, error string"


def write_fan_out(rows: DataFrame, wanted: DataFrame, path: str, wave: int = 64) -> DataFrame:
    """Writes the rows of all wanted pairs below `path`, one JSON Lines folder per pair, and reports on them.

    Pairs are written in waves, one job each; a wave enters the manifest after its rows are
    committed. Started again, a run writes only pairs that no manifest entry calls done or
    missing; a pair half written before replaces itself. When a wave fails it is halved until
    the failing pairs are alone; they are reported with their error and the others stay.
    Both lists are bounded by the language pairs.

    Report: src_lang, tgt_lang, status (done, missing: no rows, failed), n_rows, error, and
    `written`, whether this call wrote it.
    """
    spark = rows.sparkSession
    before = {(r.src_lang, r.tgt_lang) for r in finished_pairs(spark, path).collect()}
    todo = sorted({(r.src_lang, r.tgt_lang) for r in wanted.select(*PAIR).distinct().collect()} - before)
    failed: list[tuple] = []
    waves = [todo[i : i + wave] for i in range(0, len(todo), wave)]
    while waves:
        part = waves.pop()
        try:
            _write_wave(rows, part, path)
        except (Py4JJavaError, PySparkException) as e:
            if len(part) == 1:
                failed.append((*part[0], "failed", 0, _reason(e)))
            else:
                half = len(part) // 2
                waves += [part[:half], part[half:]]
    report = finished_pairs(spark, path).unionAll(spark.createDataFrame(failed, REPORT))
    asked = spark.createDataFrame(todo, "src_lang string, tgt_lang string").withColumn("_asked", F.lit(True))
    own = report.join(F.broadcast(asked), PAIR, "left")
    return own.select(*report.columns, (F.col("_asked").isNotNull() & (F.col("status") != "failed")).alias("written"))


def _write_wave(rows: DataFrame, part: list[tuple[str, str]], path: str) -> None:
    spark = rows.sparkSession
    asked = spark.createDataFrame(part, "src_lang string, tgt_lang string")
    own = rows.select("src_lang", "tgt_lang", "row_id", "src", "tgt").join(F.broadcast(asked), PAIR, "left_semi")
    (own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false")
        .partitionBy(*PAIR).json(f"{path}/pairs"))
    n = _rows_below(spark, path).join(F.broadcast(asked), PAIR, "left_semi").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n").isNull(), "missing").otherwise("done")
    entry = asked.join(F.broadcast(n), PAIR, "left").select(
        *PAIR, status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"), F.lit(None).cast("string").alias("error")
    )
    entry.coalesce(1).write.mode("append").parquet(f"{path}/finished")


def _reason(e: Exception) -> str:
    """First line of what the job failed with."""
    return str(getattr(e, "java_exception", None) or e).strip().split("\n")[0]


def _held(spark: SparkSession, pattern: str) -> bool:
    """Whether anything lies at a path, asked of the file system that it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def _rows_below(spark: SparkSession, path: str) -> DataFrame:
    if not _held(spark, f"{path}/pairs/src_lang=*"):
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).json(f"{path}/pairs")


def finished_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: pairs that are written or have no rows."""
    if not _held(spark, f"{path}/finished"):
        return spark.createDataFrame([], REPORT)
    return spark.read.schema(REPORT).parquet(f"{path}/finished").dropDuplicates(PAIR)


def read_fan_out(spark: SparkSession, path: str) -> DataFrame:
    """(src_lang, tgt_lang, row_id, src, tgt) of the finished pairs; half-written ones are left out."""
    return _rows_below(spark, path).join(F.broadcast(finished_pairs(spark, path).select(*PAIR)), PAIR, "left_semi").select(
        "src_lang", "tgt_lang", "row_id", "src", "tgt"
    )


def catalogue(pairs: DataFrame) -> DataFrame:
    """(dataset, short, split, source_split, src_lang, tgt_lang, path) for each pair."""
    entries = F.array(*[
        F.struct(F.lit(ds).alias("dataset"), F.lit(DATASET_SHORT[ds]).alias("short"), F.lit(sp).alias("split"),
                 F.lit(src).alias("source_split"))
        for ds, m in SPLITS.items() for sp, src in m.items()
    ])
    x = pairs.select("src_lang", "tgt_lang", F.explode(entries).alias("e")).select("src_lang", "tgt_lang", "e.*")
    path = F.concat(F.lit("data/"), F.col("split"), F.lit("/"), F.col("short"), F.lit("_"), F.col("src_lang"),
                    F.lit("-"), F.col("tgt_lang"), F.lit(".jsonl"))
    return x.select("dataset", "short", "split", "source_split", "src_lang", "tgt_lang", path.alias("path"))


def pair_file(dataset_short: str, split: str, src_lang: str, tgt_lang: str, pivot: str = "eng_Latn") -> tuple[str, str, str]:
    """PRJ-6: pair files are stored English-first; (path, src_col, tgt_col) for a direction.

    When the source is not English the `{tgt}-{src}` file is read and the two sentence
    columns are picked by name, so the direction never depends on file orientation.
    """
    a, b = (src_lang, tgt_lang) if src_lang == pivot else (tgt_lang, src_lang)
    return f"data/{split}/{dataset_short}_{a}-{b}.jsonl", f"sentence_{src_lang}", f"sentence_{tgt_lang}"
