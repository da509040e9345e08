"""File sources and sinks (SRC-2..7, SNK-1..5, PTB-8, VAL-1).

Scratch output goes below the cluster's checkpoint folder (shared storage), never a
machine-local temporary folder.
"""

from __future__ import annotations

import uuid

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icx.functions.text import py_strip
from icx.operators.perturb import perturb
from icx.session import ensure_checkpoint_dir
from icx.sources import positions as POS


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/icx-{name}-{uuid.uuid4().hex[:12]}"


def check_jsonl(*paths: str) -> None:
    """VAL-1: pair files must be JSON Lines."""
    for p in paths:
        if not p.endswith(".jsonl"):
            raise ValueError(f"not a JSON Lines file: {p}")


def pair_schema(src_lang: str, tgt_lang: str) -> T.StructType:
    return T.StructType([
        T.StructField(f"sentence_{src_lang}", T.StringType(), True),
        T.StructField(f"sentence_{tgt_lang}", T.StringType(), True),
    ])


#: Column that a line which is no JSON object, or whose fields have other types, lands in.
BAD_LINE = "_bad_line"


def _positioned_pairs(spark: SparkSession, path: str, src_lang: str, tgt_lang: str) -> DataFrame:
    """(row_id, line, _pair): the lines of a JSONL pair file that are not blank, by position, and what they parse to."""
    check_jsonl(path)
    schema = T.StructType([*pair_schema(src_lang, tgt_lang).fields, T.StructField(BAD_LINE, T.StringType())])
    lines = POS.with_positions(POS.scan_lines(spark, path), "row_id", keep=py_strip(F.col("value")) != "")
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": BAD_LINE, "mode": "PERMISSIVE"})
    return lines.select("row_id", F.col("value").alias("line"), parsed.alias("_pair"))


def read_pairs(spark: SparkSession, path: str, src_lang: str, tgt_lang: str, key: str | None = None) -> DataFrame:
    """SRC-2/3/6: JSONL pair file -> (row_id, src, tgt) with an explicit schema.

    Only the two sentence columns are in the read schema (no inference pass). Without a
    key column, row_id is the 0-based line position in file order. Malformed lines are left
    out and keep their position; `bad_lines` reports them.
    """
    cols = [F.col(f"_pair.sentence_{src_lang}").alias("src"), F.col(f"_pair.sentence_{tgt_lang}").alias("tgt")]
    if not key:
        return _positioned_pairs(spark, path, src_lang, tgt_lang).filter(F.col("_pair").getField(BAD_LINE).isNull()).select("row_id", *cols)
    check_jsonl(path)
    extra = [T.StructField(key, T.LongType()), T.StructField(BAD_LINE, T.StringType())]
    schema = T.StructType([*pair_schema(src_lang, tgt_lang).fields, *extra])
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", BAD_LINE).json(path)
    return raw.filter(F.col(BAD_LINE).isNull()).select(F.col(key).alias("row_id"), F.struct("*").alias("_pair")).select("row_id", *cols)


def bad_lines(spark: SparkSession, path: str, src_lang: str, tgt_lang: str) -> DataFrame:
    """(row_id, line): the malformed lines of a JSONL pair file, by their position in it."""
    bad = F.col("_pair").getField(BAD_LINE).isNotNull()
    return _positioned_pairs(spark, path, src_lang, tgt_lang).filter(bad).select("row_id", "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: text file(s) -> (line_no, text) in file order, each line stripped."""
    return POS.with_positions(POS.scan_lines(spark, path)).select("line_no", py_strip(F.col("value")).alias("text"))


def write_pairs(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-2: one JSON Lines directory per (src_lang, tgt_lang) via directory partitioning."""
    df.write.mode(mode).partitionBy("src_lang", "tgt_lang").json(path)


def postprocess_line(text):
    """`perturbed.strip().replace("\\n", "")`."""
    return F.replace(py_strip(text), F.lit("\n"), F.lit(""))


def perturb_lines(lines: DataFrame, language, attack: str, rate: float, seed: int,
                  keys: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """PTB-8 core: strip -> perturb -> strip and drop embedded newlines."""
    out = perturb(attack, py_strip(F.col("text")), [F.col(k) for k in keys], language, rate, seed)
    return lines.withColumn("text", postprocess_line(out))


def perturb_text(spark: SparkSession, in_path: str, out_path: str, language: str, attack: str,
                 rate: float | None = None, seed: int = 42) -> None:
    """PTB-8: perturb every line of a text file and write them in order; nothing is exchanged or sorted across tasks."""
    from icx.operators.perturb import DEFAULT_RATES

    rate = DEFAULT_RATES[attack] if rate is None else rate
    lines = POS.with_positions(POS.scan_lines(spark, in_path)).select("piece", "line_no", py_strip(F.col("value")).alias("text"))
    POS.write_pieces(perturb_lines(lines, language, attack, rate, seed), out_path)


def read_perturbed(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text) of what `perturb_text` wrote, checked against its manifest."""
    return POS.read_ordered(spark, path).select("line_no", "text")


def _write_runs(df: DataFrame, path: str) -> None:
    """Partitioned by run; a run that is written again replaces its own rows and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_predictions(pred: DataFrame, path: str) -> None:
    """SNK-3: predictions table partitioned by run; writing a run twice equals writing it once."""
    _write_runs(pred, path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """SNK-4: one row per run in the metrics table; writing a run twice equals writing it once."""
    _write_runs(metrics, path)


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of runs under its own schema (run ids such as 1e5 or 007 stay strings)."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def stream_runs(stream: DataFrame, path: str, checkpoint: str):
    """SNK-3 for a stream of predictions: each micro-batch lies in a folder of its own number, so a batch that is replayed replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "run_id").parquet(path)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def preview(prompts: DataFrame, n: int = 5, order: str = "row_id") -> DataFrame:
    """SNK-5: the first n prompts (TakeOrderedAndProject, no global sort)."""
    return prompts.orderBy(order).limit(n)


class Report(NamedTuple):
    """What a run's one writing job saw: (prompts, answered, [first prompts]), and its progress rows as a table."""

    n_prompts: int
    n_answered: int
    preview: list[str | None]
    progress: DataFrame


def write_reported(pred: DataFrame, path: str, sampled, n: int = 5, position: str = "pos") -> Report:
    """SNK-3, SNK-5 and SNK-6 in one job: writes a run's predictions, counts them and previews the first n prompts on the way.

    The counts and the preview are observed as rows pass to the writer, which is the last stage:
    a task that is run again counts once. `position` numbers the rows from 0. The written rows
    carry `progress`, whether `sampled` holds for them; the progress table reads those of the
    runs at `path`, however many they are. An empty table has an empty report. A null prompt is
    previewed as null.
    """
    seen = Observation()
    first = [F.max(F.when(F.col(position) == i, F.col("prompt"))).alias(f"p{i}") for i in range(n)]
    watched = pred.observe(seen, F.count(F.lit(1)).alias("n"), F.count("hypothesis").alias("answered"), *first)
    _write_runs(watched.withColumn("progress", F.coalesce(sampled, F.lit(False))), path)
    got = seen.get
    schema = T.StructType([*pred.schema.fields, T.StructField("progress", T.BooleanType())])
    held = read_runs(pred.sparkSession, path, schema) if got["n"] else pred.sparkSession.createDataFrame([], schema)
    return Report(got["n"], got["answered"], [got[f"p{i}"] for i in range(min(n, got["n"]))], held.filter("progress").select(*pred.columns))
