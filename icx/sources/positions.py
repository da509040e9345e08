"""Positions of lines in files without a sort, and an ordered sink that does not rest on file names.

Reading. A scan deals files out in splits (file, first byte). One pass counts the lines of
every split; the counts, in file order, add up to each split's first line; a second pass
numbers the lines inside their split as they are read. No text is exchanged or written.

Writing. Lines lie in pieces: a piece holds consecutive lines, in one task, and pieces are
numbered in the order of their lines. Each piece goes to a folder of its own number, and a
manifest (piece, first line, lines) is written last. A folder without a manifest, or that
holds other lines than it says, is an error for the reader; a retried task leaves nothing.

The driver holds one small row per split or piece, as many as the scan has tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splits or pieces up to this number are joined by broadcast (about 200 bytes each).
BROADCAST_SPLITS = 50_000
MANIFEST = "manifest"
LINES = "lines"


def by_number(name: str) -> tuple[str, str]:
    """Order of file names: numbers in a name by value, so part-100000 comes after part-99999."""
    return re.sub(r"\d+", lambda m: m.group().lstrip("0").rjust(40, "0"), name), name


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `_at`, the place of a line in its run of equal (first, second) columns; runs go on over batches."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column(0), batch.column(1)
        at: list[pa.Array] = []
        start = 0
        while start < batch.num_rows:
            key = (a[start].as_py(), b[start].as_py())
            end = _run_end(a, b, start)
            if key != last:
                last, seen = key, 0
            at.append(pa.array(range(seen, seen + end - start), pa.int64()))
            seen, start = seen + end - start, end
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(at)], names=[*batch.schema.names, "_at"])


def _run_end(a: pa.Array, b: pa.Array, start: int) -> int:
    """Where the run of equal rows that begins at `start` ends, in steps that double."""
    key, low, step, n = (a[start], b[start]), start, 1, len(a)
    same = lambda i: a[i] == key[0] and b[i] == key[1]
    while low + step < n and same(low + step):
        low, step = low + step, step * 2
    high = min(low + step, n)  # rows of a split are neighbours, so the run ends between low and high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if same(mid) else (low, mid)
    return low + 1


def _placed(lines: DataFrame, first: DataFrame, splits: int, name: str) -> DataFrame:
    """Lines (`_file`, `_block`, ..) with their position, from the first line of each split."""
    schema = T.StructType([*lines.schema.fields, T.StructField("_at", T.LongType())])
    at = lines.mapInArrow(_numbered, schema)
    first = F.broadcast(first) if splits <= BROADCAST_SPLITS else first
    unknown = F.raise_error(F.lit("the files or their splits changed while they were read")).cast("long")
    known = (F.col("_first").isNotNull()) & (F.col("_at") < F.col("_n"))
    placed = at.join(first, ["_file", "_block"], "left").withColumn(name, F.when(known, F.col("_first") + F.col("_at")).otherwise(unknown))
    return placed.withColumn("piece", F.col("_first")).drop("_file", "_block", "_at", "_first", "_n")


def _splits(rows: DataFrame) -> tuple[DataFrame, list]:
    """The rows with their split, and the splits in file order with their number of rows."""
    tagged = rows.select(F.input_file_name().alias("_file"), F.input_file_block_start().alias("_block"), *rows.columns)
    counts = tagged.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("n")).collect()
    return tagged, sorted(counts, key=lambda r: (by_number(r._file), r._block))


def _numbered_by(tagged: DataFrame, counts: list, name: str) -> DataFrame:
    firsts = accumulate((r.n for r in counts), initial=0)
    table = [(r._file, r._block, f, r.n) for r, f in zip(counts, firsts)]
    first = tagged.sparkSession.createDataFrame(table, "_file string, _block long, _first long, _n long")
    return _placed(tagged, first, len(table), name)


def with_positions(scan: DataFrame, name: str = "line_no", keep: Column | None = None) -> DataFrame:
    """A scan of files with `name`, the 0-based position of each row in file order, and `piece`,
    the position of the first row of its split.

    `keep` tells which rows count; the others are left out. The second pass fails if it meets
    a split that the first has not counted.
    """
    return _numbered_by(*_splits(scan if keep is None else scan.filter(keep)), name)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def write_pieces(lines: DataFrame, path: str, *order: str, piece: str = "piece", text: str = "text") -> None:
    """Ordered sink for lines that lie in pieces already, such as those of `with_positions`: no exchange.

    The lines are sorted by `order` (default line_no) inside their task. A text that holds a
    line end would become two lines; the manifest is not written then.
    """
    order = order or ("line_no",)
    spark = lines.sparkSession
    seen = Observation()
    rows = lines.select(F.col(piece).cast("long").alias("piece"), F.struct(*order).alias("_line"), F.col(text).alias("value"))
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n")).sortWithinPartitions("piece", "_line")
    rows.select("piece", "value").write.mode("overwrite").partitionBy("piece").text(f"{path}/{LINES}")
    found = []
    if seen.get["n"]:  # without lines there is no folder of a piece
        found = _read_pieces(spark, path).groupBy("piece").agg(F.count(F.lit(1)).alias("n")).orderBy("piece").collect()
    if sum(r.n for r in found) != seen.get["n"]:
        raise ValueError(f"{path} holds {sum(r.n for r in found)} lines instead of {seen.get['n']}")
    firsts = accumulate((r.n for r in found), initial=0)
    table = [(r.piece, f, r.n) for r, f in zip(found, firsts)]
    spark.createDataFrame(table, "piece long, first_line long, lines long").coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")


def write_ordered(lines: DataFrame, path: str, *order: str, text: str = "text") -> None:
    """Ordered sink for lines that lie anyhow: one range exchange by `order` (default line_no) makes the pieces."""
    order = order or ("line_no",)
    ranged = lines.select(*order, F.col(text).alias("_text")).repartitionByRange(*order)
    write_pieces(ranged.withColumn("piece", F.spark_partition_id()), path, *order, text="_text")


def read_ordered(spark: SparkSession, path: str, name: str = "line_no") -> DataFrame:
    """What an ordered sink wrote: (line number, piece, text), checked against the manifest."""
    manifest = {r.piece: r.lines for r in spark.read.parquet(f"{path}/{MANIFEST}").collect()}
    if not manifest:
        return spark.createDataFrame([], f"text string, {name} long, piece long")
    tagged, counts = _splits(_read_pieces(spark, path))
    held: dict[int, int] = {}
    for r in counts:
        number = int(re.search(r"/piece=(\d+)/", r._file).group(1))
        held[number] = held.get(number, 0) + r.n
    if held != manifest:
        raise ValueError(f"{path} holds other lines than its manifest says")
    return _numbered_by(tagged.drop("piece"), counts, name).withColumnRenamed("value", "text")


def _read_pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string, piece long").option("lineSep", "\n").text(f"{path}/{LINES}")
