"""Helpers shared by the training-data operators.

`written` cuts lineage with a Parquet table in the shared folder the session names in
`spark.checkpoint.dir`; `TextBlock` views a batch of texts as one byte array so that
per-byte and per-word work is vectorised inside Arrow tasks.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from icx.session import ensure_checkpoint_dir

#: Word: a maximal run of anything but space and the bytes 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text one vectorised step looks at; a longer text is a step of its own.
BLOCK_BYTES = 256 << 10

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/icx-llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to shared storage and read it back: lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def document_key(*columns: str) -> dict[str, Column]:
    """Join columns that stand for these columns, null-safe, under names no table has."""
    out = {}
    for i, c in enumerate(columns):
        out[f"__icx_value{i}"] = F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"__icx_value{i}")
        out[f"__icx_null{i}"] = F.col(c).isNull().alias(f"__icx_null{i}")
    return out


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """Append `name`: the dense 0-based position in `order`, without a single-task window.

    One range exchange, one written table, one count per partition on the driver.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    table = written(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in table.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    base, offsets = 0, {}
    for p, n in counts:
        offsets[p], base = base, base + n
    at = F.lit(0).cast("long")
    if offsets:
        at = F.create_map(*[F.lit(v).cast("long") for kv in offsets.items() for v in kv])[part]
    return table.withColumn(name, at + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


# ---- vectorised text blocks ---------------------------------------------------------

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64."""
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most `limit` bytes of `column` (or one row): (slice, bytes, offsets)."""
    for batch in batches:
        data, off = utf8(batch.column(batch.schema.get_field_index(column)))
        a, n = 0, batch.num_rows
        while a < n:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b
        del batch, data, off
        pa.default_memory_pool().release_unused()  # a reused worker keeps no batch's memory


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True bytes; a run never crosses a text's border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = off[(off > 0) & (off < n)]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of True flags in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


class SpanHash:
    """64-bit polynomial hashes of any spans of one byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = powers(BASE, n)
        self.total[1:] = self.total[:-1]  # in place: weight of each byte, then its term, then the sums
        self.total[1:] *= data
        self.total[1:] += powers(BASE, n)[:-1]
        self.total[0] = 0
        np.cumsum(self.total, out=self.total)
        self.back = powers(BASE_INVERSE, n)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.back[start])


def owners(start: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The text that each position belongs to."""
    return np.searchsorted(off, start, side="right") - 1


def windows(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words inside one text, and where each window starts."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : n + k]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mixed(out[at]), at
