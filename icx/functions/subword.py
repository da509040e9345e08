"""Subword tokens for BLEU: byte-level merge-rank segmentation over a given vocabulary table.

The vocabulary is a table (token binary, rank int). A text is cut into pieces by a pattern;
a piece starts as its single bytes, and of all neighbouring tokens whose joined bytes are in
the vocabulary the pair of least rank (ties: the leftmost) is merged, until none is left. A
heap of candidate pairs over a linked list makes that O(n log n) for a piece of any length.

Spark partitions the rows; inside a task every distinct piece is segmented once per memory
generation. The vocabulary is broadcast: its size is checked against `MOST`.
"""

from __future__ import annotations

import heapq
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: how texts are cut before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a broadcast vocabulary may have.
MOST = 1_000_000
#: Pieces a task remembers.
REMEMBERED = 200_000


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(token, rank) of a vocabulary file with lines of base64 bytes and rank."""
    parts = F.split(F.col("value"), " ")
    return spark.read.text(path).filter(F.length("value") > 0).select(F.unbase64(parts[0]).alias("token"), parts[1].cast("int").alias("rank"))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens of one piece."""
    if piece in ranks or len(piece) < 2:
        return [piece] if piece else []
    n = len(piece)
    end = list(range(1, n + 1))  # token that starts at i ends at end[i]; 0: merged away
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (rank := ranks.get(piece[a : end[b]])) is not None:
            heapq.heappush(heap, (rank, a, b, end[b]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if end[a] != b or end[b] != c:  # one of the two has changed since
            continue
        end[a], end[b] = c, 0
        if c < n:
            before[c] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = end[i]
    return out


def _segmented(shared, columns: list[str], pattern: str):
    def run(batches):
        import regex

        ranks, cut = shared.value, regex.compile(pattern).findall
        known: dict[str, list[str]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = []
                for c in columns:
                    rows = []
                    for text in part.column(part.schema.get_field_index(c)).to_pylist():
                        tokens: list[str] | None = None if text is None else []
                        for piece in cut(text) if text else ():
                            own = known.get(piece)
                            if own is None:
                                if len(known) >= REMEMBERED:
                                    known.clear()
                                own = known[piece] = [t.decode("latin-1") for t in merged(piece.encode(), ranks)]
                            tokens += own
                        rows.append(tokens)
                    made.append(pa.array(rows, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *[f"{c}_tokens" for c in columns]])

    return run


def with_tokens(df: DataFrame, ranks: DataFrame, columns: tuple[str, ...], pattern: str = PIECES) -> DataFrame:
    """Append `<column>_tokens`, array<string>, one character per byte of a token; null for a null text."""
    rows = ranks.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a vocabulary of more than {MOST} entries is not broadcast")
    shared = df.sparkSession.sparkContext.broadcast({bytes(r["token"]): r["rank"] for r in rows})
    added = [T.StructField(f"{c}_tokens", T.ArrayType(T.StringType())) for c in columns]
    return df.mapInArrow(_segmented(shared, list(columns), pattern), T.StructType([*df.schema.fields, *added]))
