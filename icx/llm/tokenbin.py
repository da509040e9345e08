"""Token ids in directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first chunk of
every id, level 1 the second chunk of those that have one, and so on; next to each level
stands a bitmap that tells which of its ids continue, with a rank directory (the number
of continued ids before every 512th). The token at any place is read with one chunk and
one rank per level, without decoding what stands before it.

Documents are dealt by range of doc_id, sorted, encoded, and written as segments of whole
documents; the files are tables in the folder named by the caller, one row per segment,
so any storage that Spark reads will do and a retried task replaces its own output.
`read_documents` reads only these files.

Defined cases: a null text is empty and yields the end id alone; null doc_ids come first;
rows with equal doc_id are ordered by the hash of their text; an empty table gives empty
files; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import sys
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icx.llm.common import SPACE, SpanHash, blocks, owners, runs, scratch_path, shuffle_partitions
from icx.llm.tokcount import byte_alphabet

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END_ID = 1
RANK_EVERY = 512
#: Distinct pieces remembered per task; beyond that the memory starts anew.
REMEMBERED = 500_000


def _classes() -> np.ndarray:
    """Per byte of lower-cased text: 0 white space, 1 letter, 2 digit, 3 other; 9 needs the library."""
    out = np.full(256, 9, np.uint8)
    for b in range(0x21, 0x7F):
        out[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3
    out[SPACE] = 0
    out[0x80:0xC0] = 1  # only behind 0xC3: the letters of Latin-1
    out[0xC3] = 1
    out[ord("'")] = 9  # contractions
    return out


CLASS = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Pieces:
    """Ids of the pieces that the vocabulary's encoder splits texts into, remembered by hash.

    No piece spans white space. Words of ASCII and Latin-1 letters, digits and signs are
    lower-cased and cut as arrays; all others (contractions, other scripts, special
    strings) are pieces of their own, which the library encodes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tokenize = self.tok.model.tokenize
        self.table = byte_alphabet() | {0: "\0"}
        self.hash = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    @staticmethod
    def cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-cased bytes, starts, ends, whether the library is needed) of all pieces."""
        low = LOWER[data]
        accent = np.flatnonzero(low[:-1] == 0xC3) + 1
        capital = accent[(low[accent] <= 0x9E) & (low[accent] != 0x97)]
        low[capital] += 0x20
        kind = CLASS[low]
        kind[accent[(low[accent] == 0x97) | (low[accent] == 0xB7)]] = 9  # the two signs among the letters
        inside = kind > 0
        start, end = runs(inside, off)
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == 9, out=odd[1:])
        special = np.flatnonzero((low[:-1] == ord("<")) & (low[1:] == ord("|")))
        if len(special):
            mark = np.zeros(len(data) + 1, np.int64)
            mark[special + 1] = 1
            odd += np.cumsum(mark)
        hard = odd[end] > odd[start]
        whole = np.zeros(len(data) + 1, np.int32)
        whole[start[hard]] += 1
        whole[end[hard]] -= 1
        plain = np.cumsum(whole[:-1]) == 0
        first = np.zeros(len(data), bool)
        first[1:] = inside[1:] & plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        first[start] = True
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        at = np.flatnonzero(first)
        return low, at, np.flatnonzero(last) + 1, ~plain[at]

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the memory of every piece in order, text of every piece)."""
        low, start, end, hard = self.cut(data, off)
        h = SpanHash(low)(start, end)
        if hard.any():
            h[hard] = SpanHash(data)(start[hard], end[hard]) ^ np.uint64(1)
        h, first, back = np.unique(h, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))
        new = np.flatnonzero(self.hash[place] != h) if len(self.hash) else np.arange(len(h))
        if len(new):
            self._learn(data, low, h[new], start[first[new]], end[first[new]], hard[first[new]])
            place = np.searchsorted(self.hash, h)
        return place[back.reshape(-1)], owners(start, off)

    def _learn(self, data: np.ndarray, low: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, hard: np.ndarray) -> None:
        raw, lowered, tokenize = data.tobytes(), low.tobytes(), self.tokenize
        got: list[list[int]] = [[]] * len(h)
        soft = np.flatnonzero(~hard)
        if len(soft):
            joined = b"\0".join([lowered[a:b] for a, b in zip(start[soft].tolist(), end[soft].tolist())])
            for i, piece in zip(soft.tolist(), joined.decode("latin-1").translate(self.table).split("\0")):
                got[i] = [t.id for t in tokenize(piece)]
        for i in np.flatnonzero(hard).tolist():
            got[i] = self.tok.encode(raw[start[i] : end[i]].decode(), add_special_tokens=False).ids
        size = np.fromiter(map(len, got), np.int64, len(got))
        begin = len(self.flat) + np.cumsum(size) - size
        at = np.searchsorted(self.hash, h)
        self.hash, self.begin, self.size = (np.insert(c, at, x) for c, x in ((self.hash, h), (self.begin, begin), (self.size, size)))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))])

    def forget(self) -> None:
        self.hash, self.begin, self.size, self.flat = self.hash[:0], self.begin[:0], self.size[:0], self.flat[:0]


def gathered(begin: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenation of the stretches of `flat` at `begin`."""
    total = np.cumsum(size)
    return flat[np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - size), size)]


# ---- the codes -----------------------------------------------------------------------


def packed(ids: np.ndarray) -> bytes:
    """Levels, continuation bitmaps and rank directories of an array of ids."""
    rest = ids.astype(np.uint32)
    levels = []
    while True:
        more = rest > 0xFF
        ranks = np.zeros(len(rest) // RANK_EVERY + 1, np.uint32)
        if len(rest):
            ranks[1:] = np.cumsum(np.add.reduceat(more, np.arange(0, len(rest), RANK_EVERY), dtype=np.int64))[: len(ranks) - 1]
        levels.append((rest.astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), ranks.astype("<u4").tobytes()))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = struct.pack("<I", len(levels)) + b"".join(struct.pack("<III", *map(len, level)) for level in levels)
    return head + b"".join(part for level in levels for part in level)


class Codes:
    """View of packed ids."""

    def __init__(self, data: bytes):
        n = struct.unpack_from("<I", data)[0]
        at = 4 + 12 * n
        self.levels = []
        for k in range(n):
            sizes = struct.unpack_from("<III", data, 4 + 12 * k)
            parts = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4")):
                parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append(tuple(parts))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The id at place i, with one chunk and one rank per level."""
        out = shift = 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            whole = i // RANK_EVERY
            tail = bits[whole * RANK_EVERY // 8 : (i >> 3) + 1].copy()
            tail[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[whole]) + int(np.bitwise_count(tail).sum())
            shift += 8
        return out

    def all(self) -> np.ndarray:
        out = np.zeros(len(self), np.uint32)
        at = np.arange(len(self))
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bits, bitorder="little", count=len(chunks)).astype(bool)]
        return out


# ---- files ---------------------------------------------------------------------------

SEGMENT = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("before", T.LongType()),
    T.StructField("n_ids", T.LongType()),
    T.StructField("codes", T.BinaryType()),
])


def _encoded(path: str, end_id: int):
    def run(batches):
        pieces = Pieces(path)
        part, before = TaskContext.get().partitionId(), 0
        for seq, (batch, data, off) in enumerate(blocks(batches)):
            if len(pieces.hash) > REMEMBERED:
                pieces.forget()
            place, doc = pieces.ids(data, off)
            # every text's own ids, then the end id
            n = batch.num_rows
            begin, size = pieces.begin[place], pieces.size[place]
            own = np.bincount(doc, weights=size, minlength=n).astype(np.int64)
            stop = np.cumsum(own + 1)
            ids = np.full(int(stop[-1]) if n else 0, end_id, np.uint32)
            inner = np.ones(len(ids), bool)
            inner[stop - 1] = False
            ids[inner] = gathered(begin, size, pieces.flat)
            size = own + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                    pa.array([batch.column(batch.schema.get_field_index("doc_id")).to_pylist()], pa.list_(pa.int64())),
                    pa.array([size], pa.list_(pa.int64())), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([packed(ids)], pa.binary()),
                ],
                names=SEGMENT.names,
            )
            before += len(ids)

    return run


def write_documents(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> None:
    """Encode every text and write the segments, in ascending doc_id order over parts and segments."""
    parts = shuffle_partitions(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(_encoded(vocabulary, end_id), SEGMENT).write.option("compression", "none").parquet(path)


def _decoded(batches):
    for batch in batches:
        docs, lengths, codes, base = batch.columns
        for i in range(batch.num_rows):
            ids = Codes(codes[i].as_buffer()).all().astype("<u4")
            size = lengths[i].values.to_numpy()
            stop = np.cumsum(size)
            crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(stop, size)]
            yield pa.RecordBatch.from_arrays(
                [docs[i].values, pa.array(base[i].as_py() + stop - size), pa.array(size), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    # one sum per part on the driver
    totals = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, before = {}, 0
    for part in sorted(totals):
        base[part], before = before, before + totals[part]
    first = F.lit(0).cast("long")
    if base:
        first = F.create_map(*[x for k, v in base.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("part")]
    placed = segments.withColumn("base", first + F.col("before"))
    return placed.select("doc_ids", "lengths", "codes", "base").mapInArrow(
        _decoded, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Write the files (to scratch by default) and read the documents back from them."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_documents(docs, vocabulary, path)
    return read_documents(docs.sparkSession, path)
