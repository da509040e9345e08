"""Approximate nearest neighbours with randomly rotated one-bit codes.

Every vector, less the mean, is rotated by a random orthogonal matrix (padded to at least
`LEAST_BITS` dimensions, which sharpens short vectors' codes) and only the signs are kept:
one packed bit per dimension, and two scalars, the length and the alignment of the vector
with its own code. A query is rotated alike and rounded to `PLANES` bits a dimension, so
that its inner product with a code is a few ANDs and bit counts of 64-bit words. The two
scalars turn that into an estimate of the true inner product with a known error bound:
`SIGMAS` standard errors. A vector is reranked, by its exact distance in double precision,
when its lowest possible distance does not exceed the k-th smallest exact distance found so
far; there is no cap on how many are.

The stated query set goes over the index in waves of bounded size. A wave is broadcast; the
scan runs in as many tasks as there are cores, each keeping only k rows per query, and each
wave's rows are written, so a lost executor costs its own part of one wave.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components,
take no part; of vectors of different lengths the most frequent length does (ties: the
shorter); a null id is no query and comes last among equals; rows with an equal id are
queries and candidates of their own, and only the query's own row is left out; ties go to
the smaller id; distances that overflow are reranked and come last; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icx.llm.common import scratch_path, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_BITS = 256
PLANES = 4
#: Standard errors that the bound of an estimate spans.
SIGMAS = 3.0
#: Bytes of query vectors in a wave; rows of the index and queries looked at in one step.
WAVE_BYTES = 4 << 20
CHUNK, QUERIES = 1024, 64
SEED = 20240
K = 10
EVERY = 100


def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """The first `dim` columns of a random orthogonal matrix of `bits` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def code_bits(dim: int) -> int:
    return max(LEAST_BITS, -(-dim // 64) * 64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of vectors without nulls, all of length `dim`, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, whatever their length."""
    kind = vectors.schema[vector].dataType
    element = F.col(vector)
    if not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        element = element.cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), element.alias("embedding"))
    return src.filter(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def _sums(dim: int):
    def run(batches):
        total, n = np.zeros(dim), 0
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            total += x.sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n", "total"])

    return run


def mean(vectors: DataFrame, dim: int) -> np.ndarray:
    """Mean of all vectors; a row a dimension reaches the driver."""
    parts = vectors.select("embedding").mapInArrow(_sums(dim), "n long, total array<double>")
    rows = parts.select("n", F.posexplode("total").alias("at", "v")).groupBy("at").agg((F.sum("v") / F.sum("n")).alias("v")).collect()
    out = np.zeros(dim)
    for r in rows:
        out[r["at"]] = r["v"]
    with np.errstate(over="ignore"):
        out = out.astype(np.float32).astype(np.float64)
    return np.where(np.isfinite(out), out, 0.0)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, length, alignment) of each vector less the centre."""
    with np.errstate(over="ignore", invalid="ignore"):
        own = x - centre
        length = np.sqrt((own * own).sum(axis=1))
        unit = own / np.where(length > 0, length, 1.0)[:, None]
        turned = unit @ turn.T
        align = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[0])
    return np.packbits(turned > 0, axis=1, bitorder="little"), length, align


def _encoded(dim: int, centre: np.ndarray, turn: np.ndarray):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * CHUNK):
                part = batch.slice(at, 4 * CHUNK)
                codes, length, align = encode(_matrix(part.column(part.schema.get_field_index("embedding")), dim), centre, turn)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(align)],
                    names=[*part.schema.names, "code", "length", "align"],
                )

    return run


class Index:
    """Codes and vectors of all rows in a written table, and what queries need to be coded alike."""

    def __init__(self, vectors: DataFrame, vector: str = "embedding"):
        rows = usable(vectors, vector)
        lengths = rows.groupBy(F.size("embedding").alias("dim")).count()
        top = lengths.orderBy(F.desc("count"), "dim").first()
        self.dim = top["dim"] if top else 1
        rows = rows.filter(F.size("embedding") == self.dim)
        self.centre = mean(rows, self.dim)
        self.turn = rotation(self.dim, code_bits(self.dim))
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        added = [T.StructField("code", T.BinaryType()), T.StructField("length", T.DoubleType()), T.StructField("align", T.DoubleType())]
        schema = T.StructType([*numbered.schema.fields, *added])
        self.table = written(numbered.mapInArrow(_encoded(self.dim, self.centre, self.turn), schema), "codes")


def planes(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> dict[str, np.ndarray]:
    """Rotated queries rounded to `PLANES` bits a dimension, as words per bit plane, with their scalars."""
    own = x - centre
    turned = own @ turn.T
    low = turned.min(axis=1)
    step = (turned.max(axis=1) - low) / ((1 << PLANES) - 1)
    step = np.where(step > 0, step, 1.0)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    words = np.stack([np.packbits(level >> p & 1, axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)], axis=1)
    return {"length": np.sqrt((own * own).sum(axis=1)), "low": low, "step": step, "levels": level.sum(axis=1, dtype=np.float64), "words": words}


def lowest(codes: np.ndarray, ones: np.ndarray, length: np.ndarray, align: np.ndarray, q: dict[str, np.ndarray], sigmas: float) -> np.ndarray:
    """Lower bounds of the squared distances between queries (rows) and coded vectors (columns)."""
    bits = codes.shape[1] * 64
    hits = np.zeros((len(q["low"]), len(codes)), np.int32)
    for p in range(PLANES):
        found = np.zeros(hits.shape, np.uint16)
        for w in range(codes.shape[1]):
            found += np.bitwise_count(q["words"][:, p, w, None] & codes[None, :, w])
        hits += found.astype(np.int32) << p
    # sum of the rounded query's components at the code's ones, less the sum at its zeros
    step, low = q["step"][:, None], q["low"][:, None]
    signed = step * (2.0 * hits - q["levels"][:, None]) + low * (2.0 * ones - bits)
    inner = signed / (np.sqrt(bits) * align)
    error = sigmas * (q["length"][:, None] * np.sqrt(np.maximum(1 - align * align, 0) / (align * align * (bits - 1))) + step / (np.sqrt(12) * align))
    scale = length * length + (q["length"] * q["length"])[:, None]
    return scale - 2 * length * (inner + error) - 1e-9 * scale


def _best(k: int, query, score, ident, missing, row):
    """Of these (query, candidate) pairs the k nearest of each query, ties to the smaller id."""
    order = np.lexsort((row, ident, missing, score, query))
    query = query[order]
    first = np.searchsorted(query, query, side="left")
    keep = order[np.arange(len(order)) - first < k]
    return keep


def _scanned(shared, k: int, sigmas: float, dim: int):
    def run(batches):
        qs = shared.value
        n = len(qs["row"])
        empty = np.zeros(0, np.int64)
        best = [(empty, np.zeros(0), empty, np.zeros(0, bool), empty) for _ in range(0, n, QUERIES)]
        limit = np.full(n, np.inf)
        for batch in batches:
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            x = _matrix(col("embedding"), dim)
            codes = np.frombuffer(b"".join(col("code").to_pylist()), np.uint64).reshape(len(x), -1)
            ones = np.bitwise_count(codes).sum(axis=1).astype(np.float64)
            length, align, row = (col(c).to_numpy() for c in ("length", "align", "row"))
            missing = np.asarray(col("vec_id").is_null())
            ident = col("vec_id").fill_null(0).to_numpy()
            for a in range(0, len(x), CHUNK):
                part = slice(a, min(a + CHUNK, len(x)))
                for g, at in enumerate(range(0, n, QUERIES)):
                    these = slice(at, min(at + QUERIES, n))
                    q = {c: qs[c][these] for c in ("length", "low", "step", "levels", "words")}
                    with np.errstate(all="ignore"):  # what overflows is reranked
                        low = lowest(codes[part], ones[part], length[part], align[part], q, sigmas)
                        open_ = ~(low > limit[these, None]) & (row[part][None, :] != qs["row"][these, None])
                        who, what = np.nonzero(open_)
                        if not len(who):
                            continue
                        who, what = who + at, what + a
                        apart = x[what] - qs["x"][who]
                        score = np.sqrt(np.add.reduce(np.square(apart).T.copy(), axis=0))  # component after component
                    found = [np.concatenate(p) for p in zip(best[g], (who, score, ident[what], missing[what], row[what]))]
                    keep = _best(k, *found)
                    best[g] = tuple(c[keep] for c in found)
                    query, score = best[g][:2]
                    full = np.bincount(query - at, minlength=these.stop - at) >= k
                    last = np.flatnonzero(np.append(query[1:] != query[:-1], True))
                    worst = np.full(these.stop - at, np.inf)
                    worst[query[last] - at] = score[last]
                    with np.errstate(over="ignore"):
                        limit[these] = np.where(full, worst * worst * (1 + 1e-9), np.inf)
        query, score, ident, missing, row = (np.concatenate(c) for c in zip(*best))
        yield pa.RecordBatch.from_arrays(
            [pa.array(qs["row"][query]), pa.array(qs["id"][query]), pa.array(ident, mask=missing), pa.array(row), pa.array(score)],
            names=["query_row", "query_id", "vec_id", "row", "score"],
        )

    return run


def nearest(index: Index, queries: DataFrame, k: int = K, sigmas: float = SIGMAS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query row, its own row left out.

    `queries` are rows of the index's table. Waves of them are dealt by a hash of their row number.
    """
    spark = index.table.sparkSession
    width = max(QUERIES, WAVE_BYTES // (8 * index.dim))
    asked = written(queries.select("row", "vec_id", "embedding"), "queries")
    waves = -(-asked.count() // width)
    tasks = spark.sparkContext.defaultParallelism
    paths = []
    schema = "query_row long, query_id long, vec_id long, row long, score double"
    for w in range(waves):
        rows = asked.filter(F.pmod(F.xxhash64("row"), F.lit(waves)) == w).toArrow()
        if not rows.num_rows:
            continue
        x = _matrix(rows["embedding"], index.dim)
        with np.errstate(all="ignore"):
            wave = planes(x, index.centre, index.turn) | {"x": x, "row": rows["row"].to_numpy(), "id": rows["vec_id"].to_numpy()}
        shared = spark.sparkContext.broadcast(wave)
        found = index.table.coalesce(tasks).mapInArrow(_scanned(shared, k, sigmas, index.dim), schema)
        paths.append(scratch_path(spark, "near"))
        found.write.parquet(paths[-1])
        shared.unpersist()
    found = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    order = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searched(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The k nearest rows of every row whose id is divisible by `every`, against all rows."""
    index = Index(vectors)
    return nearest(index, index.table.filter(F.col("vec_id") % every == 0), k)


SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
    AND list_bool_or([x <> 0 FOR x IN embedding])),
d AS (SELECT len(e) AS dim FROM v GROUP BY ALL ORDER BY count(*) DESC, dim LIMIT 1),
u AS (SELECT * FROM v WHERE len(e) = (SELECT dim FROM d)),
p AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score, c.r
  FROM u q JOIN u c ON q.vec_id % {EVERY} = 0 AND c.r <> q.r),
n AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score, vec_id NULLS LAST, r) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= {K}
"""
