"""Filter interaction audit: what every order of a set of filters removes, and each one's share.

Every document gets a bit mask of the filters it fails. The masks are counted per part, and
from those counts the removals of all 2^5 coalitions of filters are tabulated (a coalition
removes what fails any of its members). All reports come from that table:

* a step of an order removes the difference of two coalitions;
* a filter's redundant documents are what it removes alone less what it removes here, its
  unique ones are what the full coalition removes less what all the others remove;
* the Shapley value is the exact solution of a constrained least squares problem: the
  additive values that fit the coalition removals best under the Shapley kernel and add up
  to the removals of the full coalition. The normal equations and their constraint form one
  linear system whose matrix is inverted once, in rationals.

Defined cases: a null text is an empty one; an empty text has no words, so it fails only A
and, as a copy, E; null and empty source are one part; a null doc_id is neither smaller than
another nor has smaller ones, and no labels; rows with equal doc_id are counted one by one
and share the labels, of which any quality or toxic mark counts; very long texts are read
whole; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import sys
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icx.llm.common import blocks, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
M = len(FILTERS)
ALL = (1 << M) - 1
MIN_WORDS = 200
#: Least per cent of distinct words, largest per cent of capitals.
MIN_DISTINCT, MAX_CAPITALS = 50, 2
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
CONTINUATION = bytes(range(0x80, 0xC0))
#: What is counted of the documents a coalition removes.
MARKS = ("removed", "good", "toxic")


def text_mask(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = raw.split()  # by space and 0x09 to 0x0D
    points = len(raw.translate(None, CONTINUATION))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * capitals > MAX_CAPITALS * points) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


def _masked(batches):
    for batch, data, off in blocks(batches):
        raw = data.tobytes()
        masks = [text_mask(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "part", "digest")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(masks, pa.int32())], names=["doc_id", "part", "digest", "mask"])


def facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask of A to D, good, toxic, n): equal documents counted in n."""
    src = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    rows = src.mapInArrow(_masked, "doc_id long, part string, digest binary, mask int")
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = (
        labels.filter(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
        )
    )
    marked = rows.join(marks, "doc_id", "left")
    return marked.select("doc_id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")


def mask_counts(rows: DataFrame) -> DataFrame:
    """(part, mask of A to E, removed, good, toxic): documents by what they fail.

    A text's first document is found by joining the smallest doc_id of each text back on
    (text, doc_id), so a text with very many copies gathers in no task. All the other copies
    fail E: they are the whole less the first ones.
    """
    table = written(rows, "audit")
    kinds = ["part", "mask", "good", "toxic"]
    least = table.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    first = table.join(least, ["digest", "doc_id"]).select(*kinds, "n")
    free = first.unionByName(table.filter(F.col("doc_id").isNull()).select(*kinds, "n"))
    whole = table.select(*kinds, "n", F.lit(0).cast("long").alias("free")).unionByName(free.select(*kinds, F.lit(0).cast("long").alias("n"), F.col("n").alias("free")))
    counted = whole.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum("free").alias("free"))
    bit = 1 << FILTERS.index("E")
    split = F.inline(F.array(
        F.struct(F.col("mask").alias("fails"), F.col("free").alias("m")),
        F.struct(F.col("mask").bitwiseOR(bit).alias("fails"), (F.col("n") - F.col("free")).alias("m")),
    ))
    return (
        counted.select("part", "good", "toxic", split)
        .groupBy("part", F.col("fails").alias("mask"))
        .agg(F.sum("m").alias("removed"), F.sum(F.col("m") * F.col("good")).alias("good"), F.sum(F.col("m") * F.col("toxic")).alias("toxic"))
    )


def coalitions(counts: DataFrame) -> DataFrame:
    """(part, total, removals): per part an array over all 32 coalitions of (removed, good, toxic)."""
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    table = (
        counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
        .groupBy("part", "coalition")
        .agg(F.sum("removed").alias("total"), *[F.sum(F.when(hit, F.col(m)).otherwise(0)).alias(f"lost_{m}") for m in MARKS])
    )
    entry = F.struct("coalition", *[F.col(f"lost_{m}").alias(m) for m in MARKS])
    return table.groupBy("part").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(entry)).alias("removals"))


# ---- exact constrained least squares --------------------------------------------------


def inverse(matrix: list[list[Fraction]]) -> list[list[Fraction]]:
    """Inverse of a square matrix of rationals (Gauss-Jordan elimination)."""
    n = len(matrix)
    rows = [[*map(Fraction, r), *[Fraction(i == j) for j in range(n)]] for i, r in enumerate(matrix)]
    for c in range(n):
        pivot = next(r for r in range(c, n) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [r[n:] for r in rows]


def kernel(size: int, m: int) -> Fraction:
    """Weight of a coalition of `size` of `m` filters, neither none nor all."""
    return Fraction(m - 1, comb(m, size) * size * (m - size))


def normal_inverse(m: int) -> list[list[Fraction]]:
    """Inverse of the normal equations' matrix, bordered by the constraint that the values add up."""
    normal = [[Fraction(0)] * (m + 1) for _ in range(m + 1)]
    for c in range(1, (1 << m) - 1):
        w = kernel(c.bit_count(), m)
        for i in range(m):
            for j in range(m):
                if c >> i & 1 and c >> j & 1:
                    normal[i][j] += w
    for i in range(m):
        normal[i][m] = normal[m][i] = Fraction(1)
    return inverse(normal)


def shapley(removed: list[int], solver: list[list[Fraction]]) -> list[Fraction]:
    """Shapley values of the filters from the removals of all coalitions."""
    m = len(solver) - 1
    right = [Fraction(0)] * m + [Fraction(removed[-1])]
    for c in range(1, (1 << m) - 1):
        w = kernel(c.bit_count(), m) * removed[c]
        for i in range(m):
            if c >> i & 1:
                right[i] += w
    return [sum(a * b for a, b in zip(solver[i], right)) for i in range(m)]


def steps() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Over all orders and steps: order, step, filter number, coalition before the step."""
    orders, at, who, before = [], [], [], []
    for order in permutations(range(M)):
        done = 0
        for k, f in enumerate(order):
            orders.append("".join(FILTERS[x] for x in order))
            at.append(k + 1)
            who.append(f)
            before.append(done)
            done |= 1 << f
    return orders, np.array(at, np.int32), np.array(who), np.array(before)


def _reported(batches):
    solver = normal_inverse(M)
    orders, at, who, before = steps()
    after, bit = before | 1 << who, 1 << who
    names = pa.array(orders, pa.string())
    for batch in batches:
        for part, total, removals in zip(*(batch.column(c).to_pylist() for c in ("part", "total", "removals"))):
            value = {m: np.array([r[m] for r in removals], np.int64) for m in MARKS}
            removed = value["removed"]
            here = removed[after] - removed[before]
            share = [x * factorial(M) for x in shapley(removed.tolist(), solver)]
            assert all(x.denominator == 1 for x in share)
            out = {
                "kept": total - removed[after],
                "removed": here,
                "redundant": removed[bit] - here,
                "unique_fails": removed[ALL] - removed[ALL ^ bit],
                "good_lost": value["good"][after] - value["good"][before],
                "toxic_lost": value["toxic"][after] - value["toxic"][before],
                "shapley": np.array([int(x) for x in share], np.int64)[who],
            }
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(orders), pa.string()), names, pa.array(at), *[pa.array(v) for v in out.values()]],
                names=["part", "filter_order", "step", *out],
            )


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; `shapley` is summed over all orders."""
    return coalitions(mask_counts(facts(docs, labels))).mapInArrow(_reported, REPORT)


def _sql() -> str:
    space = r"\x20\x09-\x0D"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^{space}]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT w.part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, [
    len(ws) < {MIN_WORDS},
    100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws),
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MAX_CAPITALS} * length(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(w.doc_id > least, FALSE)] AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT ord, x.i AS step, ord[x.i] AS own FROM o, x),
r AS (
  SELECT part, ord, step, own,
    sum(n) FILTER (NOT list_bool_or([fails[y] FOR y IN ord[1:step]])) AS kept,
    sum(n) FILTER (fails[own] AND NOT coalesce(list_bool_or([fails[y] FOR y IN ord[1:step - 1]]), FALSE)) AS removed,
    sum(n) FILTER (fails[own] AND coalesce(list_bool_or([fails[y] FOR y IN ord[1:step - 1]]), FALSE)) AS redundant,
    sum(n) FILTER (fails[own] AND len([y FOR y IN fails IF y]) = 1) AS unique_fails,
    sum(good) FILTER (fails[own] AND NOT coalesce(list_bool_or([fails[y] FOR y IN ord[1:step - 1]]), FALSE)) AS good_lost,
    sum(toxic) FILTER (fails[own] AND NOT coalesce(list_bool_or([fails[y] FOR y IN ord[1:step - 1]]), FALSE)) AS toxic_lost
  FROM s, g GROUP BY ALL)
SELECT part, array_to_string(['ABCDE'[y] FOR y IN ord], '') AS filter_order, CAST(step AS INTEGER) AS step,
  {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


SQL = _sql()
