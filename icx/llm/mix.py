"""Mixing sources to target weights by pivotal dependent rounding.

Each source wants `target / source size` copies of every one of its documents: a whole
part that all get and a fraction. Fractions are settled in pairs: mass moves from one
document to the other, keeping the expected words of the pair, until one of the two is
whole; the other meets the next document. Documents are dealt into buckets by a hash of
their content, each bucket leaves at most one fractional document per source, and these
residuals meet in a reduction tree of fan-in `FAN_IN` until one per source is left. So a
source misses its target by less than one document, and every document keeps its
expected number of copies. All randomness is hashed from content, so reruns agree.

Defined cases: null text has size 0; documents of size 0 take only the whole copies and
no words; the null source is a source of its own and comes last; repeated rows are
documents of their own that share their fractions' sum, so it is settled which of them take how
many copies, not which row is which; very long texts are only counted; an empty table gives an
empty result; other columns, whatever their names, are ignored by `mixed_copies` and kept by `mixture`.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icx.llm.common import WORD, document_key, mixed, ranked, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Documents that one bucket settles on average, and residuals that one tree node combines.
BUCKET_ROWS = 8192
FAN_IN = 64
#: `monotonically_increasing_id` counts a partition's rows in its lower bits.
PARTITION_BITS = 33

STATE = T.StructType([
    T.StructField("s", T.LongType()),
    T.StructField("bucket", T.LongType()),
    T.StructField("key", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("p", T.DoubleType()),
])


def targets(sized: DataFrame) -> DataFrame:
    """(source, s, source_size, target): weights repeat over the sources in code point order,
    a target stops at `MOST_COPIES` times its source, and the excess is shared out again."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("s") % len(WEIGHTS) + 1).cast("int"))
    table = ranked(totals, order, "s").withColumn("w", weight)
    whole = table.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level = None  # words per unit of weight; it only rises, so a source once full stays full
    while True:
        full = F.lit(False) if level is None else F.col("w") * F.lit(level) >= MOST_COPIES * F.col("source_size")
        got = table.agg(
            F.sum(F.when(~full, F.col("w"))).alias("w"), F.sum(F.when(full, MOST_COPIES * F.col("source_size"))).alias("fixed")
        ).first()
        if not got["w"]:
            break
        rise = (whole - (got["fixed"] or 0)) / got["w"]
        if rise == level:
            break
        level = rise
    share = F.least(F.col("w") * F.lit(float(level or 0)), (MOST_COPIES * F.col("source_size")).cast("double"))
    return table.select("source", "s", "source_size", share.alias("target"))


def _uniform(key: int, size: int, level: int) -> float:
    """Hashed draw in [0, 1) for the meeting of a pair."""
    h = np.array([key & 0xFFFFFFFFFFFFFFFF], np.uint64) ^ np.uint64((size * 0x9E3779B97F4A7C15 + level * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    return float(mixed(mixed(h))[0] >> np.uint64(11)) / float(1 << 53)


def pivotal(p: list[float], size: list[int], key: list[int], level: int) -> list[float]:
    """Settle fractions pairwise; at most one entry of the result is not 0.0 or 1.0."""
    p = list(p)
    held = -1
    for i in range(len(p)):
        if p[i] <= 0.0 or p[i] >= 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        ratio = size[b] / size[a]
        up = min(1.0 - p[a], ratio * p[b])  # a gains, b loses
        down = min(p[a], ratio * (1.0 - p[b]))  # a loses, b gains
        if _uniform(key[a] ^ (key[b] * 31), size[a] + size[b], level) * (up + down) < down:
            p[a], p[b] = p[a] + up, p[b] - up / ratio
        else:
            p[a], p[b] = p[a] - down, p[b] + down / ratio
        for x in (a, b):
            if p[x] < 1e-12:
                p[x] = 0.0
            elif p[x] > 1.0 - 1e-12:
                p[x] = 1.0
        held = next((x for x in (a, b) if 0.0 < p[x] < 1.0), -1)
    return p


def _settle(level: int):
    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "size"], kind="stable")
        return group.assign(p=pivotal(group["p"].tolist(), group["size"].tolist(), group["key"].tolist(), level))

    return settle


def mixed_copies(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken, and the content hash `key`."""
    text = F.coalesce("text", F.lit(""))
    sized = written(
        docs.select(
            "doc_id", "source",
            F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("size"),
            F.xxhash64("doc_id", "text").alias("key"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "sized",
    )
    plan = written(targets(sized), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a source's targets are one row; copied per salt, a hot source joins in many tasks
    salts = 32
    salted = plan.select(F.col("source").alias("_s"), "s", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.pmod("key", F.lit(salts)) == F.col("_salt"))
    buckets = 1
    while buckets * BUCKET_ROWS < sized.count():
        buckets *= FAN_IN
    spread = F.pmod(F.xxhash64("key"), F.lit(buckets))
    start = written(
        sized.join(salted, on)
        .withColumn("rate", rate)
        .select(
            "doc_id", "s", "source_size", "target", "rid", F.shiftright("rid", PARTITION_BITS).alias("piece"), "key", "size",
            F.floor("rate").cast("long").alias("whole"),
            F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(F.lit(0.0)).alias("p"), spread.alias("bucket"),
        ),
        "fractions",
    )
    # equal rows settle among themselves: the whole part of their summed fractions is certain, one
    # entry meets the others with the rest; so a document repeated in any number is one entry
    same = ["s", "key", "size"]
    held = start.groupBy(*same, "piece").agg(F.count(F.lit(1)).alias("m"), F.min("p").alias("p"), F.min("bucket").alias("bucket"))
    among = Window.partitionBy(*same)
    mass = F.col("all") * F.col("p")
    equal = written(
        held.withColumn("before", F.sum("m").over(among.orderBy("piece")) - F.col("m"))
        .withColumn("all", F.sum("m").over(among)).withColumn("sure", F.floor(mass).cast("long")),
        "equal",
    )
    open_rows = equal.filter("before = 0").select("s", "bucket", "key", "size", (mass - F.col("sure")).alias("p"))
    settled, level = None, 0
    while True:
        done = written(open_rows.groupBy("s", "bucket").applyInPandas(_settle(level), STATE), f"level{level}")
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        last = buckets == 1
        if last:  # one document per source is left: it is drawn with its own probability
            u = (F.shiftrightunsigned(F.xxhash64("key", F.lit("last")), 11)) / F.lit(float(1 << 53))
            done = done.withColumn("p", F.when(fractional, (u < F.col("p")).cast("double")).otherwise(F.col("p")))
        part = done.filter(~((F.col("p") > 0) & (F.col("p") < 1))).select(*same, F.col("p").cast("long").alias("extra"))
        settled = part if settled is None else settled.unionAll(part)
        if last:
            break
        buckets, level = buckets // FAN_IN, level + 1
        open_rows = done.filter(fractional).withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
    due = F.greatest(F.lit(0), F.least("m", F.col("sure") + F.col("extra") - F.col("before")))
    pieces = equal.join(settled, same).select(*same, "piece", due.alias("due"))
    nth = F.row_number().over(Window.partitionBy(*same, "piece").orderBy("rid"))  # within one task's rows
    copies = F.col("whole") + (F.col("nth") <= F.col("due")).cast("long")
    return start.withColumn("nth", nth).join(pieces, [*same, "piece"]).select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key"
    )


def mixture(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each row as often as it has copies.

    Repeated rows (equal doc_id and text) are dealt together: their copies are summed.
    """
    got = mixed_copies(docs)
    key = document_key("doc_id")
    wanted = got.select(F.col("key").alias("__icx_text"), *key.values(), "copies").groupBy("__icx_text", *key).agg(F.sum("copies").alias("__icx_n"))
    own = docs.select("*", F.xxhash64("doc_id", "text").alias("__icx_text"), *key.values())
    dealt = own.join(wanted.filter("__icx_n > 0"), ["__icx_text", *key]).dropDuplicates(["__icx_text", *key])
    return dealt.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__icx_n"))).alias("__icx_copy")).select(*docs.columns)
