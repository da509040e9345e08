"""Quality rules with adaptive thresholds.

Every document gets integer measures; mergeable quantile sketches of the measures are
kept per (lang, source), and a document is rejected when a measure lies far outside the
quartiles of its own group. The sketch is a histogram over integer buckets with seven
significant bits: merging is adding counts, so partial sketches combine in any order
and reruns agree. There is no least size of a group: every group's sketch is merged with its
language's, scaled to the weight of `PRIOR` documents, and that one with the whole corpus's
alike, so one rule holds at every size and a small group leans on its language.

A fence stands `FENCE` spreads outside the quartiles. The spread is the distance of the
quartiles, at least a `RELATIVE`-th of the upper one; the least spreads in `MEASURES` only
keep a group of nearly equal values from rejecting its next value, and all of them are small
enough that a fence alone rejects what the base rule lets pass.

Defined cases: a null text has no words and fails the base rule; null `lang` or
`source` is a group of its own; repeated rows are judged one by one; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icx.llm.common import SPACE, SpanHash, blocks, document_key, owners, per_text, runs, windows, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Measures per mille and the least spread (in the same unit) that counts as normal.
MEASURES = {"symbols": 20, "marks": 10, "capitals": 12, "repeats": 50, "dup_lines": 80, "word_length": 300}
#: Measures that are judged on the low side too.
TWO_SIDED = ("word_length",)
#: Fences stand this many spreads outside the quartiles; a spread is this part of the upper quartile at least.
FENCE = 4
RELATIVE = 20
#: Documents that the wider level's sketch counts for in a narrower one, and the unit of weight of one document.
PRIOR = 50
UNIT = 1000
WINDOW = 8
#: Rows with the thresholds are copied this often, so that a hot group joins in as many tasks.
SALTS = 32

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals", "n_lines"]


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SYMBOLS = _flags(b"#*$%&|<>")
MARKS = _flags(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
CAPITALS = _flags(bytes(range(65, 91)))


def _measured(batches):
    for batch, data, off in blocks(batches):
        inside = ~SPACE[data]
        start, end = runs(inside, off)
        doc = owners(start, off)
        n = batch.num_rows
        hashed = SpanHash(data)
        found = {
            "n_words": np.bincount(doc, minlength=n),
            "word_chars": per_text(inside & ((data & 0xC0) != 0x80), off),
            "n_symbols": per_text(SYMBOLS[data], off),
            "n_marks": per_text(MARKS[data], off),
            "n_capitals": per_text(CAPITALS[data], off),
        }
        # words covered by a window that is found twice or more in its text
        h, at = windows(hashed(start, end), doc, WINDOW)
        again = pd.Series(h ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).duplicated(keep=False).to_numpy()
        cover = np.zeros(len(start) + WINDOW + 1, np.int32)
        np.add.at(cover, at[again], 1)
        np.add.at(cover, at[again] + WINDOW, -1)
        found["n_repeat_words"] = np.bincount(doc[np.cumsum(cover)[: len(start)] > 0], minlength=n)
        # lines with a word that equal an earlier line of the text
        line, line_end = runs(data != 0x0A, off)
        words = np.zeros(len(data) + 1, np.int64)
        np.cumsum(inside, out=words[1:])
        solid = words[line_end] > words[line]
        line, line_end = line[solid], line_end[solid]
        owner = owners(line, off)
        key = hashed(line, line_end) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        found["n_lines"] = np.bincount(owner, minlength=n)
        found["n_dup_lines"] = np.bincount(owner[pd.Series(key).duplicated().to_numpy()], minlength=n)
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "lang", "source", "key")]
        yield pa.RecordBatch.from_arrays(
            kept + [pa.array(found[c].astype(np.int64)) for c in COUNTS], names=["doc_id", "lang", "source", "key", *COUNTS]
        )


def measured(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, base verdict and per-mille measures."""
    src = docs.select("doc_id", "text", "lang", "source", F.xxhash64("doc_id", "text").alias("key"))
    schema = T.StructType([*src.drop("text").schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS]])
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    per_mille = lambda top, below: F.floor(F.col(top) * 1000 / below).cast("long")
    return src.mapInArrow(_measured, schema).select(
        "*",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        per_mille("n_symbols", words).alias("symbols"),
        per_mille("n_marks", chars).alias("marks"),
        per_mille("n_capitals", chars).alias("capitals"),
        per_mille("n_repeat_words", words).alias("repeats"),
        per_mille("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_lines"),
        per_mille("word_chars", words).alias("word_length"),
    )


def bucket(v: Column) -> Column:
    """Lower end of the sketch bucket of a non-negative integer: its seven leading bits."""
    below = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, below), below)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, at, n): the mergeable sketches of all groups."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("at")) for m in MEASURES]))
    return (
        rows.select("lang", "source", pairs.alias("m"))
        .groupBy("lang", "source", F.col("m.measure").alias("measure"), F.col("m.at").alias("at"))
        .agg(F.count("*").alias("n"))
    )


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])


def _blended(own: str, wider: str) -> Column:
    """A sketch in units of weight, and the wider level's scaled to the weight of `PRIOR` documents."""
    weight = _total(F.col(wider))
    return F.concat(
        F.transform(own, lambda x: F.struct(x["at"].alias("at"), (x["n"] * UNIT).alias("n"))),
        F.transform(wider, lambda x: F.struct(x["at"].alias("at"), _div(x["n"] * PRIOR * UNIT, weight).alias("n"))),
    )


def _levels(sketch: DataFrame) -> DataFrame:
    """(lang, source, measure, hist): every group's sketch with what it takes from its language and the corpus.

    A sketch has at most some thousand buckets, whatever the number of documents.
    """

    def level(*by: str) -> DataFrame:
        merged = sketch.groupBy(*by, "measure", "at").agg(F.sum("n").alias("n"))
        return merged.groupBy(*by, "measure").agg(F.collect_list(F.struct("at", "n")).alias("hist"))

    whole = level().withColumnsRenamed({"hist": "wide", "measure": "_m"})
    lang = level("lang").join(F.broadcast(whole), F.col("measure") == F.col("_m"))  # one row a measure
    lang = lang.select(F.col("lang").alias("_l"), F.col("measure").alias("_m"), _blended("hist", "wide").alias("wide"))
    on = F.col("lang").eqNullSafe(F.col("_l")) & (F.col("measure") == F.col("_m"))
    return level("lang", "source").join(lang, on).select("lang", "source", "measure", F.array_sort(_blended("hist", "wide")).alias("hist"))


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, f): lowest and highest accepted value of every measure in each group."""
    hists = _levels(written(sketches(rows), "sketch")).withColumn("total", _total(F.col("hist")))

    def quantile(num: int) -> Column:
        want = _div(F.col("total") * num + 3, F.lit(4))
        walk = F.aggregate(
            "hist",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("at")),
            lambda acc, x: F.struct(
                (acc["seen"] + x["n"]).alias("seen"),
                F.when((acc["at"] < 0) & (acc["seen"] + x["n"] >= want), x["at"]).otherwise(acc["at"]).alias("at"),
            ),
        )
        return walk["at"]

    least = F.element_at(F.create_map(*[F.lit(v) for kv in MEASURES.items() for v in kv]), F.col("measure"))
    fenced = (
        hists.select("lang", "source", "measure", quantile(1).alias("q1"), quantile(3).alias("q3"))
        .withColumn("spread", F.greatest(F.col("q3") - F.col("q1"), _div(F.col("q3"), F.lit(RELATIVE)), least))
        .withColumn("low", F.col("q1") - FENCE * F.col("spread"))
        .withColumn("high", F.col("q3") + FENCE * F.col("spread"))
    )
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    fences = F.struct(*[pick(m, c).alias(f"{m}_{c}") for m in MEASURES for c in ("low", "high")])
    return fenced.groupBy("lang", "source").agg(fences.alias("f"))


def judged(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept, the measures, and a content key.

    The measures are written once; the sketches and the filtering join both read them.
    """
    rows = written(measured(docs), "measures")
    salt = F.array(*[F.lit(i) for i in range(SALTS)])
    limits = thresholds(rows.filter(~F.col("base_failed"))).select(
        F.col("lang").alias("_l"), F.col("source").alias("_s"), "f", F.explode(salt).alias("_salt")
    )
    on = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("salt") == F.col("_salt"))
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & (F.col(m) <= F.col(f"f.{m}_high"))
        if m in TWO_SIDED:
            inside = inside & (F.col(m) >= F.col(f"f.{m}_low"))
    joined = rows.withColumn("salt", F.abs(F.hash("n_words", "word_chars", "doc_id") % SALTS)).join(limits, on, "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        *MEASURES, "key",
    )


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns."""
    verdict = judged(docs).filter("kept").select("doc_id", F.col("key").alias("__icx_text"))
    key = document_key("doc_id")
    verdict = verdict.select("__icx_text", *key.values()).distinct()
    own = docs.select("*", F.xxhash64("doc_id", "text").alias("__icx_text"), *key.values())
    return own.join(verdict, ["__icx_text", *key], "left_semi").select(*docs.columns)


def _sql() -> str:
    fields = lambda c: ", ".join(
        f"max(CASE WHEN measure = '{m}' THEN {c} END) AS {m}_{c}" for m in MEASURES
    )
    least = " ".join(f"WHEN '{m}' THEN {v}" for m, v in MEASURES.items())
    inside = " AND ".join(f"r.{m} <= f.{m}_high" + (f" AND r.{m} >= f.{m}_low" if m in TWO_SIDED else "") for m in MEASURES)
    union = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM rows WHERE NOT base_failed" for m in MEASURES)
    marks = r"[!-/:-@\[-`{-~]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang, source FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
wi AS (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}),
wk AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM wi),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM wk),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM rep WHERE c > 1) GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dl AS (SELECT r, sum(c - 1) AS n, sum(c) AS n_lines FROM (SELECT r, line, count(*) AS c FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
m AS (
  SELECT d.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(regexp_replace(t, '{marks}', '', 'g')) AS BIGINT) AS n_marks,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(dl.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN dl USING (r)),
rows AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_symbols * 1000 // greatest(n_words, 1) AS symbols, n_marks * 1000 // greatest(word_chars, 1) AS marks,
    n_capitals * 1000 // greatest(word_chars, 1) AS capitals, n_repeat_words * 1000 // greatest(n_words, 1) AS repeats,
    n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines, word_chars * 1000 // greatest(n_words, 1) AS word_length
  FROM m),
sketch AS (
  SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS edge, count(*) AS n
  FROM ({union}) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM sketch),
whole AS (SELECT measure, edge, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY measure) AS total FROM sketch GROUP BY measure, edge),
bylang AS (
  SELECT lang, measure, edge, sum(n) * {UNIT} AS n FROM sketch GROUP BY lang, measure, edge
  UNION ALL SELECT lang, measure, edge, n * {PRIOR} * {UNIT} // total FROM (SELECT DISTINCT lang FROM groups), whole),
lang_total AS (SELECT *, sum(n) OVER (PARTITION BY lang, measure) AS total FROM bylang),
blend AS (
  SELECT lang, source, measure, edge, n * {UNIT} AS n FROM sketch
  UNION ALL SELECT g.lang, g.source, measure, edge, n * {PRIOR} * {UNIT} // total FROM groups g JOIN lang_total l ON g.lang IS NOT DISTINCT FROM l.lang),
seen AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY edge) AS seen, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM blend),
q AS (
  SELECT lang, source, measure, min(edge) FILTER (seen >= (total + 3) // 4) AS q1, min(edge) FILTER (seen >= (total * 3 + 3) // 4) AS q3
  FROM seen GROUP BY lang, source, measure),
s AS (SELECT *, greatest(q3 - q1, q3 // {RELATIVE}, CASE measure {least} END) AS spread FROM q),
e AS (SELECT lang, source, measure, q1 - {FENCE} * spread AS low, q3 + {FENCE} * spread AS high FROM s),
f AS (SELECT lang, source, {fields("low")}, {fields("high")} FROM e GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({inside}, FALSE) AS kept, {", ".join(f"CAST(r.{m} AS BIGINT) AS {m}" for m in MEASURES)}
FROM rows r LEFT JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""


SQL = _sql()
