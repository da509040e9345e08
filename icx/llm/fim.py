"""Fill-in-middle transformation by rotating blocks in place.

A text is cut twice at token borders into prefix, middle and suffix. All work happens in
one bytearray per text: three sentinels are inserted at the cuts, which gives
`<P>`prefix`<M>`middle`<S>`suffix, and one rotation (three reversals) exchanges the blocks
into the order that the form asks for. The inverse finds the sentinels, rotates back and
deletes them, so the exact text returns. A text that holds a sentinel stays plain, which is
why the first sentinel found is always one that was inserted: a sentinel can neither start
nor end inside another one.

Cuts and form depend only on the seed and the doc_id, so reruns and retries agree.

Defined cases: a null or empty text is plain and empty; a null doc_id counts as an empty
number; a text of white space is one token; repeated rows give equal rows; a very long text
is a step of its own (reversals need a window of 64 KB besides the text); an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icx.llm.common import SPACE, blocks, runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
#: Per cent of the texts that are transformed, and per cent of those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes a reversal holds besides the text.
WINDOW = 64 << 10


def reverse(buf: bytearray, a: int, b: int) -> None:
    """Reverse buf[a:b] in place."""
    while b - a > 1:
        k = min((b - a) // 2, WINDOW)
        left = buf[a : a + k]
        buf[a : a + k] = buf[b - k : b][::-1]
        buf[b - k : b] = left[::-1]
        a, b = a + k, b - k


def rotate(buf: bytearray, a: int, m: int, b: int) -> None:
    """Exchange the neighbouring blocks buf[a:m] and buf[m:b] in place."""
    reverse(buf, a, m)
    reverse(buf, m, b)
    reverse(buf, a, b)


def transform(buf: bytearray, i: int, j: int, form: str) -> None:
    """Turn the text cut at bytes i <= j into its `psm` or `spm` form."""
    buf[j:j] = SUFFIX
    buf[i:i] = MIDDLE
    buf[0:0] = PREFIX
    rotate(buf, i + 3 if form == "psm" else 0, j + 6, len(buf))


def restore(buf: bytearray, form: str) -> None:
    """Turn a `psm` or `spm` form back into the text."""
    n = len(buf)
    if form == "psm":
        m = buf.index(SUFFIX, 3)
        s = buf.index(MIDDLE, m + 3)
        rotate(buf, m, s, n)
        s = m + n - s
    else:
        p = buf.index(PREFIX, 3)
        rotate(buf, 0, p, n)
        s, m = n - p, buf.index(MIDDLE, 3)
    del buf[s : s + 3]
    del buf[m : m + 3]
    del buf[:3]


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def _transformed(seed: int, rate: int, suffix_first: int):
    def run(batches):
        for batch, data, off in blocks(batches):
            _, word_end = runs(~SPACE[data], off)
            first = np.searchsorted(word_end, off[:-1], side="right")  # words end inside their text
            last = np.searchsorted(word_end, off[1:], side="right")
            letters = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
            ids = batch.column(0).to_pylist()
            units, forms, prefix, middle, output = [], [], [], [], []
            for d, doc_id in enumerate(ids):
                a, b = int(off[d]), int(off[d + 1])
                ends = word_end[first[d] : last[d]]
                n = len(ends) + int(b > a and SPACE[data[b - 1]])
                buf = bytearray(data[a:b].tobytes())
                h1, h2, h3, h4 = _draws(doc_id, seed)
                units.append(n)
                if not buf or h3 % 100 >= rate or any(s in buf for s in (PREFIX, SUFFIX, MIDDLE)):
                    forms.append("plain")
                    prefix.append(None)
                    middle.append(None)
                else:
                    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
                    i, j = (0 if c == 0 else int(ends[c - 1]) - a if c <= len(ends) else b - a for c in cuts)
                    forms.append("spm" if h4 % 100 < suffix_first else "psm")
                    prefix.append(int(letters[a + i] - letters[a]))
                    middle.append(int(letters[a + j] - letters[a + i]))
                    transform(buf, i, j, forms[-1])
                output.append(bytes(buf))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(units, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def transformed(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars, output."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return src.mapInArrow(_transformed(seed, rate, suffix_first), schema)


def _restored(batches):
    for batch, data, off in blocks(batches, "output"):
        texts = []
        for d, form in enumerate(batch.column(batch.schema.get_field_index("form")).to_pylist()):
            buf = bytearray(data[off[d] : off[d + 1]].tobytes())
            if form != "plain":
                restore(buf, form)
            texts.append(bytes(buf))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "restored"])


def restored(rows: DataFrame) -> DataFrame:
    """The rows of `transformed` with `restored`, the text rebuilt from output and form alone."""
    schema = T.StructType([*rows.schema.fields, T.StructField("restored", T.StringType())])
    return rows.mapInArrow(_restored, schema)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document with the digests of its output and of the text rebuilt from it."""
    return restored(transformed(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


def _sql() -> str:
    space = r"\x20\x09-\x0D"
    draw = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[{space}]*[^{space}]+|[{space}]+') AS units, {draw} FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS i, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= {RATE} THEN 'plain'
      WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
b AS (
  SELECT *, coalesce(array_to_string(units[1:i], ''), '') AS prefix, coalesce(array_to_string(units[i + 1:j], ''), '') AS middle,
    coalesce(array_to_string(units[j + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
    ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM b
"""


SQL = _sql()
