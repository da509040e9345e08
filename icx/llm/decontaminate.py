"""Benchmark decontamination by greedy string tiling.

Texts are compared as lower-cased words: runs of letters, marks and digits of any script, so
that quotes, dashes and no-break spaces set in another way do not matter. Documents and benchmark
items that share a seed of `MIN_MATCH` consecutive words are joined; each such pair is
tiled: the longest common word runs that do not overlap earlier tiles are found with
Karp-Rabin rolling hashes and marked, again and again, until no run of `MIN_MATCH` words
is left. Order does not matter to tiles, so reordered passages are caught too. A document
is contaminated by an item when tiles cover at least `COVERAGE` of the item's words.

Seeds reach the documents in blocks of at most `BLOCK_SEEDS`, so what a task holds is
bounded however large the benchmark is; all documents meet every block.

Defined cases: null and empty texts have no words and match nothing; an item with fewer
than `MIN_MATCH` words is too short to tell a leak and matches only a document with just
these words; repeated rows get equal verdicts; items with equal item_id or text are
judged one by one; an empty table on either side leaves every document clean; other
columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icx.llm.common import SpanHash, blocks, document_key, owners, runs, windows, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_MATCH = 5
COVERAGE = 0.5
#: Seeds (eight bytes each) that one pass over the documents holds.
BLOCK_SEEDS = 4_000_000

#: Words are separated by one space, see `normal`.
SPACE = ord(" ")


def normal(text):
    """Lower case, and one space for everything between words."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word of normal texts."""
    start, end = runs(data != SPACE, off)
    return SpanHash(data)(start, end), owners(start, off)


def words_of(text: str) -> list[int]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0].tolist()


def _seeds_of(words: list[int]) -> list[int]:
    """Hashes of an item's seeds."""
    h = np.array(words, np.uint64)
    if not len(h):
        return []
    n = min(MIN_MATCH, len(h))
    found = windows(h, np.zeros(len(h), np.int64), n)[0]
    return np.unique(found).view(np.int64).tolist()


def _item_seeds(batches):
    for batch in batches:
        items, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        rows = [(i, k, w, min(MIN_MATCH, len(w)), s) for i, k, w in zip(items, keys, words) for s in _seeds_of(w)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([np.array(r[2], np.uint64).view(np.int64).tolist() for r in rows], pa.list_(pa.int64())),
                pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.int64()),
            ],
            names=["item_id", "item", "words", "n", "seed"],
        )


def tiles(item, doc, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, length) of the marked matches.

    Each round looks for runs of the current search length among unmarked words with
    rolling hashes, extends them, and marks the longest first; the length then falls.
    """
    a, b = np.array(item, np.uint64), np.array(doc, np.uint64)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    out = []
    length = min(len(a), len(b))
    # only words of the document that the item has can be marked
    free_b &= np.isin(b, a)
    length = min(length, _longest_run(free_b))
    while length >= least and length > 0:
        best, matches = 0, []
        table: dict[int, list[int]] = {}
        for h, i in _free_windows(a, free_a, length):
            table.setdefault(h, []).append(i)
        for h, j in _free_windows(b, free_b, length):
            for i in table.get(h, ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k >= length:
                    matches.append((k, i, j))
                    best = max(best, k)
        if best > length:  # a longer match shows up: look for that length first
            matches = [m for m in matches if m[0] == best]
        for k, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if free_a[i : i + k].all() and free_b[j : j + k].all():
                free_a[i : i + k] = False
                free_b[j : j + k] = False
                out.append((i, j, k))
        if best > length:
            continue
        length = min(length - 1, _longest_run(free_a), _longest_run(free_b))
    return out


def _longest_run(free: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def _free_windows(words: np.ndarray, free: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    n = len(words) - size + 1
    if n <= 0:
        return iter(())
    taken = np.concatenate([[0], np.cumsum(~free)])
    h, at = windows(words, np.zeros(len(words), np.int64), size)
    ok = taken[at + size] == taken[at]
    return zip(h[ok].tolist(), at[ok].tolist())


def _candidates(seeds_by_size: dict[int, np.ndarray]):
    """Documents' seeds that are among the benchmark's, with all words of the document."""

    def run(batches):
        for batch, data, off in blocks(batches):
            h, doc = word_hashes(data, off)
            begin = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            hits = []
            for n, seeds in seeds_by_size.items():
                found, at = windows(h, doc, n)
                if n < MIN_MATCH:  # only a document that is just the item
                    just = np.diff(begin)[doc[at]] == n
                    found, at = found[just], at[just]
                place = np.minimum(np.searchsorted(seeds, found), len(seeds) - 1)
                hit = np.flatnonzero(seeds[place] == found)
                if len(hit):
                    hits.append(np.unique(np.stack([doc[at[hit]], np.full(len(hit), n), found[hit].view(np.int64)], 1), axis=0))
            if not hits:
                continue
            hits = np.concatenate(hits)
            words = {d: h[begin[d] : begin[d + 1]].view(np.int64) for d in set(hits[:, 0].tolist())}
            places = np.unique(hits[:, 0])
            row = batch.column(batch.schema.get_field_index("row")).take(pa.array(places))
            ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(places))
            pairs = [hits[hits[:, 0] == d, 1:] for d in places]
            yield pa.RecordBatch.from_arrays(
                [
                    row, ids, pa.array([words[d] for d in places.tolist()], pa.list_(pa.int64())),
                    pa.array([[{"n": int(n), "seed": int(s)} for n, s in p] for p in pairs], pa.list_(pa.struct([("n", pa.int32()), ("seed", pa.int64())]))),
                ],
                names=["row", "doc_id", "doc_words", "seeds"],
            )

    return run


def _tiled(batches):
    for batch in batches:
        out = []
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        ids = zip(*[column[c].to_pylist() for c in ("row", "doc_id", "item_id")])
        for at, (row, doc_id, item_id) in enumerate(ids):
            item, doc = (column[c][at].values.to_numpy().view(np.uint64) for c in ("words", "doc_words"))
            found = tiles(item, doc, min(MIN_MATCH, len(item)))
            marks = [{"item_at": i, "doc_at": j, "n": k} for i, j, k in found]
            out.append((row, doc_id, item_id, len(item), sum(k for _, _, k in found), marks))
        kinds = (*[pa.int64()] * 5, pa.list_(TILE))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)],
            names=["row", "doc_id", "item_id", "item_words", "covered", "tiles"],
        )


TILE = pa.struct([("item_at", pa.int64()), ("doc_at", pa.int64()), ("n", pa.int64())])
PAIRS = "row long, doc_id long, item_id long, item_words long, covered long, tiles array<struct<item_at: long, doc_at: long, n: long>>"
CANDIDATE = "row long, doc_id long, doc_words array<long>, seeds array<struct<n: int, seed: long>>"
SEED = "item_id long, item long, words array<long>, n int, seed long"


def row_key():
    """A document's content key; documents are told apart by it together with doc_id."""
    return F.xxhash64("doc_id", "text")


def tiled_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, item_words, covered, tiles) of every pair that shares a seed."""
    spark = docs.sparkSession
    source = benchmark.select(F.col("item_id").cast("long"), normal("text").alias("text"), F.xxhash64("item_id", "text").alias("item")).distinct()
    items = written(source.mapInArrow(_item_seeds, SEED), "seeds")
    n_blocks = -(-items.count() // BLOCK_SEEDS)
    if n_blocks == 0:
        return spark.createDataFrame([], PAIRS)
    n_blocks = 1 if n_blocks == 1 else 2 * n_blocks
    src = docs.select("doc_id", normal("text").alias("text"), row_key().alias("row"))
    found = None
    for b in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("seed"), F.lit(n_blocks)) == b).select("n", "seed").distinct()
        rows = block.toArrow()  # about BLOCK_SEEDS seeds at most
        sizes, seeds = rows.column("n").to_numpy(), rows.column("seed").to_numpy().view(np.uint64)
        by_size = {int(n): np.sort(seeds[sizes == n]) for n in np.unique(sizes)}
        if by_size:
            part = src.mapInArrow(_candidates(by_size), CANDIDATE)
            found = part if found is None else found.unionAll(part)
    found = written(found, "candidates")
    seeds = found.select("row", "doc_id", F.explode("seeds").alias("s")).select("row", "doc_id", "s.n", "s.seed")
    pairs = seeds.join(items.select("item", "n", "seed"), ["n", "seed"]).select("row", "doc_id", "item").distinct()
    words = found.select("row", F.col("doc_id").alias("_d"), "doc_words").dropDuplicates(["row", "_d"])
    whole = items.select("item", "item_id", "words").dropDuplicates(["item"])
    joined = pairs.join(words.withColumnRenamed("row", "_r"), (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    return joined.join(whole, "item").select("row", "doc_id", "item_id", "words", "doc_words").mapInArrow(_tiled, PAIRS)


def contaminated(pairs: DataFrame) -> DataFrame:
    """Pairs whose tiles cover enough of the item."""
    least = F.when(F.col("item_words") < MIN_MATCH, F.col("item_words")).otherwise(COVERAGE * F.col("item_words"))
    return pairs.filter(F.col("covered") >= least)


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, best_item, covered, item_words."""
    pairs = contaminated(tiled_pairs(docs, benchmark))
    best = F.max(F.struct((F.col("covered") / F.col("item_words")).alias("part"), (-F.col("item_id")).alias("item"), "covered", "item_words"))
    hit = pairs.groupBy(F.col("row").alias("_r"), F.col("doc_id").alias("_d")).agg(F.count("*").alias("n_items"), best.alias("best"))
    rows = docs.select("doc_id", row_key().alias("row"))
    return rows.join(hit, (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        (-F.col("best.item")).alias("best_item"), F.coalesce("best.covered", F.lit(0)).alias("covered"),
        F.coalesce("best.item_words", F.lit(0)).alias("item_words"),
    )


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no benchmark item contaminates, all columns."""
    key = document_key("doc_id")
    hit = contaminated(tiled_pairs(docs, benchmark)).select(F.col("row").alias("__icx_text"), *key.values()).distinct()
    own = docs.select("*", row_key().alias("__icx_text"), *key.values())
    return own.join(hit, ["__icx_text", *key], "left_anti").select(*docs.columns)
