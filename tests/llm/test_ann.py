"""One-bit codes against all distances, on random, clustered, tied and odd vectors."""

import math
import random

import numpy as np
import pytest

from icx.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, row int, code string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 1, 2, "c") for r in rows], schema)


def brute(rows, k=10, every=100):
    """(query_id, rank, vec_id, score) by computing every distance."""
    good = [(i, v) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = sorted((-sum(len(v) == d for _, v in good), d) for d in {len(v) for _, v in good})
    good = [(i, np.float32(v).astype(float)) for i, v in good if len(v) == sizes[0][1]] if sizes else []
    out = []
    for a, (q, x) in enumerate(good):
        if q is None or q % every:
            continue
        near = sorted((math.sqrt(sum((x - y) ** 2)), i is None, i or 0) for b, (i, y) in enumerate(good) if a != b)[:k]
        out += [(q, r, None if none else i, s) for r, (s, none, i) in enumerate(near, 1)]
    return out


def found(df):
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()]


def same(got, want):
    key = lambda t: (t[0], t[1], repr(t[2]), t[3])
    assert [t[:3] for t in sorted(got, key=key)] == [t[:3] for t in sorted(want, key=key)]
    assert np.allclose([t[3] for t in sorted(got, key=key)], [t[3] for t in sorted(want, key=key)], rtol=1e-12, atol=1e-12)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (100, [0.0, 0.0, 0.5]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.5]), (None, [1.0, 2.0, 3.0]), (None, None),
            (200, None), (300, []), (400, [0.0, 0.0, 0.0]), (500, [1.0, None, 2.0]), (600, [nan, 1.0, 1.0]), (700, [inf, 1.0, 1.0]), (-100, [-5.0, 0.0, 1.0]), (9, [1.0, 2.0]), (800, [1.0])]
    same(found(ann.searched(table(spark, rows))), brute(rows))
    assert ann.searched(table(spark, rows).limit(0)).count() == 0
    assert found(ann.searched(table(spark, [(0, [1.0, 1.0])]))) == []
    assert found(ann.searched(table(spark, [(1, [1.0, 1.0]), (2, [1.0, 0.0])]))) == []


def test_ties_of_a_vector_that_a_third_of_the_rows_hold(spark):
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(16).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.standard_normal(16).tolist()) for i in range(1500)]
    random.Random(1).shuffle(rows)
    same(found(ann.searched(table(spark, rows).repartition(6))), brute(rows))


@pytest.mark.parametrize("dim", [2, 64, 300])
def test_recall(spark, dim):
    rng = np.random.default_rng(dim)
    centres = 3 * rng.standard_normal((8, dim))
    rows = [(i, (rng.standard_normal(dim) + centres[i % 8] * (i % 2) + 40).tolist()) for i in range(3000)]
    want = {t[:1] + t[2:3] for t in brute(rows)}
    got = {t[:1] + t[2:3] for t in found(ann.searched(table(spark, rows).repartition(5)))}
    assert len(got) == len(want) == 300 and len(got & want) >= 0.97 * len(want)


def test_the_bound_holds_and_prunes():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 64))
    turn, centre = ann.rotation(64, 256), x.mean(axis=0)
    assert np.allclose(turn.T @ turn, np.eye(64))
    codes, length, align = ann.encode(x, centre, turn)
    words = codes.view(np.uint64)
    low = ann.lowest(words, np.bitwise_count(words).sum(axis=1).astype(float), length, align, ann.planes(x[:50], centre, turn), ann.SIGMAS)
    true = ((x[:50, None] - x[None]) ** 2).sum(axis=2)
    assert (low <= true + 1e-9).mean() > 0.998
    tenth = np.sort(true, axis=1)[:, 10]
    assert (low <= tenth[:, None]).mean() < 0.3


def test_waves_and_huge_or_tiny_numbers(spark, monkeypatch):
    monkeypatch.setattr(ann, "WAVE_BYTES", 1)
    monkeypatch.setattr(ann, "QUERIES", 4)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(3) * 10.0 ** rng.integers(-300, 300, 3)).tolist()) for i in range(600)]
    df = table(spark, rows, SCHEMA.replace("float", "double"))
    got = found(ann.searched(df, k=5, every=10))
    want = []
    with np.errstate(over="ignore"):
        for q, x in rows:
            if q % 10 == 0:
                near = sorted((float(np.sqrt(np.add.reduce(np.square(np.array(x) - np.array(y))))), i) for i, y in rows if i != q)[:5]
                want += [(q, r, i, s) for r, (s, i) in enumerate(near, 1)]
    assert sorted(got) == sorted(want)
