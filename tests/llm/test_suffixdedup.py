"""Repeated strings against brute force over all windows; the loser tree against sorting."""

import hashlib
import random

import numpy as np
import pytest

from icx.llm import suffixdedup as S


def brute(rows):
    """rows of (doc_id, text): results in input order; equal rows are one document."""
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d, t] = (d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return sorted((out[r] for r in rows), key=str)


def result(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, dk string, part int")
    return sorted(map(tuple, S.deduplicated(df, **kw).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(5)]
    rows = []
    for d in range(60):
        t = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 80)
            t += p[a : a + rng.randrange(60, 200)] + text(rng.randrange(0, 10))
        rows.append((d, t))
    near = text(120)
    for d in range(60, 80):
        k = rng.randrange(len(near))
        rows.append((d, near[:k] + word() + near[k + 3 :]))
    rows += [(80, None), (81, ""), (82, "a" * 1000), (83, "ab" * 300 + "c" + "ab" * 100), (84, rows[0][1] + rows[1][1]), (85, "x" * 99), (86, "x" * 99), (87, "y" * 100), (88, "y" * 100), (89, "z" * 101)]
    rows += [(90, near), (90, near), (None, near[:300]), (91, near * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("heavy", [S.HEAVY, 4])
def test_against_all_windows(spark, heavy):
    rows = corpus(heavy)
    assert result(spark, rows, heavy=heavy) == brute(rows)


def test_empty_and_text(spark):
    assert result(spark, []) == []
    rows = [(1, "q" * 150), (2, "start " + "q" * 150 + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.deduplicated(df, with_text=True).collect()}
    assert bytes(got[2].kept) == b"start  end" and got[2].edges == [6, 156]
    assert bytes(got[1].kept) == b"" or got[1].n_removed == 149 and bytes(got[1].kept) == b"q"


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(map(tuple, S.deduplicated(docs).collect()), key=str)
    assert got == brute(rows) and any(r[2] for r in got)


def test_loser_tree_sorts_and_knows_common_prefixes():
    rng = random.Random(9)
    for n_runs in (1, 2, 3, 7, 20):
        lists = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(0, 30))) for _ in range(n_runs)]
        lists = [x for x in lists if x] or [[b"a"]]
        order = list(S.merged([S.Run(*S._front_coded(x)) for x in lists]))
        got = [lists[r][i] for r, i, _ in order]
        assert got == sorted(sum(lists, []))
        for (_, _, k), a, b in zip(order[1:], got, got[1:]):
            assert k == S.common(a, b, 0)


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(1)
    piece = rng.integers(97, 100, 300).astype(np.uint8)
    a = np.concatenate([rng.integers(97, 100, 50).astype(np.uint8), piece])
    b = np.concatenate([rng.integers(97, 100, 77).astype(np.uint8), piece, rng.integers(97, 100, 30).astype(np.uint8)])
    def owner(x):
        _, at, first, last, _, _ = S.anchored(x, np.array([0, len(x)]))
        return {i: int(p) - i for p, f, t in zip(at, first, last) for i in range(f, t + 1)}
    oa, ob = owner(a), owner(b)
    assert len(oa) == len(a) - 99
    assert all(oa[50 + i] == ob[77 + i] for i in range(201))


def test_places_of_repeated_rows_travel_once():
    import pyarrow as pa

    def entry(dk, at, h):
        return S.packed(np.array([dk], "<i8"), np.array([len(at)], "<u4"), np.array(at, "<u4"), np.array(h, "<u8"))

    twice = [entry(1, [5, 9], [70, 80])] * 50 + [entry(2, [3], [70])] * 2
    out = S._shared(20)(pa.table({"part": pa.array([0] * 52, pa.int32()), "payload": pa.array(twice, pa.binary())}))
    got = {k: np.frombuffer(v, "<u4").tolist() for k, v in zip(out.column("dk").to_pylist(), out.column("places").to_pylist())}
    assert got == {1: [5], 2: [3]}  # 80 lies in one document alone, and neither gram is frequent
