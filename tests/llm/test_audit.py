"""The filter audit against every order played out document by document, and the solver against permutations."""

import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest

from icx.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def masks(rows):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        words = WORD.findall(t)
        out.append({
            f for f, failed in zip("ABCDE", (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                bool(re.search(r"[#$%&*|]", t)), doc_id is not None and doc_id > least[t],
            )) if failed
        })
    return out


def played(rows, labels):
    """Every order, document by document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = masks(rows)
    out, total = {}, Counter()
    for part in {s or "" for _, _, s in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone),
                ]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, source string, n int, mask int")


def label_table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, part string")


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        size = rng.choice([0, 5, 150, 199, 200, 201, 400])
        pool = words[: rng.choice([3, 100, 101, 400])]
        t = " ".join(rng.choice(pool) for _ in range(size))
        t = rng.choice([t, t, t + " #", t.upper(), "\n" + t + " \x0b é"])
        rows.append((i, t, rng.choice(["a", "a", "b", "", None])))
    for i in range(n):
        rows.append((rng.choice([n + i, -i, None, i]), rng.choice(rows)[1], rng.choice(["a", "c", None])))
    rows += [(None, None, None), (3, None, "b"), (3, "", "b"), (1, None, "only nulls"), (n, "same " * 300, "a"), (n, "same " * 300, "a"), (2, "long Text " * 60_000, "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, n, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (10**9, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order_played_out(spark, seed):
    rows, labels = corpus(seed, 60)
    got = found(audit.audited(table(spark, rows).repartition(7), label_table(spark, labels)))
    assert got == played(rows, labels)


def test_hot_text_and_empty_tables(spark):
    rows = [(i, "copy of a text", "a") for i in range(3000)] + [(10_000 + i, f"text {i}", "a") for i in range(50)]
    got = found(audit.audited(table(spark, rows), label_table(spark, [(0, 1, 1), (7, 1, 0)])))
    assert got["a", "EABCD", 1][:2] == (51, 2999) and got["a", "EABCD", 1][4:6] == (1, 0)
    assert got["a", "ABCDE", 1][4:6] == (2, 1) and len(got) == 600
    assert found(audit.audited(table(spark, rows[:1]), label_table(spark, []).limit(0)))["a", "EABCD", 1][:2] == (1, 0)
    assert audit.audited(table(spark, rows).limit(0), label_table(spark, [(0, 1, 1)])).count() == 0


@pytest.mark.parametrize("m", [2, 3, 5])
def test_least_squares_give_shapley_values(m):
    rng = random.Random(m)
    solver = audit.normal_inverse(m)
    for _ in range(20):
        v = [0, *[rng.randint(-1000, 1000) for _ in range((1 << m) - 1)]]
        want = [Fraction(0)] * m
        orders = list(permutations(range(m)))
        for order in orders:
            done = 0
            for f in order:
                want[f] += Fraction(v[done | 1 << f] - v[done], len(orders))
                done |= 1 << f
        assert audit.shapley(v, solver) == want


def test_inverse_of_rationals():
    matrix = [[Fraction(0), Fraction(2)], [Fraction(1, 3), Fraction(5)]]
    got = audit.inverse(matrix)
    assert [[sum(a * b for a, b in zip(r, c)) for c in zip(*got)] for r in matrix] == [[1, 0], [0, 1]]
