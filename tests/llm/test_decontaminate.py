"""Greedy string tiling against a plain search, and the defined cases."""

import random
import re

from icx.llm import decontaminate as D


def plain_tiles(a, b, least):
    """Textbook greedy string tiling: longest unmarked common run first."""
    ua, ub, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and ua[i + k] and ub[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return covered
        for x in range(k):
            ua[i + x] = ub[j + x] = False
        covered += k


def test_tiles_cover_as_the_plain_search():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 25))]
        b = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.5:
            i = rng.randrange(len(a))
            b[len(b) // 2 : len(b) // 2] = a[i:] + a[:i]
        got = D.tiles(a, b, 3)
        assert all(a[i : i + k] == b[j : j + k] and k >= 3 for i, j, k in got)
        assert len({x for i, _, k in got for x in range(i, i + k)}) == sum(k for _, _, k in got)
        assert len({x for _, j, k in got for x in range(j, j + k)}) == sum(k for _, _, k in got)
        assert abs(sum(k for _, _, k in got) - plain_tiles(a, b, 3)) <= 0


def test_reordered_passages_and_cases(spark):
    item = "The quick brown fox jumps over the lazy dog, while seven wise owls watch from an ancient oak tree nearby."
    moved = "Prologue. Seven wise owls WATCH from an ancient oak tree, and then the quick brown fox jumps over the lazy dog!"
    docs = [
        (0, f"words before {item} words after", 1), (1, moved, 1), (2, "the quick brown fox slept over there", 1), (3, None, 1), (4, "", 1),
        (5, "Two words", 1), (6, "two words more", 1), (7, item, 1), (7, item, 1), (None, item, 1), (8, "x " * 30_000 + item, 1), (9, "École été ÉCOLE à la mer", 1),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(1, item, "q"), (2, "two words", "q"), (3, None, "q"), (4, "", "q"), (1, item, "q"), (5, "école Été école À LA mer", "q")], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.contaminated, r.best_item) for r in D.judged(d, b).collect()), key=str)
    want = [(0, True, 1), (1, True, 1), (2, False, None), (3, False, None), (4, False, None), (5, True, 2), (6, False, None), (7, True, 1), (7, True, 1), (None, True, 1), (8, True, 1), (9, True, 5)]
    assert got == sorted(want, key=str)
    assert sorted(r.doc_id for r in D.cleaned(d, b).collect()) == [2, 3, 4, 6]
    assert D.cleaned(d, b).columns == d.columns
    assert D.judged(d.limit(0), b).count() == 0
    assert not any(r.contaminated for r in D.judged(d, b.limit(0)).collect())


def test_query_against_a_plain_search(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    bench = {r.item_id: words(r.text) for r in items.collect()}
    want = set()
    for r in docs.collect():
        w = words(r.text)
        grams = {tuple(w[i : i + 5]) for i in range(len(w))}
        for i, b in bench.items():
            if any(tuple(b[k : k + 5]) in grams for k in range(len(b) - 4)) and plain_tiles(b, [x for x in w], 5) >= 0.5 * len(b):
                want.add(r.doc_id)
    assert {r.doc_id for r in D.judged(docs, items).collect() if r.contaminated} == want
    assert want


def test_quotes_dashes_and_case_of_any_script(spark):
    item = 'She said "never trust a lone fox" - and the owls, all seven, agreed with her at once.'
    reset = "She said \u201cnever\u00a0trust a lone fox\u201d \u2014 and the owls,\u202fall seven,\u2026 agreed with her at once."
    cyrillic, greek = "Семь мудрых сов смотрят на лису из старого дуба у реки", "Επτά σοφές κουκουβάγιες κοιτούν την αλεπού από τη βελανιδιά"
    docs = spark.createDataFrame([(1, reset), (2, cyrillic.upper()), (3, greek.upper()), (4, "Семь сов и лиса у реки")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, cyrillic), (3, greek)], "item_id long, text string")
    got = {r.doc_id: r.best_item for r in D.judged(docs, items).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: None}
