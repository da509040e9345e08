"""Perturbation operators: script fixture edge cases, invariants, determinism."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from icx.functions.scripts import ASCII_CLASS
from icx.operators import perturb as PT

ROWS = [
    (1, "eng_Latn", "Hello, world! This is a test."),
    (2, "hin_Deva", "नमस्ते दुनिया। यह एक परीक्षा है।"),
    (3, "urd_Arab", "سلام دنیا، یہ ایک امتحان ہے۔"),
    (4, "rus_Cyrl", "Привет, мир! Это тест."),
    (5, "sat_Olck", "ᱡᱚᱦᱟᱨ ᱫᱷᱟᱹᱨᱛᱤ᱾"),
    (6, "amh_Ethi", "ሰላም ለዓለም።"),
    (7, "eng_Latn", ""),
    (8, "eng_Latn", "a"),
    (9, "eng_Latn", "the the the cat"),
    (10, "eng_Latn", "one,"),
    (11, "eng_Latn", "a\\b c\xa0d　e\x1cf"),
    (12, "eng_Latn", "smile 😀 twice 😀!"),
]


def run(spark, attack, rate, rows=ROWS, seed=42):
    df = spark.createDataFrame(rows, "row_id long, language string, text string")
    out = df.select("row_id", "text", PT.perturb(attack, F.col("text"), [F.col("row_id")], F.col("language"), rate, seed).alias("o"))
    return {r.row_id: (r.text, r.o) for r in out.collect()}


@pytest.mark.parametrize("attack", PT.ATTACKS)
def test_empty_text_unchanged(spark, attack):
    assert run(spark, attack, 0.5)[7] == ("", "")


def test_word_duplication_multiset(spark):
    for rate in (0.1, 0.5, 1.0):
        for rid, (t, o) in run(spark, "word_duplication", rate).items():
            w, v = t.split(), o.split()
            if not w:
                continue
            k = max(1, int(len(w) * rate))
            assert len(v) == len(w) + k
            assert all(Counter(v)[x] >= c for x, c in Counter(w).items())


def test_word_order_is_permutation(spark):
    for rate in (0.25, 0.75):
        for rid, (t, o) in run(spark, "word_order", rate).items():
            assert Counter(t.split()) == Counter(o.split())
    out = run(spark, "word_order", 1.0)
    assert out[1][1] != " ".join(out[1][0].split())  # all words chosen, distinct words -> moved
    assert out[8][1] == "a"


def test_ocr_keeps_non_space_characters(spark):
    for rate in (0.2, 0.75):
        for rid, (t, o) in run(spark, "ocr", rate).items():
            assert "".join(t.split()) == "".join(o.split())
    assert run(spark, "ocr", 0.5)[8][1] == "a"


def test_punctuation_drop(spark):
    out = run(spark, "punctuation_drop_attack", 1.0)
    assert out[1][1] == "Hello world This is a test"
    assert out[11][1] == out[11][0]  # backslash is not in the class
    half = run(spark, "punctuation_drop_attack", 0.5)
    t, o = half[1]
    removed = Counter(t) - Counter(o)
    assert sum(removed.values()) == max(1, int(3 * 0.5))
    assert all(ord(c) in ASCII_CLASS for c in removed)


def test_punctuation_add(spark):
    out = run(spark, "punctuation_add_attack", 1.0)
    assert out[10][1] == "one,"  # no candidate word
    the = [w for w in out[9][1].split() if w.startswith("the")]
    assert len(the) == 3 and all(len(w) == 4 for w in the)  # every occurrence marked
    assert all(w[-1] in "।॥" for w in out[2][1].split() if w not in out[2][0].split())
    assert out[5][1].count("᱾") >= 2  # Olck mark
    assert len(out[4][1].split()) == 4


def test_span_noise(spark):
    out = run(spark, "span_noise", 0.5)
    assert out[6][1] == out[6][0]  # script without a range: no-op
    assert out[8][1] == "a"  # budget int(1 * 0.5) = 0
    assert out[1][1] != out[1][0]
    assert len(out[1][1]) < len(out[1][0])


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        PT.perturb("ocr", F.col("t"), [F.col("k")], "eng_Latn", 1.5, 1)
    with pytest.raises(NotImplementedError):
        PT.perturb("nope", F.col("t"), [F.col("k")], "eng_Latn", 0.5, 1)


@pytest.mark.parametrize("attack", PT.ATTACKS)
def test_partitioning_does_not_change_results(spark, attack):
    from conftest import SF_SMALL
    from icx.sources import tables

    ln = tables.lines(spark, SF_SMALL)
    results = []
    for n in (1, 7, 64):
        df = ln.repartition(n)
        out = df.select("row_id", PT.perturb(attack, F.col("text"), [F.col("row_id")], F.col("code"), 0.25, 7).alias("o"))
        results.append(sorted(map(tuple, out.collect())))
    assert results[0] == results[1] == results[2]
