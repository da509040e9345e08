"""Corpus metrics: hand-worked cases and a brute-force implementation of the definitions."""

import math
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from icx.operators import metrics as M

CASES = {
    "same": ([("the cat sat on the mat", "the cat sat on the mat")], 100.0, 100.0, 100.0),
    "sub": ([("the cat sat on a mat", "the cat sat on the mat")], 53.7285, 65.9797, 67.4444),
    "short": ([("the cat sat on", "the cat sat on the mat")], 60.6531, 63.3497, 64.6094),
    "swap": ([("the sat cat on the mat .", "the cat sat on the mat .")], 47.2871, 68.7871, 70.3403),
    "disjoint": ([("xx yy zz ww", "ab cd ef gh")], 0.0, 0.0, 0.0),
    "clip": ([("the the the the", "the cat sat on")], 15.9736, 12.5201, 12.5184),
    "two": ([("the cat sat on a mat", "the cat sat on the mat"), ("a dog ran fast today.", "the dog ran fast today.")],
            59.4217, 75.4542, 75.7988),
}


# --- brute force from the published definitions --------------------------------------

def _ngrams(seq, n):
    return Counter(tuple(seq[i:i + n]) for i in range(len(seq) - n + 1))


def tok13a(line):
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(a, b)
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


def bleu(pairs, tok):
    correct, total, sl, rl = [0] * 4, [0] * 4, 0, 0
    for h, r in pairs:
        ht, rt = tok(h), tok(r)
        sl, rl = sl + len(ht), rl + len(rt)
        for n in range(1, 5):
            hc, rc = _ngrams(ht, n), _ngrams(rt, n)
            total[n - 1] += sum(hc.values())
            correct[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
    if not any(correct):
        return 0.0
    bp = (math.exp(1 - rl / sl) if sl > 0 else 0.0) if sl < rl else 1.0
    prec, smooth = [0.0] * 4, 1.0
    for n in range(4):
        if total[n] == 0:
            break
        if correct[n] == 0:
            smooth *= 2
            prec[n] = 100.0 / (smooth * total[n])
        else:
            prec[n] = 100.0 * correct[n] / total[n]
    if min(prec) == 0:
        return 0.0
    return bp * math.exp(sum(math.log(p) for p in prec) / 4)


def _split_punct(s):
    out = []
    for w in s.split():
        if len(w) == 1:
            out.append(w)
        elif w[-1] in string.punctuation:
            out += [w[:-1], w[-1]]
        elif w[0] in string.punctuation:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def chrf(pairs, word_order=0, beta=2.0):
    orders = 6 + word_order
    st = [[0, 0, 0] for _ in range(orders)]
    for h, r in pairs:
        hc, rc = "".join(h.split()), "".join(r.split())
        seqs = [(hc, rc, n) for n in range(1, 7)] + [(_split_punct(h), _split_punct(r), n) for n in range(1, word_order + 1)]
        for i, (a, b, n) in enumerate(seqs):
            H, R = _ngrams(list(a), n), _ngrams(list(b), n)
            st[i][0] += sum(H.values()) if R else 0
            st[i][1] += sum(R.values())
            st[i][2] += sum(min(c, R[g]) for g, c in H.items())
    p = r = e = 0
    for nh, nr, nm in st:
        if nh > 0 and nr > 0:
            p, r, e = p + nm / nh, r + nm / nr, e + 1
    if e == 0:
        return 0.0
    p, r = p / e, r / e
    f2 = beta * beta
    return 100 * (1 + f2) * p * r / (f2 * p + r) if p + r else 0.0


@pytest.mark.parametrize("name", sorted(CASES))
def test_hand_cases(spark, name):
    pairs, b, c, cpp = CASES[name]
    df = spark.createDataFrame([(name, h, r) for h, r in pairs], "run string, hypothesis string, reference string")
    row = M.score(df, ["run"], tokenizer="whitespace").first()
    assert row.bleu == pytest.approx(b, abs=1e-4)
    assert row.chrf == pytest.approx(c, abs=1e-4)
    assert row.chrf_pp == pytest.approx(cpp, abs=1e-4)
    assert bleu(pairs, str.split) == pytest.approx(b, abs=1e-4)
    assert chrf(pairs) == pytest.approx(c, abs=1e-4)


def test_document_metrics_against_brute_force(spark):
    """The scale query, checked on the smallest fixture against plain Python."""
    from conftest import SF_SMALL
    from icx.plans import catalog as C

    got = {r.run_id: r for r in C.document_metrics(spark, SF_SMALL).collect()}
    ln = C.tables.lines(spark, SF_SMALL)
    from icx.operators import perturb as PT

    for run in C.RUNS:
        hyp = F.col("text") if run == "clean" else PT.perturb(run, F.col("text"), [F.col("row_id")], F.col("code"), C.PTB_RATE, C.SEED)
        pairs = [(r.h, r.text) for r in ln.select(hyp.alias("h"), "text").collect()]
        assert got[run].bleu == pytest.approx(round(bleu(pairs, tok13a), 6), abs=1e-5), run
        assert got[run].chrf == pytest.approx(round(chrf(pairs), 6), abs=1e-5), run
        assert got[run].chrf_pp == pytest.approx(round(chrf(pairs, 2), 6), abs=1e-5), run
    assert got["clean"].bleu == pytest.approx(100.0)


def _odd_texts():
    import random

    rng = random.Random(11)
    signs = ["a", "b", "C", "9", "1", ".", ",", "-", "'", "$", " ", "  ", "\n", "-\n", "\t", "\xa0", "　", "é", "ж", "😀", "&amp;", "&quot;", "&lt;", "<skipped>", "...", ",,", ".5", "(", "]", "\\", "`"]
    return ["", " ", "a", ".", "...,"] + ["".join(rng.choices(signs, k=rng.choice((1, 3, 12, 90)))) for _ in range(400)]


def test_tokens_of_the_tasks_equal_the_column_forms(spark):
    texts = _odd_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    forms = {**{name: M.bleu_tokens(F.col("t"), name) for name in M.TOKENIZERS}, "chrf": M.chrf_words(F.col("t"))}
    for name, form in forms.items():
        numbers = M._Numbers(name)
        got = [numbers.of(t).tolist() for t in texts]
        names = {n: t for t, n in numbers.known.items()}
        for r in df.select("i", form.alias("w")).collect():
            assert [names[n] for n in got[r.i]] == r.w, (name, texts[r.i])


def test_counters_of_short_steps_and_large_alphabets(monkeypatch):
    """N-grams that do not fit one number are numbered anew; equal texts match themselves."""
    import random
    from collections import Counter

    import numpy as np

    rng = random.Random(4)
    for alphabet in (2, 90, 1_000_000):
        hyp = [[rng.randrange(alphabet) for _ in range(rng.choice((0, 1, 5, 60)))] for _ in range(40)]
        ref = [h if i % 5 == 0 else [rng.choice(h or [7]) for _ in range(rng.choice((0, 2, 50)))] for i, h in enumerate(hyp)]
        stream = lambda side: (np.array([x for t in side for x in t], np.int64), np.repeat(np.arange(40), [len(t) for t in side]))
        same = np.array([i % 5 == 0 for i in range(40)])
        for n, (h, r, m) in enumerate(M._counted(stream(hyp), stream(ref), 40, 6, same), 1):
            for i in range(40):
                a, b = (Counter(tuple(t[j:j + n]) for j in range(len(t) - n + 1)) for t in (hyp[i], ref[i]))
                assert (h[i], r[i], m[i]) == (sum(a.values()), sum(b.values()), sum((a & b).values()))


def test_runs_are_counted_in_the_job_that_scores_them(spark):
    """Before, the study's prompts were made a second time to count rows, and documents were exchanged once per run."""
    from conftest import SF_SMALL
    from icx.plans import catalog as C
    from icx.plans import study

    rows = spark.createDataFrame([("r", "e", "p", "a b", "a b"), ("r", "e", "p", None, "c"), ("s", "e", "p", "x", "y")],
                                 "run_id string, experiment string, prompt string, hypothesis string, reference string")
    got = study.scores(rows)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.run_id, r.n_rows, r.n_answered) for r in got.collect()} == {("r", 2, 1), ("s", 1, 1)}
    plan = C.document_metrics(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == plan.count("Repartition") == 1 and plan.index("Generate explode") < plan.index("Repartition")


def test_equal_pairs_are_counted_once_and_references_once(spark, monkeypatch):
    """Before, every run of a grid counted the n-grams of its texts anew, and a reference those of each hypothesis."""
    import pyarrow as pa

    rows = [(f"r{i % 50}", "the cat sat on a mat", "the cat sat on the mat") for i in range(200)]
    rows += [(f"r{i}", f"the cat {i} sat", "the cat sat on it") for i in range(20)] + [("r1", "", "the cat sat on it"), ("r1", "x", ""), ("r2", "", "")]
    looked, whole = [], M._matched
    monkeypatch.setattr(M, "_matched", lambda ids, *a: (looked.append(len(ids)), whole(ids, *a))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["run", "_h", "_r"])
    orders = M._orders(M.METRICS)
    got = [r.to_pylist() for r in M._count_batches(["run"], orders, "whitespace")(iter([batch]))]
    few = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(("a", "x y", "x z y"), ("b", "x", "x z y"), ("c", "", "x z y"))], names=["run", "_h", "_r"])
    assert [r["bleu_match_1"] for r in next(M._count_batches(["run"], orders, "whitespace")(iter([few]))).to_pylist()] == [2, 1, 0]
    assert looked[0] < 200 and [r["run"] for r in got[0]] == [r[0] for r in rows]
    for r, (_, h, ref) in zip(got[0], rows):
        for n in range(1, 5):
            a, b = _ngrams(h.split(), n), _ngrams(ref.split(), n)
            assert (r[f"bleu_hyp_{n}"], r[f"bleu_ref_{n}"], r[f"bleu_match_{n}"]) == (sum(a.values()), sum(b.values()), sum((a & b).values()))
        for n in range(1, 7):
            a, b = _ngrams("".join(h.split()), n), _ngrams("".join(ref.split()), n)
            assert (r[f"chr_hyp_{n}"], r[f"chr_ref_{n}"], r[f"chr_match_{n}"]) == (sum(a.values()) if b else 0, sum(b.values()), sum((a & b).values()))
