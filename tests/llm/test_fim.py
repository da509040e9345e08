"""Fill-in-middle: the definition by plain slicing, exact round trips, odd texts."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from icx.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slicing strings."""
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<PSM>ab é\U0001f642\n", max_size=40), st.data())
def test_rotations_are_slices_and_come_back(text, data):
    raw = text.encode()
    if any(s in raw for s in (b"<P>", b"<S>", b"<M>")):
        return
    i = data.draw(st.integers(0, len(raw)))
    j = data.draw(st.integers(i, len(raw)))
    p, m, s = raw[:i], raw[i:j], raw[j:]
    for form, want in (("psm", b"<P>" + p + b"<S>" + s + b"<M>" + m), ("spm", b"<S>" + s + b"<P>" + p + b"<M>" + m)):
        buf = bytearray(raw)
        fim.transform(buf, i, j, form)
        assert bytes(buf) == want
        fim.restore(buf, form)
        assert bytes(buf) == raw


def test_reversal_beyond_its_window():
    rng = random.Random(1)
    for n in (0, 1, 2, 2 * fim.WINDOW, 2 * fim.WINDOW + 1, 5 * fim.WINDOW + 7):
        raw = rng.randbytes(n)
        buf = bytearray(raw)
        fim.reverse(buf, 0, n)
        assert bytes(buf) == raw[::-1]
        m = n // 3
        buf = bytearray(raw)
        fim.rotate(buf, 0, m, n)
        assert bytes(buf) == raw[m:] + raw[:m]


def test_documents_by_the_definition(spark):
    rng = random.Random(7)
    alphabet = ["a", "bé", " ", "\n", "\t\x0b", " ", "\U0001f642", "<P", ">", "<", "S>", "word"]
    texts = [None, "", " ", " \n", "<P>", "a <M> b", "x", " x ", "  y", "long words " * 60_000]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(400)]
    rows = [(i, t, 1, "n") for i, t in enumerate(texts)] + [(None, "no number here", 2, "f"), (3, " \n", 1, "n"), (3, " \n", 1, "n"), (-7, "below zero it is", 1, "n"), (2**62, "a very large number", 1, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string").repartition(5)
    got = fim.restored(fim.transformed(docs)).collect()
    assert len(got) == len(rows)
    have = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=repr)
    want = sorted(((d, *plain(d, t), t or "") for d, t, _, _ in rows), key=repr)
    assert have == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.digests(docs.limit(0)).count() == 0


def test_rates_and_seed_are_parameters(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some words of ', id) AS text")
    forms = lambda *a, **k: [r.form for r in fim.transformed(docs, *a, **k).orderBy("doc_id").collect()]
    assert set(forms(rate=0)) == {"plain"} and set(forms(100, 0)) == {"psm"} and set(forms(100, 100)) == {"spm"}
    assert forms(seed=1) != forms(seed=2) and forms(seed=1) == forms(seed=1)
