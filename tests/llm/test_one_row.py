"""Documents that share a doc_id or have none: one row of each component."""

from collections import Counter

from icx.llm import simjoin


def test_one_row_of_each_component(spark):
    line = [f"w{i}" for i in range(60)]
    copy = " ".join(line + ["end"])
    rows = [
        (3, " ".join(line), "a"), (5, "a text of its own that nobody else has", "b"), (5, copy, "c"), (5, "another text of its own under this number", "d"),
        (None, "no number but words that are its own", "e"), (None, "no number either and quite different words", "f"), (None, copy, "g"), (None, None, "h"),
        (5, None, "i"), (6, "", "j"), (3, " ".join(line), "k"), (None, "no number but words that are its own", "l"), (6, "", "m"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = Counter((r.doc_id, r.text) for r in simjoin.one_of_each(docs).collect())
    want = {(d, t) for d, t, _ in rows} - {(5, copy), (None, copy)}
    assert got == Counter(want)
    again = Counter((r.doc_id, r.text) for r in simjoin.one_of_each(docs.repartition(5)).collect())
    assert again == got
