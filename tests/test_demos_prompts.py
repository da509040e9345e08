"""Sampling, dense index and prompt composition."""

import pytest
from pyspark.sql import functions as F

from icx.operators import demos as D
from icx.operators import prompts as P
from icx.sources.index import dense_index


def test_dense_index_is_a_permutation_in_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 10007).alias("k"))
    idx, n, _ = dense_index(df, ["k"], name="i", partitions=13)
    rows = idx.orderBy("i").collect()
    assert n == 5000
    assert [r.i for r in rows] == list(range(5000))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_floyd_draw_properties(spark):
    test = spark.range(0, 2000).withColumnRenamed("id", "row_id")
    out = D.draw(test, "row_id", 37, 8, seed=3).select("demo_idx").collect()
    for r in out:
        assert len(r.demo_idx) == 8 and len(set(r.demo_idx)) == 8
        assert all(0 <= x < 37 for x in r.demo_idx)
    hits = {}
    for r in out:
        for x in r.demo_idx:
            hits[x] = hits.get(x, 0) + 1
    assert len(hits) == 37  # every pool row gets used
    assert max(hits.values()) < 3 * min(hits.values())
    assert D.draw(test, "row_id", 37, 0, seed=3).select(F.size("demo_idx").alias("n")).distinct().first().n == 0
    with pytest.raises(ValueError):
        D.draw(test, "row_id", 3, 4, seed=3)


def _tiny(spark):
    dev = spark.createDataFrame([(i, f"s{i}", f"t{i}") for i in range(10)], "row_id long, src string, tgt string")
    test = spark.createDataFrame([(100, "hello", "hallo"), (101, "bye", "tschüss")], "row_id long, src string, tgt string")
    return test, dev


def test_broadcast_and_shuffle_fetch_agree(spark):
    test, dev = _tiny(spark)
    a = D.select_demos(test, dev, 3, 42, force="broadcast").select("row_id", "demos").collect()
    b = D.select_demos(test, dev, 3, 42, force="shuffle").select("row_id", "demos").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_golden_text_prompt(spark):
    test, dev = _tiny(spark)
    out = P.few_shot(D.select_demos(test, dev, 2, 42), "eng_Latn", "deu_Latn").filter("row_id = 100").first()
    d = out.demos
    expected = (
        "Translate this from English into German:\n\n"
        + "".join(f"English: {x.src}\nGerman: {x.tgt}\n\n" for x in d)
        + "English: hello\nGerman: "
    )
    assert out.prompt == expected
    assert [x.pos for x in d] == [0, 1]


def test_golden_chat_prompt_no_instruction(spark):
    test, dev = _tiny(spark)
    out = P.few_shot(D.select_demos(test, dev, 1, 42), "eng_Latn", "deu_Latn", chat=True, kind="no_instruct")
    msgs = out.filter("row_id = 101").first().prompt
    assert [m.role for m in msgs] == ["user", "assistant", "user"]
    assert msgs[1].content.endswith("\n\n") and msgs[2].content == "English: bye\nGerman: "


def test_contrastive_and_pivot_text(spark):
    df = spark.createDataFrame([(1, 2, "s", "p", "t")], "sp_id long, pt_id long, src string, pivot string, tgt string")
    row = df.select(P.pivot_prompt(F.col("src"), F.col("pivot"), F.col("tgt"), "Hindi", "English", "Marathi", False).alias("p")).first()
    assert row.p == ("Translate this from Hindi into English:\n\nHindi: s\nEnglish: p\n\n"
                     "Translate this from English into Marathi:\n\nEnglish: p\nMarathi: t\n\n"
                     "Translate this from Hindi into Marathi:\n\nHindi: s\nMarathi: ")
    c = P.instruction("contrastive", "A", "B", False, 1, F.lit(1))
    assert spark.range(1).select(c.alias("c")).first().c == "Translate this from B into A :\n\n"
