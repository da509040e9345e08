"""Semantic properties of the pivot draw and the allied-language choice."""

from pyspark.sql import functions as F

from icx.operators import pivot as PV
from icx.plans import grid as GR

F2 = [(1, 1, "s1", "p1", "t1"), (2, 2, "s2", "p1", "t2"), (3, 3, "s3", "p2", "t3"), (4, 4, "s3", "p2", "t4"),
      (5, 5, "s5", "p3", "t5")]


def _triples(spark, rows=F2):
    return spark.createDataFrame(rows, "sp_id long, pt_id long, src string, pivot string, tgt string")


def test_misaligned_key_always_differs(spark):
    for key in ("pivot", "src"):
        for seed in range(20):
            out = PV.misaligned(_triples(spark), key, seed).collect()
            assert len(out) == 5
            for r in out:
                assert r[f"j_{key}"] is not None and r[f"j_{key}"] != r[key]


def test_misaligned_candidates_match_fixture(spark):
    seen = {1: set(), 3: set()}
    for seed in range(60):
        by_pivot = {r.sp_id: r.j_tgt for r in PV.misaligned(_triples(spark), "pivot", seed).collect()}
        by_src = {r.sp_id: r.j_tgt for r in PV.misaligned(_triples(spark), "src", seed).collect()}
        seen[1].add(by_pivot[1])
        seen[3].add(by_src[3])
    assert seen[1] == {"t3", "t4", "t5"}  # row 1, key=pivot -> rows 3, 4, 5
    assert seen[3] == {"t1", "t2", "t5"}  # row 3, key=src -> rows 1, 2, 5


def test_misaligned_no_candidate_gives_null(spark):
    rows = [(1, 1, "s", "p", "t1"), (2, 2, "s", "p", "t2")]
    out = PV.misaligned(_triples(spark, rows), "pivot", 1).collect()
    assert all(r.j_tgt is None for r in out)


def test_variant_texts(spark):
    v4 = {r.sp_id: r for r in PV.variant_texts(_triples(spark), "IV", 3).collect()}
    assert v4[1].src == "s1" and v4[1].pivot == "p1" and v4[1].tgt in {"t3", "t4", "t5"}


def test_allied_choices(spark):
    pairs = spark.createDataFrame([("hin_Deva", "mar_Deva"), ("eng_Latn", "deu_Latn"), ("sat_Olck", "eng_Latn")],
                                  "src_lang string, tgt_lang string")
    rows = GR.allied_choices(pairs, seed=5).collect()
    got = {(r.src_lang, r.choice): r.aux_lang for r in rows}
    assert got[("hin_Deva", "same")] == "hin_Deva" and got[("hin_Deva", "english")] == "eng_Latn"
    assert got[("hin_Deva", "same_script")].endswith("_Deva")
    assert got[("hin_Deva", "same_script")] not in ("hin_Deva", "mar_Deva")
    assert got[("eng_Latn", "same_script")].endswith("_Latn")
    assert got[("eng_Latn", "random")] not in ("eng_Latn", "deu_Latn")
    assert got[("sat_Olck", "same_script")] is None  # no other Ol Chiki language


def test_grid_sizes(spark):
    pairs = spark.createDataFrame([("eng_Latn", "deu_Latn")], "src_lang string, tgt_lang string")
    sizes = {r.experiment: r["count"] for r in GR.runs(pairs).groupBy("experiment").count().collect()}
    assert sizes == {"instruction": 15, "directionality": 9, "homogeneous": 147, "heterogeneous": 256,
                     "allied": 3, "pivot": 4}
    names = GR.runs(pairs, ("homogeneous",)).select("run_name").collect()
    assert any(r.run_name == "Llama-2-7b-chat-hf-eng_Latn-deu_Latn-4shot-ocr-ocr_percentage_0.25" for r in names)
    assert any(r.run_name.endswith("-1shot-clean") for r in names)
