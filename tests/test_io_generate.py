"""Sources, sinks and the user batch-model hook."""

from pyspark.sql import functions as F

from icx.operators import generate as G
from icx.operators import perturb as PT
from icx.sources import fanout as FO
from icx.sources import io as IO


def test_text_file_job_keeps_order(spark):
    lines = [f"  line {i} has some words, and punctuation!  " for i in range(300)] + ["", "last line"]
    src = IO.scratch_dir(spark, "t-in")
    n = len(lines)
    spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").repartitionByRange(4, "i") \
        .sortWithinPartitions("i").select("t").write.text(src)
    back = IO.read_lines(spark, src).orderBy("line_no").collect()
    assert [r.text for r in back] == [t.strip() for t in lines]
    out = IO.scratch_dir(spark, "t-out")
    IO.perturb_text(spark, src, out, "eng_Latn", "word_order", seed=3)
    got = [r.text for r in IO.read_perturbed(spark, out).orderBy("line_no").collect()]
    expected = IO.perturb_lines(IO.read_lines(spark, src), "eng_Latn", "word_order", PT.DEFAULT_RATES["word_order"], 3) \
        .orderBy("line_no").collect()
    assert len(got) == n
    assert got == [r.text for r in expected]
    assert all("\n" not in g and g == g.strip() for g in got)


def test_jsonl_check():
    import pytest

    with pytest.raises(ValueError):
        IO.check_jsonl("dev.json")


def test_batch_model_hook_and_predictions(spark):
    prompts = spark.createDataFrame(
        [(i, f"Q{i}: ", f"ref {i}") for i in range(50)] + [(50, None, "ref 50")], "row_id long, prompt string, reference string")

    def init():
        calls = []

        def model(batch):
            calls.append(len(batch))
            assert len(batch) <= 8 and None not in batch
            return [p + f"answer {p[1:-2]}\nmore" for p in batch]

        return model

    raw = G.run(prompts, init, 8)
    assert raw.columns == ["row_id", "prompt", "reference", "raw"]
    some = raw.filter("row_id % 10 <> 3").select("row_id", "raw")
    pred = {r.row_id: r.hypothesis for r in G.predictions(prompts, some, ["row_id"]).collect()}
    assert pred == {i: None if i == 50 or i % 10 == 3 else f"answer {i}" for i in range(51)}
    assert sorted(r.row_id for r in G.lost_rows(prompts, some, ["row_id"]).collect()) == [3, 13, 23, 33, 43, 50]


def test_sinks_roundtrip(spark):
    pred = spark.createDataFrame([("r1", 1, "p", "h", "x"), ("r2", 2, "p", "h", "y")],
                                 "run_id string, row_id long, prompt string, hypothesis string, reference string")
    path = IO.scratch_dir(spark, "pred")
    IO.write_predictions(pred, path)
    assert spark.read.parquet(path).filter(F.col("run_id") == "r2").count() == 1
    pairs = spark.createDataFrame([("eng_Latn", "deu_Latn", 0, "a", "b")], "src_lang string, tgt_lang string, row_id long, src string, tgt string")
    jp = IO.scratch_dir(spark, "pairs")
    IO.write_pairs(pairs, jp)
    assert spark.read.json(jp).filter("src_lang = 'eng_Latn'").count() == 1


def test_pair_file_orientation():
    assert FO.pair_file("flores", "dev", "eng_Latn", "hin_Deva")[0] == "data/dev/flores_eng_Latn-hin_Deva.jsonl"
    path, s, t = FO.pair_file("flores", "dev", "hin_Deva", "eng_Latn")
    assert path == "data/dev/flores_eng_Latn-hin_Deva.jsonl" and s == "sentence_hin_Deva" and t == "sentence_eng_Latn"
