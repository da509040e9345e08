"""The grid job against single-run queries and direct scores, run by run."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from icx.operators import demos as D
from icx.operators import metrics as M
from icx.operators import prompts as P
from icx.plans import catalog as C
from icx.plans import grid as GR
from icx.plans import study
from icx.sources import tables


def test_grid_runs_equal_single_runs(spark):
    test, dev = C._test_dev(spark, SF_SMALL)
    aux_dev = C._split(tables.aux_pairs(spark, SF_SMALL), "dev")
    triples = tables.triples(spark, SF_SMALL)
    asked = study.prompts(test, dev, aux_dev, triples, C.SRC, C.TGT, C.AUX, C.PIVOT, model="plain/text-model").cache()
    pair = spark.createDataFrame([(C.SRC, C.TGT)], "src_lang string, tgt_lang string")
    grid = GR.runs(pair, study.DEMO_EXPERIMENTS).unionByName(
        GR.runs(pair.withColumn("aux_lang", F.lit(C.AUX)), ("allied",))).unionByName(GR.runs(pair.withColumn("pivot_lang", F.lit(C.PIVOT)), ("pivot",)))
    ids = {tuple(r)[1:]: r.run_id for r in grid.select("run_id", "experiment", "shots", "kind", "seed", "attack", "rate", "direction", "htype", "variant").collect()}
    assert len(ids) == grid.count() == len(set(ids.values()))
    assert {r.run_id for r in asked.select("run_id").distinct().collect()} == set(ids.values())

    def mine(*key):
        return sorted((r.row_id, r.prompt) for r in asked.filter(F.col("run_id") == ids[key]).collect())

    def rows(df):
        return sorted((r.row_id, r.prompt) for r in df.collect())

    for kind in P.INSTRUCTION_KINDS:
        assert mine("instruction", 4, kind, 42, None, None, None, None, None) == rows(C._few_shot(spark, SF_SMALL, kind=kind))
    assert mine("directionality", 8, None, 25, None, None, None, None, None) == rows(P.few_shot(D.select_demos(test, dev, 8, 25), C.SRC, C.TGT))
    for direction in GR.DIRECTIONS:
        assert mine("homogeneous", 4, None, 42, "word_order", 0.25, direction, None, None) == rows(C._homogeneous(spark, SF_SMALL, direction))
    for htype in GR.HETERO_TYPES:
        assert mine("heterogeneous", 4, None, 42, "span_noise", 0.25, "target", htype, None) == rows(C._hetero(spark, SF_SMALL, htype))
    assert mine("allied", 4, None, 42, None, None, None, None, None) == rows(C._allied(spark, SF_SMALL))
    for v in ("I", "III"):
        want = sorted((r.sp_id, r.prompt) for r in C.QUERIES[f"pivot_variant_{v}"](spark, SF_SMALL).collect())
        assert mine("pivot", 0, None, 42, None, None, None, None, v) == want
    chat = study.prompts(test, dev, aux_dev, triples, C.SRC, C.TGT, C.AUX, C.PIVOT)
    one = chat.filter(F.col("run_id") == ids["instruction", 1, "standard", 42, None, None, None, None, None]).first().prompt
    assert one.startswith("[system] Translate this from English into German.")
    predicted = study.predictions(asked, 3000).cache()
    got = {r.run_id: r for r in study.scores(predicted).collect()}
    assert set(got) == set(ids.values())
    key = ids["homogeneous", 1, None, 42, None, None, None, None, None]
    seg = predicted.filter(F.col("run_id") == key)
    assert got[key].n_rows == seg.count() and got[key].n_answered == seg.filter("hypothesis is not null").count()
    assert abs(got[key].chrf - M.score(seg, ["run_id"]).first().chrf) < 1e-9


def test_a_set_of_runs_is_perturbed_at_once(spark, monkeypatch):
    """Before, each run perturbed its demonstrations: 400 rows of a test row went to the noise, now one per draw, attack and direction."""
    seen, whole = [], study.PT.perturb_each
    monkeypatch.setattr(study.PT, "perturb_each", lambda attack, texts, keys, lang, rate, seed: (seen.append(rate), whole(attack, texts, keys, lang, rate, seed))[1])
    pairs = "row_id long, src string, tgt string"
    test = spark.createDataFrame([(1, "a b, c d.", "e f g h"), (2, "i j.", None)], pairs)
    dev = spark.createDataFrame([(i, f"one, two {i} three.", f"four {i}, five") for i in range(10, 20)], pairs)
    triples = spark.createDataFrame([], "sp_id long, pt_id long, src string, pivot string, tgt string")
    asked = study.prompts(test, dev, dev, triples, "eng_Latn", "deu_Latn", "fra_Latn", "fra_Latn", model="plain/text-model")
    assert seen == [GR.RATES]
    sets = spark.range(1).select(study._sets("eng_Latn", "deu_Latn", study.DEMO_EXPERIMENTS).alias("x")).first().x
    assert sum(s.attack is not None for x in sets.values() for s in x) == 3 * 6 * 2 + 2 * 4 * 2
    runs = 15 + 9 + 3 + 144 + 256 + 3
    assert asked.count() == 2 * runs == 2 * asked.select("run_id").distinct().count()
    key = "heterogeneous|eng_Latn|deu_Latn|||4||42|ocr|0.25|source|IV|"
    mine = asked.filter(F.col("run_id") == F.md5(F.lit(key))).orderBy("row_id").collect()
    assert len(mine) == 2 and all(r.prompt.count("English: ") == 5 for r in mine)


def test_a_prompt_is_taken_off_by_bytes_or_characters(spark):
    from icx.operators import generate as G

    cases = [("pé 😀", "pé 😀 ünd\nextra"), ("pé😀", "other😀 text"), ("", " x "), ("p", "p"), (None, "p x"), ("p", None), ("longer", "l")]
    rows = spark.createDataFrame(cases, "prompt string, raw string").select("prompt", "raw", G.clean(F.col("raw"), F.col("prompt")).alias("got")).collect()
    for r in rows:
        assert r.got == (None if r.prompt is None or r.raw is None else r.raw[len(r.prompt):].strip().split("\n")[0])
    odd = spark.createDataFrame([(f"{c}a{c} b{c}{c}",) for c in map(chr, range(1, 0x3100)) if not 0xD800 <= ord(c) < 0xE000], "t string")
    from icx.functions.text import py_strip

    assert all(r.t.strip() == r.s for r in odd.select("t", py_strip(F.col("t")).alias("s")).collect())
