"""The vectorised noise rules against their column forms, on odd texts, keys and languages; no lambda per character in the plans."""

import random

import pytest
from pyspark.sql import functions as F

from icx.operators import perturb as PT

CODES = ("eng_Latn", "hin_Deva", "urd_Arab", "rus_Cyrl", "sat_Olck", "amh_Ethi", "xx_Zyyy", "nolang", None)
COLUMN_FORM = {
    "span_noise": lambda t, k, c, r, s: PT.span_noise(t, k, c, r, s),
    "word_duplication": lambda t, k, c, r, s: PT.word_duplication(t, k, r, s),
    "punctuation_drop_attack": lambda t, k, c, r, s: PT.punctuation_drop(t, k, c, r, s),
    "punctuation_add_attack": lambda t, k, c, r, s: PT.punctuation_add(t, k, c, r, s),
    "ocr": lambda t, k, c, r, s: PT.ocr(t, k, r, s),
    "word_order": lambda t, k, c, r, s: PT.word_order(t, k, r, s),
}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    signs = "abcde,.!\\-] \n\t\xa0\x1c　éЖжनम।ںا۔ᱟ᱾አ።😀\x00"
    rows = [(i, "".join(rng.choices(signs, k=rng.choice((1, 2, 9, 60, 300)))), rng.choice(CODES)) for i in range(200)]
    rows += [(i, t, "eng_Latn") for i, t in enumerate(("", " ", None, "a", "...", "the the the"), 200)] + [(None, "no key, no loss.", "eng_Latn")]
    return spark.createDataFrame(rows, "row_id long, text string, code string")


@pytest.mark.parametrize("attack", PT.ATTACKS)
def test_both_forms_of_a_rule_agree(texts, attack):
    for language in (F.col("code"), "urd_Arab"):
        for rate in (0.0, 0.3, 1.0):
            args = F.col("text"), [F.col("row_id"), F.lit("x")], language, rate, 5
            rows = texts.select("row_id", PT.perturb(attack, *args).alias("got"), COLUMN_FORM[attack](*args).alias("want")).collect()
            assert all(r.got == r.want for r in rows), next((r for r in rows if r.got != r.want))


@pytest.mark.parametrize("attack", PT.ATTACKS)
def test_texts_of_an_array_are_perturbed_by_their_own_keys(texts, attack):
    keys = F.array(F.lit("7"), F.lit(None).cast("string"), F.col("row_id").cast("string"))
    each = PT.perturb_each(attack, F.array("text", "text", F.lit("one, two. three")), keys, F.col("code"), 0.4, 9)
    alone = [PT.perturb(attack, F.col("text"), [F.lit("7")], F.col("code"), 0.4, 9), F.col("text"),
             PT.perturb(attack, F.lit("one, two. three"), [F.col("row_id")], F.col("code"), 0.4, 9)]
    for r in texts.filter("row_id is not null").select(each.alias("got"), F.array(*alone).alias("want")).collect():
        assert r.got == r.want


def test_an_attack_per_row(texts):
    attack = F.when(F.col("row_id") % 2 == 0, "ocr")
    for r in texts.filter("row_id is not null").select(
            "row_id", "text", PT.perturb(attack, F.col("text"), [F.col("row_id")], F.col("code"), 0.5, 1).alias("got"),
            PT.ocr(F.col("text"), [F.col("row_id")], 0.5, 1).alias("ocr")).collect():
        assert r.got == (r.text if r.row_id % 2 else r.ocr)


def test_long_texts_leave_the_interpreted_lambdas(spark):
    """Before, every character of a document went through lambdas of the plan."""
    from conftest import SF_SMALL
    from icx.plans import catalog

    for name in ("ptb_span_noise", "ptb_punctuation_add", "ptb_scripts_span_noise", "ptb_scripts_punctuation_add", "perturb_hetero_chat"):
        plan = catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan, name


@pytest.mark.parametrize("attack", PT.ATTACKS)
def test_several_rates_at_once(texts, attack):
    """Before, the words and ranks of a text were made anew for every rate."""
    rates, keys = (0.5, 0.0, 1.0, 0.1), F.array(F.lit("7"), F.lit(None).cast("string"), F.col("row_id").cast("string"))
    args = F.array("text", "text", F.lit("one, two. three")), keys, F.col("code")
    alone = [PT.perturb_each(attack, *args, r, 9) for r in rates]
    for r in texts.filter("row_id is not null").select(PT.perturb_each(attack, *args, rates, 9).alias("got"), F.array(*alone).alias("want")).collect():
        assert r.got == r.want
    none = PT.perturb_each(F.lit(None).cast("string"), *args, rates, 9)
    assert texts.select(none.alias("x")).filter("x is not null").count() == 0
