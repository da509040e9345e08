"""A fan-out that is started again: finished pairs stay, failing ones are reported, nothing is doubled."""

import itertools

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from icx.sources import fanout as FO
from icx.sources import io as IO

CODES = "abcdef"


@pytest.fixture
def study(spark):
    sent = spark.createDataFrame([(i, c, None if i == 3 else f"{c} \"{i}\"\n") for n, c in enumerate(CODES[:-1]) for i in range(5 + n)],
                                 "row_id long, code string, text string")
    wanted = spark.createDataFrame(list(itertools.permutations(CODES, 2)), "src_lang string, tgt_lang string")
    return FO.fan_out(sent, wanted), wanted


def broken(rows, *pairs):
    bad = F.concat("src_lang", "tgt_lang").isin(*pairs)
    return rows.withColumn("src", F.when(bad, F.raise_error(F.lit("gone")).cast("string")).otherwise(F.col("src")))


def state(report):
    return {r.src_lang + r.tgt_lang: (r.status, r.n_rows, r.written) for r in report.collect()}


def test_failed_pairs_are_reported_and_the_others_stay(spark, study):
    rows, wanted = study
    path = IO.scratch_dir(spark, "t-fan")
    first = FO.write_fan_out(broken(rows, "ab", "dc"), wanted, path, wave=7)
    errors = {r.src_lang + r.tgt_lang: r.error for r in first.collect() if r.error}
    got = state(first)
    assert errors.keys() == {"ab", "dc"} and all("gone" in e for e in errors.values())
    for a, b in itertools.permutations(CODES, 2):
        n = min(5 + CODES.index(a), 5 + CODES.index(b))
        assert got[a + b] == (("failed", 0, False) if a + b in errors else ("missing", 0, True) if "f" in (a, b) else ("done", n, True))
    have = rows.filter(~F.concat("src_lang", "tgt_lang").isin("ab", "dc"))
    assert sorted(FO.read_fan_out(spark, path).collect(), key=str) == sorted(have.collect(), key=str)
    again = state(FO.write_fan_out(rows, wanted, path))
    assert {p for p, s in again.items() if s[2]} == {"ab", "dc"} and all(s[0] != "failed" for s in again.values())
    assert sorted(FO.read_fan_out(spark, path).collect(), key=str) == sorted(rows.collect(), key=str)
    assert not any(s[2] for s in state(FO.write_fan_out(broken(rows, "ab"), wanted, path)).values())  # nothing is left to write


def test_a_run_that_dies_before_its_manifest_replaces_its_rows(spark, study, monkeypatch):
    rows, wanted = study
    path = IO.scratch_dir(spark, "t-fan-dies")
    rows.write.partitionBy(*FO.PAIR).json(f"{path}/pairs")  # rows without an entry in the manifest
    assert FO.read_fan_out(spark, path).count() == 0
    FO.write_fan_out(rows, wanted, path)
    assert sorted(FO.read_fan_out(spark, path).collect(), key=str) == sorted(rows.collect(), key=str)


def test_empty_fan_outs(spark, study):
    rows, wanted = study
    path = IO.scratch_dir(spark, "t-fan-empty")
    assert FO.write_fan_out(rows, wanted.limit(0), path).count() == 0
    assert {s[0] for s in state(FO.write_fan_out(rows.limit(0), wanted, path)).values()} == {"missing"}
    assert FO.read_fan_out(spark, path).count() == 0
    with pytest.raises((Py4JJavaError, PySparkException)):
        broken(rows, "ab").collect()


def test_texts_are_exchanged_once_for_all_waves(spark):
    """Before, every wave and every try exchanged the texts of both sides again."""
    sent = spark.createDataFrame([(i, c, f"{c}{i}") for c in "abc" for i in range(4)] + [(9, "a", "alone"), (None, "a", "x"), (None, "b", "y")]
                                 + [(1, "b", "twice"), (2, "a", None)], "row_id long, code string, text string")
    wanted = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "z")], "src_lang string, tgt_lang string")
    rows = FO.fan_out(sent, wanted)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    s, t = sent.toDF("row_id", "src_lang", "src"), sent.toDF("row_id", "tgt_lang", "tgt")
    want = s.join(t, "row_id").join(wanted, FO.PAIR).select(*rows.columns)
    assert sorted(rows.collect(), key=str) == sorted(want.collect(), key=str)
