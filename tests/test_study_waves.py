"""The study over all language pairs in waves: the same prompts, drawn rows fetched once, exchanges dropped."""

import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from icx.operators.segments import GatheredPools
from icx.plans import catalog
from icx.plans import grid as GR
from icx.plans import study as ST
from icx.sources import fanout as FO
from icx.sources import tables
from icx.sources.index import stored_index

SIZES = {"eng_Latn": 61, "deu_Latn": 40, "hin_Deva": 40, "xx_Zyyy": 18, "fra_Latn": 0}
EXPERIMENTS = ("instruction", "directionality", "homogeneous")


def sentences(spark, sizes=None):
    rows = [(i, c, None if (c, i) in (("hin_Deva", 7), ("deu_Latn", 8)) else f"{c} Satz {i} – 😀 " + "é" * (i % 5)) for c, n in (sizes or SIZES).items() for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, code string, text string").repartition(5)
    return df, GR.language_pairs(df.select("code").distinct())


def prompts(df):
    return df.withColumn("run", F.explode("runs")).select("run.run_id", "run.experiment", *ST.PAIR, "row_id", "shots", "prompt", "n_chars", "reference")


@pytest.mark.parametrize("wave_bytes", [1, 64 << 20])
def test_waves_make_the_prompts_of_all_pairs(spark, wave_bytes):
    sent, wanted = sentences(spark)
    got = ST.outcome_of_sentences(sent, wanted, F.col("row_id") % 4 == 0, prompts, EXPERIMENTS, wave_bytes=wave_bytes).collect()
    assert all(r.n_chars == (None if r.prompt is None else len(r.prompt)) for r in got) and any(r.prompt is None for r in got)
    pairs = FO.fan_out(sent, wanted)
    want = ST.prompts_of_pairs(pairs.filter("row_id % 4 = 0"), pairs.filter("row_id % 4 <> 0"), EXPERIMENTS, noise=False, model="a/base-model")
    own = ("run_id", "experiment", *ST.PAIR, "row_id", "shots", "prompt", "reference")
    assert sorted((tuple(r[c] for c in own) for r in got), key=str) == sorted((tuple(r) for r in want.select(*own).collect()), key=str)


def test_no_pairs_have_no_prompts(spark):
    sent, wanted = sentences(spark, {"eng_Latn": 9})
    assert ST.outcome_of_sentences(sent, wanted, F.col("row_id") % 4 == 0, prompts, EXPERIMENTS).count() == 0


def test_pairs_with_the_same_pool_fetch_a_row_once(spark):
    sent, wanted = sentences(spark)
    rows = FO.gathered(sent, wanted).withColumn("in_all", F.transform("in_all", lambda s: F.struct(s["code"].alias("code"), s["text"].alias("text"), F.length(s["text"]).cast("long").alias("chars")))).checkpoint()
    draws = ST._draws(EXPERIMENTS, False)
    pools = GatheredPools(rows, wanted, F.col("row_id") % 4 == 0, draws)
    assert sorted((len(r.pairs), r["size"]) for r in pools.pools.collect()) == [(6, 13), (6, 30)]
    asked = pools.asked().collect()
    assert len(asked) == 10 + 5 and all(len(r.idxs) == len(set(r.idxs)) < sum(k for k, _ in draws) for r in asked)
    assert pools.fetched(pools.requests()).count() == (10 + 5) * 6 * len(draws)


def left(spark):
    """Bytes of the shuffle files that are on disk."""
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    paths = [files.apply(i).getPath() for i in range(files.size())]
    return sum(os.path.getsize(p) for p in paths if "shuffle_" in os.path.basename(p) and os.path.exists(p))


def test_the_study_leaves_no_exchanged_texts(spark):
    before = left(spark)
    out = catalog.QUERIES["study_all_pairs"](spark, SF_SMALL)
    for _ in range(40):  # files go shortly after
        if left(spark) - before < 100_000:
            break
        time.sleep(0.25)
    assert left(spark) - before < 100_000 and out.count()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_stored_index_counts_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), F.lit("x").alias("text")).repartition(7)
    assert sorted((r.idx, r.id) for r in stored_index(df, ["id"]).collect()) == [(i, i) for i in range(1000)]
    assert stored_index(df.limit(0), ["id"]).count() == 0
    codes = tables.sentences(spark, SF_SMALL).groupBy("code").agg(F.min("row_id"), F.max("row_id"), F.count_distinct("row_id")).collect()
    assert all(r[1] == 0 and r[2] + 1 == r[3] for r in codes)
