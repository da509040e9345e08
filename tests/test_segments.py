"""One segmented index against one pool per language pair, and the study over all pairs against the study of each."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from icx.operators import demos as D
from icx.operators.segments import SegmentedPool, looked_up
from icx.plans import catalog
from icx.plans import grid as GR
from icx.plans import study as ST

PAIRS = [("eng_Latn", "deu_Latn"), ("hin_Deva", "eng_Latn"), ("deu_Latn", "xx_Zyyy")]


def rows_of_pairs(spark, sizes=(40, 13, 10)):
    rows = [(s, t, i, f"{s} source {i}, with some words.", None if i == 7 and s == "hin_Deva" else f"{t} target {i} of it.")
            for (s, t), n in zip(PAIRS, sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "src_lang string, tgt_lang string, row_id long, src string, tgt string").repartition(5)
    return df.filter("row_id % 4 = 0"), df.filter("row_id % 4 <> 0")


def of_pair(df, s, t):
    return df.filter((F.col("src_lang") == s) & (F.col("tgt_lang") == t)).drop("src_lang", "tgt_lang")


def test_draws_equal_those_of_every_pool_alone(spark):
    test, dev = rows_of_pairs(spark)
    pool = SegmentedPool(dev, ST.PAIR)
    got = {(r.src_lang, r.tgt_lang, r.row_id, r.shots, r.seed): [(d.pos, d.src, d.tgt) for d in r.demos]
           for r in pool.fetched(pool.drawn(test, [(1, 42), (4, 0), (8, 25)])).collect()}
    want = {}
    for s, t in PAIRS:
        own_test, own_dev = of_pair(test, s, t), of_pair(dev, s, t)
        size = own_dev.count()
        for k, seed in ((1, 42), (4, 0), (8, 25)):
            if k <= size:
                for r in D.select_demos(own_test, own_dev, k, seed).collect():
                    want[s, t, r.row_id, k, seed] = [(d.pos, d.src, d.tgt) for d in r.demos]
    assert got == want
    assert not any(k[:2] == PAIRS[2] and k[3] == 8 for k in got) and any(k[:2] == PAIRS[2] for k in got)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_a_segment_that_holds_most_rows_and_empty_ones(spark, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        test, dev = rows_of_pairs(spark, (900, 12, 0))
        pool = SegmentedPool(dev, ST.PAIR)
        rows = pool.fetched(pool.drawn(test, [(4, 42)])).collect()
        assert len(rows) == 225 + 3 and all(len({d.dev for d in r.demos}) == 4 for r in rows)
        assert all(d.src.startswith(r.src_lang) and d.dev % 4 for r in rows for d in r.demos)
        assert pool.fetched(pool.drawn(test.limit(0), [(4, 42)])).count() == 0
        none = SegmentedPool(dev.limit(0), ST.PAIR)
        assert none.fetched(none.drawn(test, [(1, 42)])).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_runs_of_all_pairs_equal_the_study_of_each(spark):
    """All experiments that draw from the pair's own pool, perturbed runs included."""
    test, dev = rows_of_pairs(spark, (16, 13, 2))
    test = test.filter("row_id < 8")
    got = {(r.run_id, r.row_id): (r.prompt, r.reference) for r in ST.prompts_of_pairs(test, dev, ST.DEMO_EXPERIMENTS).collect()}
    aux = spark.createDataFrame([(i, "a", "b") for i in range(9)], "row_id long, src string, tgt string")
    triples = spark.createDataFrame([], "sp_id long, pt_id long, src string, pivot string, tgt string")
    want = {}
    for s, t in PAIRS[:2]:
        alone = ST.prompts(of_pair(test, s, t), of_pair(dev, s, t), aux, triples, s, t, "fra_Latn", "eng_Latn")
        want |= {(r.run_id, r.row_id): (r.prompt, r.reference) for r in alone.collect() if r.experiment not in ("allied", "pivot")}
    assert {k: v for k, v in got.items() if k in want} == want
    ids = {r.run_id for r in GR.all_runs(spark.createDataFrame(PAIRS, "src_lang string, tgt_lang string")).collect()}
    assert {run for run, _ in got} <= ids and len(got) > len(want)


def test_run_ids_are_those_of_the_whole_grid(spark):
    grid = {r.run_id for r in catalog.QUERIES["grid_all"](spark, SF_SMALL).filter("attack is null and experiment in ('instruction', 'directionality', 'homogeneous')").collect()}
    assert {r.run_id for r in catalog.QUERIES["study_run_sizes"](spark, SF_SMALL).collect()} == grid


def test_looked_up(spark):
    got = spark.createDataFrame([("a",), ("x",), (None,)], "k string").select(looked_up({"a": "1’é"}, F.col("k")).alias("v")).collect()
    assert [r.v for r in got] == ["1’é", None, None]
