"""Large pools, long conversations, nulls, storage settings."""

import pytest
from pyspark.sql import functions as F

from icx import session
from icx.functions.seeded import floyd_draw
from icx.operators import demos as D
from icx.operators import metrics as M
from icx.operators import prompts as P
from icx.sources import tables


def test_draws_reach_all_of_a_large_pool(spark):
    d = 20_000_000_000
    top = spark.range(0, 3000).select(F.explode(floyd_draw(42, "demo", F.col("id"), d, 4)).alias("i")).agg(F.max("i").alias("m"), F.min("i").alias("n")).first()
    assert 0.99 * d < top.m < d and top.n < 0.01 * d


def test_long_conversations_keep_their_keys(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}/{t}") for c in (1, 2) for t in range(1200)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tables._turn_pairs(conv, "user", "assistant")
    assert got.count() == 1200 and got.select("row_id").distinct().count() == 1200
    bad = spark.createDataFrame([(1, 1 << 20, "user", "a"), (1, (1 << 20) + 1, "assistant", "b")], conv.schema)
    with pytest.raises(Exception, match="no key"):
        tables._turn_pairs(bad, "user", "assistant").collect()


def test_null_texts_null_the_prompt(spark):
    dev = spark.createDataFrame([(0, "a", "b"), (1, "c", None)], "row_id long, src string, tgt string")
    test = spark.createDataFrame([(5, "x", "y"), (6, None, "y")], "row_id long, src string, tgt string")
    for chat in (False, True):
        both = P.few_shot(D.select_demos(test, dev, 2, 1), "eng_Latn", "deu_Latn", chat=chat)
        assert [r.prompt for r in both.collect()] == [None, None]
        clean = P.few_shot(D.select_demos(test, dev.limit(1), 1, 1), "eng_Latn", "deu_Latn", chat=chat).orderBy("row_id").collect()
        assert clean[0].prompt is not None and clean[1].prompt is None


def test_size_settings(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    pool = D.Pool(None, 1, 50 << 20)
    pool.df = spark.range(1)
    try:
        for value, fits in (("64MB", True), ("1g", True), ("10485760", False), ("10485760b", False), ("-1", False), ("60000k", True)):
            spark.conf.set(key, value)
            assert pool.broadcastable() == fits, value
    finally:
        spark.conf.set(key, old)


def test_no_machine_local_checkpoints_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_streaming_joins_without_broadcast(spark):
    dev = spark.createDataFrame([(i, f"s{i}", f"t{i}") for i in range(20)], "row_id long, src string, tgt string")
    test = spark.createDataFrame([(i, "q", "r") for i in range(5)], "row_id long, src string, tgt string")
    a, b = (D.select_demos(test, dev, 3, 7, force=f).select("row_id", "demos").orderBy("row_id").collect() for f in ("joins", "broadcast"))
    assert a == b


def test_hot_hypotheses_spread(spark):
    rows = spark.range(0, 4000).select(
        F.lit("r").alias("run"), F.when(F.col("id") % 5 > 0, "").otherwise(F.concat(F.lit("word "), F.col("id").cast("string"))).alias("hypothesis"),
        F.lit("word 5").alias("reference"))
    dealt = rows.repartition(8)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * min(sizes)
    assert M.score(rows, ["run"], metrics=("chrf",)).first().chrf > 0


def test_own_tokens(spark):
    df = spark.createDataFrame([("r", "a b c d e", "a b c d f", ["ab", "c", "d", "e", "f"], ["ab", "c", "d", "e", "g"])],
                               "run string, hypothesis string, reference string, h array<string>, t array<string>")
    own = M.score(df, ["run"], metrics=("bleu",), tokens=("h", "t"))
    assert own.columns == ["run", "bleu"]
    spaced = df.select("run", F.array_join("h", " ").alias("hypothesis"), F.array_join("t", " ").alias("reference"))
    assert own.first().bleu == M.score(spaced, ["run"], tokenizer="whitespace").first().bleu
    none = df.select("run", F.lit(None).cast("string").alias("hypothesis"), "reference")
    assert M.score(none, ["run"]).first().bleu == 0.0
