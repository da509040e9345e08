"""Model batches equal to the assigned ones, and runs that report on themselves while they are written."""

import pytest
from pyspark.sql import functions as F

from icx.operators import generate as G
from icx.sources import io as IO

SCHEMA = "pos long, prompt string"


def echo_model():
    return lambda: lambda batch: [f"{len(batch)}:" + "|".join(batch) for _ in batch]


def test_the_model_sees_the_assigned_batches(spark):
    texts = {i: None if i in (3, 16, 17, 18, 19, 20, 21, 22, 23) else f"p{i}" for i in range(1003)}  # one batch of nulls alone
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # no multiple of a batch
    try:
        for parts in (1, 5):
            rows = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(parts, F.hash("pos"))
            got = {r.pos: r for r in G.run_batches(rows, echo_model(), 8, "pos").collect()}
            assert len(got) == len(texts)
            for pos, row in got.items():
                sent = [t for i in range(pos // 8 * 8, pos // 8 * 8 + 8) if (t := texts.get(i)) is not None]
                assert row.batch_id == pos // 8
                assert row.raw == (None if texts[pos] is None else f"{len(sent)}:" + "|".join(sent))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_batches_of_no_rows_and_wrong_positions(spark):
    assert G.run_batches(spark.createDataFrame([], SCHEMA), echo_model(), 8, "pos").collect() == []
    for rows in ([(0, "a")] * 9, [(None, "a")]):
        with pytest.raises(Exception, match="positions repeat|no position"):
            G.run_batches(spark.createDataFrame(rows, SCHEMA), echo_model(), 8, "pos").collect()
    with pytest.raises(Exception, match="returned 1 outputs for 2 prompts"):
        G.run_batches(spark.createDataFrame([(0, "a"), (1, "b")], SCHEMA), lambda: lambda batch: ["x"], 8, "pos").collect()


def test_a_run_is_written_counted_and_previewed_at_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counting(v):
        made.add(1)
        return v

    schema = "run_id string, pos long, prompt string, hypothesis string"
    rows = [("r", i, None if i == 1 else f"p{i}", None if i == 2 else f"h{i}") for i in range(40)]
    pred = spark.createDataFrame(rows, schema).repartition(4).withColumn("hypothesis", F.udf(counting)("hypothesis"))
    path = IO.scratch_dir(spark, "t-report")
    for _ in range(2):  # a run that is written again replaces itself
        made.value = 0
        report = IO.write_reported(pred, path, F.col("pos") % 10 == 0, n=3)
        assert made.value == 40  # every row is made once for the table, counts, preview and samples
        assert (report.n_prompts, report.n_answered, report.preview) == (40, 39, ["p0", None, "p2"])
        assert sorted(r.hypothesis for r in report.progress.collect()) == ["h0", "h10", "h20", "h30"]
        assert spark.read.parquet(path).count() == 40
    assert IO.write_reported(pred.filter("pos < 2"), IO.scratch_dir(spark, "t-two"), F.lit(None), n=3).preview == ["p0", None]
    nothing = IO.write_reported(spark.createDataFrame([], schema), IO.scratch_dir(spark, "t-none"), F.lit(True))
    assert nothing[:3] == (0, 0, []) and nothing.progress.collect() == []


def test_segments_are_counted_in_place_when_the_scan_has_splits_enough(spark):
    from icx.operators import metrics as M

    texts = (F.format_string("one two three w%d", "id"), F.format_string("one two four w%d", F.col("id") % 7))
    df = spark.range(0, 60, 1, 64).select(F.lit("r").alias("run_id"), texts[0].alias("hypothesis"), texts[1].alias("reference"))
    dealt, in_place = M.score(df, ["run_id"]), M.score(df, ["run_id"], basis=df)
    assert dealt.collect() == in_place.collect()
    plans = [x._jdf.queryExecution().optimizedPlan().toString().count("Repartition") for x in (dealt, in_place)]
    assert plans == [1, 0]
