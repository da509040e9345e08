"""Sinks of runs, malformed lines, and the order of numbered part files."""

from pyspark.sql import functions as F

from icx.sources import io as IO


def runs(spark, *ids):
    return spark.createDataFrame([(r, i, f"{r} {i}") for r in ids for i in range(3)], "run_id string, row_id long, hypothesis string")


def test_writing_a_run_twice_equals_writing_it_once(spark):
    path = IO.scratch_dir(spark, "t-runs")
    IO.write_predictions(runs(spark, "a", "007"), path)
    IO.write_predictions(runs(spark, "007", "1e5"), path)
    IO.write_predictions(runs(spark, "1e5").limit(0), path)
    got = IO.read_runs(spark, path, runs(spark, "a").schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, runs(spark, "a", "007", "1e5").collect()))


def test_a_replayed_stream_writes_once(spark):
    landing, path, check = (IO.scratch_dir(spark, n) for n in ("t-land", "t-out", "t-check"))
    runs(spark, "a", "b").write.parquet(landing)
    for checkpoint in (check, check, IO.scratch_dir(spark, "t-check2")):  # resumed, then its progress lost
        stream = spark.readStream.schema(runs(spark, "a").schema).parquet(landing)
        IO.stream_runs(stream, path, checkpoint).awaitTermination()
    assert spark.read.parquet(path).count() == 6


def test_bad_lines_are_reported_and_good_ones_keep_their_place(spark):
    path = IO.scratch_dir(spark, "t-bad") + "/p.jsonl"
    lines = ['{"sentence_a": "x", "sentence_b": "y"}', "{broken", '{"sentence_a": "z"}', "[1]", '{"sentence_a": null, "sentence_b": "w", "more": 1}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    assert sorted(map(tuple, IO.read_pairs(spark, path, "a", "b").collect())) == [(0, "x", "y"), (2, "z", None), (4, None, "w")]
    assert [tuple(r) for r in IO.bad_lines(spark, path, "a", "b").orderBy("row_id").collect()] == [(1, "{broken"), (3, "[1]")]


def test_part_files_go_by_number(spark):
    path = IO.scratch_dir(spark, "t-parts")
    for i, name in enumerate(("part-9", "part-99999", "part-100000", "part-123456789012345")):
        spark.createDataFrame([(f"line {i}",)], "value string").coalesce(1).write.text(f"{path}/{name}")
    got = IO.read_lines(spark, f"{path}/*").orderBy("line_no").collect()
    assert [r.text for r in got] == [f"line {i}" for i in range(4)] and [r.line_no for r in got] == list(range(4))
    assert spark.range(1).select(F.lit(1)).count() == 1
