"""Line positions without a sort, and the ordered sink with its manifest."""

import os
import random

import pytest
from pyspark.sql import functions as F

from icx.sources import io as IO
from icx.sources import positions as POS


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def local(path):
    return path.replace("file:", "", 1)


def write_files(folder, files):
    os.makedirs(local(folder))
    for name, text in files.items():
        with open(f"{local(folder)}/{name}", "w", newline="") as f:
            f.write(text)


def sample(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab \té\r") for _ in range(rng.choice((0, 1, 7, 90)))) + "." for _ in range(n)]


def test_positions_are_those_of_a_plain_reader(spark, small_splits):
    folder = IO.scratch_dir(spark, "t-pos")
    texts = {f"part-{i}": sample(n, i) for i, n in ((9, 700), (10, 1), (99999, 350), (100000, 500))}
    texts["part-11"] = ["x" * 20_000, "", "", "end"]
    write_files(folder, {name: "\n".join(t) + "\n" * (name != "part-10") for name, t in texts.items()} | {"part-12": ""})
    scan = POS.scan_lines(spark, folder)
    assert scan.rdd.getNumPartitions() > 20
    got = POS.with_positions(scan).orderBy("line_no").collect()
    want = [line for i in (9, 10, 11, 99999, 100000) for line in texts[f"part-{i}"]]
    assert [r.line_no for r in got] == list(range(len(want))) and [r.value for r in got] == want
    plan = POS.with_positions(scan)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
    kept = POS.with_positions(scan, keep=F.col("value") != "").orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in kept] == list(enumerate(x for x in want if x))
    assert POS.with_positions(POS.scan_lines(spark, f"{folder}/part-12")).count() == 0


def test_runs_go_on_over_batches(spark):
    import pyarrow as pa

    keys = [("a", 0)] * 5 + [("a", 9)] + [("b", 0)] * 3 + [("b", 4)] * 1030
    batch = lambda k: pa.RecordBatch.from_arrays([pa.array([x for x, _ in k], pa.string()), pa.array([y for _, y in k], pa.int64())], names=["_file", "_block"])
    for cut in (1, 2, 5, 6, 500):
        parts = [keys[i : i + cut] for i in range(0, len(keys), cut)]
        got = [x for b in POS._numbered(iter(map(batch, [[], *parts]))) for x in b.column(2).to_pylist()]
        assert got == [*range(5), 0, *range(3), *range(1030)]


def test_ordered_sink_keeps_every_line(spark, small_splits):
    src, out, copy = (IO.scratch_dir(spark, f"t-sink{i}") for i in range(3))
    want = [x.replace("\r", "") for x in sample(900, 5)] + ["", "last"]
    write_files(src, {"one.txt": "\n".join(want)})
    lines = POS.with_positions(POS.scan_lines(spark, src)).withColumnRenamed("value", "text")
    for _ in range(2):  # written again, it replaces itself
        POS.write_pieces(lines, out)
        got = POS.read_ordered(spark, out).orderBy("line_no").collect()
        assert [(r.line_no, r.text) for r in got] == list(enumerate(want))
    manifest = spark.read.parquet(f"{out}/manifest").orderBy("piece").collect()
    assert len(manifest) > 5 and all(r.piece == r.first_line for r in manifest) and sum(r.lines for r in manifest) == len(want)
    shuffled = lines.select("line_no", "text").repartition(5, "text")
    POS.write_ordered(shuffled, copy)
    assert [r.text for r in POS.read_ordered(spark, copy).orderBy("line_no").collect()] == want


def test_what_differs_from_the_manifest_is_refused(spark):
    out = IO.scratch_dir(spark, "t-manifest")
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(50)], "line_no long, text string")
    POS.write_ordered(lines, out)
    with open(f"{local(out)}/lines/piece=0/part-late.txt", "w") as f:
        f.write("one more\n")
    with pytest.raises(ValueError):
        POS.read_ordered(spark, out)
    with pytest.raises(ValueError):
        POS.write_ordered(lines.withColumn("text", F.lit("two\nlines")), IO.scratch_dir(spark, "t-broken"))
    POS.write_ordered(lines.limit(0), out)
    assert POS.read_ordered(spark, out).count() == 0
