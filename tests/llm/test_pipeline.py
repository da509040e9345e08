"""The pipeline against the operators' brute-force definitions, stage by stage."""

import re

import corpus_pipeline
from icx.llm import decontaminate, mix, quality, shard
from icx.llm.common import scratch_path
from test_simjoin import plain_components

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near duplicates", "decontamination", "source mix", "sharding"]
    kept = stages["quality rules"](spark, docs, SF).cache()
    assert kept.columns == columns
    wanted = {r.doc_id for r in quality.judged(docs).collect() if r.kept}
    assert rows_of(kept) == rows_of(docs.filter(docs.doc_id.isin(list(wanted))))
    one = stages["near duplicates"](spark, kept, SF).cache()
    assert one.columns == columns
    groups = plain_components([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert {r.doc_id for r in one.collect()} == {c for _, _, c in groups} and one.count() == len({c for _, _, c in groups})
    clean = stages["decontamination"](spark, one, SF).cache()
    assert clean.columns == columns
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = lambda r: " " + " ".join(re.findall(r"[^\W_]+", r.text.lower())) + " "
    whole = {r.doc_id for r in one.collect() if any(f" {' '.join(i)} " in text(r) for i in items)}
    left = {r.doc_id for r in clean.collect()}
    assert not whole & left
    hit = {r.doc_id for r in decontaminate.judged(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
    assert left == {r.doc_id for r in one.collect()} - hit
    mixed = stages["source mix"](spark, clean, SF).cache()
    assert mixed.columns == columns
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {r.doc_id: r.copies for r in mix.mixed_copies(clean).collect() if r.copies}
    shards = stages["sharding"](spark, mixed, SF).collect()
    assert len(shards) == sum(copies.values())
    assert rows_of(stages["sharding"](spark, mixed, SF).select("doc_id", "text", "lang", "source")) == rows_of(mixed.select("doc_id", "text", "lang", "source"))
    for s in {r.shard for r in shards}:
        assert sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards)))


def test_run_agrees_with_itself(spark):
    a, b = (sorted((r.doc_id, r["size"], r.shard) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_shards_are_written_with_their_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = scratch_path(spark, "t-shards")
    shard.write_shards(docs, path)
    back = spark.read.parquet(path)
    assert rows_of(back.select("doc_id", "text")) == rows_of(docs.select("doc_id", "text"))
    placed = {(r.shard, r.slot, r.doc_id) for r in shard.sharded(docs).collect()}
    assert {(r.shard, r.slot, r.doc_id) for r in back.collect()} == placed and len(placed) == docs.count()
