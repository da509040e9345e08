"""Dense row index without a single-partition window (SRC-4).

`row_number() over (order by key)` with no partition clause funnels every row through
one task. Instead the table is range-partitioned on the key, sorted inside each
partition and checkpointed to the cluster's checkpoint folder (reliable storage, so
executor loss does not change partition contents). Per-partition counts — one number
per partition — are turned into offsets on the driver, and each row's index is its
partition offset plus its ordinal inside the partition. The ordinal comes from
`monotonically_increasing_id`, which is deterministic here because it runs over the
checkpointed, fixed partitions.
"""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icx.session import ensure_checkpoint_dir, shuffles_dropped

_ORDINAL_BITS = 33  # monotonically_increasing_id = partition_id << 33 | ordinal


class Indexed(NamedTuple):
    df: DataFrame
    size: int
    sums: dict[str, int]


def dense_index(
    df: DataFrame,
    order_by: list[str | Column],
    name: str = "idx",
    partitions: int | None = None,
    sums: dict[str, Column] | None = None,
) -> Indexed:
    """Add `name` = 0-based position in `order_by` order; with the row count and the `sums`.

    `order_by` must be a total order (include a unique key as the last column). `sums`
    maps names to expressions that the counting job adds up. Without `partitions` the
    adaptive planner sizes the range exchange by the data. The checkpoint is the only copy
    that is written: the index is computed over its fixed partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(partitions, *order_by) if partitions else df.repartitionByRange(*order_by)
    ranged = dealt.sortWithinPartitions(*order_by).checkpoint(eager=True)
    pid = F.spark_partition_id()
    sums = sums or {}
    rows = ranged.groupBy(pid.alias("p")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()]
    ).collect()
    counts = {r["p"]: r["n"] for r in rows}
    sizes = [counts.get(p, 0) for p in range(max(counts, default=0) + 1)]
    offsets = [0] + list(accumulate(sizes))[:-1]
    offset_col = F.element_at(F.array(*[F.lit(o).cast("bigint") for o in offsets]), pid + 1)
    mid = F.monotonically_increasing_id()
    ordinal = mid - F.shiftleft(F.shiftright(mid, _ORDINAL_BITS), _ORDINAL_BITS)
    return Indexed(ranged.withColumn(name, offset_col + ordinal), sum(sizes), {k: sum((r[k] or 0) for r in rows) for k in sums})


def stored_index(df: DataFrame, order_by: list[str], name: str = "idx") -> DataFrame:
    """The rows of `dense_index` from a Parquet table below the checkpoint folder, for tables of whole texts.

    Each row is written with its range and its ordinal there, so the index holds however the
    table is split when it is read. The texts lie compressed, in one copy (a checkpoint keeps
    them as they are), the exchange is dropped with the job, and who asks for keys reads no texts.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/icx-index-{uuid4().hex[:12]}"
    mid = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumns({
        "_range": F.shiftright(mid, _ORDINAL_BITS), "_at": mid.bitwiseAND(F.lit((1 << _ORDINAL_BITS) - 1))})
    with shuffles_dropped(spark):
        placed.write.parquet(path)
    held = spark.read.schema(placed.schema).parquet(path)
    counts = {r["_range"]: r["n"] for r in held.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [counts.get(p, 0) for p in range(max(counts, default=0) + 1)]
    offsets = F.array(*[F.lit(o).cast("bigint") for o in [0, *accumulate(sizes)][:-1]])
    index = F.element_at(offsets, (F.col("_range") + 1).cast("int")) + F.col("_at")
    return held.withColumn(name, index).drop("_range", "_at")
