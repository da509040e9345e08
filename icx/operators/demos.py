"""Demonstration selection (SMP-1, JOIN-2/3/4, ORD-1).

Each test row draws k distinct demonstrations uniformly from the pool, in random
order, with the draw keyed by (seed, row key) — the same rows are chosen however the
data is partitioned. The pool gets a dense index, the draw is Floyd's algorithm over
[0, D) (k steps per row), and demonstrations are fetched by equi-join on the index.

Fetch strategies:
  * pool within the broadcast budget (size measured, not guessed): k broadcast hash
    joins on `demo_idx[j]`; no shuffle and no regrouping of test rows;
  * larger pools of a streaming query: the same k joins by shuffle (no regrouping, so no
    streaming aggregation);
  * larger pools: `posexplode_outer` + shuffle join on the index + regroup by the
    test key with an ordered `collect_list` (sorted by position, never relying on
    arrival order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icx.functions.seeded import floyd_draw, shuffled
from icx.session import byte_setting
from icx.sources.index import dense_index

DEMO_TAG = "demo"
ORDER_TAG = "demo_order"


class Pool:
    """A demonstration pool with its dense index, size and measured byte size."""

    def __init__(self, df: DataFrame, size: int, nbytes: int):
        self.df = df
        self.size = size
        self.nbytes = nbytes

    @classmethod
    def build(cls, dev: DataFrame, key: str = "row_id", cols: tuple[str, ...] = ("src", "tgt")) -> "Pool":
        """One range exchange and one checkpoint of the pool; every fetch reads that table."""
        row_bytes = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in cols), F.lit(16))
        idx = dense_index(dev.select(*dict.fromkeys([key, *cols])), [key], name="idx", sums={"bytes": row_bytes})
        return cls(idx.df.select("idx", *cols), idx.size, idx.sums["bytes"])

    def fixed(self) -> "Pool":
        """The pool with its index written out, as streaming joins need it (they cannot number rows)."""
        return Pool(self.df.checkpoint(eager=True), self.size, self.nbytes)

    def broadcastable(self) -> bool:
        limit = byte_setting(self.df.sparkSession, "spark.sql.autoBroadcastJoinThreshold", 10 << 20)
        return 0 <= self.nbytes <= limit


def drawn(key: Column, pool_size: int | Column, k: int | Column, seed: int | Column, tag: str = DEMO_TAG) -> Column:
    """k pool indexes in demonstration order."""
    return shuffled(seed, tag + "_order", key, floyd_draw(seed, tag, key, pool_size, k))


def draw(test: DataFrame, key: str | Column, pool_size: int, k: int, seed: int, tag: str = DEMO_TAG) -> DataFrame:
    """Add `demo_idx`: k pool indexes in demonstration order."""
    kc = F.col(key) if isinstance(key, str) else key
    return test.withColumn("demo_idx", drawn(kc, pool_size, k, seed, tag))


def attach(
    test: DataFrame,
    pool: Pool,
    k: int,
    key: str = "row_id",
    cols: tuple[str, ...] = ("src", "tgt"),
    force: str | None = None,
) -> DataFrame:
    """Add `demos: array<struct<pos, cols...>>` in demonstration order."""
    empty = F.array().cast(
        "array<struct<pos:int," + ",".join(f"{c}:string" for c in cols) + ">>"
    )
    if k == 0:
        return test.withColumn("demos", empty)
    strategy = force or ("broadcast" if pool.broadcastable() else "shuffle")
    if strategy in ("broadcast", "joins"):
        out = test
        for j in range(k):
            side = pool.df.select(F.col("idx").alias(f"_i{j}"), *[F.col(c).alias(f"_d{j}_{c}") for c in cols])
            side = F.broadcast(side) if strategy == "broadcast" else side
            out = out.join(side, F.col("demo_idx").getItem(j) == F.col(f"_i{j}"), "left")
        demos = F.array(
            *[F.struct(F.lit(j).alias("pos"), *[F.col(f"_d{j}_{c}").alias(c) for c in cols]) for j in range(k)]
        )
        drop = [f"_i{j}" for j in range(k)] + [f"_d{j}_{c}" for j in range(k) for c in cols]
        return out.withColumn("demos", demos).drop(*drop)
    # shuffle strategy: explode -> equi-join on the index -> ordered regroup
    base_cols = [c for c in test.columns]
    ex = test.select(key, F.posexplode_outer("demo_idx").alias("_pos", "_idx"))
    dev = pool.df.select(F.col("idx").alias("_idx"), *[F.col(c).alias(f"_d_{c}") for c in cols])
    joined = ex.join(dev, "_idx", "left")
    grouped = joined.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("_pos").alias("pos"), *[F.col(f"_d_{c}").alias(c) for c in cols]))
        ).alias("demos")
    )
    return test.join(grouped, key, "left").select(*base_cols, "demos")


def select_demos(test: DataFrame, dev: DataFrame, k: int, seed: int, key: str = "row_id",
                 cols: tuple[str, ...] = ("src", "tgt"), force: str | None = None) -> DataFrame:
    """Test rows with their k demonstrations drawn from `dev` (k > |dev| raises)."""
    pool = Pool.build(dev, key, cols)
    drawn = draw(test, key, pool.size, k, seed)
    return attach(drawn, pool, k, key, cols, force)
