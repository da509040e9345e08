"""Sharding by histogram sort.

Documents are sorted by (hash of the text, doc_id, row) and cut into shards of nearly
equal bytes. The cuts are found by counting: every round adds up the exact bytes that
fall between evenly spaced probes, over all partitions, and each splitter keeps the one
probe interval that holds its target; rounds go on until a splitter is within tolerance
or its interval is a single key, and then the next key column takes over. Only probe
counts reach the driver, as many as splitters times `PROBES`. With all splitters known,
rows are exchanged once, to their final place.

The hash comes first in the key, so equal texts lie together and share a shard unless a
cut falls inside their group; a group larger than a shard is cut by doc_id.

Defined cases: a null text has no bytes (size 8, crc of the empty string); null doc_ids
sort first; repeated rows are told apart by their position in the written key table; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icx.llm.common import shuffle_partitions, written

SHARDS = 24
#: Probes per open splitter and round.
PROBES = 64
#: A splitter may miss its target by this part of the bytes between two splitters.
TOLERANCE = 0.01
SPAN_BITS = 62


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The key table: one pass over the texts, then only its narrow columns are counted.

    Columns to carry lie beside them under names of their own.
    """
    text = F.coalesce("text", F.lit(""))
    return written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - SPAN_BITS).alias("k0"),
            # doc_id in unsigned order of its upper 62 bits, then its lower two bits and the row
            F.shiftrightunsigned(F.coalesce("doc_id", F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63))), 64 - SPAN_BITS).alias("k1"),
            F.monotonically_increasing_id().alias("k2"),
            *[F.col(c).alias(f"_carried{i}") for i, c in enumerate(carry)],
        ),
        "keys",
    )


KEYS = ("k0", "k1", "k2")


@dataclass
class Interval:
    """Probe interval [low, high) of key column `depth`, below earlier columns fixed to `fixed`.

    `below`: bytes of all rows before it; `wanted`: the splitters whose targets lie in it.
    """

    fixed: tuple[int, ...]
    low: int
    high: int
    below: int
    wanted: list[int]

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low) // (PROBES * len(self.wanted))))

    def key(self, at: int) -> tuple[int, ...]:
        return (*self.fixed, at, *[0] * (len(KEYS) - len(self.fixed) - 1))


def _long_div(value: Column, by: Column) -> Column:
    """Integer quotient of longs (exact at 62 bits, unlike a double)."""
    return F.call_function("div", value, by)


def splitters(keys: DataFrame, cuts: int) -> list[tuple[int, ...]]:
    """`cuts - 1` ascending key tuples; a row lies after a splitter unless its key is below it."""
    spark = keys.sparkSession
    ends = keys.agg(F.sum("size").alias("bytes"), *[f(k).alias(f"{n}_{k}") for k in KEYS for n, f in (("min", F.min), ("max", F.max))]).first()
    total = ends["bytes"] or 0
    if not total or cuts < 2:
        return []
    goals = [total * i // cuts for i in range(1, cuts)]
    allowed = TOLERANCE * total / cuts
    span = lambda depth: (ends[f"min_{KEYS[depth]}"], ends[f"max_{KEYS[depth]}"] + 1)
    found: dict[int, tuple[int, ...]] = {}
    active = [Interval((), *span(0), 0, list(range(len(goals))))]
    rows = keys.select(
        *KEYS, "size", F.lit(0).alias("iv"), F.lit(active[0].low).cast("long").alias("low"),
        F.lit(active[0].width).cast("long").alias("width"), F.lit(0).alias("depth"),
    )
    while active:
        value = F.get(F.array(*KEYS), F.col("depth"))
        probed = rows.withColumn("probe", _long_div(value - F.col("low"), F.col("width")))
        hist: dict[int, list] = {}
        counted = probed.groupBy("iv", "probe").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        for r in counted.collect():  # at most PROBES rows for each splitter
            hist.setdefault(r["iv"], []).append((r["probe"], r["bytes"], r["n"]))
        refined: list[tuple[int, int, Interval]] = []
        for iv, o in enumerate(active):
            below, want = o.below, list(o.wanted)
            for probe, size, n in sorted(hist[iv]):
                low = o.low + probe * o.width
                high = min(low + o.width, o.high)
                rest = []
                while want and goals[want[0]] <= below + size:
                    w = want.pop(0)
                    before, after = goals[w] - below, below + size - goals[w]
                    if min(before, after) <= allowed or n == 1:
                        found[w] = o.key(low if before <= after else high)
                    else:
                        rest.append(w)
                if rest and high - low > 1:
                    refined.append((iv, probe, Interval(o.fixed, low, high, below, rest)))
                elif rest:  # many rows with one value here: go on with the next key column
                    refined.append((iv, probe, Interval((*o.fixed, low), *span(len(o.fixed) + 1), below, rest)))
                below += size
        active = [o for _, _, o in refined]
        if active:
            table = spark.createDataFrame(
                [(iv, probe, i, o.low, o.width, len(o.fixed)) for i, (iv, probe, o) in enumerate(refined)],
                "iv int, probe long, next int, low long, width long, depth int",
            )
            rows = written(
                probed.select(*KEYS, "size", "iv", "probe")
                .join(F.broadcast(table), ["iv", "probe"])  # at most one row for each splitter
                .select(*KEYS, "size", F.col("next").alias("iv"), "low", "width", "depth"),
                "open",
            )
    return [found[i] for i in range(len(goals))]


def _longs(values: list[int]) -> Column:
    """A constant array<bigint> (folded into one literal by the optimizer)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def place(keys: DataFrame, cuts: list[tuple[int, ...]]) -> Column:
    """Number of splitters that are not above the row's key, through a table of 4096 cells."""
    if not cuts:
        return F.lit(0)
    shift = SPAN_BITS - 12
    cells = [c[0] >> shift for c in cuts]
    base, inside, i = [], [], 0
    for cell in range(4097):
        base.append(i)
        n = 0
        while i < len(cells) and cells[i] == cell:
            i, n = i + 1, n + 1
        inside.append(n)
    cell = F.shiftright("k0", shift).cast("int")
    first = F.get(_longs(base), cell).cast("int")
    near = F.slice(
        F.arrays_zip(*[_longs([c[d] for c in cuts]).alias(KEYS[d]) for d in range(len(KEYS))]), first + 1, F.get(_longs(inside), cell).cast("int")
    )

    def not_above(s: Column) -> Column:
        a, b, c = (s.getField(k) for k in KEYS)
        k0, k1, k2 = (F.col(k) for k in KEYS)
        return (a < k0) | ((a == k0) & ((b < k1) | ((b == k1) & (c <= k2))))

    return first + F.size(F.filter(near, not_above))


def sharded(docs: DataFrame, shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the columns to carry: one row per document.

    Each shard is cut into several equal parts, so that the exchange has enough tasks. Columns
    to carry, such as the text, go through that one exchange with their row.
    """
    keys = keyed(docs, carry)
    spark = docs.sparkSession
    parts = max(1, -(-2 * shuffle_partitions(spark) // shards))
    placed = keys.withColumn("part", place(keys, splitters(keys, shards * parts)))
    if not carry:
        placed = written(placed, "placed")
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # shards * parts rows
    offsets: list[int] = []
    for i in range(shards * parts):
        offsets.append(0 if i % parts == 0 else offsets[-1] + counts.get(i - 1, 0))
    order = Window.partitionBy("part").orderBy(*KEYS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        F.floor(F.col("part") / parts).cast("int").alias("shard"),
        (F.get(_longs(offsets), F.col("part")) + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_carried{i}").alias(c) for i, c in enumerate(carry)],
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents as Parquet: a folder per shard, in it rows (slot, doc_id, text), sorted by slot in every file."""
    rows = sharded(docs, shards, ("text",)).select("shard", "slot", "doc_id", "text")
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
