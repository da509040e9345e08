"""Many demonstration pools behind one segmented dense index.

A study draws from the pool of every language pair. Instead of an index and a job per
pool, all pools lie in one table ordered by (segment, key): its dense index runs through
all of them, and a segment is an interval of it, (first, size). A test row draws k
positions below the size of its own segment (the same draw it makes from that pool alone)
and adds `first`; one equi-join on the index then fetches the demonstrations of every
pair, shot count and seed.

The segment table has one row per pool (bounded by the language pairs); it comes from a
partially aggregated group-by, so a segment with most of the rows is counted where it lies.

`GatheredPools` serves sentences that are gathered by row id (one row holds a sentence in all
its languages). Pairs whose pools are the same rows make the same draws, so they share one pool:
a drawn row travels to a test row once, with the texts of all their languages, however many
pairs, shot counts and seeds ask for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icx.functions.arrays import let
from icx.operators.demos import drawn
from icx.session import byte_setting
from icx.sources.index import dense_index


class SegmentedPool:
    """Demonstrations of many pools under one index, with each pool's interval."""

    def __init__(self, dev: DataFrame, segment: tuple[str, ...], key: str = "row_id", cols: tuple[str, ...] = ("src", "tgt")):
        self.segment, self.key, self.cols = segment, key, cols
        row_bytes = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in cols), F.lit(16))
        index = dense_index(dev.select(*segment, key, *cols), [*segment, key], name="idx", sums={"bytes": row_bytes})
        self.df, self.nbytes = index.df, index.sums["bytes"]
        self.intervals = self.df.groupBy(*segment).agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("size"))

    def _small(self) -> bool:
        limit = byte_setting(self.df.sparkSession, "spark.sql.autoBroadcastJoinThreshold", 10 << 20)
        return 0 <= self.nbytes <= limit

    def drawn(self, test: DataFrame, draws: list[tuple[int, int]], row_key: str = "row_id") -> DataFrame:
        """Test rows once per draw (shots, seed) with `picks`: positions in the whole index, in order.

        A segment with fewer rows than the shots has no such draw; a test row without a pool has none.
        """
        wanted = F.array(*[F.struct(F.lit(k).alias("shots"), F.lit(s).alias("seed")) for k, s in draws])
        rows = test.join(F.broadcast(self.intervals), list(self.segment)).withColumn("draw", F.explode(wanted))
        rows = rows.filter(F.col("draw.shots") <= F.col("size"))
        shots = F.least(F.col("draw.shots").cast("long"), F.col("size"))  # the filter may run after the draw
        own = drawn(F.col(row_key), F.col("size"), shots, F.col("draw.seed"))
        return rows.withColumn("picks", F.transform(own, lambda i: i + F.col("first"))).select(
            *test.columns, F.col("draw.shots").alias("shots"), F.col("draw.seed").alias("seed"), "picks"
        )

    def fetched(self, asked: DataFrame, row_key: str = "row_id") -> DataFrame:
        """Rows of `drawn` with `demos`: array<struct<pos, dev, cols...>> in demonstration order."""
        by = [*self.segment, row_key, "shots", "seed"]
        side = self.df.select("idx", F.col(self.key).alias("dev"), *[F.col(c).alias(f"d_{c}") for c in self.cols])
        side = F.broadcast(side) if self._small() else side  # measured size
        each = asked.select(*by, F.posexplode("picks").alias("pos", "idx")).join(side, "idx")
        demo = F.struct("pos", "dev", *[F.col(f"d_{c}").alias(c) for c in self.cols])
        lists = each.groupBy(*by).agg(F.array_sort(F.collect_list(demo)).alias("demos"))
        return asked.drop("picks").join(lists, by)


class GatheredPools:
    """The pools of all wanted language pairs over gathered rows (row_id, in_all: array<struct<code, text, chars>>).

    `rows` is a stored table; every language is in a row once at most. `chars` is the length of a
    text, counted where it is gathered, as the text goes into dozens of prompts. `is_test` tells test rows
    from the pools' rows by their id. `pools` has one entry per distinct set of pool rows: its
    pairs, their languages, the size, and the first position in the index (bounded by the pairs).
    """

    POOL = "pool int, pairs array<struct<src_lang:string,tgt_lang:string>>, codes array<string>, size long, first long"
    QUERY = -1  # stands for the test row itself among the rows it asks for

    def __init__(self, rows: DataFrame, wanted: DataFrame, is_test: Column, draws: list[tuple[int, int]]):
        self.rows, self.draws = rows, draws
        spark = rows.sparkSession
        keys = rows.select("row_id", F.col("in_all.code").alias("codes"))
        self.test, dev = keys.filter(is_test), keys.filter(~is_test)
        pair = F.struct("src_lang", "tgt_lang")
        each = dev.select("row_id", "codes", F.explode("codes").alias("src_lang")).select("row_id", "src_lang", F.explode("codes").alias("tgt_lang"))
        each = each.join(F.broadcast(wanted), ["src_lang", "tgt_lang"])
        # equal sets of row ids: count, ends, and two independent hashes over all of them
        marks = [F.count(F.lit(1)).alias("size"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"),
                 F.bit_xor(F.xxhash64("row_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit("pool"), "row_id")).alias("y")]
        sets = each.groupBy("src_lang", "tgt_lang").agg(*marks).groupBy("size", "lo", "hi", "x", "y").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
        held, first = [], 0
        for r in sorted(sets.collect(), key=lambda r: r.pairs[0]):
            held.append((len(held), r.pairs, sorted({c for p in r.pairs for c in p}), r["size"], first))
            first += r["size"]
        self.pools = spark.createDataFrame(held, self.POOL)
        both = F.array_contains("codes", F.col("of.src_lang")) & F.array_contains("codes", F.col("of.tgt_lang"))
        one = self.pools.select("pool", F.col("pairs")[0].alias("of"))
        self.index = dense_index(dev.join(F.broadcast(one), both).select("pool", "row_id"), ["pool", "row_id"], name="idx").df

    def _drawn(self) -> Column:
        """The draws of a test row from its pool: shots, seed and positions in the whole index, in order."""
        size, row = F.col("size"), F.col("row_id")

        def of(k: int, seed: int) -> Column:
            own = drawn(row, size, F.least(F.lit(k).cast("long"), size), seed)  # the filter may run after the draw
            return F.struct(F.lit(k).alias("shots"), F.lit(seed).alias("seed"), F.transform(own, lambda i: i + F.col("first")).alias("picks"))

        return F.filter(F.array(*[of(k, seed) for k, seed in self.draws]), lambda d: d["shots"] <= size)

    def asked(self) -> DataFrame:
        """(row_id, pool, idxs) of the test rows that have a pair of the pool: every position that a draw of theirs takes, once."""
        mine = F.exists("pairs", lambda p: F.array_contains("codes", p["src_lang"]) & F.array_contains("codes", p["tgt_lang"]))
        rows = self.test.join(F.broadcast(self.pools.drop("codes")), mine).withColumn("draws", self._drawn())
        return rows.filter(F.size("draws") > 0).select("row_id", "pool", F.array_distinct(F.flatten("draws.picks")).alias("idxs"))

    def nbytes(self) -> tuple[int, int]:
        """Bytes of the texts of all rows, and of those that the test rows ask for."""
        texts = self.rows.select(F.explode("in_all").alias("s")).groupBy("s.code").agg(F.sum(F.octet_length("s.text")).alias("b"), F.count(F.lit(1)).alias("n"))
        of = {r.code: (r.b or 0, r.n) for r in texts.collect()}
        codes = {r.pool: r.codes for r in self.pools.collect()}
        wanted = self.asked().groupBy("pool").agg(F.sum(F.size("idxs") + 1).alias("n")).collect()
        return sum(b for b, _ in of.values()), round(sum(r.n * of[c][0] / of[c][1] for r in wanted for c in codes[r.pool]))

    def requests(self) -> DataFrame:
        """(row_id, pool, idx, dev): the rows `dev` that a test row asks for, itself included; keys without texts."""
        asked = self.asked()
        picked = asked.select("row_id", "pool", F.explode("idxs").alias("idx")).join(self.index.select("idx", F.col("row_id").alias("dev")), "idx")
        own = asked.select("row_id", "pool", F.lit(self.QUERY).cast("long").alias("idx"), F.col("row_id").alias("dev"))
        return picked.select("row_id", "pool", "idx", "dev").unionByName(own)

    def fetched(self, requests: DataFrame) -> DataFrame:
        """(src_lang, tgt_lang, row_id, src, tgt, shots, seed, demos) of the test rows of `requests`, which has all of a test row or none.

        The rows of `SegmentedPool.fetched`, with `chars`: the length of the row's source and all texts of its demonstrations.
        """
        side = self.rows.select(F.col("row_id").alias("dev"), "in_all")
        each = requests.join(side, "dev").join(F.broadcast(self.pools.select("pool", "codes")), "pool")
        own = F.filter("in_all", lambda s: F.array_contains("codes", s["code"]))
        texts = F.map_from_entries(F.transform(own, lambda s: F.struct(s["code"].alias("code"), F.struct(s["text"].alias("text"), s["chars"].alias("chars")))))
        found = each.select("row_id", "pool", F.struct("idx", F.struct("dev", texts.alias("texts")).alias("row")).alias("got")).groupBy("row_id", "pool").agg(
            F.map_from_entries(F.collect_list("got")).alias("found"))
        here = found.join(F.broadcast(self.pools.select("pool", "pairs", "size", "first")), "pool").withColumn("draws", self._drawn())
        query = F.col("found")[F.lit(self.QUERY).cast("long")]["texts"]

        def of(draw: Column, got: Column, pair: Column) -> Column:
            def demo(row: Column, pos: Column) -> Column:
                return F.struct(pos.alias("pos"), row["dev"].alias("dev"), row["texts"][pair["src_lang"]]["text"].alias("src"),
                                row["texts"][pair["tgt_lang"]]["text"].alias("tgt"))

            def chars(total: Column, row: Column) -> Column:
                return total + row["texts"][pair["src_lang"]]["chars"] + row["texts"][pair["tgt_lang"]]["chars"]

            src, tgt = query[pair["src_lang"]], query[pair["tgt_lang"]]
            return F.struct(pair["src_lang"].alias("src_lang"), pair["tgt_lang"].alias("tgt_lang"), F.col("row_id").alias("row_id"),
                            src["text"].alias("src"), tgt["text"].alias("tgt"), draw["shots"].alias("shots"), draw["seed"].alias("seed"),
                            F.transform(got, demo).alias("demos"), F.aggregate(got, src["chars"], chars).alias("chars"))

        own = F.filter("pairs", lambda p: F.map_contains_key(query, p["src_lang"]) & F.map_contains_key(query, p["tgt_lang"]))
        cases = F.flatten(F.transform("draws", lambda d: let(  # a draw's rows are looked up once for all pairs
            F.transform(d["picks"], lambda i: F.col("found")[i]), lambda got: F.transform(own, lambda p: of(d, got, p)))))
        return here.select(F.explode(cases).alias("case")).select("case.*")


def looked_up(table: dict[str, str], key: Column) -> Column:
    """A bounded plan-time table as one constant map; null where the key is not in it."""
    import json

    return F.try_element_at(F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "map<string,string>"), key)
