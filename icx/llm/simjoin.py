"""N-gram Jaccard join through a token-group matrix.

A document's set holds its distinct shingles, of 3 words unless the caller says otherwise;
sets with a Jaccard similarity of 90 per cent, or what the caller says, are linked. Equal
sets are one class, and the join runs over classes:

1. One pass over the texts gives each set's size and signature, and a frequency sketch of
   all shingles: counts per hash bucket, of fixed size whatever the input.
2. A second pass emits each set's rarest shingles (the prefix: two sets that reach the
   threshold share at least one token of their prefixes under any common order, and at
   least k of prefixes that are k - 1 tokens longer; the sketch provides an order that
   puts frequent tokens last). Prefix tokens of a single class are dropped as they stream
   by, then classes with too few shared tokens.
3. Similar classes are partitioned into groups: a class joins the group of its most
   shared prefix token. The matrix holds, per token, the groups whose members have it in
   their prefixes, with the members' least and greatest sizes.
4. Every class meets, through the matrix, the groups that may hold a partner: those with
   enough of its prefix tokens and members of fitting size. A task
   holds one block of a group: it bounds the overlap of a query by the group's token
   union, opens the group only if the bound reaches the threshold, and compares exactly.
   Inside a group, links are followed breadth first and what is linked is not compared
   again, so a large family of copies costs little more than one comparison each. Groups
   with more than `BLOCK` members are first compared with one leader; all it links are one
   core, and only the others visit the further blocks.
5. Links between classes become components by alternating star contraction.

No pairs within a class or core are emitted, yet no link between different sets is lost.

Defined cases: null and empty texts have an empty set, are linked with nothing and form
components of their own; texts of fewer words than a shingle have one; repeated rows are
one class; a null doc_id never becomes a component id unless all of the component are
null; an empty table gives an empty result; columns other than doc_id and text are
ignored. `one_of_each` keeps one row of each component; there, rows of equal doc_id and text
are one document, and different texts under one doc_id, or under none, are different ones.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icx.llm.common import SPACE, SpanHash, blocks, document_key, mixed, owners, runs, windows, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a shingle and threshold in per cent, unless the caller says otherwise.
SHINGLE = 3
PERCENT = 90
#: Buckets of the frequency sketch (four bytes each) and of the filter of wanted classes.
SKETCH_BITS = 20
FILTER_BITS = 23
SLICE = 1 << 14
#: Prefixes hold one more token for so many tokens of the set, and partners share as many more.
EXTRA = 10
#: Members of a group that one task holds, and queries that meet them there.
BLOCK = 2048

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, token) of all distinct shingles, ordered by text and token."""
    low = LOWER[data]
    start, end = runs(~SPACE[low], off)
    doc = owners(start, off)
    h = SpanHash(low)(start, end)
    tokens, at = windows(h, doc, shingle)
    parts = [(doc[at], tokens)]
    n_words = np.bincount(doc, minlength=len(off) - 1)
    for k in range(1, shingle):  # shorter texts: the whole sequence
        tokens, at = windows(h, doc, k)
        short = n_words[doc[at]] == k
        parts.append((doc[at[short]], mixed(tokens[short] ^ np.uint64(k))))
    doc = np.concatenate([d for d, _ in parts])
    tokens = np.concatenate([t for _, t in parts])
    order = np.lexsort((tokens, doc))
    doc, tokens = doc[order], tokens[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (tokens[1:] != tokens[:-1])
    return doc[first], tokens[first]


def signatures(doc: np.ndarray, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: set size and two order-free 64-bit signatures."""
    begin = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mixed(tokens ^ np.uint64(salt)), out=total[1:])
        out.append(mixed(total[begin[1:]] - total[begin[:-1]] + np.diff(begin).astype(np.uint64)).view(np.int64))
    return np.diff(begin), out[0], out[1]


FIRST = "doc_id long, key long, n long, s1 long, s2 long, slice int, counts binary"


def _first_pass(shingle: int):
    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch, data, off in blocks(batches):
            doc, tokens = shingle_sets(data, off, shingle)
            n, s1, s2 = signatures(doc, tokens, batch.num_rows)
            sketch += np.bincount((tokens & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(sketch))
            none = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(s1), pa.array(s2), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())],
                names=["doc_id", "key", "n", "s1", "s2", "slice", "counts"],
            )
        parts = [np.minimum(sketch[i : i + SLICE], 2**32 - 1).astype("<u4").tobytes() for i in range(0, len(sketch), SLICE)]
        none = [pa.nulls(len(parts), pa.int64())] * 5
        if sketch.any():
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "key", "n", "s1", "s2", "slice", "counts"]
            )

    return run


def _added(batches):
    """Sums of the sketch's slices, streaming."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[k] = total.get(k, 0) + np.frombuffer(raw, "<u4").astype(np.int64)
    for k, v in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], names=["slice", "counts"]
        )


def _prefixes(sketch: np.ndarray, shingle: int, percent: int):
    """(token, s1, n) of the rarest tokens of every set, enough for the threshold."""

    def run(batches):
        for batch, data, off in blocks(batches):
            doc, tokens = shingle_sets(data, off, shingle)
            n, s1, _ = signatures(doc, tokens, batch.num_rows)
            freq = sketch[(tokens & np.uint64(len(sketch) - 1)).astype(np.int64)]
            order = np.lexsort((tokens, freq, doc))
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
            take = n - (percent * n + 99) // 100 + 1 + n // EXTRA  # at least 1 + n // EXTRA are shared in these
            _, first = np.unique(s1, return_index=True)  # copies in one block emit once
            once = np.zeros(batch.num_rows, bool)
            once[first] = True
            keep = (rank < take[doc]) & once[doc]  # doc is the same before and after ordering
            doc, tokens = doc[keep], tokens[order][keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens.view(np.int64)), pa.array(s1[doc]), pa.array(n[doc])], names=["token", "s1", "n"]
            )

    return run


def _shared(batches):
    """Of rows sorted by (token, s1): one row per class, only tokens that two classes have.

    `near` counts the classes of the token in the same batch; it only guides the grouping.
    """
    last: tuple | None = None  # (token, s1, n, whether emitted)
    for batch in batches:
        token, s1, n = (c.to_numpy() for c in batch.columns)
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (s1[1:] != s1[:-1])
        if last is not None:
            new[0] = (token[0], s1[0]) != last[:2]
        token, s1, n = token[new], s1[new], n[new]
        if not len(token):
            continue
        same = np.zeros(len(token), bool)  # equal token as the row before
        same[1:] = token[1:] == token[:-1]
        carried = None
        if last is not None and token[0] == last[0]:
            same[0] = True
            if not last[3]:
                carried = last[:3]
        keep = same.copy()
        keep[:-1] |= same[1:]
        _, back, near = np.unique(token, return_inverse=True, return_counts=True)
        out = [token[keep], s1[keep], n[keep], near[back][keep]]
        if carried:
            out = [np.concatenate([[c], x]) for c, x in zip((*carried, 1), out)]
        last = (token[-1], s1[-1], n[-1], bool(keep[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["token", "s1", "n", "near"])


def _wanted_sets(bits: np.ndarray, shingle: int):
    """(s1, n, tokens) of texts whose class may be wanted."""

    def run(batches):
        for batch, data, off in blocks(batches):
            doc, tokens = shingle_sets(data, off, shingle)
            n, s1, _ = signatures(doc, tokens, batch.num_rows)
            begin = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            slot = (s1.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
            may = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            _, first = np.unique(s1, return_index=True)
            once = np.zeros(batch.num_rows, bool)
            once[first] = True
            at = np.flatnonzero(may & once & (n > 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(s1[at]), pa.array([tokens[begin[i] : begin[i + 1]].tobytes() for i in at.tolist()], pa.binary())], names=["s1", "tokens"]
            )

    return run


class _Members:
    """Inverted lists of the members of a block."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.n = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(token, kind="stable")
        self.token, self.owner = token[order], owner[order]

    def union_bound(self, q: np.ndarray) -> int:
        """Tokens of the query in the union of the group: no member shares more."""
        at = np.minimum(np.searchsorted(self.token, q), len(self.token) - 1)
        return int((self.token[at] == q).sum())

    def narrowed(self, alive: np.ndarray) -> None:
        keep = alive[self.owner]
        self.token, self.owner = self.token[keep], self.owner[keep]

    def linked(self, q: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.token, q, "left"), np.searchsorted(self.token, q, "right")
        n = high - low
        total = np.cumsum(n)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(low - total + n, n)
        shared = np.bincount(self.owner[at], minlength=len(self.n))
        return np.flatnonzero((shared > 0) & (100 * shared >= self.percent * (self.n + len(q) - shared)))


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _compared(table: pa.Table, percent: int) -> pa.Table:
    """Links of one block: among its members, and of its queries to members."""
    role, s1 = table.column("role").to_numpy(), table.column("s1").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
    mine = np.flatnonzero(role != QUERY)
    links: list[tuple[int, int]] = []
    if len(mine):
        own = [sets[i] for i in mine]
        ids = s1[mine]
        label = np.arange(len(mine))
        if (role[mine] != SEEN).any():  # in further rows of the grid, members only meet queries
            members = _Members(own, percent)
            alive = np.ones(len(mine), bool)
            core = np.flatnonzero(role[mine] == CORE)
            seeds = [core.tolist()] if len(core) else []
            label[core] = core[0] if len(core) else 0
            alive[core] = False
            at, held = 0, len(mine)
            while alive.any() or seeds:
                if seeds:
                    queue = seeds.pop()
                else:
                    at += int(np.argmax(alive[at:]))
                    alive[at] = False
                    queue = [at]
                head = label[queue[0]]
                while queue and alive.any():
                    y = queue.pop()
                    if 2 * (left := int(alive.sum())) < held:
                        members.narrowed(alive)
                        held = left
                    found = members.linked(own[y])
                    found = found[alive[found]]
                    alive[found] = False
                    label[found] = head
                    links += [(ids[y], ids[z]) for z in found]
                    queue += found.tolist()
        queries = np.flatnonzero(role == QUERY)
        if len(queries):
            members = _Members(own, percent)
            for i in queries:
                q = sets[i]
                if 100 * members.union_bound(q) < percent * len(q):
                    continue  # the group stays closed
                found = members.linked(q)
                if len(found):
                    _, one = np.unique(label[found], return_index=True)  # one link to each part that is linked anyway
                    links += [(s1[i], ids[z]) for z in found[one]]
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


MEMBER, CORE, SEEN, QUERY = 0, 1, 2, 3


def _led(table: pa.Table, percent: int) -> pa.Table:
    """Members of one block that the leader links."""
    s1, lead = table.column("s1").to_numpy(), table.column("lead").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
    leader = next((s for s, flag in zip(sets, lead) if flag), None)
    first = next((i for i, flag in zip(s1, lead) if flag), None)
    own = [i for i, flag in enumerate(lead) if not flag]
    core = _Members([sets[i] for i in own], percent).linked(leader) if leader is not None and own else []
    found = s1[[own[i] for i in core]] if len(core) else np.zeros(0, np.int64)
    return pa.table({"a": pa.array(np.full(len(found), first if first is not None else 0), pa.int64()), "b": pa.array(found, pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of (a, b) edges.

    Large-star and small-star contraction: every round joins edges with per-node minima
    and writes the shorter edges; star centres are joined, never collected.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "small")


def _least_shared(n, percent: int):
    """Prefix tokens that a set of size n shares with any partner, which has `percent` of n tokens at least."""
    return 1 + F.floor(F.floor((percent * n + 99) / 100) / EXTRA)


def links(docs: DataFrame, sketch: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """(a, b): linked classes, by signature. Enough links to connect all that are linked."""
    src = docs.select("doc_id", "text")
    prefixes = src.mapInArrow(_prefixes(sketch, shingle, percent), "token long, s1 long, n long")
    shared = prefixes.repartition("token").sortWithinPartitions("token", "s1").mapInArrow(_shared, "token long, s1 long, n long, near long")
    # per class, one exchange: how many of its tokens are shared, and its group, the one most shared
    of_class = Window.partitionBy("s1")
    placed = (
        shared.select(
            "token", "s1", "n", F.count("*").over(of_class).alias("c"), F.max(F.struct("near", "token")).over(of_class)["token"].alias("g"),
        )
        .filter(F.col("c") >= _least_shared(F.col("n"), percent))
        .select("token", "s1", "n", "g")
    )
    placed = written(placed, "placed")
    group = placed.select("s1", "g").distinct()
    sizes = group.groupBy("g").agg(F.count("*").alias("size"), F.min("s1").alias("leader"))
    sized = written(
        group.join(sizes, "g").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("s1"), F.col("blocks")).cast("int")),
        "members",
    )
    # the token-group matrix meets the classes, both dealt by token: the tokens a class shares with each group
    by_token = placed.repartition("token")
    matrix = by_token.groupBy("token", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("held"))
    reach = (100 * F.col("high") >= percent * F.col("n")) & (percent * F.col("low") <= 100 * F.col("n"))
    other = (F.col("g") != F.col("own")) | (F.col("held") > 1)
    evidence = (
        by_token.withColumnRenamed("g", "own").join(matrix.hint("merge"), "token").filter(reach & other)
        .groupBy("s1", "g", "own").agg(F.count("*").alias("c"), F.max("n").alias("n"))
        .filter(F.col("c") >= _least_shared(F.col("n"), percent)).select("s1", "g", "own")
    )
    evidence = written(evidence, "evidence")
    visits = evidence.filter("g <> own").select("s1", "g")
    # of the own group, only members that share enough with the others of it; of a visited group, all
    inner = evidence.filter("g = own").select("s1")
    called = sized.join(visits.select("g").distinct(), "g", "left_semi").select("s1")
    sized = written(sized.join(inner.unionAll(called).distinct(), "s1", "left_semi"), "open")
    wanted = sized.select("s1").unionAll(visits.select("s1")).distinct()
    bits = _filter_bits(wanted)
    sets = src.mapInArrow(_wanted_sets(bits, shingle), "s1 long, tokens binary").join(wanted, "s1", "left_semi").dropDuplicates(["s1"])
    sets = written(sets, "sets")
    # large groups: what the leader links is one core
    large = sized.filter("blocks > 1")
    one = lambda lead: F.lit(lead).alias("lead")
    lead_rows = large.select("g", "leader", "blocks").distinct().select("g", F.col("leader").alias("s1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), one(True))
    others = large.filter("s1 <> leader").select("g", "s1", "block", one(False))
    led = lead_rows.unionByName(others).join(sets, "s1").groupBy("g", "block").applyInArrow(lambda table: _led(table, percent), LINK)
    core = written(led, "core")
    in_core = core.select(F.col("b").alias("s1")).unionAll(core.select(F.col("a").alias("s1"))).distinct().withColumn("core", F.lit(True))
    placed = sized.join(in_core, "s1", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    placed = written(placed.select("s1", "g", "blocks", "block", "core"), "placed")
    # queries of a group: visitors, and its own members outside the core towards the other blocks
    asked = visits.join(sized.select("g", "blocks").distinct(), "g").select("s1", "g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    loose = (
        placed.filter("blocks > 1 and not core")
        .select("s1", "g", F.col("block").alias("home"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        .filter("block <> home").drop("home")
    )
    asked = written(asked.unionByName(loose), "queries")
    grid = asked.groupBy("g", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows"))
    members = placed.join(grid, ["g", "block"], "left").select(
        "s1", "g", "block", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("rows", F.lit(1)), F.lit(1)) - 1)).alias("row"),
        F.when(F.col("core"), CORE).otherwise(MEMBER).alias("role"),
    )
    members = members.withColumn("role", F.when(F.col("row") > 0, SEEN).otherwise(F.col("role")))
    queries = asked.join(grid, ["g", "block"]).select(
        "s1", "g", "block", F.pmod(F.xxhash64("s1"), F.col("rows")).cast("int").alias("row"), F.lit(QUERY).alias("role")
    )
    rows = members.unionByName(queries).join(sets, "s1")
    return core.unionAll(rows.groupBy("g", "block", "row").applyInArrow(lambda table: _compared(table, percent), LINK))


def _filter_bits(classes: DataFrame) -> np.ndarray:
    """A one-hash bitmap of class signatures, of fixed size: it only saves work."""
    slot = F.col("s1").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = classes.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    got = words.toArrow()  # at most 2^FILTER_BITS / 64 rows
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return bits.view(np.uint64)


def _rooted(docs: DataFrame, least: Column, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows as doc_id, key (content key), n, s1, s2; and their classes as s1, s2, least, root, those of equal root linked."""
    src = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    first = written(src.mapInArrow(_first_pass(shingle), FIRST), "signatures")
    slices = first.filter("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(_added, "slice int, counts binary")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in slices.collect():  # fixed size: the whole sketch
        sketch[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], "<u4")
    rows = first.filter("slice is null").drop("slice", "counts")
    classes = written(rows.filter("n > 0").groupBy("s1", "s2").agg(F.min(least).alias("least")), "classes")
    roots = components(links(docs, sketch, shingle, percent))
    linked = roots.select("node", "root").unionAll(roots.select(F.col("root").alias("node"), "root")).distinct()
    return rows, classes.join(linked, classes["s1"] == linked["node"], "left").withColumn("root", F.coalesce("root", "s1"))


def joined(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    rows, named = _rooted(docs, F.col("doc_id"), shingle, percent)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "root").select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "component_id")
    on = (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n") > 0)
    return rows.join(of_class, on, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest doc_id (nulls last) and content key, all columns."""
    rows, named = _rooted(docs, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"), shingle, percent)
    kept = named.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.key")
    kept = kept.unionAll(rows.filter("n = 0").select("doc_id", "key"))  # empty sets are components of their own
    key = document_key("doc_id")
    kept = kept.select(F.col("key").alias("__icx_text"), *key.values()).distinct()
    own = docs.select("*", F.xxhash64("doc_id", "text").alias("__icx_text"), *key.values())
    # rows that share doc_id and text are one document; the join has dealt them together already
    on = ["__icx_text", *key]
    return own.join(kept, on, "left_semi").dropDuplicates(on).select(*docs.columns)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS k FROM d),
u AS (SELECT DISTINCT doc_id, k FROM sh),
n AS (SELECT doc_id, count(*) AS c FROM u GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM u a JOIN u b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.c + y.c - shared)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""
