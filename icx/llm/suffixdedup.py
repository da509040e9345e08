"""Removal of repeated byte strings by a distributed suffix merge sort.

A byte goes if it is covered by a `LENGTH`-byte string that also starts earlier (smaller
doc_id, or the same document and an earlier start). Sorting every suffix of the corpus
would move each byte many times, so the suffix array is sparse: every string of `LENGTH`
bytes has one anchor, the leftmost of its `GRAM`-byte grams with the least hash, and only
suffixes that begin at anchors are sorted. Equal strings have equal anchors at equal
offsets, so nothing is lost.

1. Anchors' hashes are exchanged in packed columns; what occurs once in the corpus is
   dropped, and every document gets the places of its shared anchors back.
2. Documents cut the suffixes at shared anchors, with the bytes before the anchor that
   strings around it can reach. Tasks sort them into runs by (anchor hash, bytes), leave
   only the first of equal ones (the others are marked at once), and exchange the runs
   front-coded: per suffix the length of the prefix it shares with its predecessor, and
   the rest.
3. A task gets one range of the order and merges its runs with a loser tree that carries
   common prefix lengths: strings are compared only beyond what is known to be equal, and
   often not at all. The merge yields the sorted suffixes and their common prefixes;
   neighbours that share the whole gram form a group.
4. In a group, equal stretches keep their first place; where stretches differ, the strings
   around the anchor are told apart one by one, and all but the first are marked.
5. Marks are joined to the documents.

A gram that occurs more than `HEAVY` times (a passage in a third of all documents) would
be one large group; its strings travel by their own hashes instead, each task sending the
first of equal ones only, so they spread over all tasks.

Defined cases: a null text is empty; texts shorter than `LENGTH` lose nothing; a null
doc_id sorts first; rows with equal doc_id and text are one document and get equal
results, rows with equal doc_id and other text are ordered by a hash of the text; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icx.llm.common import SpanHash, blocks, mixed, shuffle_partitions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 100
GRAM = 32
HEAVY = 20_000
#: Bytes of text that are looked at together, and bytes of suffixes in one sorted run.
STEP_BYTES = 1 << 20
RUN_BYTES = 3 << 20
#: Bytes of text whose anchors' hashes travel in one packed row per part.
HASHED_BYTES = 16 << 20
#: Ranges of the order per shuffle partition.
RANGES = 4
NULL_ID = -(1 << 63)
HEAVY_BIT = np.uint32(1 << 31)


# ---- anchors ---------------------------------------------------------------------------


def anchored(data: np.ndarray, off: np.ndarray):
    """Per anchor that owns strings: (text, anchor, first start, last start) as byte positions, and the gram hashes.

    The strings that start at `first`..`last` have the same anchor.
    """
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, np.zeros(0, np.uint64), None
    span = SpanHash(data)
    grams = np.arange(len(data) - GRAM + 1)
    h = span(grams, grams + GRAM)
    least = ((h >> np.uint64(32)) << np.uint64(32)) | grams.astype(np.uint64)  # hash, then leftmost
    width, reach = LENGTH - GRAM + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if rest := width - reach:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    valid = doc[:n] == doc[LENGTH - 1 :]
    same = np.zeros(n, bool)  # same owner as the string before
    same[1:] = valid[1:] & valid[:-1] & (anchor[1:] == anchor[:-1]) & (doc[1:n] == doc[: n - 1])
    first = np.flatnonzero(valid & ~same)
    follow = np.zeros(n, bool)
    follow[:-1] = same[1:]
    last = np.flatnonzero(valid & ~follow)
    at = anchor[first]
    # least hashes are small ones: hashed again, they spread over the whole range
    return doc[first], at, first, last, mixed(h[at] ^ np.uint64(0x452821E638D01377)), span


# ---- packed columns ----------------------------------------------------------------------


def packed(*columns: np.ndarray) -> bytes:
    head = np.array([len(columns), *[c.nbytes for c in columns]], "<u4").tobytes()
    return head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpacked(raw: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(raw, "<u4", len(kinds) + 1)[1:].astype(np.int64)
    at, out = 4 * (len(kinds) + 1), []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Equal ranges of the hash order."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _split(key: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(value, slice) of each value of an ascending key."""
    cut = np.searchsorted(key, np.arange(n + 1))
    return ((v, slice(cut[v], cut[v + 1])) for v in range(n) if cut[v] < cut[v + 1])


HASHES = "part int, payload binary"


def _hashes(parts: int):
    """Anchors' hashes with their places, one packed row per part and run of texts."""

    def flush(held):
        dk, doc, at, h = (np.concatenate(x) for x in zip(*held))
        part = _range_of(h, parts)
        order = np.lexsort((at, doc, part))
        doc, at, h, part = doc[order], at[order], h[order], part[order]
        rows = []
        for p, s in _split(part, parts):
            own, inner = np.unique(doc[s], return_inverse=True)
            rows.append((p, packed(dk[own], np.bincount(inner).astype("<u4"), at[s].astype("<u4"), h[s])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "payload"])

    def run(batches):
        held, size, texts = [], 0, 0
        for batch, data, off in blocks(batches, limit=STEP_BYTES):
            doc, at, _, _, h, _ = anchored(data, off)
            dk = batch.column(batch.schema.get_field_index("dk")).to_numpy()
            held.append((dk, doc + texts, at - off[doc], h))
            texts += batch.num_rows
            size += len(data)
            if size >= HASHED_BYTES:
                yield from flush(held)
                held, size, texts = [], 0, 0
        if held:
            yield from flush(held)

    return run


PLACES = T.StructType([T.StructField("dk", T.LongType()), T.StructField("places", T.BinaryType())])


def _shared(heavy: int):
    def run(table: pa.Table) -> pa.Table:
        dk, n, at, h = (np.concatenate(x) for x in zip(*[unpacked(raw, "<i8", "<u4", "<u4", "<u8") for raw in table.column("payload").to_pylist()]))
        # rows with equal doc_id and text are one document: its places count and travel once
        total = np.add.reduceat(h, np.cumsum(n, dtype=np.int64) - n)
        order = _order(dk, total)
        once = np.ones(len(dk), bool)
        once[order] = ~_same_as_before(dk[order], total[order])
        own = np.repeat(once, n)
        dk, at, h = np.repeat(dk, n)[own], at[own], h[own]
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(s)))
        often = np.empty(len(s), np.int64)
        often[order] = np.repeat(count, count)
        keep = often >= 2
        dk, at = dk[keep], np.where(often[keep] > heavy, at[keep] | HEAVY_BIT, at[keep]).astype("<u4")
        order = np.argsort(dk, kind="stable")
        dk, at = dk[order], at[order]
        own, begin = np.unique(dk, return_index=True)
        end = np.append(begin[1:], len(dk))
        return pa.table({"dk": pa.array(own, pa.int64()), "places": pa.array([at[a:b].tobytes() for a, b in zip(begin, end)], pa.binary())})

    return run


# ---- runs ----------------------------------------------------------------------------------

RUN, STRINGS, MARKS = 0, 1, 2
ROWS = "part int, kind int, payload binary"


def _front_coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared prefix with the predecessor, length of the rest, and all rests."""
    shared = np.zeros(len(texts), np.uint8)
    rests = []
    before = b""
    for i, s in enumerate(texts):
        k = common(before, s, 0)
        shared[i] = k
        rests.append(s[k:])
        before = s
    return shared, np.array([len(r) for r in rests], np.uint8), np.frombuffer(b"".join(rests), np.uint8)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, looking only beyond `known`."""
    n = min(len(a), len(b))
    k = known
    if a[k:n] == b[k:n]:
        return n
    while a[k : k + 8] == b[k : k + 8]:
        k += 8
    while a[k] == b[k]:
        k += 1
    return k


def _order(*columns) -> np.ndarray:
    """Stable order, first column first."""
    return np.lexsort(columns[::-1])


def _same_as_before(*columns) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    out[:1] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


def _first_of(new: np.ndarray) -> np.ndarray:
    """For each row, the row that begins its stretch."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _marked(doc: np.ndarray, dk: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Marks with those that touch in a document united."""
    order = _order(doc, dk, start)
    doc, dk, start, end = doc[order], dk[order], start[order], end[order]
    if not len(doc):
        return doc, dk, start, end
    fresh = ~_same_as_before(doc, dk)
    group = np.cumsum(fresh) - 1
    shift = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = fresh.copy()
    new[1:] |= start[1:] + shift[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(doc)) - 1
    return doc[begin], dk[begin], start[begin], reach[stop] - shift[stop]


def _runs(parts: int):
    """Sorted, front-coded runs of the suffixes at shared anchors."""

    def flush(held):
        doc, dk, at, low, high, h, heavy, size, text = (np.concatenate(x) for x in zip(*held))
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        span = SpanHash(text)
        rows = []
        # heavy grams: strings by their own hash, the first of equal ones
        strong = np.flatnonzero(heavy)
        if len(strong):
            n = high[strong] - low[strong] + 1
            own = np.repeat(strong, n)
            inner = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            a = begin[own] + inner
            h1, start = span(a, a + LENGTH), at[own] - high[own] + inner
            h2 = mixed(span(a + GRAM, a + LENGTH) ^ span(a, a + GRAM) * np.uint64(3))
            order = _order(h1, h2, doc[own], dk[own], start)
            own, h1, h2, start = own[order], h1[order], h2[order], start[order]
            again = _same_as_before(h1, h2)
            lead = _first_of(~again)
            other = again & ~((doc[own] == doc[own[lead]]) & (dk[own] == dk[own[lead]]) & (start == start[lead]))
            m = _marked(doc[own[other]], dk[own[other]], start[other], start[other] + LENGTH)
            rows.append((int(h[0] % np.uint64(parts)), MARKS, packed(*m)))
            own, h1, h2, start = own[~again], h1[~again], h2[~again], start[~again]
            for p, s in _split(_range_of(h1, parts), parts):
                rows.append((p, STRINGS, packed(h1[s], h2[s], doc[own[s]], dk[own[s]], start[s])))
        weak = np.flatnonzero(~heavy)
        if len(weak):
            # equal stretches of this run: only the first travels
            whole = span(begin[weak], begin[weak] + size[weak])
            order = weak[_order(h[weak], low[weak], high[weak], whole, doc[weak], dk[weak], at[weak])]
            whole = span(begin[order], begin[order] + size[order])
            again = _same_as_before(h[order], low[order], high[order], whole)
            lead = order[_first_of(~again)]
            other = order[again & ~((doc[order] == doc[lead]) & (dk[order] == dk[lead]) & (at[order] == at[lead]))]
            m = _marked(doc[other], dk[other], at[other] - high[other], at[other] + LENGTH - low[other])
            rows.append((int(h[0] % np.uint64(parts)), MARKS, packed(*m)))
            left = order[~again]
            raw = text.tobytes()
            keys = h[left].astype(">u8").tobytes()
            suffix = [keys[8 * i : 8 * i + 8] + raw[begin[j] + high[j] : begin[j] + size[j]] for i, j in enumerate(left.tolist())]
            rank = sorted(range(len(left)), key=suffix.__getitem__)
            left = left[rank]
            suffix = [suffix[i] for i in rank]
            for p, s in _split(_range_of(h[left], parts), parts):
                j = left[s]
                before = np.frombuffer(b"".join(raw[begin[i] : begin[i] + high[i]] for i in j.tolist()), np.uint8)
                shared, rest, tails = _front_coded(suffix[s])
                rows.append((p, RUN, packed(shared, rest, tails, before, low[j].astype(np.uint8), high[j].astype(np.uint8), doc[j], dk[j], at[j].astype("<u4"))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
            names=["part", "kind", "payload"],
        )

    def run(batches):
        held, size = [], 0
        for batch, data, off in blocks(batches, limit=STEP_BYTES):
            doc, at, first, last, h, _ = anchored(data, off)
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            ids = column("doc_id").fill_null(NULL_ID).to_numpy()
            dk = column("dk").to_numpy()
            wanted, strong = [], []
            for i, lists in enumerate(column("places").to_pylist()):
                places = np.frombuffer(b"".join(lists), "<u4")
                wanted.append((places & ~HEAVY_BIT).astype(np.int64) + off[i])
                strong.append((places & HEAVY_BIT) != 0)
            wanted, strong = np.concatenate(wanted), np.concatenate(strong)
            order = np.argsort(wanted, kind="stable")
            wanted, strong = wanted[order], strong[order]
            if not len(wanted) or not len(at):
                continue
            place = np.minimum(np.searchsorted(wanted, at), len(wanted) - 1)
            hit = np.flatnonzero(wanted[place] == at)
            doc, at, first, last, h, heavy = doc[hit], at[hit], first[hit], last[hit], h[hit], strong[place[hit]]
            n = last + LENGTH - first
            a = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
            held.append((ids[doc], dk[doc], at - off[doc], at - last, at - first, h, heavy, n, data[a]))
            size += len(a)
            if size >= RUN_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


# ---- merging ---------------------------------------------------------------------------------


class Run:
    """Cursor over a front-coded run: its current string and the prefix that shares with the one before."""

    def __init__(self, shared: np.ndarray, rest: np.ndarray, tails: np.ndarray):
        self.shared, self.rest, self.tails = shared.tolist(), rest.tolist(), tails.tobytes()
        self.i, self.at = -1, 0
        self.text: bytes | None = b""
        self.advance()

    def advance(self) -> int:
        """Go to the next string; its common prefix with the one before, -1 at the end."""
        self.i += 1
        if self.i >= len(self.shared):
            self.text = None
            return -1
        k, n = self.shared[self.i], self.rest[self.i]
        self.text = self.text[:k] + self.tails[self.at : self.at + n]
        self.at += n
        return k


def merged(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, index in run, common prefix with the string before) in sorted order.

    Every loser keeps the length of the prefix it shares with the winner that beat it. Two
    strings that share different lengths with the last winner are ordered by these alone;
    bytes are looked at only beyond a length that both are known to share.
    """
    k = 1
    while k < len(runs):
        k *= 2
    shared = [0 if r.text is not None else -1 for r in runs] + [-1] * (k - len(runs))
    texts = [r.text for r in runs] + [None] * (k - len(runs))
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two leaves, setting the loser's shared length."""
        x, y = shared[a], shared[b]
        if x > y:
            return a, b
        if x < y:
            return b, a
        if x < 0:
            return a, b
        s, t = texts[a], texts[b]
        n = common(s, t, x)
        if n == len(s) or (n < len(t) and s[n] < t[n]):  # equal strings: the left run first
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        nxt = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            loser[node + i // 2] = lost
            nxt.append(w)
        level = nxt
    winner = level[0]
    while texts[winner] is not None:
        run = runs[winner]
        yield winner, run.i, shared[winner]
        shared[winner] = run.advance()
        texts[winner] = run.text
        node = (winner + k) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


SPANS = T.StructType([T.StructField("dk", T.LongType()), T.StructField("id", T.LongType()), T.StructField("spans", T.BinaryType())])


def _judged_range(table: pa.Table) -> pa.Table:
    """All marks of one range of the order."""
    kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
    marks = [unpacked(p, "<i8", "<i8", "<i8", "<i8") for k, p in zip(kinds, payloads) if k == MARKS]
    raw_runs = [unpacked(p, "u1", "u1", "u1", "u1", "u1", "u1", "<i8", "<i8", "<u4") for k, p in zip(kinds, payloads) if k == RUN]
    if raw_runs:
        marks += _from_runs(raw_runs)
    strings = [unpacked(p, "<u8", "<u8", "<i8", "<i8", "<i8") for k, p in zip(kinds, payloads) if k == STRINGS]
    if strings:
        h1, h2, doc, dk, start = (np.concatenate(x) for x in zip(*strings))
        order = _order(h1, h2, doc, dk, start)
        h1, h2, doc, dk, start = h1[order], h2[order], doc[order], dk[order], start[order]
        marks.append(_not_first(_same_as_before(h1, h2), doc, dk, start, start + LENGTH))
    if not marks:
        return pa.table({"dk": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
    doc, dk, start, end = _marked(*(np.concatenate(x) for x in zip(*marks)))
    spans = np.stack([start, end], 1).astype("<u4")
    begin = np.flatnonzero(~_same_as_before(doc, dk))
    stop = np.append(begin[1:], len(doc))
    return pa.table({
        "dk": pa.array(dk[begin], pa.int64()), "id": pa.array(doc[begin], pa.int64()),
        "spans": pa.array([spans[a:b].tobytes() for a, b in zip(begin, stop)], pa.binary()),
    })


def _not_first(again: np.ndarray, doc: np.ndarray, dk: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Marks of all rows of a stretch that are another place than its first."""
    lead = _first_of(~again)
    other = again & ~((doc == doc[lead]) & (dk == dk[lead]) & (start == start[lead]))
    return doc[other], dk[other], start[other], end[other]


def _from_runs(raw_runs: list[list[np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
    """Merge runs and tell the members of every group of equal grams apart."""
    runs = [Run(*r[:3]) for r in raw_runs]
    base = np.cumsum([0, *[len(r[0]) for r in raw_runs]])
    which, index, shared = (np.array(x, np.int64) for x in zip(*merged(runs)))
    row = base[which] + index
    joins = shared >= 8 + GRAM  # the whole gram, after its hash
    group = np.cumsum(~joins)
    size = np.bincount(group)
    pick = np.flatnonzero(size[group] > 1)
    if not len(pick):
        return []
    row, group = row[pick], group[pick]
    low, high, doc, dk, at = (np.concatenate([r[c] for r in raw_runs])[row].astype(np.int64) for c in (4, 5, 6, 7, 8))
    # the stretch of each: the bytes before the anchor and the suffix, cut back to what strings reach
    heads = np.concatenate([r[3] for r in raw_runs])
    head_size = np.concatenate([r[5] for r in raw_runs]).astype(np.int64)
    head_at = (np.cumsum(head_size) - head_size)[row]
    texts = _texts(raw_runs)
    raw = heads.tobytes()
    pieces = [raw[a : a + n] + texts[i] for a, n, i in zip(head_at.tolist(), high.tolist(), row.tolist())]
    n = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.cumsum(n) - n
    span = SpanHash(np.frombuffer(b"".join(pieces), np.uint8))
    whole = span(begin, begin + n)
    order = _order(group, low, high, whole, doc, dk, at)
    group, low, high, whole, doc, dk, at, begin = (c[order] for c in (group, low, high, whole, doc, dk, at, begin))
    again = _same_as_before(group, low, high, whole)
    out = [_not_first(again, doc, dk, at - high, at + LENGTH - low)]
    # firsts of groups with several different stretches: string by string
    own = np.flatnonzero(~again)
    several = np.bincount(group[own])[group[own]] > 1
    own = own[several]
    if len(own):
        n = high[own] - low[own] + 1
        of = np.repeat(own, n)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        a = begin[of] + inner
        offset = high[of] - inner
        key = span(a, a + LENGTH)
        start = at[of] - offset
        order = _order(group[of], offset, key, doc[of], dk[of], start)
        of, offset, key, start = of[order], offset[order], key[order], start[order]
        again = _same_as_before(group[of], offset, key)
        out.append(_not_first(again, doc[of], dk[of], start, start + LENGTH))
    return out


def _texts(raw_runs: list[list[np.ndarray]]) -> list[bytes]:
    """All suffixes without their leading hash."""
    out = []
    for r in raw_runs:
        run = Run(*r[:3])
        while run.text is not None:
            out.append(run.text[8:])
            run.advance()
    return out


# ---- documents ---------------------------------------------------------------------------------


def _kept(with_text: bool):
    def run(batches):
        for batch, data, off in blocks(batches):
            raw = data.tobytes()
            out = []
            for i, lists in enumerate(batch.column(batch.schema.get_field_index("spans")).to_pylist()):
                text = raw[off[i] : off[i + 1]]
                spans = np.frombuffer(b"".join(lists or []), "<u4").reshape(-1, 2).astype(np.int64)
                zero = np.zeros(len(spans), np.int64)
                _, _, start, end = _marked(zero, zero, spans[:, 0], spans[:, 1])
                edge = [0, *np.stack([start, end], 1).reshape(-1).tolist(), len(text)]
                left = b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2]))
                out.append((len(text), len(text) - len(left), len(start), hashlib.sha256(left).hexdigest(), left, edge[1:-1]))
            columns = [pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns += [pa.array([o[4] for o in out], pa.binary()), pa.array([o[5] for o in out], pa.list_(pa.int64()))]
                names += ["kept", "edges"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *columns], names=names)

    return run


def deduplicated(docs: DataFrame, heavy: int = HEAVY, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept bytes, removed span edges): one row per document.

    The documents are dealt by content key once; both joins read that exchange.
    """
    parts = shuffle_partitions(docs.sparkSession)
    ranges = RANGES * parts
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    src = src.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("dk"))
    hashes = src.select("dk", "text").mapInArrow(_hashes(ranges), HASHES)
    places = hashes.groupBy("part").applyInArrow(_shared(heavy), PLACES).groupBy("dk").agg(F.collect_list("places").alias("places"))
    found = src.join(places.hint("merge"), "dk").select("doc_id", "dk", "text", "places")
    spans = found.mapInArrow(_runs(ranges), ROWS).groupBy("part").applyInArrow(_judged_range, SPANS)
    gathered = spans.groupBy("dk").agg(F.collect_list(F.struct("id", "spans")).alias("all"))
    own = F.filter("all", lambda x: x["id"] == F.coalesce("doc_id", F.lit(NULL_ID)))
    out = src.join(gathered.hint("merge"), "dk", "left").select("doc_id", "text", F.transform(own, lambda x: x["spans"]).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, edges array<long>" if with_text else "")
    return out.mapInArrow(_kept(with_text), schema)


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
f AS (SELECT s, min((doc_id, i)) AS one, count(*) AS c FROM w GROUP BY s HAVING count(*) > 1),
again AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.s = f.s WHERE (w.doc_id, w.i) <> f.one),
marks AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS opens FROM again),
numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marks),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, k),
pieces AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
heads AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS stop FROM spans GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN heads USING (doc_id)
"""
