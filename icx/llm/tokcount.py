"""Token counts at every prefix by dynamic programming.

A prefix ends in exactly one last token, and what stands before that token is the
encoding of the shorter prefix; so `count[j] = count[j - len(last)] + 1`. The last token
is the one vocabulary entry ending at j that forms a valid pair with the last token
before it (two tokens are a valid pair if their joined bytes encode to just these two).
The table of a text answers truncation and budget questions without encoding again.

Texts are cut into units that no token crosses (before a single space, around a single
line feed); a unit's table is built once per block of texts and shared by its repeats,
and units are visited in sorted order so that equal beginnings share their table.

Defined cases: a null text is empty; special strings inside a text are the special
token, as in the library; repeated rows are counted one by one; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from icx.llm.common import SpanHash, blocks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: how byte-level encoders split text before their merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 1024
#: Bytes of text a step looks at: the more, the more of its units repeat or begin alike.
STEP_BYTES = 4 << 20
#: Entries of a young generation of memory; the one before it is kept too.
REMEMBERED = 150_000
#: Valid and invalid token pairs a task remembers per generation.
PAIRS = 1_000_000


def byte_alphabet() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, others for 256 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory:
    """A bounded dictionary of two generations: what is used stays, what is not goes."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class PrefixCounts:
    """Prefix tables under one byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.model = tok.model
        self.ids = tok.get_vocab(with_added_tokens=False)
        self.text = {i: s for s, i in self.ids.items()}
        #: Every ending of a vocabulary entry, with its id if it is an entry itself, else -1.
        self.tails = dict.fromkeys((s[k:] for s in self.ids for k in range(len(s))), -1) | self.ids
        self.special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.split = regex.compile(SPLIT).findall
        self.spaces = regex.compile(r"\s+").finditer
        self.table = byte_alphabet()
        self.pair = Memory(PAIRS)
        self.seen, self.last, self.count = "", [-1], [0]
        self.whole = Memory(REMEMBERED)

    def _valid(self, a: int, b: int) -> bool:
        key = (a + 1) << 32 | b
        if (known := self.pair.get(key)) is None:
            joined = (self.text[a] if a >= 0 else "") + self.text[b]
            known = [t.id for t in self.model.tokenize(joined)] == ([a, b] if a >= 0 else [b])
            self.pair.put(key, known)
        return known

    def piece(self, s: str) -> list[int]:
        """Counts at the prefixes 0..len(s) of one piece in the byte alphabet."""
        last, count, old = self.last, self.count, self.seen
        k, most = 0, min(len(s), len(old))
        while k < most and s[k] == old[k]:
            k += 1
        del last[k + 1 :], count[k + 1 :]
        tails, valid = self.tails.get, self._valid
        for j in range(k + 1, len(s) + 1):
            i, at, token = j - 1, j, -1  # the longest entry that ends at j
            while i >= 0 and (t := tails(s[i:j])) is not None:
                if t >= 0:
                    at, token = i, t
                i -= 1
            fits = self.pair.young.get((last[at] + 1) << 32 | token) if token >= 0 else False
            if fits is None:
                fits = valid(last[at], token)
            while not fits:  # the next shorter one
                at += 1
                if at >= j:
                    raise ValueError(f"no token of the vocabulary ends {s[:j]!r}")
                token = tails(s[at:j])
                fits = token >= 0 and valid(last[at], token)
            last.append(token)
            count.append(count[at] + 1)
        self.seen = s
        return count

    def size(self, unit: str) -> int:
        """Number of tokens of a unit."""
        total, whole = 0, self.whole
        for piece in self.split(unit):
            n = whole.get(piece)
            if n is None:
                n = self.piece(self._mapped(piece))[-1]
                whole.put(piece, n)
            total += n
        return total

    def prefixes(self, unit: str) -> np.ndarray:
        """Counts at every byte prefix of a text without special strings."""
        out, before = [0], 0
        for piece in self.split(unit):
            if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):  # cut short, these are two pieces
                inner = [1, 2, self.size(piece)]
            else:
                inner = self.piece(self._mapped(piece))[1:]
            out += [before + n for n in inner]
            before += self.size(piece)
        for run in self.spaces(unit):  # white space that ends a prefix is one piece, whatever follows in the text
            a = len(unit[: run.start()].encode())
            inner = self.piece(self._mapped(run.group()))[1:]
            out[a + 1 : a + 1 + len(inner)] = [out[a] + n for n in inner]
        return np.array(out, np.int64)

    def _mapped(self, s: str) -> str:
        return s.encode().decode("latin-1").translate(self.table)

    def of_text(self, text: str) -> np.ndarray:
        """Counts at every byte prefix of any text; special strings count as one token once whole."""
        out, base = [np.zeros(1, np.int64)], 0
        while True:
            found = [(i, s) for s in self.special if (i := text.find(s)) >= 0]
            if not found:
                out.append(base + self.prefixes(text)[1:])
                return np.concatenate(out)
            i, s = min(found)
            out.append(base + self.prefixes(text[:i] + s[:-1])[1:])
            base += self.size(text[:i]) + 1
            out.append(np.array([base]))
            text = text[i + len(s) :]


def unit_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions where a unit begins: each text's first byte, and cuts between certain non-spaces."""
    n = len(data)
    sure = (data > 0x20) & (data != 0x7F)  # byte of a character that is no white space for certain
    for lead, follow in ((0xC2, 1), (0xE1, 2), (0xE2, 2), (0xE3, 2)):  # white space beyond ASCII begins so
        at = np.flatnonzero(data == lead)
        for k in range(follow + 1):
            sure[np.minimum(at + k, n - 1)] = False
    cut = np.zeros(n, bool)
    alone = (data[1:-1] == 0x20) | (data[1:-1] == 0x0A)
    alone &= sure[:-2] & sure[2:]
    at = np.flatnonzero(alone) + 1
    cut[at] = True
    cut[at[data[at] == 0x0A] + 1] = True
    cut[off[:-1][off[:-1] < n]] = True
    return np.flatnonzero(cut)


def _counted(path: str, limit: int):
    def run(batches):
        counts = PrefixCounts(path)
        known = Memory(REMEMBERED)
        special = [s.encode() for s in counts.special]
        for batch, data, off in blocks(batches, limit=STEP_BYTES):
            start = unit_starts(data, off)
            end = np.append(start[1:], len(data))
            h, first, back = np.unique(SpanHash(data)(start, end), return_index=True, return_inverse=True)
            sizes = [known.get(x) for x in h.tolist()]
            raw = data.tobytes()
            new = sorted((raw[start[first[i]] : end[first[i]]], i) for i, s in enumerate(sizes) if s is None)
            for unit, i in new:
                sizes[i] = counts.size(unit.decode())
                known.put(int(h[i]), sizes[i])
            each = np.array(sizes, np.int64)[back] if len(start) else np.zeros(0, np.int64)
            total = np.zeros(len(start) + 1, np.int64)
            np.cumsum(each, out=total[1:])
            first_unit = np.searchsorted(start, off[:-1])
            next_text = np.searchsorted(start, off[1:])
            n_tokens = total[next_text] - total[first_unit]
            n_bytes = np.diff(off)
            fits = n_bytes.copy()
            for i in np.flatnonzero(n_tokens > limit):
                u = int(np.searchsorted(total, total[first_unit[i]] + limit, side="right")) - 1  # the unit that goes over
                unit = raw[start[u] : end[u]]
                table = counts.prefixes(unit.decode()) + total[u] - total[first_unit[i]]
                fits[i] = start[u] - off[i] + _last_fit(unit, table, limit)
            if any(s in raw for s in special):
                for i in range(batch.num_rows):
                    text = raw[off[i] : off[i + 1]]
                    if any(s in text for s in special):
                        table = counts.of_text(text.decode())
                        n_tokens[i], fits[i] = table[-1], _last_fit(text, table, limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), *map(pa.array, (n_bytes, n_tokens, n_tokens > limit, fits))],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_bytes"],
            )

    return run


def _last_fit(text: bytes, table: np.ndarray, limit: int) -> int:
    """Bytes of the longest prefix of whole characters with at most `limit` tokens."""
    border = np.append((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, True)
    return int(np.flatnonzero(border & (table <= limit))[-1])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_bytes (longest prefix within the limit)."""
    src = docs.select("doc_id", "text")
    schema = T.StructType([
        src.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()), T.StructField("limit_bytes", T.LongType()),
    ])
    return src.mapInArrow(_counted(vocabulary, limit), schema)


def prefix_tables(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and `counts`: the exact number of tokens of every byte prefix, 0 to the whole text.

    `counts[n]` is the cost of the first n bytes; the largest n with `counts[n] <= budget`
    answers a budget.
    """
    src = docs.select("doc_id", "text")
    schema = T.StructType([src.schema["doc_id"], T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches):
        counts = PrefixCounts(vocabulary)
        for batch, data, off in blocks(batches, limit=1 << 18):
            raw = data.tobytes()
            tables = [counts.of_text(raw[a:b].decode()).astype(np.int32) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tables, pa.list_(pa.int32()))], names=["doc_id", "counts"]
            )

    return src.mapInArrow(run, schema)
