"""Token counts and token files against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from icx.llm import tokcount, tokenbin

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "", " ", "\n", "  a", "a  b", "a \n b\n\n\nc ", "x're we'll 'rest !'re I'm it's 'S", "don't<|endoftext|>  go<|endoftext|>",
    "<|startoftext|>A<|endoftext|>B", "a\u00a0b \u3000 c", "é\u0301 e\u0301 Éé Σίσυφος ΣΑΣ İx ǅ", "1234 5,6.7 a1b2", "日本語 テキスト 한국어 🙂🙂 \u200d",
    "tab\tand\x0bvt\x1cfs\x85nel", "=" * 300, "a" * 500, "\u2028line\u2029 sep", "the of and " * 700, "\r\n \r\n x", "!!! ??? ---- ____",
]


def documents(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(100, None, None, None, None), (101, ODD[6], "en", "s", 0), (101, ODD[6], "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int")


def test_counts_equal_the_library(spark):
    tok = Tokenizer.from_file(BYTE)
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for docs in (documents(spark), small):
        want = sorted((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
        got = tokcount.token_counts(docs, BYTE).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
        assert all(r.limit_bytes == r.n_bytes for r in got if not r.over_limit)


def test_every_prefix_equals_the_library(spark):
    tok = Tokenizer.from_file(BYTE)
    counts = tokcount.PrefixCounts(BYTE)
    rng = random.Random(3)
    texts = [t for t in ODD if len(t) < 400]
    texts += ["".join(rng.choice("ab' tr\nlveé!1 ") for _ in range(60)) for _ in range(40)]
    for t in texts:
        table = counts.of_text(t)
        assert len(table) == len(t.encode()) + 1
        for i in range(len(t) + 1):
            assert table[len(t[:i].encode())] == len(tok.encode(t[:i], add_special_tokens=False).ids), (t, i)


def test_limit_is_the_longest_prefix_that_fits(spark):
    tok = Tokenizer.from_file(BYTE)
    size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    docs = documents(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in tokcount.token_counts(docs, BYTE, limit=5).collect():
        t = texts[r.doc_id]
        best = max(i for i in range(len(t) + 1) if size(t[:i]) <= 5)
        assert len(t[:best].encode()) == r.limit_bytes


def test_stored_tables(spark):
    rows = {r.doc_id: r.counts for r in tokcount.prefix_tables(documents(spark), BYTE).collect()}
    tok = Tokenizer.from_file(BYTE)
    assert rows[100] == [0]
    assert rows[6][-1] == len(tok.encode(ODD[6], add_special_tokens=False).ids)


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 300_000, 7))])
def test_codes_round_trip_and_random_access(ids):
    ids = np.array(ids, np.uint32)
    codes = tokenbin.Codes(tokenbin.packed(ids))
    assert codes.all().tolist() == ids.tolist()
    places = range(len(ids)) if len(ids) < 10 else [0, 511, 512, 513, 1023, 1024, 9999, len(ids) - 1]
    assert [codes[i] for i in places] == [int(ids[i]) for i in places]


def test_files_equal_the_library(spark):
    tok = Tokenizer.from_file(WORDS)
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for docs in (documents(spark), small, small.limit(0)):
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
        want, start = [], 0
        for r in rows:
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
            want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = sorted(map(tuple, tokenbin.token_files(docs, WORDS).collect()))
        assert got == sorted(want)


def test_pieces_equal_the_library_on_odd_words():
    tok = Tokenizer.from_file(WORDS)
    rng = random.Random(4)
    letters = "aZé×÷ÀßÿñŁİıſ'’<|>19²½_-.,#*日и\x01\x7f\x1c ́"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(4000)] + ["it's", "<|endoftext|>x", "A<|startoftext|>", "O'Ré'LL"]
    texts = [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)] + [""]
    pieces = tokenbin.Pieces(WORDS)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    for _ in range(2):  # learned, then remembered
        place, doc = pieces.ids(data, off)
        ids = tokenbin.gathered(pieces.begin[place], pieces.size[place], pieces.flat).tolist()
        n = np.bincount(doc, weights=pieces.size[place], minlength=len(texts)).astype(int)
        for t, stop, size in zip(texts, np.cumsum(n), n):
            assert ids[stop - size : stop] == tok.encode(t, add_special_tokens=False).ids, t
