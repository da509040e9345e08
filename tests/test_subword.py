"""Merge-rank segmentation against the public library, on odd strings and whole tables."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from conftest import SF_SMALL
from icx.functions import subword as SW
from icx.operators import metrics as M
from icx.plans import catalog
from icx.sources import tables

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("own", pat_str=SW.PIECES, mergeable_ranks=ranks, special_tokens={})


def tokens_of(encoding, text):
    return [encoding.decode_single_token_bytes(t).decode("latin-1") for t in encoding.encode_ordinary(text)]


def test_merges_equal_the_library(library):
    ranks, encoding = library
    rng = random.Random(3)
    alphabet = "abcdeeeettts  \n\t'sé世界\U0001f642.,-0123 Ж"
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        assert [t for p in __import__("regex").findall(SW.PIECES, text) for t in SW.merged(p.encode(), ranks)] == [encoding.decode_single_token_bytes(t) for t in encoding.encode_ordinary(text)]
    long = "abcde" * 20_000
    assert b"".join(SW.merged(long.encode(), ranks)) == long.encode()


def test_whole_table_and_nulls(spark, library):
    ranks = SW.read_ranks(spark, PATH)
    rows = tables.pairs(spark, SF_SMALL).select("src", "tgt").unionByName(spark.createDataFrame([(None, ""), (" \n", None)], "src string, tgt string"))
    for r in SW.with_tokens(rows, ranks, ("src", "tgt")).collect():
        for text, got in ((r.src, r.src_tokens), (r.tgt, r.tgt_tokens)):
            assert got == (None if text is None else tokens_of(library[1], text))


def test_score_is_bleu_of_the_library_tokens(spark, library):
    pairs = tables.pairs(spark, SF_SMALL).collect()
    rows = [("source_copy", tokens_of(library[1], r.src or ""), tokens_of(library[1], r.tgt or ""), "", "") for r in pairs]
    df = spark.createDataFrame(rows, "run_id string, h array<string>, r array<string>, hypothesis string, reference string")
    want = M.score(df, ["run_id"], metrics=("bleu",), tokens=("h", "r")).collect()
    assert catalog.QUERIES["bleu_subword"](spark, SF_SMALL).collect() == want


def test_a_vocabulary_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(SW, "MOST", 2)
    with pytest.raises(ValueError):
        SW.with_tokens(spark.createDataFrame([("a",)], "t string"), SW.read_ranks(spark, PATH), ("t",))
    assert SW.read_ranks(spark, PATH).agg(F.countDistinct("token"), F.count("*")).first()[0] > 50_000
