"""Nulls in any column, empty and long texts, repeated rows, empty tables, clashing column names."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from icx.llm import decontaminate, mix, pii, quality, shard, simjoin, suffixdedup, tokcount, tokenbin, urlfilter

NAMES = "n s1 s2 slice counts token g row block role shard slot key copies size taken found spans dk places part kind words seed item item_id best rid bucket p s".split()
LONG = "the long text goes on and on " * 20_000
ROWS = [
    (1, "a clean text of some words " * 5, "en", "x"), (1, "a clean text of some words " * 5, "en", "x"), (1, "another text under the same id " * 4, "en", "x"),
    (2, None, None, None), (None, "a text without any id but words " * 4, None, "y"), (None, None, "de", None), (3, "", "", ""), (4, " \n\t ", "fr", None),
    (5, LONG, "en", "y"), (6, "word", "en", "x"), (7, "x@y.co \u0000 \U0001f642", "en", "z"),
]


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


def benchmark(spark):
    return spark.createDataFrame([(1, "another text under the same id another text"), (None, None), (2, "")], "item_id long, text string").withColumn("row", F.lit(1))


BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PER_ROW = {
    "decontaminate": lambda s, d: decontaminate.judged(d, benchmark(s)),
    "quality": lambda s, d: quality.judged(d),
    "shard": lambda s, d: shard.sharded(d),
    "pii": lambda s, d: pii.replaced(d),
    "tokens": lambda s, d: tokenbin.token_files(d, WORDS),
    "mix": lambda s, d: mix.mixed_copies(d),
    "simjoin": lambda s, d: simjoin.joined(d),
    "counts": lambda s, d: tokcount.token_counts(d, BYTE),
    "suffix": lambda s, d: suffixdedup.deduplicated(d),
}
STAGES = {
    "quality": lambda s, d: quality.filtered(d),
    "simjoin": lambda s, d: simjoin.one_of_each(d),
    "decontaminate": lambda s, d: decontaminate.cleaned(d, benchmark(s)),
    "mix": lambda s, d: mix.mixture(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_document(spark, name):
    ids = Counter(r.doc_id for r in PER_ROW[name](spark, table(spark)).select("doc_id").collect())
    assert ids == Counter(r[0] for r in ROWS)
    assert PER_ROW[name](spark, table(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_all_columns(spark, name):
    docs = table(spark)
    out = STAGES[name](spark, docs)
    assert out.columns == docs.columns
    rows = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in out.collect()} <= rows
    assert STAGES[name](spark, docs.limit(0)).count() == 0


def test_mix_keeps_whole_copies_and_totals(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), "en", f"s{i % 4}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix.mixed_copies(df).collect()
    again = mix.mixed_copies(df.repartition(13)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    for source in range(4):
        mine = [r for r in got if r.doc_id % 4 == source]
        assert len({r.target for r in mine}) == 1 and abs(sum(r.taken for r in mine) - mine[0].target) <= 40
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in mine)
    assert abs(sum({r.doc_id % 4: r.target for r in got}.values()) - sum(r["size"] for r in got)) < 1e-6


def test_mix_of_a_document_repeated_often(spark):
    rows = [(None, "w " * 9, "en", "a")] * 20000 + [(i, "w " * (1 + i % 5), "en", "b") for i in range(300)] + [(7, "w w", "en", "b")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix.mixed_copies(df).collect()
    assert len(got) == len(rows)
    hot = [r for r in got if r.doc_id is None]
    share = hot[0].target / hot[0].source_size
    assert {r.copies for r in hot} <= {int(share), int(share) + 1}
    assert abs(sum(r.taken for r in hot) - hot[0].target) < 9
    other = [r for r in got if r.doc_id is not None]
    assert abs(sum(r.taken for r in other) - other[0].target) < 5
    again = mix.mixed_copies(df.repartition(11)).collect()
    assert Counter((r.doc_id, r["size"], r.copies) for r in got) == Counter((r.doc_id, r["size"], r.copies) for r in again)


def test_mix_targets_stop_at_three_times_the_source(spark):
    rows = [(0, "w " * 1000, "en", "a"), (1, "w " * 10, "en", "b"), (2, "w " * 10, "en", "c"), (3, "w " * 500, "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.source_size: r.target for r in mix.mixed_copies(df).collect()}
    # weights 1, 2, 3, 1; b and c stop at 30, the other 1460 go to a and null alike
    assert got[10] == 30 and got[1000] == got[500] == 730


def test_pivotal_keeps_expected_words():
    import random

    rng = random.Random(2)
    taken = Counter()
    p, size = [0.2, 0.7, 0.5, 0.9, 0.35], [10, 3, 25, 8, 14]
    for _ in range(4000):
        out = mix.pivotal(p, size, [rng.getrandbits(60) for _ in p], 0)
        fractional = [x for x in out if 0 < x < 1]
        assert len(fractional) <= 1 and abs(sum(x * s for x, s in zip(out, size)) - sum(x * s for x, s in zip(p, size))) < 1e-6
        for i, x in enumerate(out):
            taken[i] += x
    assert all(abs(taken[i] / 4000 - p[i]) < 0.05 for i in range(5))


def test_shards_of_hot_groups(spark):
    rows = [(i, "the same text for a third of all rows", "en", "x") for i in range(900)] + [(1000 + i, f"text {i} " * (1 + i % 9), "en", "x") for i in range(1800)]
    got = shard.sharded(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    size, slots = Counter(), {}
    for r in got:
        size[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(size.values()) / 24
    assert len(size) == 24 and all(abs(s - mean) <= 0.05 * mean + 100 for s in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    same = spark.createDataFrame([(7, "t", "en", "x")] * 500, "doc_id long, text string, lang string, source string")
    assert Counter(r.shard for r in shard.sharded(same).collect()).most_common(1)[0][1] <= 23


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://NET", "http://a.net/x", "http://example.net/en/", "http://example.net/en", "https://www.Example.COM/de/a?x#y",
            "https://example.com/de", "http://x.org/fr/", "http://x.org?/fr/", "http://net#/", "ftp://..net//", "http://a.net:80/", "x://a.b.c.net/en/é", "http://a.net/\n/"]
    pages = spark.createDataFrame([(i, u, 1, "r") for i, u in enumerate(urls * 2)], "page_id long, url string, host int, rule string")
    got = urlfilter.verdicts(pages, urlfilter.rule_table(spark)).collect()
    assert len(got) == len(pages.collect())
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    for r in got:
        u = urls[r.page_id % len(urls)] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
        fits = [x for x in rules if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[1] + best[2], best[0] if best else "allow"), u
    assert urlfilter.verdicts(pages.limit(0), urlfilter.rule_table(spark)).count() == 0


def test_long_urls_and_rules_of_one_expression(spark):
    """A URL of 200,000 labels or steps has as few expressions as the rules ask for."""
    labels, steps = "http://" + "a." * 200_000 + "net/x", "http://a.org/fr/" + "b/" * 200_000
    long = ["http://" + "c" * 300_000 + ".net/", labels, steps, "http://a.org/" + "f" * 300_000]
    pages = spark.createDataFrame(list(enumerate(long)), "page_id long, url string")
    rules = urlfilter.rule_table(spark)
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.verdicts(pages, rules).collect()}
    assert got == {0: ("net/", "block"), 1: ("net/", "block"), 2: ("org/fr/", "allow"), 3: (None, "allow")}
    both = urlfilter.rule_table(spark, (("allow", "net/"), ("block", "net/"), ("block", "org/fr/b/b/")))
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.verdicts(pages, both).collect()}
    assert got == {0: ("net/", "block"), 1: ("net/", "block"), 2: ("org/fr/b/b/", "block"), 3: (None, "allow")}
    assert {r.verdict for r in urlfilter.verdicts(pages, rules.limit(0)).collect()} == {"allow"}
