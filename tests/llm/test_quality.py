"""Fences of the quality rules: they reject by themselves, and follow what is normal in a group."""

import random

from icx.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def clean(rng, lines=60):
    return "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(8)) + "." for _ in range(lines))


def repeated_lines(rng, again):
    """60 lines, a short one `again` times more between the others."""
    lines = clean(rng, 60 - again).split("\n")
    return "\n".join(x for i, line in enumerate(lines) for x in ([line, "refrain"] if i <= again else [line]))


def repeated_words(rng, share):
    words = clean(rng).split()
    n = int(len(words) * share / 2)
    return " ".join(words[:-n] + words[:n])


def judged(spark, rows):
    return {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_a_fence_alone_rejects_repetition(spark):
    rng = random.Random(4)
    rows = [(i, clean(rng), "en", "x") for i in range(300)]
    rows += [(1000, repeated_words(rng, 0.285), "en", "x"), (1001, repeated_lines(rng, 29), "en", "x")]
    got = judged(spark, rows)
    assert all(got[i].kept for i in range(300))
    assert 200 < got[1000].repeats <= 300 and not got[1000].base_failed and not got[1000].kept
    assert got[1001].n_dup_lines == 29 and not got[1001].base_failed and not got[1001].kept


def test_what_is_normal_in_a_source_is_kept_there(spark):
    rng = random.Random(5)
    two = lambda: repeated_lines(rng, 29)
    rows = [(i, clean(rng), "en", "prose") for i in range(400)] + [(1000 + i, two(), "en", "songs") for i in range(400)] + [(5000, two(), "en", "prose")]
    got = judged(spark, rows)
    assert got[1000].dup_lines > 300 and all(got[1000 + i].kept for i in range(400))
    assert not got[5000].base_failed and not got[5000].kept


def test_one_rule_at_every_size(spark):
    """A group's own documents count from the first one on, with no step at any size."""
    rng = random.Random(6)
    rows = [(i, clean(rng), "en", "prose") for i in range(300)]
    odd = lambda: clean(rng).replace(" ", " # ")
    kept = {}
    for n in (1, 10, 25, 49, 50, 51, 100, 400):
        got = judged(spark, rows + [(1000 + i, odd(), "en", "marked") for i in range(n)])
        kept[n] = sum(got[1000 + i].kept for i in range(n)) / n
    assert kept[1] == 0 and kept[400] == 1
    assert list(kept.values()) == sorted(kept.values()) and kept[49] == kept[50] == kept[51]
