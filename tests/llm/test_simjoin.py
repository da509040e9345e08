"""The similarity join against brute force over all pairs."""

import random
import re

from icx.llm import simjoin


def brute(rows):
    """component of each row by comparing all pairs of distinct sets."""
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    classes = {}
    for i, s in enumerate(sets):
        classes.setdefault(s or i, []).append(i)
    keys = [k for k in classes if not isinstance(k, int)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in keys:
        for i in classes[k]:
            parent[find(i)] = find(classes[k][0])
    for x in range(len(keys)):
        for y in range(x):
            a, b = keys[x], keys[y]
            if 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)) and 100 * len(a & b) >= 90 * len(a | b):
                parent[find(classes[a][0])] = find(classes[b][0])
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def families(seed, n_families, members, words):
    rng = random.Random(seed)
    rows = []
    vocabulary = [f"w{i}" for i in range(400)]
    line = [rng.choice(vocabulary) for _ in range(12)]
    for _ in range(n_families):
        base = [rng.choice(vocabulary) for _ in range(words)] + line
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def result(spark, rows, monkeypatch=None):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, s1 string, n int")
    return sorted(map(tuple, simjoin.joined(df).collect()))


def test_families(spark):
    rows = families(1, 12, 20, 60) + [(0, None), (1, ""), (2, "  \n"), (3, "Two words"), (4, "two WORDS"), (5, "one"), (6, "ONE"), (7, "a b c"), (8, "x " * 50_000)]
    rows += [(900 + i, rows[0][1]) for i in range(30)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "BLOCK", 8)
    rows = families(2, 3, 60, 40)
    assert result(spark, rows) == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, simjoin.joined(docs).collect()))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got)
    kept = simjoin.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, _, c in got})


def plain_components(rows, shingle, percent):
    """component of each row, all pairs compared, at any shingle length and threshold."""
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, 1))} if w else set())
    root = list(range(len(rows)))
    for x, a in enumerate(sets):
        for y, b in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = root[x], root[y]
                root = [q if r == p else r for r in root]
    return sorted((d, len(sets[i]), min(e for j, (e, _) in enumerate(rows) if root[j] == root[i])) for i, (d, _) in enumerate(rows))


def test_other_shingles_and_thresholds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cases = [families(3, 8, 12, 60) + [(0, None), (1, ""), (2, "four words are short"), (3, "Four WORDS are short"), (4, "w1 w2")], [(r.doc_id, r.text) for r in docs.collect()]]
    for rows in cases:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want = plain_components(rows, 5, 80)
        assert sorted(map(tuple, simjoin.joined(df, 5, 80).collect())) == want
        assert {c for _, _, c in want} != {c for _, _, c in plain_components(rows, 3, 90)}
        assert sorted(r.doc_id for r in simjoin.one_of_each(df, 5, 80).collect()) == sorted({c for _, _, c in want})
