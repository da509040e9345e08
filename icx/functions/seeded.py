"""Seeded, partition-independent randomness.

Every random choice is a pure function of (seed, tag, keys...):

    h(tag, keys...)   = md5(concat_ws('|', seed, tag, keys...))
    u60(tag, keys...) = first 15 hex digits of h as an integer in [0, 2^60)

60 bits reach every row of any table and leave a modulo bias below |pool| / 2^60.

Per-position draws inside a text (thousands per row) use one md5 per (row, tag) and
a polynomial of the position over the prime P = 2^31 - 1 (Horner form, so the
position is referenced once per degree and nothing is re-evaluated per element):

    (a, b, c) = three 32-bit slices of md5(seed|tag|keys) mod P
    pos_hash(pos) = ((a * pos + b) mod P * pos + c) mod P      -- 3-wise independent

Every intermediate product stays below 2^63. The same formulas are plain SQL in other engines, so each random operator has an exact
oracle, results do not depend on partitioning, and task retries recompute the same
values. `rand()`-style generators are never used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from icx.functions.arrays import let

# Rank keys combine the 31-bit position hash with the position so that ties are impossible:
# pos_hash * 2^31 + pos < 2^62 for every pos < 2^31.
POS_RADIX = 2147483648


def _key(k) -> Column:
    if isinstance(k, Column):
        return k.cast("string")
    return F.lit(str(k))


def h(seed: int | Column, tag: str, *keys) -> Column:
    return F.md5(F.concat_ws("|", _key(seed), F.lit(tag), *[_key(k) for k in keys]))


def u60(seed: int, tag: str, *keys) -> Column:
    return F.conv(F.substring(h(seed, tag, *keys), 1, 15), 16, 10).cast("bigint")


PRIME = 2147483647


def _slice_u32(hexcol: Column, start: int) -> Column:
    return F.conv(F.substring(hexcol, start, 8), 16, 10).cast("bigint") % F.lit(PRIME)


def row_seeds(seed: int, tags: list[str], keys: list) -> Column:
    """Per tag, the polynomial coefficients (a, b, c) for the row (bind once with `let`)."""
    def coeffs(t):
        hx = h(seed, t, *keys)
        return F.struct(_slice_u32(hx, 1).alias("a"), _slice_u32(hx, 9).alias("b"), _slice_u32(hx, 17).alias("c"))

    return F.struct(*[coeffs(t).alias(t) for t in tags])


def pos_hash(s: Column, pos: Column) -> Column:
    """Position hash in [0, P) from a row's coefficients."""
    p = pos.cast("bigint")
    return ((s["a"] * p + s["b"]) % F.lit(PRIME) * p + s["c"]) % F.lit(PRIME)


def pos_rank(s: Column, pos: Column) -> Column:
    """Unique per-position random key: pos_hash * 2^31 + pos."""
    return pos_hash(s, pos) * F.lit(POS_RADIX) + pos.cast("bigint")


def key_pos(rk: Column) -> Column:
    """Position encoded in a rank key."""
    return (rk % F.lit(POS_RADIX)).cast("int")


def kmax(n: Column, rate: float | Column, at_least_one: bool = True) -> Column:
    """Python's `max(1, int(n * rate))` (or `int(n * rate)`) with double arithmetic."""
    share = rate if isinstance(rate, Column) else F.lit(float(rate))
    k = F.floor(n.cast("double") * share.cast("double")).cast("int")
    return F.greatest(F.lit(1), k) if at_least_one else k


def floyd_draw(seed: int | Column, tag: str, row_key: Column, d: int | Column, k: int | Column) -> Column:
    """k distinct indexes from [0, d), uniform, as an array (Floyd's algorithm).

    Step j = d-k .. d-1 draws t = u60(row, j) mod (j+1) and adds t, or j when t is
    already present. k steps per row, no rejection loop, no cross join.
    """
    if isinstance(k, Column) or isinstance(d, Column):
        k, d = (x if isinstance(x, Column) else F.lit(x) for x in (k, d))
        d = d.cast("bigint")
        too_few = F.raise_error(F.concat(F.lit("cannot draw from a pool of "), d.cast("string"), F.lit(" demonstrations: "), k.cast("string")))
        steps = F.when(k > d, too_few.cast("array<bigint>")).when(k > 0, F.sequence(d - k, d - 1))
        steps = F.coalesce(steps, F.array().cast("array<bigint>"))
    elif k <= 0:
        return F.array().cast("array<bigint>")
    elif k > d:
        raise ValueError(f"cannot draw {k} demonstrations from a pool of {d}")
    else:
        steps = F.sequence(F.lit(d - k).cast("bigint"), F.lit(d - 1).cast("bigint"))

    def step(acc, j):
        return let(
            u60(seed, tag, row_key, j) % (j + 1),
            lambda t: F.when(F.array_contains(acc, t), F.concat(acc, F.array(j))).otherwise(
                F.concat(acc, F.array(t))
            ),
        )

    return F.aggregate(steps, F.array().cast("array<bigint>"), step)


def shuffled(seed: int, tag: str, row_key: Column, values: Column) -> Column:
    """Values of a bigint array in hash order (random but reproducible order)."""
    keyed = F.transform(values, lambda v: F.struct(u60(seed, tag, row_key, v).alias("h"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])
