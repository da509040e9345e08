"""Script-aware noise operators (PTB-1..7) as one-pass, row-local column expressions.

Every random choice is fixed up front by seeded hashes of (row keys, position), so an
operator is a pure function of the row: no shuffle, no state, identical under any
partitioning or retry. Per-row cost is O(n log n) in the number of words or characters.
`perturb` and `perturb_each` run the rules vectorised in Arrow tasks (`functions/noise.py`);
the functions named after the operators are the same rules as column expressions, which also
go inside lambdas. Tests hold the two forms against each other.

Shared rules
  words    = Python `str.split()` (Unicode white space)
  k        = max(1, int(n * rate)) with double arithmetic
  sampling = the k positions with the smallest rank keys hash(keys, pos)*2^31 + pos

Operators (`text` and `keys` are columns, `language` a lang_Script string or column):
  word_duplication  k sampled words are written twice in place (n+k words)
  word_order        k sampled positions are permuted among themselves; an identity
                    permutation becomes the sorted, then the reversed order
  punctuation_drop  k of the m punctuation characters of the language's class are
                    removed; no other change (white space kept as is)
  punctuation_add   k of the c punctuation-free words are sampled; every occurrence
                    of a sampled word gets a mark drawn from the script's marks
  ocr               k sampled words are fused with the next word (50%) or split at a
                    random inner point (50%; the last word is always split; one-
                    character words are left alone); non-space characters never change
  span_noise        budget B = int(m * rate) over the m eligible characters (inside the
                    script range, not punctuation). Starts are taken in hash order, each
                    with length 1..3, until their lengths sum to B (the last is trimmed).
                    Each start is deleted or replaced by one random character of the
                    script pool; the rest of its span is deleted.

Texts with nothing to act on (no words, no punctuation, no candidates, zero budget)
are returned unchanged.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from icx.functions import noise
from icx.functions import scripts as S
from icx.functions.arrays import at, let
from icx.functions.seeded import key_pos, kmax, pos_hash, pos_rank, row_seeds
from icx.functions.text import chars, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

ATTACKS = (
    "span_noise",
    "word_duplication",
    "punctuation_drop_attack",
    "punctuation_add_attack",
    "ocr",
    "word_order",
)
# Default rates of the file job, per attack.
DEFAULT_RATES = {
    "span_noise": 0.1,
    "word_duplication": 0.2,
    "punctuation_drop_attack": 1.0,
    "punctuation_add_attack": 1.0,
    "ocr": 0.2,
    "word_order": 0.2,
}
# The parameter name that each attack takes its single rate under.
RATE_PARAM = {
    "span_noise": "noise_percentage",
    "word_duplication": "repetition_percentage",
    "punctuation_drop_attack": "punctuation_percentage",
    "punctuation_add_attack": "punctuation_percentage",
    "ocr": "ocr_percentage",
    "word_order": "permutation_percentage",
}


def _check_rate(rate: float | Column) -> float | Column:
    if isinstance(rate, Column):
        return rate
    rate = float(rate)
    if not 0.0 <= rate <= 1.0:
        raise ValueError(f"rate must be within [0, 1], got {rate}")
    return rate


def _kth(ranks: Column, k: Column) -> Column:
    """k-th smallest of the non-null rank keys (k >= 1)."""
    return F.element_at(F.sort_array(F.filter(ranks, lambda r: r.isNotNull())), k)


def _is_punct_word(w: Column, pclass: Column) -> Column:
    return (
        F.when(pclass == S.LATIN, w.rlike(S.class_regex(S.LATIN)))
        .when(pclass == S.INDIC, w.rlike(S.class_regex(S.INDIC)))
        .otherwise(w.rlike(S.class_regex(S.ARABIC)))
    )


def _cp(c: Column) -> Column:
    return F.ascii(c)  # code point of the (single) character


# --- PTB-1 -----------------------------------------------------------------------

def word_duplication(text: Column, keys: list[Column], rate: float, seed: int) -> Column:
    RS = None
    rate = _check_rate(rate)

    def with_words(W):
        n = F.size(W)
        ranks = F.transform(W, lambda w, i: pos_rank(RS["dup"], i))
        return let(ranks, lambda R: let(_kth(R, kmax(n, rate)), lambda th: F.array_join(
            F.flatten(F.transform(W, lambda w, i: F.when(R[i] <= th, F.array(w, w)).otherwise(F.array(w)))), " "
        )))

    def _bound(rs):
        nonlocal RS
        RS = rs
        return let(words(text), lambda W: F.when(F.size(W) == 0, text).otherwise(with_words(W)))

    return let(row_seeds(seed, ['dup'], keys), _bound)


# --- PTB-6 -----------------------------------------------------------------------

def word_order(text: Column, keys: list[Column], rate: float, seed: int) -> Column:
    RS = None
    rate = _check_rate(rate)

    def with_words(W):
        n = F.size(W)
        ranks = F.transform(W, lambda w, i: pos_rank(RS["order_slot"], i))

        def with_th(R, th):
            slots = F.transform(F.sort_array(F.filter(R, lambda r: r <= th)), key_pos)

            def with_slots(Sl):
                src = F.transform(
                    F.sort_array(F.transform(Sl, lambda p: pos_rank(RS["order_src"], p))), key_pos
                )

                def repaired(P):
                    srt = F.sort_array(Sl)
                    return F.when(P != Sl, P).when(srt != Sl, srt).otherwise(F.reverse(srt))

                def assemble(P):
                    moved = F.arrays_zip(Sl.alias("t"), P.alias("s"))
                    moved = F.transform(moved, lambda e: F.struct(e["t"].alias("t"), e["s"].alias("s")))
                    idx = F.transform(W, lambda w, i: i)
                    kept = F.transform(F.filter(idx, lambda i: R[i] > th), lambda i: F.struct(i.alias("t"), i.alias("s")))
                    order = F.sort_array(F.concat(moved, kept))
                    return F.array_join(F.transform(order, lambda e: W[e["s"]]), " ")

                return let(repaired(src), assemble)

            return let(slots, with_slots)

        return let(ranks, lambda R: let(_kth(R, kmax(n, rate)), lambda th: with_th(R, th)))

    def _bound(rs):
        nonlocal RS
        RS = rs
        return let(words(text), lambda W: F.when(F.size(W) == 0, text).otherwise(with_words(W)))

    return let(row_seeds(seed, ['order_slot', 'order_src'], keys), _bound)


# --- PTB-3 -----------------------------------------------------------------------

def punctuation_drop(text: Column, keys: list[Column], language, rate: float, seed: int) -> Column:
    rate = _check_rate(rate)
    if isinstance(language, Column):
        return let(S.pclass_col(language), lambda pc: _punctuation_drop(text, keys, pc, rate, seed))
    return _punctuation_drop(text, keys, F.lit(S.punct_class_of(language)), rate, seed)


def _punctuation_drop(text, keys, pc, rate, seed):
    RS = None
    def with_chars(C):
        ranks = F.transform(C, lambda c, i: F.when(S.is_punct(_cp(c), pc), pos_rank(RS["pdrop"], i)))

        def with_ranks(R):
            m = F.size(F.filter(R, lambda r: r.isNotNull()))
            return F.when(m == 0, text).otherwise(
                let(_kth(R, kmax(m, rate)), lambda th: F.array_join(
                    F.transform(C, lambda c, i: F.when(F.coalesce(R[i] <= th, F.lit(False)), F.lit("")).otherwise(c)),
                    "",
                ))
            )

        return let(ranks, with_ranks)

    def _bound(rs):
        nonlocal RS
        RS = rs
        return let(chars(text), with_chars)

    return let(row_seeds(seed, ['pdrop'], keys), _bound)


# --- PTB-4 -----------------------------------------------------------------------

def _value_flags(W: Column, sel) -> Column:
    """Per position: does any selected position hold the same word? (array group-by)

    Sort (word, unselected, pos); group starts are where the word changes; a group is
    marked when its first entry is selected; each group's flag is spread over its slice
    and the result re-sorted by position. O(n log n), no per-element search.
    """
    entries = F.transform(W, lambda w, i: F.struct(w.alias("w"), (~sel(i)).alias("ns"), i.alias("pos")))

    def with_sorted(A):
        n = F.size(A)
        starts = F.filter(
            F.transform(A, lambda e, x: F.when((x == 0) | (e["w"] != at(A, x - 1)["w"]), x).otherwise(-1)),
            lambda x: x >= 0,
        )

        def spread(G):
            per_group = F.transform(
                G,
                lambda st, g: let(
                    F.coalesce(at(G, g + 1), n),
                    lambda end: F.transform(
                        F.slice(A, st + 1, end - st),
                        lambda e: F.struct(e["pos"].alias("pos"), (~A[st]["ns"]).alias("m")),
                    ),
                ),
            )
            return F.transform(F.sort_array(F.flatten(per_group)), lambda e: e["m"])

        return let(starts, spread)

    return let(F.sort_array(entries), with_sorted)


def punctuation_add(text: Column, keys: list[Column], language, rate: float, seed: int) -> Column:
    rate = _check_rate(rate)
    if isinstance(language, Column):
        params = F.struct(S.pclass_col(language).alias("pc"), S.mark_pool_col(language).alias("marks"))
        return let(params, lambda P: _punctuation_add(text, keys, P["pc"], P["marks"], rate, seed))
    return _punctuation_add(text, keys, F.lit(S.punct_class_of(language)), S.mark_pool_col(language), rate, seed)


def _punctuation_add(text, keys, pc, marks, rate, seed):
    RS = None
    def with_words(W):
        ranks = F.transform(W, lambda w, i: F.when(~_is_punct_word(w, pc), pos_rank(RS["padd"], i)))

        def with_ranks(R):
            c = F.size(F.filter(R, lambda r: r.isNotNull()))

            def with_th(th):
                flags = _value_flags(W, lambda i: F.coalesce(R[i] <= th, F.lit(False)))
                return let(marks, lambda M: let(flags, lambda Fl: F.array_join(
                    F.transform(W, lambda w, i: F.when(
                        Fl[i],
                        F.concat(w, F.element_at(M, (pos_hash(RS["mark"], i) % F.size(M) + 1).cast("int"))),
                    ).otherwise(w)),
                    " ",
                )))

            return F.when(c == 0, text).otherwise(let(_kth(R, kmax(c, rate)), with_th))

        return let(ranks, with_ranks)

    def _bound(rs):
        nonlocal RS
        RS = rs
        return let(words(text), with_words)

    return let(row_seeds(seed, ['padd', 'mark'], keys), _bound)


# --- PTB-5 -----------------------------------------------------------------------

def ocr(text: Column, keys: list[Column], rate: float, seed: int) -> Column:
    RS = None
    rate = _check_rate(rate)

    def with_words(W):
        n = F.size(W)
        ranks = F.transform(W, lambda w, i: pos_rank(RS["ocr"], i))

        def with_th(R, th):
            def piece(w, i):
                ln = F.length(w)
                sel = R[i] <= th
                is_fuse = (i < n - 1) & (pos_hash(RS["ocr_op"], i) % 2 == 0)
                cut = let(pos_hash(RS["ocr_cut"], i) % (ln - 1) + 1, lambda c: F.concat(
                    w.substr(F.lit(1), c.cast("int")), F.lit(" "), w.substr((c + 1).cast("int"), ln)
                ))
                body = F.when(sel & ~is_fuse & (ln >= 2), cut).otherwise(w)
                sep = F.when((i == n - 1) | (sel & is_fuse), F.lit("")).otherwise(F.lit(" "))
                return F.concat(body, sep)

            return F.array_join(F.transform(W, piece), "")

        return let(ranks, lambda R: let(_kth(R, kmax(n, rate)), lambda th: with_th(R, th)))

    def _bound(rs):
        nonlocal RS
        RS = rs
        return let(words(text), lambda W: F.when(F.size(W) == 0, text).otherwise(with_words(W)))

    return let(row_seeds(seed, ['ocr', 'ocr_op', 'ocr_cut'], keys), _bound)


# --- PTB-2 -----------------------------------------------------------------------

def span_noise(text: Column, keys: list[Column], language, rate: float, seed: int) -> Column:
    rate = _check_rate(rate)
    if isinstance(language, Column):
        pc, lo, hi = S.pclass_col(language), S.range_lo(language), S.range_hi(language)
    else:
        pc = F.lit(S.punct_class_of(language))
        lo, hi = F.lit(S.SCRIPT_RANGES.get(S.script_of(language), (0, 0))[0]), F.lit(
            S.SCRIPT_RANGES.get(S.script_of(language), (0, 0))[1]
        )
    pool = S.span_pool_col(language)
    if isinstance(language, Column):
        params = F.struct(lo.alias("lo"), hi.alias("hi"), pc.alias("pc"), pool.alias("pool"))
        return let(params, lambda P: _span_noise(text, keys, P["lo"], P["hi"], P["pc"], P["pool"], rate, seed))
    return _span_noise(text, keys, lo, hi, pc, pool, rate, seed)


def _span_noise(text, keys, lo, hi, pc, pool, rate, seed):
    RS = None
    def span_len(q):
        return pos_hash(RS["span_len"], q) % 3 + 1

    def with_chars(C):
        def eligible(c):
            cp = _cp(c)
            return (cp >= lo) & (cp < hi) & ~S.is_punct(cp, pc)

        ranks = F.transform(C, lambda c, i: F.when(eligible(c), pos_rank(RS["span"], i)))

        def with_ranks(R):
            m = F.size(F.filter(R, lambda r: r.isNotNull()))
            budget = kmax(m, rate, at_least_one=False)

            def with_budget(B):
                return F.when(B == 0, text).otherwise(
                    let(F.slice(F.sort_array(F.filter(R, lambda r: r.isNotNull())), 1, B), lambda O: with_order(B, O))
                )

            def with_order(B, order):
                zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("c"), F.lit(0).alias("last"))
                plan = F.aggregate(
                    order,
                    zero,
                    lambda acc, r: F.when(
                        acc["s"] < B,
                        F.struct(
                            (acc["s"] + span_len(key_pos(r))).cast("int").alias("s"),
                            (acc["c"] + 1).alias("c"),
                            acc["s"].alias("last"),
                        ),
                    ).otherwise(acc),
                )

                def with_plan(Pl):
                    return let(F.element_at(order, Pl["c"]), lambda th: with_th(Pl, th))

                def with_th(Pl, th):
                    lens = F.transform(
                        R,
                        lambda r, q: F.when(r.isNull() | (r > th), F.lit(0))
                        .when(r == th, B - Pl["last"])
                        .otherwise(span_len(q).cast("int")),
                    )

                    def render(L):
                        def out(c, q):
                            replace = pos_hash(RS["span_op"], q) % 2 == 1
                            repl = let(pool, lambda Pool: F.element_at(
                                Pool, (pos_hash(RS["span_rep"], q) % F.size(Pool) + 1).cast("int")
                            ))
                            covered = (F.coalesce(at(L, q - 1), F.lit(0)) >= 2) | (F.coalesce(at(L, q - 2), F.lit(0)) >= 3)
                            return (
                                F.when(L[q] > 0, F.when(replace, repl).otherwise(F.lit("")))
                                .when(covered, F.lit(""))
                                .otherwise(c)
                            )

                        return F.array_join(F.transform(C, out), "")

                    return let(lens, render)

                return let(plan, with_plan)

            return let(budget, with_budget)

        return let(ranks, with_ranks)

    def _bound(rs):
        nonlocal RS
        RS = rs
        return let(chars(text), with_chars)

    return let(row_seeds(seed, ['span', 'span_len', 'span_op', 'span_rep'], keys), _bound)


# --- PTB-7 -----------------------------------------------------------------------

def perturb(attack: str | Column, text: Column, keys: list[Column], language, rate: float | Column, seed: int) -> Column:
    """The attack of that name on a text; unknown names raise at plan time.

    `attack` may be a column: rows where it is null keep their text.
    """
    return _noisy_text(language, seed)(*_parameters(attack, language, rate), text, _key_string(keys))


def perturb_each(attack: str | Column, texts: Column, keys: Column, language, rate: float | Column | tuple[float, ...], seed: int) -> Column:
    """`perturb` on every text of an array; `keys` holds each one's key, and a text without one stays.

    With a tuple of rates, the arrays of all of them in its order (null where the attack is):
    a text is cut into words and ranked once for all.
    """
    keys = F.transform(keys, lambda k: F.concat(F.lit("|"), k.cast("string")))
    if isinstance(rate, tuple):
        attack, language_, _ = _parameters(attack, language, 0.0)
        return _noisy_texts_at(language, tuple(_check_rate(r) for r in rate), seed)(attack, language_, texts, keys)
    return _noisy_texts(language, seed)(*_parameters(attack, language, rate), texts, keys)


def _parameters(attack: str | Column, language, rate: float | Column) -> tuple[Column, Column, Column]:
    if not isinstance(attack, Column):
        if attack not in ATTACKS:
            raise NotImplementedError(f"invalid attack type {attack!r}; choose one of {', '.join(ATTACKS)}")
        attack = F.lit(attack)
    rate = _check_rate(rate)
    language = language if isinstance(language, Column) else F.lit(language)
    return attack, language, rate.cast("double") if isinstance(rate, Column) else F.lit(rate)


def _key_string(keys: list[Column]) -> Column:
    """The keys as `seeded.h` joins them, nulls left out."""
    return F.concat_ws("", *[F.concat(F.lit("|"), k.cast("string")) for k in keys])


def _scripts(language):
    """Looks up what the rules need of a language code; built from the fixed values when the query is planned."""

    def script(name: str, pclass: int) -> noise.Script:
        lo, hi = S.SCRIPT_RANGES.get(name, (0, 0))
        return noise.Script(frozenset(S.CLASS_POINTS[pclass]), lo, hi, S.span_pool(name, pclass), S.mark_pool(name, pclass))

    if not isinstance(language, Column):
        fixed = script(S.script_of(language), S.punct_class_of(language))
        return lambda code: fixed
    known = {s: script(s, S.punct_class_of("x_" + s)) for s in S.SCRIPT_RANGES}
    other = {"Arab": script("", S.ARABIC), "Latn": script("", S.LATIN), "Cyrl": script("", S.LATIN)}
    indic = script("", S.INDIC)

    def of(code: str | None) -> noise.Script:
        code = code or ""
        return known.get(code.split("_")[-1]) or other.get(code[-4:], indic)

    return of


#: Rows whose texts are Python strings at a time.
_ROWS = 256


def _noisy_text(language, seed: int):
    of, rules = _scripts(language), noise.RULES

    @F.arrow_udf("string")
    def noisy_text(attack: pa.Array, code: pa.Array, rate: pa.Array, text: pa.Array, key: pa.Array) -> pa.Array:
        columns = (attack, code, rate, text, key)
        return pa.concat_arrays([pa.array([
            t if a is None or t is None else rules[a](t, k, of(c), r, seed)
            for a, c, r, t, k in zip(*[x.slice(i, _ROWS).to_pylist() for x in columns])
        ], pa.string()) for i in range(0, len(text) or 1, _ROWS)])

    return noisy_text


def _noisy_texts(language, seed: int):
    of, rules = _scripts(language), noise.RULES

    @F.arrow_udf("array<string>")
    def noisy_texts(attack: pa.Array, code: pa.Array, rate: pa.Array, texts: pa.Array, keys: pa.Array) -> pa.Array:
        columns = (attack, code, rate, texts, keys)
        return pa.concat_arrays([pa.array([
            ts if a is None or ts is None else [t if t is None or k is None else rules[a](t, k, of(c), r, seed) for t, k in zip(ts, ks)]
            for a, c, r, ts, ks in zip(*[x.slice(i, _ROWS).to_pylist() for x in columns])
        ], pa.list_(pa.string())) for i in range(0, len(texts) or 1, _ROWS)])

    return noisy_texts


def _noisy_texts_at(language, rates: tuple[float, ...], seed: int):
    of, rules = _scripts(language), noise.RULES_AT

    def every(attack: str, code: str, texts: list, keys: list) -> list[list]:
        one = [[t] * len(rates) if t is None or k is None else rules[attack](t, k, of(code), rates, seed) for t, k in zip(texts, keys)]
        return [list(x) for x in zip(*one)] if one else [[] for _ in rates]

    @F.arrow_udf("array<array<string>>")
    def noisy_texts_at(attack: pa.Array, code: pa.Array, texts: pa.Array, keys: pa.Array) -> pa.Array:
        columns = (attack, code, texts, keys)
        return pa.concat_arrays([pa.array([
            None if a is None or ts is None else every(a, c, ts, ks)
            for a, c, ts, ks in zip(*[x.slice(i, _ROWS).to_pylist() for x in columns])
        ], pa.list_(pa.list_(pa.string()))) for i in range(0, len(texts) or 1, _ROWS)])

    return noisy_texts_at
