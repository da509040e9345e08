"""Corpus BLEU, chrF and chrF++ (MET-1..5) as distributed aggregations.

Definitions follow the published metrics (Papineni et al. 2002; Popović 2015, 2017)
with the defaults of the common reference implementation:

  BLEU   n = 1..4 word n-grams; clipped matches and totals summed over the corpus;
         'exp' smoothing (the j-th zero-match order gets 100 / (2^j * total));
         brevity penalty exp(1 - ref/sys) when sys < ref; no match at all, or an
         order with no hypothesis n-grams -> 0.
  chrF   character 1..6-grams of the text without white space, beta = 2; per order
         corpus sums of hypothesis, reference and matched n-grams (hypothesis n-grams
         count only for sentences whose reference has that order); mean precision and
         mean recall over orders where both sums are positive; F-beta * 100.
  chrF++ chrF plus word 1..2-grams of tokens with one leading or trailing ASCII
         punctuation mark split off (8 orders averaged). Reported as `chrf_pp`.

Tokens are made inside the tasks, once per distinct word (`bleu_tokens` and `chrf_words` are
the same rules as column expressions), or given by the caller as array columns. The counting
is vectorised over Arrow batches: an n-gram is a number that holds its tokens as digits, and
the beginning of a longer one, so one sort of the longest serves all orders; where they don't
fit a number, what was sorted is numbered anew and goes on, so equal numbers mean equal n-grams
whatever their length. The clipped match of a segment is read off sorted keys. In a batch, a pair
of texts that comes again is counted once, and a reference once beside all its hypotheses. Each segment leaves as one row of counters, and one partially aggregated `groupBy(run
keys)` sums them: no n-gram is shuffled, and a whole grid of runs is scored in one job.
Only the orders of the metrics asked for are counted.

Segments are dealt round-robin before counting, never by their text, so a run of equal or
empty hypotheses spreads like any other.
"""

from __future__ import annotations

import itertools
import re
import string
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icx.functions.text import no_space, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLEU_ORDER, CHAR_ORDER, WORD_ORDER, BETA = 4, 6, 2, 2.0
TOKENIZERS = ("whitespace", "13a", "char")
METRICS = ("bleu", "chrf", "chrf_pp")
#: Characters that one counting step looks at, and words whose tokens a task remembers.
STEP = 1 << 18
WORDS = 1 << 16
#: Hypotheses that are counted beside one copy of their reference.
SIDES = 7

# The 13a tokenizer's substitutions (mteval-v13a), in order.
_13A_CLASS = r"[\x{7B}-\x{7E}\x{5B}-\x{60}\x{20}-\x{26}\x{28}-\x{2B}\x{3A}-\x{40}\x{2F}]"
_PUNCT_POINTS = [ord(c) for c in string.punctuation]


def tokenize_13a(text: Column) -> Column:
    t = F.replace(text, F.lit("<skipped>"), F.lit(""))
    t = F.replace(t, F.lit("-\n"), F.lit(""))
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, "(" + _13A_CLASS + ")", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([\.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return words(t)


def bleu_tokens(text: Column, tokenizer: str) -> Column:
    if tokenizer == "whitespace":
        return words(text)
    if tokenizer == "13a":
        return tokenize_13a(text)
    if tokenizer == "char":
        s = no_space(text)
        return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))
    raise ValueError(f"unknown tokenizer {tokenizer!r}")


def _is_p(c: Column) -> Column:
    return F.ascii(c).isin(_PUNCT_POINTS)


def chrf_words(text: Column) -> Column:
    """Words with one leading or trailing punctuation mark split off."""
    def split_word(w):
        ln = F.length(w)
        last, first = F.substring(w, -1, 1), F.substring(w, 1, 1)
        return (
            F.when(ln == 1, F.array(w))
            .when(_is_p(last), F.array(w.substr(F.lit(1), ln - 1), last))
            .when(_is_p(first), F.array(first, w.substr(F.lit(2), ln)))
            .otherwise(F.array(w))
        )

    return F.flatten(F.transform(words(text), split_word))


# ---- tokens inside the tasks: the same rules, once per distinct word ---------------------

_13A_STEPS = [(re.compile(a), b) for a, b in (
    (r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
)]
_PUNCT = frozenset(string.punctuation)
_13A_MARKS = _PUNCT - {"'", "-"}  # split off wherever they stand, but for . and , between digits


def _text_13a(text: str) -> str:
    """What 13a replaces before it looks at words."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    return text.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")


def _word_13a(word: str) -> list[str]:
    """13a's substitutions look one character around a mark, so a word between blanks is tokenized by itself."""
    if word.isalnum():  # no mark
        return [word]
    if word[-1] in _13A_MARKS and word[:-1].isalnum():
        return [word[:-1], word[-1]]
    word = f" {word} "
    for pattern, put in _13A_STEPS:
        word = pattern.sub(put, word)
    return word.split()


def _word_chrf(word: str) -> list[str]:
    if len(word) > 1 and word[-1] in _PUNCT:
        return [word[:-1], word[-1]]
    if len(word) > 1 and word[0] in _PUNCT:
        return [word[0], word[1:]]
    return [word]


_WORD_RULES = {"13a": _word_13a, "whitespace": lambda w: [w], "char": list, "chrf": _word_chrf}


class _Numbers(dict):
    """Words with the number of their token under a rule, or with -1, -2, .. for a place in `several`, which holds the numbers of more or less than one."""

    def __init__(self, rule: str):
        self.rule, self.split, self.known, self.several = rule, _WORD_RULES[rule], {}, []

    def __missing__(self, word: str) -> int:
        known, tokens = self.known, self.split(word)
        if len(tokens) == 1:
            out = self[word] = known.setdefault(tokens[0], len(known))
        else:
            self.several.append([known.setdefault(t, len(known)) for t in tokens])
            out = self[word] = -len(self.several)
        return out

    def of(self, text: str) -> np.ndarray:
        words = (_text_13a(text) if self.rule == "13a" else text).split()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(ids < 0)
        if not len(at):
            return ids
        put = [self.several[-i - 1] for i in ids[at].tolist()]
        size = np.ones(len(ids), np.int64)
        size[at] = [len(x) for x in put]
        out = np.repeat(ids, size)
        out[out < 0] = [*itertools.chain.from_iterable(put)]
        return out


# ---- counting ------------------------------------------------------------------------

Stream = tuple[np.ndarray, np.ndarray]  # token numbers, and the segment of each


def _token_streams(hyp: pa.Array, ref: pa.Array) -> tuple[Stream, Stream]:
    """Numbered tokens of two list columns."""
    both = pa.concat_arrays([hyp.flatten(), ref.flatten()]).dictionary_encode()
    ids = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(hyp.flatten())
    seg = [np.repeat(np.arange(len(c)), np.diff(c.offsets.to_numpy())) for c in (hyp, ref)]
    return (ids[:n], seg[0]), (ids[n:], seg[1])


def _text_streams(hyp: list[str], ref: list[str], numbers: Callable[[str], np.ndarray]) -> tuple[Stream, Stream]:
    """Numbers of two text columns; a text that comes again is looked at once."""
    made = {t: numbers(t) for t in dict.fromkeys(itertools.chain(hyp, ref))}
    out = []
    for texts in (hyp, ref):
        parts = [made[t] for t in texts]
        out.append((np.concatenate([np.zeros(0, np.int64), *parts]), np.repeat(np.arange(len(texts)), [len(x) for x in parts])))
    return out[0], out[1]


def _char_numbers(text: str) -> np.ndarray:
    """Code points without white space."""
    return np.frombuffer("".join(text.split()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _dense(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """The numbers as 0.. in the same order, and how many there are."""
    if not len(ids):
        return ids, 1
    seen = np.zeros(int(ids.max()) + 1, bool)
    seen[ids] = True
    return (np.cumsum(seen) - 1)[ids], int(seen.sum())


def _counted(hyp: Stream, ref: Stream, n_seg: int, orders: int, same: np.ndarray,
             of: np.ndarray | None = None, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: n-grams of the hypothesis, of the reference, and clipped matches, by segment.

    `of` names the reference of each segment, if segments share them, and `side` (1..) tells the
    segments of a reference apart. Segments marked `same` match themselves; their hypothesis is not looked at.
    """
    of, side = np.arange(n_seg) if of is None else of, np.ones(n_seg, np.int64) if side is None else side
    n_ref = int(of.max()) + 1 if n_seg else 0
    sizes = [np.bincount(hyp[1], minlength=n_seg), np.bincount(ref[1], minlength=n_ref)[of]]
    sizes[0] = np.where(same, sizes[1], sizes[0])
    differ = ~same[hyp[1]]
    ids, seg = hyp[0][differ], hyp[1][differ]
    matches = _matched(np.concatenate([ref[0], ids]), np.concatenate([ref[1], of[seg]]), np.concatenate([np.zeros(len(ref[0]), np.int64), side[seg]]),
                       np.concatenate([ref[1], n_ref + seg]), n_ref, int(side.max(initial=0)) + 1, orders)
    for order, match in enumerate(matches):
        n_h, n_r = (np.maximum(n - order, 0) for n in sizes)
        yield n_h, n_r, np.where(same, n_r, match[side, of])


def _matched(ids: np.ndarray, group: np.ndarray, side: np.ndarray, text: np.ndarray, groups: int, sides: int, orders: int) -> Iterator[np.ndarray]:
    """Per order: by side and group, the clipped matches of that side's text with the group's text of side 0.

    The arrays describe tokens, text after text. The n-grams that begin at a token are the
    beginnings of its highest one, so one sort serves several orders: a key holds group, tokens
    as digits, and side. Where 64 bits don't hold all orders, what was sorted is numbered anew and goes on.
    """
    if not len(ids):
        for _ in range(orders):
            yield np.zeros((sides, groups), np.int64)
        return
    ids, n_ids = _dense(ids)
    bits, side_bits = n_ids.bit_length(), (sides - 1).bit_length()  # a digit 0 stands behind a text's end
    gap = np.cumsum(np.concatenate([[0], text[1:] != text[:-1]])) * (orders - 1)
    at = np.arange(len(ids)) + gap
    flat = np.zeros(int(at[-1]) + orders, np.uint64)
    flat[at] = ids + 1
    total = int(at[-1]) + 1
    prefix, owner, place = group.astype(np.uint64), np.arange(groups), side.astype(np.uint64)
    done = 0
    while done < orders:
        n = min(orders - done, (64 - max(1, (len(owner) - 1).bit_length()) - side_bits) // bits)
        if n < 1:
            raise ValueError(f"a step of {len(ids)} tokens is too large")
        key = flat[done : done + total].copy()
        for j in range(done + 1, done + n):
            key <<= bits
            key |= flat[j : j + total]
        key = (((prefix << bits * n) | key[at]) << side_bits) | place
        if done + n < orders:
            by = np.argsort(key)
            key = key[by]
        else:
            key.sort()
        of_side = (key & ((1 << side_bits) - 1)).astype(np.int64)
        key >>= side_bits
        for j in range(1, n + 1):
            gram = key >> bits * (n - j)
            new = np.concatenate([[True], gram[1:] != gram[:-1]])
            number = np.cumsum(new) - 1
            gram = gram[new]
            count = np.bincount(of_side * len(gram) + number, minlength=sides * len(gram)).reshape(sides, len(gram))
            most = np.where(gram & ((1 << bits) - 1) != 0, count[0], 0)  # one that ends behind its text is shorter
            mine = owner[(gram >> bits * j).astype(np.int64)]
            cut = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            match = np.zeros((sides, groups), np.int64)
            for k in range(1, sides):
                match[k, mine[cut]] = np.add.reduceat(np.minimum(most, count[k]), cut)
            yield match
        done += n
        if done < orders:
            prefix = np.empty(len(ids), np.uint64)
            prefix[by] = number
            owner = mine


def _orders(metrics: tuple[str, ...]) -> dict[str, int]:
    """Families of n-grams that the metrics need, with their highest order."""
    out = {"bleu": BLEU_ORDER} if "bleu" in metrics else {}
    if {"chrf", "chrf_pp"} & set(metrics):
        out["chr"] = CHAR_ORDER
    if "chrf_pp" in metrics:
        out["word"] = WORD_ORDER
    return out


def _counter_names(orders: dict[str, int]) -> list[str]:
    names = ["sys_len", "ref_len"] if "bleu" in orders else []
    for family, most in orders.items():
        names += [f"{family}_{x}_{n}" for n in range(1, most + 1) for x in ("hyp", "ref", "match")]
    return names


def _distinct(hyp: pa.Array, ref: pa.Array, own: bool) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The texts, the distinct pairs of them (numbers of hypothesis and reference) by reference, and the pair of each row.

    With the caller's `own` tokens every row is a pair of its own.
    """
    if own:
        each = np.arange(len(hyp))
        return hyp, ref, each, each, each
    h, r = hyp.dictionary_encode(), ref.dictionary_encode()
    n = max(1, len(h.dictionary))
    pairs, of_row = np.unique(r.indices.to_numpy().astype(np.int64) * n + h.indices.to_numpy(), return_inverse=True)
    return h.dictionary, r.dictionary, pairs % n, pairs // n, of_row


def _steps(hyp_chars: list[int], ref_chars: list[int], refs: list[int], same: list[bool], own: bool) -> Iterator[tuple[int, int, list[int], list[int], list[int]]]:
    """Cuts pairs into counting steps of about STEP characters: first and last pair, pair by pair its reference's place
    in the step and its side there, and the references."""
    first, chars, of, side, found = 0, 0, [], [], []
    for i, r in enumerate(refs):
        more = 0 if same[i] else hyp_chars[i]
        beside = not own and found and refs[i - 1] == r and top < SIDES and beside_chars + more <= STEP
        if not beside and found and chars + ref_chars[i] + more > STEP:
            yield first, i, of, side, found
            first, chars, of, side, found = i, 0, [], [], []
        if not beside:
            found.append(r)
            top, beside_chars = 0, ref_chars[i]
            chars += ref_chars[i]
        top += not same[i]
        beside_chars, chars = beside_chars + more, chars + more
        of.append(len(found) - 1)
        side.append(0 if same[i] else top)
    if found:
        yield first, len(refs), of, side, found


def _count_batches(kept: list[str], orders: dict[str, int], tokenizer: str | None):
    """Counters of the segments; `tokenizer` None: the batches bring the caller's tokens for BLEU.

    Pairs of texts that come again in a batch are counted once, and a reference once beside all its hypotheses.
    """
    names = _counter_names(orders)
    rules = {"bleu": tokenizer, "word": "chrf"}
    own = "bleu" in orders and not tokenizer

    def counters(column: dict, hyp: list[str], ref: list[str], of: np.ndarray, side: np.ndarray, numbers: dict[str, _Numbers]) -> list[np.ndarray]:
        same, out = side == 0, []
        for family, most in orders.items():
            given = family == "bleu" and own
            if given:  # here each pair has its own reference
                streams = _token_streams(column["_h_own"], column["_r_own"])
            else:
                streams = _text_streams(hyp, ref, numbers[family].of if family in numbers else _char_numbers)
            no, at = (np.zeros(len(of), bool), np.ones(len(of), np.int64)) if given else (same, side)
            for order, (h, r, m) in enumerate(_counted(*streams, len(of), most, no, of, at), 1):
                if family == "bleu" and order == 1:
                    out += [h, r]
                # characters and words of a hypothesis count only where the reference has this order
                out += [h if family == "bleu" else np.where(r > 0, h, 0), r, m]
        return out

    def run(batches):
        numbers: dict[str, _Numbers] = {}
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            hyps, refs, hyp_at, ref_at, of_row = _distinct(column["_h"], column["_r"], own)
            same = pc.equal(hyps.take(pa.array(hyp_at)), refs.take(pa.array(ref_at))).to_numpy(zero_copy_only=False)
            chars = [pc.utf8_length(x).to_numpy(zero_copy_only=False)[i].tolist() for x, i in ((hyps, hyp_at), (refs, ref_at))]
            found = np.zeros((len(names), len(hyp_at)), np.int64)
            for a, b, of, side, its_refs in _steps(*chars, ref_at.tolist(), same.tolist(), own):
                for family in orders:
                    if rules.get(family) and (family not in numbers or len(numbers[family]) > WORDS):
                        numbers[family] = _Numbers(rules[family])
                side_of = np.array(side)
                hyp = hyps.take(pa.array(hyp_at[a:b])).to_pylist() if (side_of > 0).all() else [
                    hyps[int(i)].as_py() if at else "" for i, at in zip(hyp_at[a:b], side)]
                some = {c: column[c].slice(a, b - a) for c in ("_h_own", "_r_own") if own}
                found[:, a:b] = counters(some, hyp, refs.take(pa.array(its_refs)).to_pylist(), np.array(of), side_of, numbers)
            yield pa.RecordBatch.from_arrays([*[column[k] for k in kept], *[pa.array(c[of_row]) for c in found]], names=[*kept, *names])

    return run


def corpus_stats(df: DataFrame, keys: list[str], hyp: str = "hypothesis", ref: str = "reference", tokenizer: str = "13a",
                 metrics: tuple[str, ...] = METRICS, tokens: tuple[str, str] | None = None,
                 basis: DataFrame | None = None, dealt: bool = False, counts: dict[str, Column] | None = None) -> DataFrame:
    """Corpus counters per group of `keys` (one row per run).

    `tokens` names two array<string> columns that hold the caller's own BLEU tokens of
    hypothesis and reference; otherwise `tokenizer` makes them. Null texts (and null token
    arrays) count as empty. `basis` is the plain scan that `df` comes from: when it has splits
    enough for every task, segments are counted where they lie and no text is exchanged; so they
    are with `dealt`, when the caller has dealt what they are made from. `counts` are more columns to sum.
    """
    orders, counts = _orders(metrics), counts or {}
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {tokenizer!r}")
    own = tokens is not None and "bleu" in orders
    texts = [F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((hyp, "_h"), (ref, "_r"))]
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")).alias(name) for c, name in zip(tokens, ("_h_own", "_r_own"))] if own else []
    named = df.select(*keys, *[c.cast("long").alias(name) for name, c in counts.items()], *texts, *lists)
    named = named if dealt else deal(named, basis)
    sums = [*counts, *_counter_names(orders)]
    schema = T.StructType([*[df.schema[k] for k in keys], *[T.StructField(n, T.LongType()) for n in sums]])
    counted = named.mapInArrow(_count_batches([*keys, *counts], orders, None if own else tokenizer), schema)
    return counted.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])


def deal(df: DataFrame, basis: DataFrame | None = None) -> DataFrame:
    """Rows over as many tasks as the session plans for a shuffle, and over all cores at least: counting costs CPU per character.

    They stay where they are when the plain scan `basis` that they come from has as many splits.
    """
    tasks = tasks_of(df)
    return df if basis is not None and basis.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def tasks_of(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def bleu_from_stats() -> Column:
    c = [F.col(f"bleu_match_{n}").cast("double") for n in range(1, BLEU_ORDER + 1)]
    t = [F.col(f"bleu_hyp_{n}").cast("double") for n in range(1, BLEU_ORDER + 1)]
    sys_len, ref_len = F.col("sys_len").cast("double"), F.col("ref_len").cast("double")
    bp = F.when(sys_len < ref_len, F.when(sys_len > 0, F.exp(1 - ref_len / sys_len)).otherwise(F.lit(0.0))).otherwise(
        F.lit(1.0)
    )
    logs, zeros = [], F.lit(0)
    for n in range(BLEU_ORDER):
        zeros = zeros + F.when(c[n] == 0, 1).otherwise(0)
        p = F.when(c[n] > 0, 100.0 * c[n] / t[n]).otherwise(100.0 / (F.pow(F.lit(2.0), zeros) * t[n]))
        logs.append(F.log(p))
    score = bp * F.exp(sum(logs[1:], logs[0]) / BLEU_ORDER)
    no_match = sum(c[1:], c[0]) == 0
    return F.round(F.when(no_match | (t[-1] == 0), F.lit(0.0)).otherwise(score), 6)


def chrf_from_stats(word_order: int = 0, beta: float = BETA) -> Column:
    orders = [("chr", n) for n in range(1, CHAR_ORDER + 1)] + [("word", n) for n in range(1, word_order + 1)]
    prec, rec, eff = F.lit(0.0), F.lit(0.0), F.lit(0)
    for name, n in orders:
        h, r, m = (F.col(f"{name}_{x}_{n}").cast("double") for x in ("hyp", "ref", "match"))
        ok = (h > 0) & (r > 0)
        prec = prec + F.when(ok, m / h).otherwise(0.0)
        rec = rec + F.when(ok, m / r).otherwise(0.0)
        eff = eff + F.when(ok, 1).otherwise(0)
    f2 = beta * beta

    def score(p, r):
        return F.when(p + r > 0, 100.0 * (1 + f2) * p * r / (f2 * p + r)).otherwise(F.lit(0.0))

    return F.round(F.when(eff == 0, F.lit(0.0)).otherwise(score(prec / eff, rec / eff)), 6)


def score(df: DataFrame, keys: list[str], hyp: str = "hypothesis", ref: str = "reference", tokenizer: str = "13a",
          metrics: tuple[str, ...] = METRICS, tokens: tuple[str, str] | None = None, basis: DataFrame | None = None,
          dealt: bool = False, counts: dict[str, Column] | None = None) -> DataFrame:
    """(keys..., one column per metric, the `counts`) — the whole grid in one aggregation."""
    st = corpus_stats(df, keys, hyp, ref, tokenizer, metrics, tokens, basis, dealt, counts)
    made = {"bleu": bleu_from_stats, "chrf": lambda: chrf_from_stats(0), "chrf_pp": lambda: chrf_from_stats(WORD_ORDER)}
    return st.select(*keys, *[made[m]().alias(m) for m in metrics], *(counts or ()))


def ngram_stats(df: DataFrame, keys: list[str], hyp: str = "hypothesis", ref: str = "reference",
                tokenizer: str = "13a", basis: DataFrame | None = None) -> DataFrame:
    """Long form of the corpus counters: (keys..., metric, ord, n_hyp, n_ref, n_match)."""
    st = corpus_stats(df, keys, hyp, ref, tokenizer, basis=basis)
    rows = [
        F.struct(F.lit(family).alias("metric"), F.lit(n).alias("ord"), *[F.col(f"{family}_{x}_{n}").alias(f"n_{x}") for x in ("hyp", "ref", "match")])
        for family, most in _orders(METRICS).items() for n in range(1, most + 1)
    ]
    return st.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")
