"""The six noise rules on one text, vectorised, for Arrow tasks.

Same definitions and same hash contract as the column expressions of
`operators/perturb.py`: positions are hashed, ranked and cut with numpy, words and code
points are handled as arrays, so a character costs well below a microsecond.

Hashes and ranks of a text don't depend on the rate, so a rule takes several rates, in any
order, and returns a text for each: words, code points and ranks are made once for all.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

PRIME, POS_RADIX = 2147483647, 2147483648


class Script(NamedTuple):
    """What a language's rules look at: code points of its punctuation, script range, replacements, marks."""

    punct: frozenset
    lo: int
    hi: int
    pool: list
    marks: list


def _hashes(seed: int, tag: str, key: str, pos: np.ndarray) -> np.ndarray:
    """`seeded.pos_hash` of many positions; `key` is the row's keys, each with its '|'."""
    hx = hashlib.md5(f"{seed}|{tag}{key}".encode()).hexdigest()
    a, b, c = (int(hx[i : i + 8], 16) % PRIME for i in (0, 8, 16))
    return ((a * pos + b) % PRIME * pos + c) % PRIME


def _ranks(seed: int, tag: str, key: str, pos: np.ndarray) -> np.ndarray:
    return _hashes(seed, tag, key, pos) * POS_RADIX + pos


def _ranked(seed: int, tag: str, key: str, pos: np.ndarray) -> np.ndarray:
    """The positions by rank."""
    return pos[np.argsort(_ranks(seed, tag, key, pos))]


def _shares(order: np.ndarray, rates: Sequence[float]) -> Iterator[tuple[int, list[int]]]:
    """By rising rate: its place, and the positions it has beyond the rate before, of the max(1, int(n * rate)) lowest."""
    done = 0
    for i in sorted(range(len(rates)), key=rates.__getitem__):
        k = max(1, int(len(order) * rates[i]))
        yield i, order[done:k].tolist()
        done = k


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


#: By the punctuation of a script: the table and the signs below.
_KNOWN: dict[frozenset, tuple[np.ndarray, frozenset]] = {}


def _punct(script: Script) -> tuple[np.ndarray, frozenset]:
    """Marks by code point, with one more place that stands for all higher ones; and as signs."""
    if script.punct not in _KNOWN:
        table = np.zeros(max(script.punct, default=0) + 2, bool)
        table[list(script.punct)] = True
        _KNOWN[script.punct] = table, frozenset(map(chr, script.punct))
    return _KNOWN[script.punct]


def _is_punct(points: np.ndarray, script: Script) -> np.ndarray:
    table, _ = _punct(script)
    return table[np.minimum(points, len(table) - 1)]


def _word_duplication(text: str, key: str, script: Script, rates: Sequence[float], seed: int) -> list[str]:
    words, made = text.split(), [text] * len(rates)
    if not words:
        return made
    for i, more in _shares(_ranked(seed, "dup", key, np.arange(len(words))), rates):
        for at in more:
            words[at] = f"{words[at]} {words[at]}"
        made[i] = " ".join(words)
    return made


def _word_order(text: str, key: str, script: Script, rates: Sequence[float], seed: int) -> list[str]:
    words = text.split()
    if not words:
        return [text] * len(rates)
    order = _ranked(seed, "order_slot", key, np.arange(len(words)))
    wanted, made = _ranks(seed, "order_src", key, order), []
    for rate in rates:
        k = max(1, int(len(words) * rate))
        slots = order[:k]
        source = slots[np.argsort(wanted[:k])]
        if np.array_equal(source, slots):
            source = np.sort(slots)
            if np.array_equal(source, slots):
                source = source[::-1]
        out = list(words)
        for to, at in zip(slots.tolist(), source.tolist()):
            out[to] = words[at]
        made.append(" ".join(out))
    return made


def _punctuation_drop(text: str, key: str, script: Script, rates: Sequence[float], seed: int) -> list[str]:
    points, made = _points(text), [text] * len(rates)
    at = np.flatnonzero(_is_punct(points, script))
    if not len(at):
        return made
    kept = np.ones(len(points), bool)
    for i, more in _shares(_ranked(seed, "pdrop", key, at), rates):
        kept[more] = False
        made[i] = _text(points[kept])
    return made


def _punctuation_add(text: str, key: str, script: Script, rates: Sequence[float], seed: int) -> list[str]:
    words, made, (_, signs) = text.split(), [text] * len(rates), _punct(script)
    at = np.flatnonzero([signs.isdisjoint(w) for w in words])
    if not len(at):
        return made
    mark = (_hashes(seed, "mark", key, np.arange(len(words))) % len(script.marks)).tolist()
    chosen: set[str] = set()
    for i, more in _shares(_ranked(seed, "padd", key, at), rates):
        chosen.update([words[j] for j in more])
        made[i] = " ".join([w + script.marks[m] if w in chosen else w for w, m in zip(words, mark)])
    return made


def _ocr(text: str, key: str, script: Script, rates: Sequence[float], seed: int) -> list[str]:
    words, made = text.split(), [text] * len(rates)
    if not words:
        return made
    at = np.arange(len(words))
    fuse = ((_hashes(seed, "ocr_op", key, at) % 2 == 0) & (at < len(words) - 1)).tolist()
    cut = _hashes(seed, "ocr_cut", key, at).tolist()
    out = [w + " " for w in words]
    out[-1] = words[-1]
    for i, more in _shares(_ranked(seed, "ocr", key, at), rates):
        for j in more:
            w = words[j]
            if fuse[j]:
                out[j] = w
            elif len(w) >= 2:
                c = cut[j] % (len(w) - 1) + 1
                out[j] = f"{out[j][:c]} {out[j][c:]}"
        made[i] = "".join(out)
    return made


def _span_noise(text: str, key: str, script: Script, rates: Sequence[float], seed: int) -> list[str]:
    points = _points(text)
    able = (points >= script.lo) & (points < script.hi) & ~_is_punct(points, script)
    at = np.flatnonzero(able)
    budgets = [int(len(at) * rate) for rate in rates]
    most = max(budgets)
    if not most:
        return [text] * len(rates)
    ranks = _ranks(seed, "span", key, at)
    if most < len(ranks) // 2:
        ranks = np.partition(ranks, most - 1)[:most]
    starts = np.sort(ranks)[:most] % POS_RADIX  # in hash order
    lens = _hashes(seed, "span_len", key, starts) % 3 + 1
    upto = np.cumsum(lens)
    last = int(np.searchsorted(upto, most))  # the start that spends the largest budget
    starts, lens = starts[: last + 1], lens[: last + 1]
    put = _hashes(seed, "span_op", key, starts) % 2 == 1
    put_signs = np.array(script.pool, np.int64)[_hashes(seed, "span_rep", key, starts[put]) % len(script.pool)] if put.any() else np.zeros(0, np.int64)
    upto_put, made = np.cumsum(put), []
    for budget in budgets:
        if not budget:
            made.append(text)
            continue
        last = int(np.searchsorted(upto, budget))
        trimmed = int(lens[last] - (upto[last] - budget))  # what is left for the last span
        mine, own = starts[:last], lens[:last]
        kept = np.ones(len(points) + 2, bool)
        kept[mine] = False
        kept[mine[own >= 2] + 1] = False
        kept[mine[own >= 3] + 2] = False
        kept[starts[last] : starts[last] + trimmed] = False
        out = points.copy()
        new = starts[: last + 1][put[: last + 1]]
        out[new] = put_signs[: upto_put[last]]
        kept[new] = True
        made.append(_text(out[kept[: len(points)]]))
    return made


#: The rules, each for several rates at once.
RULES_AT = {
    "span_noise": _span_noise, "word_duplication": _word_duplication, "punctuation_drop_attack": _punctuation_drop,
    "punctuation_add_attack": _punctuation_add, "ocr": _ocr, "word_order": _word_order,
}


def _at_one_rate(rule):
    return lambda text, key, script, rate, seed: rule(text, key, script, (rate,), seed)[0]


RULES = {name: _at_one_rate(rule) for name, rule in RULES_AT.items()}
