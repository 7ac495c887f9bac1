"""Recompression of word sequences: rounds that name runs and pairs, alike wherever the words are alike.

A name is a hash of what it stands for (a word, a run of one name, a pair of names), so it is the same in every document and
every task, and a round needs no exchange of names. Which pairs become one symbol their names alone say: a bit of each name,
drawn anew each round, makes it a left or a right one, and a left one takes up a right one behind it. Symbols of a round are
no longer than its cap.

What a window of words fixes: a symbol at its border may be part of a longer one that begins outside. A round takes such symbols
from the window's ends, and what is left stands alike wherever the window does. Of the symbols left after the last round the
longest is the window's mark, of equal ones that with the greatest hash: the same for all equal windows, at the same place in
them, and mostly the same for windows that begin side by side. Should an earlier round leave nothing for the next, the first
symbol that it leaves is the mark.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: The most words in a symbol, round by round, and whether the round names runs too.
ROUNDS = ((2, True), (4, False), (8, False), (12, False), (16, False), (20, False))

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_ODD = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def named(x: np.ndarray, y: np.ndarray, salt: int) -> np.ndarray:
    return mixed(mixed(x + _salted(salt)) * _ODD + y)


def _salted(salt: int) -> np.uint64:
    return np.uint64(salt * int(_A) & (1 << 64) - 1)


class Words(NamedTuple):
    """The words of some documents, one after the other."""

    names: np.ndarray  # uint64
    before: np.ndarray  # of each document the words before it, and all of them


def words_of(texts: pa.Array) -> Words:
    import xxhash

    digest, found, counts = xxhash.xxh64_intdigest, [], []
    for text in texts.cast(pa.binary()).to_pylist():
        words = (text or b"").split()  # bytes are split at ASCII white space alone
        counts.append(len(words))
        found.append(np.fromiter(map(digest, words), np.uint64, len(words)))
    return Words(np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]))


class Symbols(NamedTuple):
    name: np.ndarray
    start: np.ndarray  # its first word
    length: np.ndarray
    last: np.ndarray  # the last of its document


def _kept(s: Symbols, keep: np.ndarray, name: np.ndarray) -> Symbols:
    """The symbols that start new ones, each up to the next."""
    start = s.start[keep]
    end = np.append(start[1:], s.start[-1] + s.length[-1])
    at = np.append(np.flatnonzero(keep)[1:], len(keep)) - 1
    return Symbols(name[keep], start, end - start, s.last[at])


def _runs(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol the place of its run's first and of its run's last symbol."""
    n = len(s.name)
    fresh = np.ones(n, bool)
    fresh[1:] = (s.name[1:] != s.name[:-1]) | s.last[:-1]
    firsts = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    return firsts[run], np.append(firsts[1:], n)[run] - 1


class Parsed(NamedTuple):
    """Of each window: its first word, and of its mark the round, the name and the first word."""

    window: np.ndarray
    level: np.ndarray
    name: np.ndarray
    start: np.ndarray


def parsed(words: Words, width: int, rounds=ROUNDS) -> Parsed:
    """The marks of all windows of ``width`` words of one document."""
    n = len(words.names)
    sizes = np.diff(words.before)
    windows = np.arange(n, dtype=np.int64)
    doc_end = np.repeat(words.before[1:], sizes)
    windows = windows[windows + width <= doc_end]
    if not len(windows):
        empty = np.zeros(0, np.int64)
        return Parsed(empty, empty.astype(np.int8), empty.astype(np.uint64), empty)
    last = np.zeros(n, bool)
    last[words.before[1:][sizes > 0] - 1] = True
    s = Symbols(mixed(words.names), np.arange(n, dtype=np.int64), np.ones(n, np.int64), last)
    level, name, start = np.zeros(len(windows), np.int8), s.name[windows], windows.copy()
    at, low, high = np.arange(len(windows)), windows.copy(), windows + width  # windows with something left, and from where to where
    index = np.zeros(n + 1, np.int64)
    for k, (cap, with_runs) in enumerate(rounds, 1):
        if with_runs:
            first, final = _runs(s)
            index[s.start], index[n] = np.arange(len(s.name)), len(s.name)
            f, g = index[low], index[high] - 1
            for side in (0, 1):  # of the run at the border what lies in the window
                inside = np.minimum(final[f], g) - f + 1 if side == 0 else g - np.maximum(first[g], f) + 1
                length = s.length[f] if side == 0 else s.length[g]
                lost = np.where(np.maximum(inside, 2) * length <= cap, inside, 0)
                if side == 0:
                    left = lost
                else:
                    right = lost
            f, g = f + left, g - right
            some = f <= g
            at, f, g = at[some], f[some], g[some]
            low, high = s.start[f], s.start[g] + s.length[g]
            times = final - first + 1
            joins = (times > 1) & (times * s.length <= cap)
            renamed = np.where(joins, named(s.name, times.astype(np.uint64), 2 * k), s.name)
            s = _kept(s, ~joins | (first == np.arange(len(first))), renamed)
        right_one = (mixed(s.name ^ _salted(k)) & np.uint64(1)).astype(bool)
        index[s.start], index[n] = np.arange(len(s.name)), len(s.name)
        f, g = index[low], index[high] - 1
        small = s.length < cap
        f = f + (right_one & small)[f]
        g = g - (~right_one & small)[g]
        some = f <= g
        at, f, g = at[some], f[some], g[some]
        low, high = s.start[f], s.start[g] + s.length[g]
        pair = np.zeros(len(s.name), bool)
        pair[:-1] = ~right_one[:-1] & right_one[1:] & ~s.last[:-1] & (s.length[:-1] + s.length[1:] <= cap)
        keep = np.ones(len(pair), bool)
        keep[1:] = ~pair[:-1]
        renamed = s.name.copy()
        pairs = np.flatnonzero(pair)
        renamed[pairs] = named(s.name[pairs], s.name[pairs + 1], 2 * k + 1)
        s = _kept(s, keep, renamed)
        if not len(at):
            break
        index[s.start], index[n] = np.arange(len(s.name)), len(s.name)
        f, g = index[low], index[high] - 1
        best = f if k < len(rounds) else greatest_between((s.length.astype(np.uint64) << np.uint64(56)) | (mixed(s.name) >> np.uint64(8)), f, g)
        level[at], name[at], start[at] = k, s.name[best], s.start[best]
    return Parsed(windows, level, name, start)


def greatest_between(value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each pair of places the place of the greatest value between them, of equal ones the first; by tables of powers of two."""
    out, power = first.copy(), np.log2(last - first + 1).astype(np.int64)
    best = np.arange(len(value))
    for k in range(int(power.max(initial=0)) + 1):
        here = np.flatnonzero(power == k)
        a, b = best[first[here]], best[last[here] + 1 - (1 << k)]
        out[here] = np.where(value[a] >= value[b], a, b)
        a, b = best[: -(1 << k)], best[1 << k :]
        best[: len(a)] = np.where(value[a] >= value[b], a, b)
    return out


class Stretches(NamedTuple):
    """Neighbouring windows with one and the same mark: the first window's first word, their number, and the names of the mark
    and of all their words with the mark's place in them."""

    first: np.ndarray
    windows: np.ndarray
    mark: np.ndarray
    whole: np.ndarray


class Spans:
    """Names of any spans of words, by sums over powers of an odd number modulo 2 ** 64."""

    _BASE = 0xA24BAED4963EE407
    _powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, words: Words, salt: int):
        n = len(words.names)
        if Spans._powers is None or len(Spans._powers[0]) < n:
            size = max(n, 1 << 16)
            one, back = np.full(size, self._BASE, np.uint64), np.full(size, pow(self._BASE, -1, 1 << 64), np.uint64)
            one[0] = back[0] = 1
            Spans._powers = np.cumprod(one), np.cumprod(back)
        self.salt, self.back = salt, Spans._powers[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(words.names ^ _salted(salt)) * Spans._powers[0][:n], out=self.sums[1:])

    def of(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return named((self.sums[first + size] - self.sums[first]) * self.back[first], np.asarray(size, np.uint64) + np.zeros(len(first), np.uint64), self.salt)


def stretches(words: Words, width: int) -> Stretches:
    """All windows of ``width`` words of one document, those with the same mark together: fewer than ``width`` side by side hold it."""
    p = parsed(words, width)
    n = len(p.window)
    fresh = np.ones(n, bool)
    fresh[1:] = (p.window[1:] != p.window[:-1] + 1) | (p.start[1:] != p.start[:-1]) | (p.level[1:] != p.level[:-1])
    at = np.flatnonzero(fresh)
    first, windows = p.window[at], np.diff(np.append(at, n))
    mark = named(p.name[at], p.level[at].astype(np.uint64), 99)
    whole = Spans(words, 1).of(first, windows + width - 1) if n else mark
    place = ((p.start[at] - first) * 64 + windows).astype(np.uint64)
    return Stretches(first, windows, mark, named(whole, place, 98))


def pieces(texts: pa.Array, width: int, most: int = 200_000):
    """The words of ``texts`` in pieces of some ``most`` words: (Words, number of each of its documents, its first word's place).

    A longer text is cut into pieces that share ``width - 1`` words, so that each window is in one: marks don't depend on what is
    around a window.
    """
    names, parts, held = [], [], 0

    def close() -> tuple[Words, np.ndarray, np.ndarray]:
        before = np.concatenate([[0], np.cumsum([len(x) for x in names], dtype=np.int64)])
        return Words(np.concatenate(names), before), *(np.array(x, np.int64) for x in zip(*parts))

    for at in range(0, len(texts), 256):
        words = words_of(texts.slice(at, 256))
        for k, (a, b) in enumerate(zip(words.before[:-1].tolist(), words.before[1:].tolist())):
            for first in range(0, max(1, b - a - width + 1), most):
                own = words.names[a + first : min(b, a + first + most + width - 1)]
                names.append(own)
                parts.append((at + k, first))
                held += len(own)
                if held >= most:
                    yield close()
                    names, parts, held = [], [], 0
    if parts:
        yield close()
