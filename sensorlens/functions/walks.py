"""Walks over text whose steps depend on all before them, by running sums over whole buffers instead of a loop over characters.

All of them run on Arrow batches, and texts without the character that makes a walk needed are passed by as null.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def erased(text: str) -> str:
    """``text`` with each backspace taking away the character before it that is left, if there is one.

    The number of characters left is the running sum of 1 for a character and -1 for a backspace, raised by what fell below
    zero. A character stays if the number never again falls below what it was with it.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    back = code == 8
    total = np.cumsum(np.where(back, -1, 1))
    left = total - np.minimum(np.minimum.accumulate(total), 0)
    later = np.minimum.accumulate(left[::-1])[::-1]
    return code[~back & (later >= left)].tobytes().decode("utf-32-le", "surrogatepass")


def substituted(text: str) -> list[str]:
    """What stands inside each outermost ``$( )`` of ``text``, parentheses inside counted, up to one that nothing closes.

    Depths are running sums over the parentheses alone; what closes one is the next place of the depth before it.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    at = np.flatnonzero((raw == 40) | (raw == 41))
    opening = raw[at] == 40
    depth = np.cumsum(np.where(opening, 1, -1))
    n = len(at)
    # Places by depth: steps are of one, so the next place of the depth before is where it closes.
    place = (depth - depth.min(initial=0)).astype(np.int64) * (n + 1) + np.arange(n)
    order = np.sort(place)
    start = np.flatnonzero(opening & (at > 0) & (raw[np.maximum(at, 1) - 1] == 36))
    wanted = place[start] - (n + 1) + 1
    found = np.searchsorted(order, wanted)
    closes = np.where(found < n, order[np.minimum(found, n - 1)], -1)
    closes = np.where((closes >= 0) & (closes // (n + 1) == wanted // (n + 1)) & (wanted >= 0), closes % (n + 1), -1)
    # From one that closes the next that opens behind it.
    after = np.searchsorted(start, closes, side="right").tolist()
    firsts, lasts, data = (at[start] + 1).tolist(), np.where(closes >= 0, at[closes], -1).tolist(), raw.tobytes()
    out, k = [], 0
    while k < len(firsts) and lasts[k] >= 0:
        out.append(data[firsts[k] : lasts[k]].decode("utf-8", "surrogatepass"))
        k = after[k]
    return out


def common(x: list[str], y: list[str]) -> int:
    """The length of the longest common subsequence, a whole row of the table in a few operations on long integers."""
    if len(x) < len(y):
        x, y = y, x
    places: dict[str, int] = {}
    for k, word in enumerate(y):
        places[word] = places.get(word, 0) | 1 << k
    every = (1 << len(y)) - 1
    row = every  # a zero where the row of the table grows by one
    for word in x:
        hit = row & places.get(word, 0)
        if hit:
            row = (row + hit | row - hit) & every
    return len(y) - row.bit_count()


def backspaced(text: Column) -> Column:
    """``text`` without backspaces and what they take away."""

    @F.pandas_udf("string")
    def walk(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield series.map(erased, na_action="ignore")

    some = text.contains("\b")
    return F.when(some, walk(F.when(some, text))).otherwise(text)


def substitutions(text: Column) -> Column:
    """The list of what stands in the outermost ``$( )`` of ``text``; empty for null."""

    @F.pandas_udf("array<string>")
    def walk(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield series.map(lambda t: substituted(t) if t else [])

    some = text.contains("$(")
    return F.when(some, walk(F.when(some, text))).otherwise(F.array().cast("array<string>"))


def common_words(a: Column, b: Column) -> Column:
    """The words of the longest common subsequence of two texts, cut at white space, in any case."""

    @F.pandas_udf("long")
    def walk(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series([common((p or "").lower().split(), (q or "").lower().split()) for p, q in zip(x, y, strict=True)])

    return walk(a, b)
