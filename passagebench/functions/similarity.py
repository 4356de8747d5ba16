"""Fuzzy containment: the best alignment of a short string in a long one.

The ratio of two strings is 2 M / (m + n) with M the length of their longest common subsequence; the partial ratio is the best
ratio of the shorter against windows of the longer of its length, the truncated ones at both ends included. LCS lengths come
from the bit-parallel recurrence on Python integers, so a window costs one pass over its characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


Q = 3


def grams(text: str) -> np.ndarray:
    """A number for each run of Q characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:] if len(c) >= Q else c[:0]


def possible_ends(m: int, own: np.ndarray, others: np.ndarray, n: int, above: float) -> np.ndarray | None:
    """Where a window with a ratio above that may end; None if that can't be told.

    own: the sorted grams of the short string, of length m; others: those of the long one, of length n. A character that isn't
    matched spoils at most Q grams of the short string, one that the window has more at most Q - 1; what is left must
    stand in the window.
    """
    if not len(own):
        return None
    at = np.minimum(np.searchsorted(own, others), len(own) - 1)
    known = np.concatenate([[0], np.cumsum(own[at] == others)])
    end = np.arange(1, n + m)
    low, high = np.maximum(end - m, 0), np.minimum(end, n)
    size = high - low
    matched = above * (m + size) / 2
    need = (m - Q + 1) - Q * (m - matched) - (Q - 1) * (size - matched)
    if (need <= 0).all():
        return None
    last = np.clip(high - Q + 1, 0, len(others))
    return end[known[np.maximum(last, low.clip(max=len(others)))] - known[low.clip(max=len(others))] >= np.floor(need)]


def best_alignment(short: str, long: str, above: float = 0.0, ends: np.ndarray | None = None) -> tuple[float, int, int]:
    """Ratio, start and end of the best window, the first of equals; zeros if no ratio exceeds `above`. ends: the only places
    where such a window can end.

    A window that is d places on shares at most d characters more, so after a ratio r the next that can beat the best so far
    is (best - r) times the window's length on; no window is missed by going there at once.
    """
    if not short or not long:
        return (1.0 if short == long else 0.0), 0, 0
    if len(short) > len(long):
        r, _, _ = best_alignment(long, short, above)
        return r, 0, len(long)
    m = len(short)
    at = long.find(short)
    if at >= 0:
        return 1.0, at, at + m
    best = (above, 0, 0)
    places = iter(() if ends is None else ends.tolist())
    end = 1 if ends is None else 0
    while end < len(long) + m:
        if ends is not None:
            end = next((e for e in places if e >= end), len(long) + m)
            if end >= len(long) + m:
                break
        lo, hi = max(0, end - m), min(end, len(long))
        if 2 * (hi - lo) / (m + hi - lo) <= best[0]:  # cut off at an end, and too short for any ratio above the best
            end += 1
            continue
        r = ratio(short, long[lo:hi])
        if r > best[0]:
            best = r, lo, hi
        whole = m <= end <= len(long)
        step = int((best[0] - r) * m) if whole else 0
        end = min(end + max(1, step), len(long) + 1) if whole else end + 1
    return best if best[2] else (0.0, 0, 0)


def partial_ratio(short: str, long: str, above: float = 0.0) -> float:
    return best_alignment(short, long, above)[0]


@F.pandas_udf(DoubleType())
def _partial_ratio(pairs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, least in pairs:
        yield pd.Series([None if x is None or y is None else partial_ratio(x, y, t) for x, y, t in zip(a, b, least)], dtype="float64")


def partial_ratio_column(short: Column, long: Column, above: float = 0.0) -> Column:
    return _partial_ratio(short, long, F.lit(float(above)))
