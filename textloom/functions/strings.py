"""Jaro and Jaro-Winkler similarity of strings."""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.cognate import by_lengths, of_pairs


def jaro_score(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left: list[str] = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, (ch for ch, u in zip(b, used, strict=True) if u), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_score(a: str, b: str, prefix_weight: float = 0.1) -> float:
    base = jaro_score(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return base + same * prefix_weight * (1 - base)


def jaro_scores(a: list[str], b: list[str]) -> np.ndarray:
    """jaro_score of many pairs: those of equal lengths are matched together, letter by letter."""
    out = np.zeros(len(a))
    for at, x, y in by_lengths(a, b):
        n, m = x.shape[1], y.shape[1]
        if not n or not m:
            out[at] = float(n == m)
            continue
        reach = max(0, max(n, m) // 2 - 1)
        left, right = np.zeros(x.shape, dtype=bool), np.zeros(y.shape, dtype=bool)
        for i in range(n):
            for j in range(max(0, i - reach), min(m, i + reach + 1)):
                hit = ~left[:, i] & ~right[:, j] & (x[:, i] == y[:, j])
                left[:, i] |= hit
                right[:, j] |= hit
        hits = left.sum(axis=1)
        # The matched letters of either word moved to the front, in order.
        k = min(n, m)
        p = np.take_along_axis(x, np.argsort(~left, axis=1, kind="stable"), 1)[:, :k]
        q = np.take_along_axis(y, np.argsort(~right, axis=1, kind="stable"), 1)[:, :k]
        swaps = ((p != q) & (np.arange(k) < hits[:, None])).sum(axis=1) // 2
        most = np.maximum(hits, 1)
        found = np.where(hits > 0, (hits / n + hits / m + (hits - swaps) / most) / 3, 0.0)
        out[at] = np.where((x == y).all(axis=1), 1.0, found) if n == m else found
    return out


def jaro_winkler_scores(a: list[str], b: list[str], prefix_weight: float = 0.1) -> np.ndarray:
    base = jaro_scores(a, b)
    same = np.array([len(commonprefix([s[:4], t[:4]])) for s, t in zip(a, b, strict=True)])
    return base + same * prefix_weight * (1 - base)


def _column(fn, a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return of_pairs(fn, x, y)

    return scored(a, b)


def jaro(a: Column, b: Column) -> Column:
    return _column(jaro_scores, a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _column(jaro_winkler_scores, a, b)
