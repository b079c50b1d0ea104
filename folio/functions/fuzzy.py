"""Similarity of names in hundredths, from the longest common subsequence, as pandas functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a row of bits for ``a`` (Hyyro's recurrence)."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> int:
    """100 for equal texts, 0 where nothing is shared or either is empty."""
    if not a or not b:
        return 0
    return round(200 * common(a, b) / (len(a) + len(b)))


def partial_ratio(a: str | None, b: str | None) -> int:
    """The best ratio of the shorter text with a stretch of its length in the longer."""
    if not a or not b:
        return 0
    short, long = sorted((a, b), key=len)
    return max(ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def token_set_ratio(a: str | None, b: str | None) -> int:
    """Ratio of sets of words: shared words against those with what either has besides."""
    x, y = (set(re.findall(r"\w+", (t or "").lower())) for t in (a, b))
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (both, " ".join(sorted(own))))) for own in (x - y, y - x))
    return max(ratio(both, left), ratio(both, right), ratio(left, right))


def scorer(score):
    """A column function for pairs of texts, a batch at a time."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="int32")

    return run
