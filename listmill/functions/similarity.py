"""Likeness of short texts by matching blocks: an Arrow kernel that compares all pairs of a batch at once.

Letters, digits and underscores of both texts count, lower-cased. The longest common block (the first one in the first text, then in
the second, if several are as long) splits both texts; what stands before and behind it is compared in the same way. The ratio is
twice the characters in blocks over all characters. Texts are cut at MOST characters, which bounds the work on a pair.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 160
#: Pairs of a batch that are compared at once.
TOGETHER = 512
_NO_WORD = re.compile(r"\W+")


def plain(text: str | None) -> str:
    return _NO_WORD.sub("", text[:MOST].lower()) if text else ""


def _points(texts: list[str], fill: int) -> np.ndarray:
    """Code points, one text a row, filled up with a number that no other text has."""
    out = np.full((len(texts), max(map(len, texts), default=0)), fill, np.int32)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le"), "<i4")
    return out


def longest_blocks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of a and b the longest common block: start in a, start in b, length."""
    n = len(a)
    best, at_a, at_b = (np.zeros(n, np.int32) for _ in range(3))
    runs, rows = np.zeros((n, b.shape[1] + 1), np.int16), np.arange(n)
    for i in range(a.shape[1]):
        longer = np.zeros_like(runs)
        np.multiply(runs[:, :-1] + 1, a[:, i : i + 1] == b, out=longer[:, 1:])
        runs = longer
        end = runs.argmax(axis=1)
        length = runs[rows, end]
        better = length > best
        best[better] = length[better]
        at_a[better], at_b[better] = i + 1 - length[better], end[better] - length[better]
    return at_a, at_b, best


def matched(left: list[str], right: list[str]) -> np.ndarray:
    """Characters in matching blocks of each pair."""
    total = np.zeros(len(left), np.int64)
    a, b = _points(left, -1), _points(right, -2)
    pair = np.arange(len(left))
    from_a, from_b = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    to_a, to_b = np.array([len(t) for t in left], np.int64), np.array([len(t) for t in right], np.int64)
    while True:
        on = (to_a > from_a) & (to_b > from_b)
        pair, from_a, to_a, from_b, to_b = pair[on], from_a[on], to_a[on], from_b[on], to_b[on]
        if not len(pair):
            return total
        parts = []
        for points, start, end, fill in ((a, from_a, to_a, -1), (b, from_b, to_b, -2)):
            at = start[:, None] + np.arange(int((end - start).max()))
            parts.append(np.where(at < end[:, None], points[pair[:, None], np.minimum(at, points.shape[1] - 1)], fill))
        i, j, k = longest_blocks(*parts)
        np.add.at(total, pair, k)
        some = k > 0
        pair, i, j, k = pair[some], from_a[some] + i[some], from_b[some] + j[some], k[some]
        from_a, to_a, from_b, to_b = (np.concatenate(x) for x in ((from_a[some], i + k), (i, to_a[some]), (from_b[some], j + k), (j, to_b[some])))
        pair = np.concatenate((pair, pair))


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Ratio of each pair of plain() texts; 0 where one is empty."""
    out = np.zeros(len(left))
    for at in range(0, len(left), TOGETHER):
        a, b = left[at : at + TOGETHER], right[at : at + TOGETHER]
        sizes = np.array([len(x) + len(y) if x and y else 0 for x, y in zip(a, b, strict=True)])
        out[at : at + TOGETHER] = np.divide(2.0 * matched(a, b), sizes, out=np.zeros(len(a)), where=sizes > 0)
    return out


@F.pandas_udf(T.DoubleType())
def _closest(text: pd.Series, others: pd.Series) -> pd.Series:
    rows, left, right = [], [], []
    for row, (t, some) in enumerate(zip(text, others, strict=True)):
        for o in [] if t is None or some is None else some:
            rows.append(row)
            left.append(plain(t))
            right.append(plain(o))
    out = np.zeros(len(text))
    np.maximum.at(out, rows, ratios(left, right))
    return pd.Series(out)


def closest(text: Column, others: Column) -> Column:
    """The greatest ratio of a text and an array of texts; 0 for nulls and for texts without letters or digits."""
    return _closest(text, others)


def similarity(a: Column, b: Column) -> Column:
    return closest(a, F.array(b))
