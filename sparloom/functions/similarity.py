"""Similarities of texts and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


#: Cells of a table that are compared at a time.
CELLS = 2_000_000


def _codes(texts: list[str], pad: int) -> np.ndarray:
    """Code points by row, padded."""
    sizes = np.array([len(t) for t in texts])
    out = np.full((len(texts), max(1, sizes.max())), pad, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    return out


def _seeds(b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which code points may begin a match: in texts of 200 or more, those that are not in over one of a hundred
    places, and one more."""
    seeds = b >= 0
    for row in np.flatnonzero(size >= 200):
        own = b[row, : size[row]]
        values, at, counts = np.unique(own, return_inverse=True, return_counts=True)
        seeds[row, : size[row]] = (counts <= size[row] // 100 + 1)[at]
    return seeds


def _longest(a: np.ndarray, b: np.ndarray, seeds: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, size) of the longest run of equal seeds within each of the spans (row, a's start and end, b's), the
    first one in a, then in b; at the spans' starts and of size 0 if there is none. All spans at once: the lengths of
    runs that end at a place of a are those of the place before, moved on by one."""
    row, alo, ahi, blo, bhi = spans.T
    wide, high = int((bhi - blo).max()), int((ahi - alo).max())
    places = np.arange(wide)
    within = places < (bhi - blo)[:, None]
    at = np.minimum(blo[:, None] + places, b.shape[1] - 1)
    own = np.where(within & seeds[row[:, None], at], b[row[:, None], at], -2)
    run, best = np.zeros((len(spans), wide + 1), np.int32), np.zeros(len(spans), np.int32)
    i_end, j_end = np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64)
    for k in range(high):
        here = np.where(alo + k < ahi, a[row, np.minimum(alo + k, a.shape[1] - 1)], -3)
        run[:, 1:] = np.where(own == here[:, None], run[:, :-1] + 1, 0)
        last = run[:, 1:].argmax(axis=1)
        most = run[np.arange(len(spans)), last + 1]
        better = most > best
        best[better], i_end[better], j_end[better] = most[better], k + 1, last[better] + 1
    return alo + i_end - best, blo + j_end - best, best.astype(np.int64)


def _grown(a: np.ndarray, b: np.ndarray, spans: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> None:
    """Lets each run grow over equal code points on both sides, seeds or not."""
    row, alo, ahi, blo, bhi = spans.T
    for left in (True, False):
        open_ = np.arange(len(spans))
        while len(open_):
            x, y = (i[open_] - 1, j[open_] - 1) if left else (i[open_] + size[open_], j[open_] + size[open_])
            inside = (x >= alo[open_]) & (y >= blo[open_]) if left else (x < ahi[open_]) & (y < bhi[open_])
            x, y = np.clip(x, 0, a.shape[1] - 1), np.clip(y, 0, b.shape[1] - 1)
            open_ = open_[inside & (a[row[open_], x] == b[row[open_], y])]
            size[open_] += 1
            if left:
                i[open_] -= 1
                j[open_] -= 1


def matched(left: list[str], right: list[str]) -> np.ndarray:
    """Code points in matching blocks of each pair: the longest one, and those of what is left before and behind it,
    and so on. All pairs go through a level of this at once."""
    a, b = _codes(left, -1), _codes(right, -2)
    sizes = np.array([[len(t) for t in texts] for texts in (left, right)])
    seeds, total = _seeds(b, sizes[1]), np.zeros(len(left), np.int64)
    zero = np.zeros(len(left), np.int64)
    spans = np.stack([np.arange(len(left)), zero, sizes[0], zero, sizes[1]], axis=1)
    while len(spans := spans[(spans[:, 2] > spans[:, 1]) & (spans[:, 4] > spans[:, 3])]):
        spans = spans[np.argsort(spans[:, 4] - spans[:, 3], kind="stable")]
        later, step = [], max(1, CELLS // int((spans[:, 4] - spans[:, 3]).max()))
        for part in (spans[k : k + step] for k in range(0, len(spans), step)):
            i, j, size = _longest(a, b, seeds, part)
            _grown(a, b, part, i, j, size)
            np.add.at(total, part[:, 0], size)
            row, alo, ahi, blo, bhi = part[size > 0].T
            i, j, size = i[size > 0], j[size > 0], size[size > 0]
            later += [np.stack([row, alo, i, blo, j], axis=1), np.stack([row, i + size, ahi, j + size, bhi], axis=1)]
        spans = np.concatenate(later)
    return total


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts in this order (it is not symmetric): twice the code points in matching blocks
    over those of both texts, 1 for two empty ones."""
    pairs = pd.DataFrame({"a": left.fillna("").to_numpy(), "b": right.fillna("").to_numpy()})
    once = pairs.drop_duplicates()
    lengths = once["a"].str.len() + once["b"].str.len()
    once = once.assign(both=lengths).sort_values("both")
    ratio, at = np.ones(len(once)), 0
    while at < len(once):  # pairs of like lengths together, so that little is padding
        size = max(1, int(once["both"].iloc[at]))
        part = once.iloc[at : at + max(1, CELLS // (8 * size))]
        part = part[part["both"] <= 2 * size]
        both = part["both"].to_numpy()
        ratio[at : at + len(part)] = np.where(both > 0, 2.0 * matched(part["a"].tolist(), part["b"].tolist()) / np.maximum(both, 1), 1.0)
        at += len(part)
    return pairs.merge(once.assign(ratio=ratio), on=["a", "b"], how="left")["ratio"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is null or has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def sign_bits(vector: Column) -> Column:
    """64 bits of a vector: bit i is set if element i is positive (the first 64 elements)."""
    return F.aggregate(F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def differing_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
