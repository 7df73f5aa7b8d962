"""Jaro and Jaro-Winkler similarity over candidate pairs in Arrow batches.

A batch of pairs is worked on column by column of the first texts: the places in the second texts
that hold the same character, lie in the matching window and are free are one 64-bit word per pair,
and its lowest bit is the match. Texts over 64 characters take the same steps with Python's long
integers. Distinct pairs are compared once per batch.

Two readings are in use. The one here counts half a transposition per character out of order and
adds the common prefix always; ``strict`` drops an odd half and adds the prefix only above 0.7.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PREFIX_WEIGHT, PREFIX_LENGTH, PREFIX_FROM = 0.1, 4, 0.7
WORD = 64
_PAIR = StructType().add("jaro", DoubleType()).add("winkler", DoubleType())
_ONES = np.array([(1 << k) - 1 for k in range(WORD + 1)], np.uint64)
_BITS = np.array([1 << k for k in range(WORD)], np.uint64)


def matched_long(a: str, b: str) -> tuple[int, int]:
    """(characters matched, matched characters out of order) of texts of any length."""
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    places: dict[str, int] = {}
    for j, ch in enumerate(b):
        places[ch] = places.get(ch, 0) | (1 << j)
    used, kept = 0, []
    for i, ch in enumerate(a):
        low, high = max(0, i - reach), min(i + reach + 1, len(b))
        free = places.get(ch, 0) & ~used & ((1 << high) - 1) >> low << low if high > low else 0
        if free:
            used |= free & -free
            kept.append(ch)
    other = [ch for j, ch in enumerate(b) if used >> j & 1]
    return len(kept), sum(x != y for x, y in zip(kept, other))


def _codes(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint32)
    for i, t in enumerate(texts):
        out[i, :len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def matched(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``matched_long`` of many pairs of at most ``WORD`` characters at once."""
    len_a, len_b = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    x, y = _codes(a, int(len_a.max(initial=0))), _codes(b, int(len_b.max(initial=0)))
    reach = np.maximum(0, np.maximum(len_a, len_b) // 2 - 1)
    used = np.zeros(len(a), np.uint64)
    in_a = np.zeros(x.shape, bool)
    own = np.arange(y.shape[1])[None, :] < len_b[:, None]
    for i in range(x.shape[1]):
        low, high = np.maximum(0, i - reach), np.minimum(i + reach + 1, len_b)
        window = np.where(high > low, _ONES[high] & ~_ONES[np.minimum(low, WORD)], np.uint64(0))
        same = np.where((y == x[:, i:i + 1]) & own, _BITS[None, :y.shape[1]], np.uint64(0)).sum(axis=1, dtype=np.uint64)
        free = np.where(i < len_a, same & window & ~used, np.uint64(0))
        lowest = free & (~free + np.uint64(1))
        used |= lowest
        in_a[:, i] = lowest != 0
    in_b = (used[:, None] & _BITS[None, :y.shape[1]]) != 0
    n = in_a.sum(axis=1)
    first = np.take_along_axis(x, np.argsort(~in_a, axis=1, kind="stable"), axis=1)
    second = np.take_along_axis(y, np.argsort(~in_b, axis=1, kind="stable"), axis=1)
    width = min(first.shape[1], second.shape[1])
    moved = ((first[:, :width] != second[:, :width]) & (np.arange(width)[None, :] < n[:, None])).sum(axis=1)
    return n, moved


def _similarities(a: list[str], b: list[str], strict: bool) -> np.ndarray:
    """Rows of (jaro, jaro-winkler)."""
    n, moved = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    long = np.array([max(len(x), len(y)) > WORD for x, y in zip(a, b)], bool)
    short = np.flatnonzero(~long)
    if len(short):
        n[short], moved[short] = matched([a[i] for i in short], [b[i] for i in short])
    for i in np.flatnonzero(long):
        n[i], moved[i] = matched_long(a[i], b[i])
    len_a, len_b = (np.maximum(1, np.array([len(t) for t in x], np.float64)) for x in (a, b))
    half = moved // 2 if strict else moved / 2
    some = np.maximum(1, n).astype(np.float64)
    jaro = np.where(n > 0, (n / len_a + n / len_b + (n - half) / some) / 3.0, 0.0)
    same = np.array([x == y for x, y in zip(a, b)], bool)
    jaro[same & (np.array([len(t) for t in a]) > 0)] = 1.0
    prefix = np.array([next((k for k in range(min(len(x), len(y), PREFIX_LENGTH)) if x[k] != y[k]), min(len(x), len(y), PREFIX_LENGTH)) for x, y in zip(a, b)], np.float64)
    winkler = jaro + PREFIX_WEIGHT * prefix * (1 - jaro)
    if strict:
        winkler = np.where(jaro > PREFIX_FROM, winkler, jaro)
    else:
        winkler[same] = 1.0
    return np.column_stack([jaro, winkler])


def _pairs(a: pd.Series, b: pd.Series, strict: bool) -> pd.DataFrame:
    rows = pd.DataFrame({"a": a.to_numpy(), "b": b.to_numpy()}, dtype=object)
    known = rows.dropna().drop_duplicates()
    out = pd.DataFrame(np.full((len(rows), 2), np.nan), columns=["jaro", "winkler"])
    if len(known):
        values = _similarities(known["a"].tolist(), known["b"].tolist(), strict)
        place = {pair: k for k, pair in enumerate(zip(known["a"], known["b"]))}
        at = [place.get(pair, -1) for pair in zip(rows["a"], rows["b"])]
        hit = np.array(at) >= 0
        out.loc[hit, ["jaro", "winkler"]] = values[np.array(at)[hit]]
    return out.astype(object).where(out.notna(), None)


@F.pandas_udf(_PAIR)
def _similar(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return _pairs(a, b, False)


@F.pandas_udf(_PAIR)
def _similar_strict(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return _pairs(a, b, True)


def jaro_similarities(a: Column, b: Column, strict: bool = False) -> Column:
    """Struct (jaro, winkler) of two texts; nulls for a null text. Two empty texts have jaro 0."""
    return (_similar_strict if strict else _similar)(a, b)
