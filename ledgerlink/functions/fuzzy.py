"""Fuzzy name similarity: subsequence ratios, token ratios, OCR variants.

The only Python that touches rows are the ratios, Arrow functions meant for candidate pairs, which
compare the pairs of a batch together (``best_window_ratio`` one by one), and
``best_in_block``, which compares a block of texts with a block of names.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from ledgerlink.functions.numeric import round_half_up
from ledgerlink.functions.scores import clean, edit_similarity

# Characters a scanner confuses, at most two replacements each.
OCR_SWAPS = {
    "0": ["O", "o"], "O": ["0", "Q"], "1": ["I", "l"], "I": ["1", "l"], "2": ["Z"], "Z": ["2"],
    "5": ["S", "s"], "S": ["5", "s"], "6": ["G", "b"], "G": ["6", "b"], "8": ["B"], "B": ["8"],
}
OCR_MAX_LENGTH, OCR_MAX_VARIANTS = 50, 5

# Executors get these functions with the task, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def percent_ratio(a: str | None, b: str | None) -> int:
    """round(100 * 2 * common / total length); equal texts give 100."""
    if a is None or b is None:
        return 0
    if a == b:
        return 100
    total = len(a) + len(b)
    return round(200.0 * common_subsequence(a, b) / total) if total else 0


#: Longest texts whose pairs are compared together, one bit per character of the first text.
_TOGETHER = 64


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """``common_subsequence`` of many pairs at once, for texts of up to 64 characters.

    All pairs walk along their second texts together; the row of a pair is one 64-bit number.
    """
    n, m = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    width = next(w for w in (8, 16, 32, 64) if w >= n.max(initial=1))
    x = np.array(a, f"<U{width}").view(np.uint32).reshape(len(a), width)
    y = np.array(b, f"<U{m.max(initial=1)}").view(np.uint32).reshape(len(b), -1)
    full = np.where(n > 0, np.uint64(2**64 - 1) >> (64 - np.maximum(n, 1)).astype(np.uint64), np.uint64(0))
    row = full.copy()
    for j in range(m.max(initial=0)):
        where = np.packbits((x == y[:, j, None]).ravel(), bitorder="little").view(f"<u{width // 8}").astype(np.uint64)
        hit = np.where(j < m, row & where, np.uint64(0))
        row = ((row + hit) | (row - hit)) & full
    return n - np.bitwise_count(row).astype(np.int64)


def percent_ratios(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """``percent_ratio`` of every pair; pairs with a long text are compared one by one."""
    out, short, long = np.zeros(len(a), np.int32), [], {}
    for i, (x, y) in enumerate(zip(a, b)):
        if x is not None and x == y:
            out[i] = 100
        elif x and y:
            if len(x) <= _TOGETHER and len(y) <= _TOGETHER:
                short.append(i)
            else:
                long.setdefault((x, y), []).append(i)
    for pair, at in long.items():
        out[at] = percent_ratio(*pair)
    if short:
        xs, ys = [a[i] for i in short], [b[i] for i in short]
        total = np.array([len(x) + len(y) for x, y in zip(xs, ys)])
        out[short] = np.rint(200.0 * common_subsequences(xs, ys) / total)
    return out


def percent_window(a: str | None, b: str | None) -> int:
    """Best ``percent_ratio`` of the shorter text against equally long windows."""
    if not a or not b:
        return 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return max(percent_ratio(short, long[i:i + len(short)]) for i in range(len(long) - len(short) + 1))


def _pairwise(fn, a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple, int] = {}
    out = []
    for pair in zip(a, b):
        if pair not in seen:
            seen[pair] = fn(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="int32")


@F.pandas_udf(IntegerType())
def subsequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(percent_ratios(a.tolist(), b.tolist()), dtype="int32")


@F.pandas_udf(IntegerType())
def best_window_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(percent_window, a, b)


@F.pandas_udf(DoubleType())
def subsequence_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * common / total length, without rounding; two empty texts give 0."""
    return pd.Series([2.0 * common_subsequence(x, y) / (len(x) + len(y)) if x is not None and y is not None and len(x) + len(y) else 0.0 for x, y in zip(a, b)], dtype="float64")


_WORD = re.compile("[a-z0-9_]+")


@F.pandas_udf(IntegerType())
def _sorted_words_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = ([None if t is None else " ".join(sorted(_WORD.findall(t))) for t in side.tolist()] for side in (a, b))
    return pd.Series(percent_ratios(x, y), dtype="int32")


@F.pandas_udf(IntegerType())
def _word_sets_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    shared, left, right = [], [], []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = (set(_WORD.findall(t or "")) for t in (x, y))
        both = sorted(p & q) if p and q else []
        shared.append(" ".join(both))
        # Without words on either side nothing is compared.
        left.append(" ".join(both + sorted(p - q)) if p and q else None)
        right.append(" ".join(both + sorted(q - p)) if p and q else None)
    best = np.maximum(percent_ratios(left, right), np.maximum(percent_ratios(shared, left), percent_ratios(shared, right)))
    return pd.Series(best, dtype="int32")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Ratio of the texts' lower-case alphanumeric words in order."""
    return _sorted_words_ratio(F.lower(a), F.lower(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio among the shared words and the two texts rebuilt around them; 0 when a text has no words."""
    return _word_sets_ratio(F.lower(a), F.lower(b))


def similarity(a: Column, b: Column, method: str = "composite") -> Column:
    """0-1 similarity by method; 0 when a side is empty, 1 when equal after cleaning."""
    x, y = clean(a), clean(b)
    if method == "levenshtein":
        return edit_similarity(a, b)
    if method == "phonetic":
        score = F.when(F.soundex(x) == F.soundex(y), 1.0).otherwise(0.0)
    elif method == "composite":
        score = (edit_similarity(a, b) * 0.3 + token_sort_ratio(x, y) / 100.0 * 0.4
                 + token_set_ratio(x, y) / 100.0 * 0.3)
    else:
        ratio = {
            "fuzzy_ratio": subsequence_ratio, "fuzzy_partial": best_window_ratio,
            "fuzzy_token_sort": token_sort_ratio, "fuzzy_token_set": token_set_ratio,
        }[method](x, y)
        score = ratio / 100.0
    empty = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(empty, 0.0).when(x == y, 1.0).otherwise(score)


def ocr_variants(c: Column, limit: int = OCR_MAX_VARIANTS) -> Column:
    """The text itself, then single-character swaps in position order.

    Each confusable character gives its first swap; the second swap is added only while fewer than
    ``limit`` variants have been made, so every position is represented whatever the length.
    """
    swaps = F.create_map(*[part for key, subs in OCR_SWAPS.items()
                           for part in (F.lit(key), F.array(*[F.lit(s) for s in subs]))])
    upper = F.upper(c)

    def grown(made: Column, i: Column) -> Column:
        subs = F.coalesce(F.element_at(swaps, F.substr(upper, i, F.lit(1))), F.array().cast("array<string>"))

        def swapped(n: int) -> Column:
            v = F.concat(F.substr(upper, F.lit(1), i - 1), F.get(subs, F.lit(n)), F.substr(upper, i + 1))
            return F.array(v, F.lower(v))

        one = F.array_union(made, swapped(0))
        two = F.when((F.size(one) < limit) & (F.size(subs) > 1), F.array_union(one, swapped(1))).otherwise(one)
        return F.when(F.size(subs) == 0, made).otherwise(two)

    every = F.aggregate(F.sequence(F.lit(1), F.length(c)), F.array(c), grown)
    return F.when(F.coalesce(F.length(c), F.lit(0)).between(1, OCR_MAX_LENGTH), every).otherwise(F.array(c))


def composite_rounded(a: Column, b: Column) -> Column:
    return round_half_up(similarity(a, b), 6)


# --- best name of a block ---------------------------------------------------------------

#: Bins of characters: letters, digits and the underscore one each, then what stands between words.
_WORD_BINS, _BINS = 37, 64
_BIN = np.full(128, 38)
_BIN[[ord(ch) for ch in "abcdefghijklmnopqrstuvwxyz0123456789_ "]] = np.arange(38)
BLOCK_SCHEMA = "tenant_id int, text string, best_match string, score double"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, one bit per character of ``a``."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for ch in b:
        hit = where.get(ch, 0)
        same = (((hit & up) + up) ^ up) | hit | down
        more, less = (down | ~(same | up)) & full, same & up
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1) | 1, less << 1
        up, down = (less | ~(same | more)) & full, more & same & full
    return distance


class _Forms:
    """Cleaned texts with their sorted words, distinct words, lengths and characters per bin."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        words = [_WORD.findall(k) for k in keys]
        self.ordered = [" ".join(sorted(w)) for w in words]
        self.distinct = [sorted(set(w)) for w in words]
        self.length = np.array([len(k) for k in keys])
        self.ordered_length = np.array([len(x) for x in self.ordered])
        self.gaps = np.array([max(0, len(w) - 1) for w in words])
        self.distinct_length = np.array([len(" ".join(w)) for w in self.distinct])
        self.bins = np.zeros((len(keys), _BINS), np.int16 if self.length.max(initial=0) < 1 << 15 else np.int32)
        for i, k in enumerate(keys):
            codes = np.frombuffer(k.encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.where(codes < 128, _BIN[np.minimum(codes, 127)], 39 + codes % 25)
            self.bins[i] = np.bincount(at, minlength=_BINS)


def _most(a: _Forms, i: int, b: _Forms, holders: dict[str, np.ndarray]) -> np.ndarray:
    """What the composite similarity of text ``i`` and each name can be at most.

    An edit keeps at most the characters common to both, and so does a subsequence; words in
    common count with their exact length. Percentages are rounded, by half of one at most.
    """
    both = np.minimum(a.bins[i], b.bins)
    in_words = both[:, :_WORD_BINS].sum(1, dtype=np.int64)
    edit = (in_words + both[:, _WORD_BINS:].sum(1, dtype=np.int64)) / np.maximum(1, np.maximum(a.length[i], b.length))
    kept = in_words + np.minimum(a.gaps[i], b.gaps)

    def ratio(common: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        common = np.minimum(common, np.minimum(x, y))
        return np.where(x + y > 0, 2 * common / np.maximum(1, x + y) + 0.005, 1.0)

    shared = np.zeros(len(b.keys), np.int64)
    for w in a.distinct[i]:
        shared[holders.get(w, [])] += len(w) + 1
    shared = np.maximum(0, shared - 1)
    left, right = a.distinct_length[i], b.distinct_length
    words = np.maximum(ratio(kept, left, right), np.maximum(ratio(shared, shared, left), ratio(shared, shared, right)))
    return edit * 0.3 + ratio(kept, a.ordered_length[i], b.ordered_length) * 0.4 + words * 0.3


def _composite(a: _Forms, i: int, b: _Forms, j: int) -> float:
    """``similarity`` of two cleaned texts."""
    x, y = a.keys[i], b.keys[j]
    if x == y:
        return 1.0
    edit = 1.0 - float(edit_distance(x, y)) / max(len(x), len(y))
    p, q = a.distinct[i], b.distinct[j]
    words = 0
    if p and q:
        common = [w for w in p if w in q]
        shared = " ".join(common)
        left = " ".join(common + [w for w in p if w not in q])
        right = " ".join(common + [w for w in q if w not in p])
        words = max(percent_ratio(shared, left), percent_ratio(shared, right), percent_ratio(left, right))
    return edit * 0.3 + percent_ratio(a.ordered[i], b.ordered[j]) / 100.0 * 0.4 + words / 100.0 * 0.3


def best_in_block(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
    """Closest of the ``stored`` names (candidate, key) to each of the ``asked`` texts (tenant_id,
    text, keys of its variants) by composite similarity, the smallest name among equals. Texts to
    which no name is similar at all have no row.

    Pairs are scored from the highest bound down, until no bound reaches the best score.
    """
    out = []
    if len(asked) and len(stored):
        names = stored["candidate"].tolist()
        b = _Forms(stored["key"].tolist())
        holders: dict[str, list[int]] = {}
        for j, words in enumerate(b.distinct):
            for w in words:
                holders.setdefault(w, []).append(j)
        at = {w: np.array(js) for w, js in holders.items()}
        for tenant, text, keys in zip(asked["tenant_id"], asked["text"], asked["keys"]):
            a = _Forms(list(keys))
            most = np.concatenate([_most(a, i, b, at) for i in range(len(a.keys))])
            n, best, name = len(names), 0.0, None
            first = int(most.argmax())
            least = _composite(a, first // n, b, first % n) - 1e-9
            reach = np.flatnonzero(most >= least)
            for k in reach[np.argsort(-most[reach])]:
                if most[k] < best - 1e-9:
                    break
                score = _composite(a, k // n, b, k % n)
                if score > best or (score == best and score > 0 and names[k % n] < name):
                    best, name = score, names[k % n]
            if name is not None:
                out.append((tenant, text, name, best))
    return pd.DataFrame(out, columns=["tenant_id", "text", "best_match", "score"])
