"""Words and lines of a batch of texts as numpy arrays: positions and 64-bit hashes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. Hashes are sums of tabulated byte values times powers of an odd base, finished by an
avalanche step, so all words of a slice are hashed by a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTES = np.arange(256, dtype=np.uint8)
_VALUE = mix((np.arange(256, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_SPACE = np.isin(_BYTES, [0x20, 9, 10, 11, 12, 13])
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(size, base, _U)
            row[0] = 1
            _powers.append(np.multiply.accumulate(row))
    return _powers


@dataclass
class TextSlice:
    """Some texts: their bytes, and the words with the index of their text."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    _sums: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte range."""
        inverse = _power_tables(len(self.data) + 1)[1]
        return mix((self._sums[end] - self._sums[start]) * inverse[start] + (end - start).astype(_U))

    @property
    def words(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    @property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each text's bytes."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def is_space(self) -> np.ndarray:
        return _SPACE[self.data]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each line; lines are what line feeds separate."""
        feeds = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.offsets[:-1], feeds + 1]))
        end = np.sort(np.concatenate([feeds, self.offsets[1:]]))
        return start, end, np.repeat(np.arange(self.docs), self.per_doc(self.data == 10) + 1)

    def windows(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``size`` words within one text."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1:size - 1 + n])
        return at, window_hashes(hashes, size)[at]


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes, whatever text they are in."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for k in range(size):
        total = total * _U(_BASE) + hashes[k:k + n]
    return mix(total)


def text_slice(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> TextSlice:
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] |= word[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] |= word[edges]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets[1:], start, side="right")
    powers = _power_tables(len(data) + 1)[0]
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_VALUE[data] * powers[:len(data)], out=sums[1:])
    return TextSlice(data, offsets, start, end, doc, sums)


def slices(batch: pa.RecordBatch, column: str = "text", lower: bool = False) -> Iterator[tuple[pa.RecordBatch, TextSlice]]:
    """The batch in pieces of about ``SLICE_BYTES`` of text (one text at least); null is empty text."""
    at = batch.schema.get_field_index(column)
    texts = batch.column(at).cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(texts))
        own = offsets[row:stop + 1]
        yield batch.slice(row, stop - row), text_slice(data[own[0]:own[-1]], own - own[0], lower)
        row = stop
    pa.default_memory_pool().release_unused()
