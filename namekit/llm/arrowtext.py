"""Words of whole Arrow string columns as numpy arrays.

A word is a maximal run of digits, letters a-z (A-Z lower-cased) and bytes above 0x7F, which is the
pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over the lower-cased text: every code point above
U+007F consists of such bytes in UTF-8. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_CODES = np.arange(256)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
IS_WORD = (((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 65) & (_CODES <= 90))
           | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128))

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
#: Bytes hashed at a time; bounds the 64-bit temporaries, also inside one very long text.
PIECE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of some texts. ``low``: lower-cased bytes; ``starts``, ``ends``: byte ranges of the
    words; ``hashes``: 64-bit hashes; ``first``: index of each text's first word, and the total."""

    low: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i]:self.ends[i]].tobytes()


def text_array(column) -> pa.Array:
    """One contiguous large_string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.cast(pa.large_string()).fill_null("")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each text in them."""
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    a, b = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, b - a, a) if b > a else np.zeros(0, np.uint8)
    return raw, offsets - a


def split(texts: pa.Array) -> Words:
    """All words of ``texts``."""
    raw, offsets = buffers(texts)
    low = LOWER[raw]
    n = len(low)
    is_word = np.zeros(n + 1, bool)
    is_word[:n] = IS_WORD[low]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | begins))
    ends = np.flatnonzero(before & (~is_word | begins))
    first = np.searchsorted(starts, offsets)
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        base, stop = int(starts[i]), int(ends[j - 1])
        up, down = _tables(stop - base + 1)
        total = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((low[base:stop].astype(np.uint64) + np.uint64(1)) * up[:stop - base], out=total[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        hashes[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return Words(low, offsets, starts, ends, hashes, first)


_POWER_TABLES: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > PIECE + 1:
        return _powers(_P, n), _powers(_P_INVERSE, n)
    if not _POWER_TABLES:
        _POWER_TABLES.extend([_powers(_P, PIECE + 1), _powers(_P_INVERSE, PIECE + 1)])
    return _POWER_TABLES[0], _POWER_TABLES[1]


def slices(texts: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text each, or of one longer text."""
    if len(texts) == 0:
        return
    _, offsets = buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield i, min(j, n)
        i = j
