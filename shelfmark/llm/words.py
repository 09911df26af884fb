"""Words, word hashes and shingles of Arrow text batches, in whole-column numpy steps.

A word is a run of bytes that are none of the six ASCII blanks, which in UTF-8
equals ``[^\\x20\\x09-\\x0D]+`` over characters. Words are hashed as polynomials over
the bytes modulo 2^64 and mixed; prefix sums give all words of a slice at once. The
same word has the same hash in every task, on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE = 512 << 10
SHINGLE = 5

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


IN_WORD = np.ones(256, bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    filled, step = 1, base
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(step)
        filled, step = filled + more, step * step & _MASK
    return out


_power_tables: list[np.ndarray] = [_powers(_BASE, 1), _powers(_INVERSE, 1)]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power_tables[0]) < n:
        if n > SLICE + 1:  # one very long text: not kept
            return _powers(_BASE, n), _powers(_INVERSE, n)
        _power_tables[:] = [_powers(_BASE, SLICE + 1), _powers(_INVERSE, SLICE + 1)]
    return _power_tables[0], _power_tables[1]


@dataclass
class Words:
    """The words of some consecutive texts: byte spans, and each text's share of them."""

    data: np.ndarray  # bytes of all the texts
    texts: np.ndarray  # n + 1 byte offsets
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n + 1 offsets into the words

    def hashes(self, lower: bool = True) -> np.ndarray:
        return self.span_hashes(self.start, self.end, lower)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
        """A hash of the bytes of each span."""
        power, inverse = _power_table(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_LOWERED if lower else _VALUES)[self.data] * power[: len(self.data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(data: np.ndarray, texts: np.ndarray) -> Words:
    inside = IN_WORD[data]
    n = len(data)
    opens, closes = inside.copy(), inside.copy()
    if n:
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        begins = texts[:-1][np.diff(texts) > 0]
        opens[begins] = inside[begins]
        closes[begins[begins > 0] - 1] = inside[begins[begins > 0] - 1]
    start = np.flatnonzero(opens)
    return Words(data, texts, start, np.flatnonzero(closes) + 1, np.searchsorted(start, texts))


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def slices_of_words(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, Words]]:
    for row, stop, data, offsets in text_slices(column, limit):
        yield row, stop, split_words(data, offsets)


def windows_hashed(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive words, not minding where texts end."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD1B54A32D192ED03) + hashes[k : k + n]
    return mix(out)


def shingle_set(hashes: np.ndarray, windows: np.ndarray, a: int, b: int, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingles of the text with words a to b; the whole text if it is shorter than one."""
    if b - a >= width:
        return np.unique(windows[a : b - width + 1])
    if b == a:
        return np.zeros(0, np.uint64)
    return windows_hashed(hashes[a:b] ^ np.uint64(b - a), b - a)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from concatenated values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
