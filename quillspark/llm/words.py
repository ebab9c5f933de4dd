"""Words and word shingles of Arrow text columns, as 64-bit hashes, without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. The hash of a word is a
polynomial in a random table's values modulo 2 ** 64, read off prefix sums, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(2024)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_parts(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, bytes, bounds of each row in the bytes) of runs of whole texts of about most bytes."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, side="right")) - 1)
        yield a, b, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of the first word of each text (one more at the end)."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = bounds[1:] > bounds[:-1]
    starts, ends = bounds[:-1][full], bounds[1:][full] - 1
    first[starts] = inside[starts]
    last[ends] = inside[ends]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers_to(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[data] * power[:n], out=sums[1:])
    return mix((sums[last] - sums[first]) * inverse[first]), np.searchsorted(first, bounds)


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; with fewer words, of the whole sequence."""
    if len(words) >= size:
        runs = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            runs += words[k : len(words) - size + 1 + k] * _PLACE[k]
        runs = mix(runs)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * _PLACE[size : size + b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.empty(0, np.uint64)
