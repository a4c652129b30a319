"""Words of Arrow string columns as numpy arrays: spans and 64-bit hashes without a Python object per word.

Two word rules are offered, both on UTF-8 bytes after A-Z became a-z: ``ALNUM`` keeps digits, letters and every byte
of a non-ASCII code point (the expression ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``), ``SPACED`` keeps all but the blank
characters 0x09-0x0D and 0x20 (``[^\\x20\\x09-\\x0D]+``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOW = np.arange(256)
ALNUM = ((_LOW >= 48) & (_LOW <= 57)) | ((_LOW >= 97) & (_LOW <= 122)) | ((_LOW >= 65) & (_LOW <= 90)) | (_LOW >= 128)
SPACED = ~(((_LOW >= 9) & (_LOW <= 13)) | (_LOW == 32))
#: Bytes that are handled at once; a longer text is handled alone.
BLOCK = 1 << 20
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or have.size < n:
        steps = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes, or of one row."""
    i, n = 0, offsets.size - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and the word range of each row (n_rows + 1 bounds)."""
    n = data.size
    inside = kind[data]
    first = np.empty(n, bool)
    last = np.empty(n, bool)
    if n:
        first[0] = last[-1] = True
        np.logical_not(inside[:-1], out=first[1:])
        np.logical_not(inside[1:], out=last[:-1])
        edge = offsets[(offsets > 0) & (offsets < n)]
        first[edge] = True
        last[edge - 1] = True
    start = np.flatnonzero(inside & first)
    end = np.flatnonzero(inside & last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word, from prefix sums of a polynomial over byte values."""
    out = np.empty(start.size, np.uint64)
    i = 0
    while i < start.size:
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        base = start[i]
        part = LOWER[data[base : end[j - 1]]]
        up, down = _power(_PRIME, part.size + 1), _power(_INVERSE, part.size + 1)
        sums = np.zeros(part.size + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[part] * up[: part.size], out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix64(out)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of each row, and the bounds of its shingles. A row of fewer words, but not none, has one shingle of all its words."""
    count = np.diff(bounds)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    out_bounds = np.concatenate(([0], np.cumsum(made)))
    if not words.size:
        return np.zeros(0, np.uint64), out_bounds
    factor = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(width)]
    n = max(0, words.size - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * factor[k]
    full = np.flatnonzero(count >= width)
    keep = np.zeros(n, bool)
    for a, b in zip(bounds[full], bounds[full + 1], strict=True):
        keep[a : b - width + 1] = True
    out = np.empty(out_bounds[-1], np.uint64)
    place = np.ones(out.size, bool)
    short = np.flatnonzero((count > 0) & (count < width))
    place[out_bounds[short]] = False
    out[place] = rolled[keep]
    for row in short:
        own = words[bounds[row] : bounds[row + 1]]
        out[out_bounds[row]] = sum((int(w) * int(factor[k]) for k, w in enumerate(own)), len(own)) & 0xFFFFFFFFFFFFFFFF
    return mix64(out), out_bounds
