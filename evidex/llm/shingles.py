"""Sets of hashed word shingles of many texts at once, in numpy.

Words are runs of [^\\x20\\x09-\\x0D] with A-Z lower-cased. A text's set holds the 64-bit hashes of its
distinct runs of `width` words; a text with fewer words has one shingle, its whole word sequence; a text
without words has none.
"""

from __future__ import annotations

import numpy as np

from .common import WHITE, mix64

_rng = np.random.default_rng(20240101)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_KEPT = 1 << 19  # powers kept by a worker; a longer batch (one long text) makes its own
_powers: list[np.ndarray] = []


def _made(n: int) -> list[np.ndarray]:
    return [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, b, np.uint64))]) for b in (_BASE, _INVERSE)]


def _power(n: int) -> list[np.ndarray]:
    """Powers 0 to n, or more, of the base and of its inverse."""
    if n > _KEPT:
        return _made(n)
    if not _powers:
        _powers.extend(_made(_KEPT))
    return _powers


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash of every word, and the number of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offs) - 1, np.int64)
    solid = ~WHITE[data]
    filled = np.diff(offs) > 0
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    after[-1], after[:-1] = True, ~solid[1:]
    before[offs[:-1][filled]] = True
    after[offs[1:][filled] - 1] = True
    start, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    up, down = _power(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    h = mix64((total[end] - total[start]) * down[start])
    at = np.searchsorted(start, offs)
    return start, end, h, np.diff(at)


def shingle_stream(hashes: np.ndarray, count: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, their number per text, and the first word of each."""
    first = np.cumsum(count) - count
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.repeat(first, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    length = np.repeat(np.minimum(count, width), n)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    out = np.zeros(len(begin), np.uint64)
    short = length < width
    for j in range(width):
        part = padded[begin + j] * _STEP[j]
        if short.any():
            part[short & (length <= j)] = 0
        out += part
    out += length.astype(np.uint64) * _STEP[63]
    return mix64(out), n, begin


def sets(data: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and the offsets (n + 1)."""
    _, _, h, count = words(data, offs)
    s, n, _ = shingle_stream(h, count, width)
    at = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        s[a:b].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    keep[at[:-1][n > 0]] = True
    seen = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], seen[at]


def batches(data: np.ndarray, offs: np.ndarray, most: int = 1 << 19):
    """Ranges of texts of about `most` bytes each: (first, last, data, offsets)."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, min(b, n), data[offs[a] : offs[min(b, n)]], offs[a : min(b, n) + 1] - offs[a]
        a = min(b, n)
