"""Hashes of words and windows of one text, in numpy: all arithmetic is modulo 2**64."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20_240_501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        row = np.full(max(n, 1 << 16), base, np.uint64)
        row[0] = 1
        have = _powers[base] = np.cumprod(row)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of a text."""
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(raw)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * _power(_BASE, n))))
    back = _power(pow(_BASE, -1, 1 << 64), n)
    return _mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words."""
    n = len(word) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * _power(_STEP, len(word)))))
    return _mix((total[k:] - total[:-k]) * _power(pow(_STEP, -1, 1 << 64), n))


def lows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    n = len(values) - width + 1
    if n < 1:
        return values[:0]
    size, low = 1, values
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:n], low[width - size : width - size + n])
