"""Where a text may hold a string of given length that is also elsewhere: window minima of gram hashes."""

from __future__ import annotations

import numpy as np

GRAM = 64
BASE = 0x9E3779B97F4A7C15
#: A second base, for a second hash of the same strings.
OTHER = 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        size = 1 << max(16, n.bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def gram_hashes(data: np.ndarray, gram: int = GRAM, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each string of `gram` bytes; equal strings have equal hashes."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, n), out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _powers(pow(base, -1, 1 << 64), n - gram + 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by prefix and suffix minima of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    pad = -n % width
    full = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).reshape(-1)
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def window_minima(data: np.ndarray, length: int, gram: int = GRAM) -> np.ndarray:
    """For each start of a string of `length` bytes the least hash of the grams in it.

    Equal strings have equal minima, and a string's minimum belongs to a gram that it holds."""
    return sliding_min(gram_hashes(data, gram), length - gram + 1)
