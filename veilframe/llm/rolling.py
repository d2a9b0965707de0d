"""64-bit hashes of any stretch of bytes from one running sum, with numpy.

The hash of a stretch is the sum of v[byte] / base^place, times the power of the base that takes the start's place out
again, all modulo 2^64, with a random odd base and random values, then mixed.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20).integers(1, 1 << 63, 259, dtype=np.uint64)
VALUES, BASE, _MIX = _RANDOM[:256], _RANDOM[256] | np.uint64(1), _RANDOM[257:] | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEGMENT = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (BASE, inverse))
        return self.up, self.down


class Sums:
    """The running sum over a stretch of data."""

    def __init__(self, data: np.ndarray, powers: Powers):
        self.up, down = powers.of(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * down[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def stretches(self, starts: np.ndarray, size) -> np.ndarray:
        """Hashes of data[start : start + size]; size may be an array."""
        return mixed((self.sums[starts + size] - self.sums[starts]) * self.up[starts] + np.asarray(size, np.uint64))


def words(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words (no x20, x09-x0D) of a text's bytes, A-Z read as a-z."""
    hashes, starts, at = [], [], 0
    space = _SPACE[data]
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        while end < len(data) and not space[end]:
            end += 1
        on = ~space[at:end]
        edge = np.diff(np.concatenate([[False], on, [False]]).astype(np.int8))
        a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes.append(Sums(_LOWER[data[at:end]], powers).stretches(a, z - a))
        starts.append(a + at)
        at = end
    none = np.empty(0, np.int64)
    return np.concatenate([none.view(np.uint64), *hashes]), np.concatenate([none, *starts])
