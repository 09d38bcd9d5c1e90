"""Hashes of byte ranges of a text in constant time each, and word shingles made of them."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (wraps modulo 2**64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, factor, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class RangeHash:
    """Polynomial prefix sums of a byte string: the hash of [start, end) depends on its bytes alone."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(max(1, len(data)))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; of all words, where they are fewer; of nothing, none.

    Words are what ASCII blanks separate, with A-Z in lower case; one blank joins them.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    blanks = np.flatnonzero(data == 0x20)
    starts = np.concatenate(([0], blanks + 1))
    ends = np.concatenate((blanks, [len(data)]))
    k = min(size, len(words))
    return np.unique(RangeHash(data).of(starts[: len(starts) - k + 1], ends[k - 1 :]))
