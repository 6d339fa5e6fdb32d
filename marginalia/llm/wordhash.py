"""64-bit hashes of words and of runs of words, vectorised.

A run of words has the hash sum(w[i + k] * P**k) mod 2**64, from prefix sums, then mixed. Words
are those of the byte string: maximal runs without the bytes 0x20 and 0x09 to 0x0D.
"""

from __future__ import annotations

import numpy as np
import xxhash

from . import caches

#: Word hashes kept per worker before the dictionary starts afresh.
CACHE_WORDS = 300_000
P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


hashes = caches.register(_Hashes())
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**j and P**-j for j < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for k, base in enumerate((P, pow(P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(w: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of length words, by first word; empty if there are fewer words."""
    n = len(w) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(w) + 1)
    sums = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * up[: len(w)], dtype=np.uint64, out=sums[1:])
    return mix((sums[length:] - sums[:n]) * down[:n] + np.uint64(length))
