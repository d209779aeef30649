"""Word-level helpers that run inside tasks: stable word hashes and hashed word windows."""

from __future__ import annotations

import numpy as np
import xxhash

# Odd 64-bit multipliers, one per position of a window (powers of one odd number).
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(1, 9)], dtype=np.uint64)

# Words remembered by one worker; the store is emptied when it is full.
MEMO_WORDS = 400_000


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def forget() -> None:
    """Empty the store of word hashes."""
    _HASHES.clear()


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """A hash of every ``width`` consecutive words; of the whole sequence when it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        total = np.uint64(0xA5A5A5A5 + n)
        for k in range(n):
            total = total + hashes[k:k + 1] * POWERS[k]
        return mix(total)
    out = hashes[:n - width + 1] * POWERS[0]
    for k in range(1, width):
        out = out + hashes[k:n - width + 1 + k] * POWERS[k]
    return mix(out)
