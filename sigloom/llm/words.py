"""Words as 64-bit hashes, and hashes of word windows, over numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words a worker remembers the hash of.
MOST_WORDS = 300_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_hashes = _Hashes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash of every window of size words; with fewer words, one of the whole sequence, and none without words. size: up to 5."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, size)
    total = np.full(n - width + 1, width, np.uint64) * _ODD[3]
    for k in range(width):
        x = hashes[k : n - width + 1 + k]
        total += (x ^ (x >> np.uint64(29))) * _ODD[k]
    return mix(total)
