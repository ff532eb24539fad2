"""64-bit hashes of words and of runs of words, over numpy."""

from __future__ import annotations

import numpy as np
import xxhash

KEPT_WORDS = 150_000
#: Odd constants with well-spread bits.
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash per word; each worker keeps the hashes of a bounded number of words."""
    return np.array(list(map(_HASHES.__getitem__, words)), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of every element over all 64; different inputs stay different."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * ODD[4]
    return x ^ (x >> np.uint64(29))


def run_hashes(hashes: np.ndarray, n: int, odd: np.uint64 = ODD[0]) -> np.ndarray:
    """A hash per run of ``n`` consecutive elements, in order."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    total = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            total = mix(total * odd + hashes[i : len(hashes) - n + 1 + i])
    return total
