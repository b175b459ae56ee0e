"""Words of a text as 64-bit numbers, for shingles and passages."""

from __future__ import annotations

import hashlib
import string

import numpy as np

# Words are runs of bytes other than ASCII white space, with A-Z lower-cased.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
BASE = np.uint64(0x9E3779B97F4A7C15)
REMEMBERED = 200_000


class WordCodes(dict):
    """Word to 64-bit number, remembered while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return code


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def codes_of(found: list[bytes], known: WordCodes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the public splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words, in order."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * BASE + codes[k : k + n]
    return mix(total)


def power_runs(codes: np.ndarray, size: int) -> np.ndarray:
    """As :func:`runs`, in time that does not depend on ``size``: by doubling."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # The factor is an array of one, whose products wrap round without a warning.
    total, have, block, width, factor = np.zeros(n, np.uint64), 0, codes, 1, np.array([BASE])
    left = size
    while left:
        if left & 1:
            total = total * factor + block[have : have + n]
            have += width
        left >>= 1
        if left:
            block = block[:-width] * factor + block[width:]
            factor = factor * factor
            width *= 2
    return mix(total)


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, no words none."""
    if not len(codes):
        return np.empty(0, np.uint64)
    if len(codes) < size:
        return runs(codes, len(codes)) ^ np.uint64(len(codes))
    return np.unique(runs(codes, size))
