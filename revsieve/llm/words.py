"""Words between ASCII blanks and their 128-bit hashes as number arrays."""

from __future__ import annotations

import hashlib

import numpy as np

from revsieve.llm.common import ship

ship(__name__)

#: Odd multipliers of the two halves when hashes of neighbouring words are put together.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes:
    """Hashes of words; remembers a bounded number of them."""

    def __init__(self, kept: int = 250_000):
        self.kept = kept
        self.halves: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})

    def _half(self, words: list[bytes], half: int) -> np.ndarray:
        known = self.halves[half]
        if len(known) > self.kept:
            known.clear()
        for w in set(words).difference(known):
            digest = hashlib.blake2b(w, digest_size=16).digest()
            known[w] = int.from_bytes(digest[8 * half : 8 * half + 8], "little")
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def high_of(self, words: list[bytes]) -> np.ndarray:
        """The first half of each word's hash."""
        return self._half(words, 0)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Both halves."""
        return self._half(words, 0), self._half(words, 1)


def joined(hashes: np.ndarray, size: int, half: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words in a row, from the hashes of the words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = np.uint64(MIX[half])
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= factor
        out += hashes[j : j + n]
    return out


def stirred(h: np.ndarray) -> np.ndarray:
    """The numbers with their bits mixed well, for orders and samples."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h
