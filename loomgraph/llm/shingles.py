"""Hashed words and shingles of a text, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5

_LOWER = bytes(range(256)).lower()
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT, _SHIFT2 = np.uint64(32), np.uint64(29)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 150_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: str) -> list[bytes]:
    """A-Z in lower case, split at blanks, tabs, line feeds and the like (9 to 13)."""
    return text.encode().translate(_LOWER).split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT2)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each `size` hashes in a row: a polynomial modulo 2 ** 64, then mixed."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * _MIX + hashes[k : k + n]
    return mixed(out + np.uint64(size))


def shingle_set(hashes: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles, sorted; fewer words than a shingle has are one, none are none."""
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(size, len(hashes))))
