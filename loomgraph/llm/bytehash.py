"""Hashes of byte strings at many places of a text, and places chosen by content, with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(29).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


@lru_cache(maxsize=16)
def _powers(base: int, bits: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below 2 ** bits."""
    out = np.ones(1 << bits, np.uint64)
    for k in range(bits):
        out[1 << k : 2 << k] = out[: 1 << k] * np.uint64(pow(base, 1 << k, 1 << 64))
    return out


class Hashes:
    """Polynomial hashes, modulo 2 ** 64, of any substring of some bytes."""

    def __init__(self, data: bytes):
        values = _TABLE[np.frombuffer(data, np.uint8)]
        bits = max(len(data).bit_length(), 18)
        self.inverse = _powers(_INVERSE, bits)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, bits)[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A mixed hash for each begin and end."""
        h = (self.sums[end] - self.sums[begin]) * self.inverse[begin]
        h = (h ^ (h >> _SHIFT)) * _MIX
        return h ^ (h >> _SHIFT)

    def every(self, size: int) -> np.ndarray:
        """A mixed hash of the `size` bytes from each place on."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = (self.sums[size:] - self.sums[:n]) * self.inverse[:n]
        h = (h ^ (h >> _SHIFT)) * _MIX
        return h ^ (h >> _SHIFT)


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the place of its least one, the last among equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # Each value with its place in the low bits: the least is then one number, found from the
    # running minima of blocks, forwards and backwards.
    low = np.uint64((1 << 24) - 1)
    place = low - (np.arange(len(values), dtype=np.uint64) & low)
    packed = (values & ~low) | place
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = packed
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    at = (low - (least & low)).astype(np.int64)
    begin = np.arange(n)
    # The place is known modulo 2 ** 24, and lies within the window.
    return begin + ((at - begin) & int(low))
