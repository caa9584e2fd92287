"""Words, hashes of word runs and bit counts over Arrow batches, vectorised."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64


def table_of(seed: int) -> np.ndarray:
    """256 random odd 64-bit numbers that depend on the seed alone."""
    return np.random.Generator(np.random.PCG64(seed)).integers(
        0, 1 << 64, 256, dtype=np.uint64) | U(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = h ^ (h >> U(31))
    h = h * U(0x9E3779B97F4A7C15)
    h = h ^ (h >> U(29))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, U(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes; a word is a run of bytes other than white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
