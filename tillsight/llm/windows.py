"""Hashes of ranges of a sequence, and which position stands for each window.

A sequence is an array of 64-bit values, one for each word or byte.  ``RangeHash`` gives
the hash of any range from prefix sums.  ``anchors`` picks for every window of ``length``
values the position of its least k-gram (leftmost of equal ones).  The choice depends on
the window's values alone, so equal windows anywhere pick equal k-grams at the same
place in them: windows can only be equal where their anchors are.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASES = (U(0xD1342543DE82EF95), U(0xAF251AF3B0F025B5))
#: Windows looked at in one go.
BLOCK = 1 << 16
PLACE = U((1 << 18) - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


class RangeHash:
    """Polynomial hash modulo 2**64 of ranges of ``values``; its bases are odd, so powers can be divided out."""

    def __init__(self, values: np.ndarray, base: np.uint64 = BASES[0]):
        n = len(values)
        powers = np.full(n + 1, base, U)
        powers[0] = U(1)
        powers = np.multiply.accumulate(powers)
        inverse = U(pow(int(base), -1, 1 << 64))
        back = np.full(n + 1, inverse, U)
        back[0] = U(1)
        self.back = np.multiply.accumulate(back)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * powers[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U))

    def fixed(self, length: int) -> np.ndarray:
        """Of every range of ``length``, by its start."""
        m = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:m]) * self.back[:m] + U(length))


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` neighbouring ``grams``, by its start: the position of the least one."""
    m = len(grams) - span + 1
    out = np.empty(max(m, 0), np.int64)
    for at in range(0, m, BLOCK):
        part = grams[at : min(at + BLOCK, m) + span - 1]
        low = (part & ~PLACE) | np.arange(len(part), dtype=U)
        step = 1
        while step * 2 <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < span:
            rest = span - step
            low = np.minimum(low[:-rest], low[rest:])
        out[at : at + len(low)] = (low & PLACE).astype(np.int64) + at
    return out
