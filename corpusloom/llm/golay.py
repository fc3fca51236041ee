"""The perfect binary Golay code of length 23: which of its 4096 codewords are near a 23-bit word."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, DATA = 23, 12
#: Fixed value: the code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Codewords up to this distance give keys. All words are within 3 of one codeword; those exactly 3 away have 5 more at 4.
RADIUS = 4
KEYS = 6


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each word's polynomial by the generator."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - DATA - 1, -1):
        rest = rest ^ (((rest >> bit) & 1) * (GENERATOR << (bit - (LENGTH - DATA))))
    return rest


@lru_cache(maxsize=1)
def _differences() -> np.ndarray:
    """For each syndrome the bits by which its words differ from their near codewords, and -1 for none, nearest first."""
    table = np.full((1 << (LENGTH - DATA), KEYS), -1, dtype=np.int64)
    filled = np.zeros(len(table), dtype=np.int64)
    for weight in range(RADIUS + 1):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], dtype=np.int64)
        for s, pattern in zip(syndrome(patterns).tolist(), patterns.tolist()):
            table[s, filled[s]] = pattern
            filled[s] += 1
    return table


def near_codewords(words: np.ndarray) -> np.ndarray:
    """The indices (12 bits) of the 1 or 6 codewords near each word, as a column each; -1 where there is none.

    Words that differ in at most two bits always share one.
    """
    differ = _differences()[syndrome(words)]
    return np.where(differ >= 0, (words.astype(np.int64)[:, None] ^ differ) >> (LENGTH - DATA), -1)
