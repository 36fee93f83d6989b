"""The binary Golay code [23, 12, 7], decoded to all codewords that are near.

A word of 23 bits lies within 3 bits of exactly one codeword. Where that distance is 3, five more
codewords lie at distance 4. near() gives the one codeword, or those six. Two words that differ in at most
two bits always share one of them: extend words and code by a parity bit, so that distances to the code are
0, 2 or 4, where the words at 4 have one codeword for each tetrad of their sextet. If both words are at 4,
the two bits fall into two tetrads (exchanging one for the other gives a tetrad of the other word) or into
one (then the other word is at 2, from that tetrad's codeword). If one is at 2 or less, its codeword is
within 4 of the other.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, DIM = 23, 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, fixed value
PAD = -1


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder by the generator polynomial, 11 bits."""
    rest = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, LENGTH - DIM - 1, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - (LENGTH - DIM)), 0)
    return rest


@cache
def _errors() -> np.ndarray:
    """2048 x 6: error patterns that lead from a word with that syndrome to the codewords near it."""
    table = np.full((1 << (LENGTH - DIM), 6), PAD, np.int64)
    lead = np.full(len(table), 9)
    used = np.zeros(len(table), int)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(LENGTH), weight)] or [0], np.int64)
        for s, p in zip(syndrome(patterns), patterns):
            if weight < 4 or lead[s] == 3:
                lead[s] = min(lead[s], weight)
                table[s, used[s]] = p
                used[s] += 1
    return table


def near(words: np.ndarray) -> np.ndarray:
    """n x 6: the 12-bit indices of the codewords near each 23-bit word, PAD where there are fewer."""
    errors = _errors()[syndrome(words)]
    return np.where(errors == PAD, PAD, (words.astype(np.int64)[:, None] ^ errors) >> (LENGTH - DIM))
