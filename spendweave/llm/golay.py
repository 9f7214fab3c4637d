"""The binary Golay code of length 23: every word is within three errors of exactly one of 4,096 codewords."""
from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, DATA = 23, 12
PARITY = LENGTH - DATA
GENERATOR = 0b101011100011     # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def remainder(word: int) -> int:
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - PARITY)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low and the high half of a word, and the error pattern of each remainder."""
    units = [remainder(1 << b) for b in range(LENGTH)]
    low, high = np.zeros(1 << 12, np.uint32), np.zeros(1 << 11, np.uint32)
    for table, first in ((low, 0), (high, 12)):
        for bit in range(len(table).bit_length() - 1):
            on = (np.arange(len(table)) >> bit & 1).astype(bool)
            table[on] ^= units[first + bit]
    errors = np.zeros(1 << PARITY, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            at = 0
            for b in bits:
                at ^= units[b]
            errors[at] = sum(1 << b for b in bits)
    return low, high, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword (its 12 data bits) of each word."""
    low, high, errors = tables()
    words = words.astype(np.uint32)
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> PARITY


def fuzzy_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """Per word (row), the codeword indices of itself and of all words one bit away, sorted, repeats included.

    Two words that differ in at most two of the ``bits`` bits have a word between them, one bit from both, so they share a
    key. A word within two errors of its codeword has one key, any other word of full length has six.
    """
    near = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(bits, dtype=np.uint32)])
    return np.sort(decode(words.astype(np.uint32)[:, None] ^ near[None, :]), axis=1)
