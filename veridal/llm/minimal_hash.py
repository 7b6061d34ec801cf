"""A minimal perfect hash of 128-bit keys, in levels of bits.

At each level every key left takes a bit; keys that have a bit to themselves are
settled there, the others go on to the next level. The number of set bits before
a key's own is its place, so ``n`` keys have the places 0 to ``n - 1``. A set of
keys costs about three bits a key. Other keys get any place or -1.
"""

from __future__ import annotations

import numpy as np

from veridal.llm.shingles import mix

_P = 0x9E3779B97F4A7C15
#: Bits a key that is left, at each level.
_SPARE = 1.5
#: Levels after which different keys are as good as sure to be told apart.
_MOST_LEVELS = 200


def _bits_of(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h1 ^ mix(h2 + np.uint64(_P * (level + 1) % (1 << 64)))) % np.uint64(size)).astype(np.int64)


class MinimalHash:
    """``sizes`` of the levels in bits, their ``words`` of 64 bits one after another, and the ``ranks`` before each word."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.ranks = np.cumsum(np.bitwise_count(words).astype(np.int64)) - np.bitwise_count(words)

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> MinimalHash:
        """The hash of distinct keys, each of two numbers of 64 bits."""
        sizes: list[int] = []
        words: list[np.ndarray] = []
        while len(h1):
            if len(sizes) == _MOST_LEVELS:
                raise ValueError("the keys are not distinct")
            size = max(64, -(-int(len(h1) * _SPARE) // 64) * 64)
            bits = _bits_of(h1, h2, len(sizes), size)
            alone = np.bincount(bits, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = ~alone[bits]
            h1, h2 = h1[left], h2[left]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each key; for a key that the hash was not made of, any place or -1."""
        out = np.full(len(h1), -1, np.int64)
        left, first = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            bits = _bits_of(h1[left], h2[left], level, size)
            word, bit = self.words[first + (bits >> 6)], (bits & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (self.ranks[first + (bits >> 6)] + below)[here]
            left, first = left[~here], first + size // 64
        return out
