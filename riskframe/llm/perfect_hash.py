"""Minimal perfect hashing of 64-bit keys, level by level.

On each level every key left takes a place in a bit array of twice their
number; keys alone on their place are done, the others go to the next level.
The index of a key is the number of set bits before its own. All steps work on
whole arrays.
"""

from __future__ import annotations

import numpy as np

from riskframe.llm.common import mix

_GAMMA = 2
_GOLDEN, _MASK = 0x9E3779B97F4A7C15, 0xFFFFFFFFFFFFFFFF


def _seed(level: int) -> np.uint64:
    return np.uint64((level + 1) * _GOLDEN & _MASK)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words, words per level) for distinct keys."""
    left, words, sizes, level = keys.astype(np.uint64), [], [], 0
    while len(left):
        n = -(-_GAMMA * len(left) // 64)
        place = (mix(left + _seed(level)) % np.uint64(64 * n)).astype(np.int64)
        alone = np.bincount(place, minlength=64 * n) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(n)
        left = left[~alone[place]]
        level += 1
    return np.concatenate([np.zeros(0, "<u8"), *words]), np.array(sizes, np.int32)


class Directory:
    """The hashes of many disjoint slices of keys: a key's index counts on through the slices."""

    def __init__(self, hashes: list[tuple[np.ndarray, np.ndarray]]):
        self.words = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in hashes)])
        levels = max([len(s) for _, s in hashes], default=0)
        self.size = np.zeros((len(hashes), levels), np.int64)
        for i, (_, sizes) in enumerate(hashes):
            self.size[i, : len(sizes)] = sizes
        ends = np.cumsum(self.size.ravel()).reshape(self.size.shape)
        self.start = ends - self.size
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def index(self, keys: np.ndarray, part: np.ndarray | int = 0) -> np.ndarray:
        """The index of each key of slice ``part``; a key that was not built in gets any index or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        part = np.broadcast_to(np.asarray(part, np.int64), (len(keys),))
        for level in range(self.size.shape[1]):
            left = left[self.size[part[left], level] > 0]
            if not len(left):
                break
            size = self.size[part[left], level]
            place = (mix(keys[left] + _seed(level)) % (64 * size).astype(np.uint64)).astype(np.int64)
            word = self.start[part[left], level] + (place >> 6)
            bit = np.uint64(1) << (place & 63).astype(np.uint64)
            hit = (self.words[word] & bit) != 0
            below = np.bitwise_count(self.words[word[hit]] & (bit[hit] - np.uint64(1))).astype(np.int64)
            out[left[hit]] = self.before[word[hit]] + below
            left = left[~hit]
        return out
