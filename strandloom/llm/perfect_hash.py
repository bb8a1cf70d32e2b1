"""Minimal perfect hash of a set of 64-bit keys, in levels of bit arrays.

At each level the keys that are left hash into an array of ``SPREAD`` slots a key; those
alone in their slot settle there, the others go one level down. A key's index
is the number of settled slots before its own, over all levels in turn.
"""

from __future__ import annotations

import numpy as np

from .common import mixed

SPREAD = 2.0
MOST_LEVELS = 64


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    turn = mixed(keys ^ np.uint64((0xA0761D6478BD642F * (level + 1)) % 2**64))
    return ((turn >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)  # size stays below 2**32


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        """levels: arrays of 0 and 1."""
        self.levels = levels
        self.ranks, before = [], 0
        for level in levels:
            sums = np.cumsum(level, dtype=np.int64) - level + before
            self.ranks.append(sums)
            before += int(level.sum())
        self.size = before

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """keys: different 64-bit numbers."""
        levels, left = [], np.asarray(keys, np.uint64)
        while len(left):
            if len(levels) == MOST_LEVELS:
                raise ValueError("keys repeat")
            size = max(2, int(len(left) * SPREAD))
            slot = _slot(left, len(levels), size).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[slot]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; of a key outside the set any index, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, todo = np.asarray(keys, np.uint64), np.arange(len(keys))
        for number, (level, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(todo):
                break
            slot = _slot(left, number, len(level)).astype(np.int64)
            here = level[slot] == 1
            out[todo[here]] = rank[slot[here]]
            left, todo = left[~here], todo[~here]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *(len(x) for x in self.levels)], "<u4")
        return sizes.tobytes() + b"".join(np.packbits(x, bitorder="little").tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        count = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes = np.frombuffer(raw, "<u4", count, 4).astype(int)
        at, levels = 4 * (count + 1), []
        for size in sizes:
            width = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=size, bitorder="little"))
            at += width
        return cls(levels)
