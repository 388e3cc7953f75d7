"""A minimal perfect hash by cascading bit arrays, vectorised with numpy.

Level k maps the keys that are still unplaced to ``gamma * n`` positions; a position hit by exactly one key gets its bit
set and that key is placed. The rank of a key's bit among all set bits is its index, so n keys get 0..n-1. A key is a pair
of 64-bit hashes. Keys left after the last level (practically none) are kept in an explicit sorted list.
"""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS = 1.7, 40
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(h1 + _mix(h2 + _U(0x9E3779B97F4A7C15) * _U(level + 1))) % _U(size)


class PerfectHash:
    """sizes: bits of each level (multiples of 64); words: all levels' bits; rest: keys beyond the last level."""

    def __init__(self, sizes: list[int], words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.base = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> "PerfectHash":
        """From distinct pairs of unsigned 64-bit hashes."""
        sizes, words = [], []
        for level in range(LEVELS):
            if not len(h1):
                break
            size = max(64, -(-int(len(h1) * GAMMA) // 64) * 64)
            at = _place(h1, h2, level, size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[at.astype(np.int64)]
            h1, h2 = h1[left], h2[left]
        rest = np.sort(np.rec.fromarrays([h1, h2], names="a,b"))
        return cls(sizes, np.concatenate(words) if words else np.empty(0, np.uint64), rest)

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """0..n-1 for keys that were built in; for others some index or -1: compare a fingerprint."""
        found = np.full(len(h1), -1, np.int64)
        todo, start = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                return found
            at = _place(h1[todo], h2[todo], level, size)
            word, bit = (at >> _U(6)).astype(np.int64) + start // 64, at & _U(63)
            w = self.words[word]
            hit = (w >> bit) & _U(1) == 1
            below = np.bitwise_count(w & ((_U(1) << bit) - _U(1)))
            found[todo[hit]] = self.base[word[hit]] + below[hit]
            todo, start = todo[~hit], start + size
        if len(self.rest) and len(todo):
            want = np.rec.fromarrays([h1[todo], h2[todo]], names="a,b")
            at = np.searchsorted(self.rest, want).clip(max=len(self.rest) - 1)
            same = self.rest[at] == want
            found[todo[same]] = self.base[-1] + at[same]
        return found

    def __len__(self) -> int:
        return int(self.base[-1]) + len(self.rest)

    def dump(self) -> dict:
        return {"sizes": self.sizes, "words": self.words.tobytes(), "rest": self.rest.tobytes()}

    @classmethod
    def load(cls, sizes, words: bytes, rest: bytes) -> "PerfectHash":
        return cls([int(x) for x in sizes], np.frombuffer(words, np.uint64), np.frombuffer(rest, [("a", "<u8"), ("b", "<u8")]))
