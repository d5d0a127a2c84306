"""Hashed features of words: the word, its beginnings and its character n-grams, for many words at once in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from ._common import CACHE_BYTES

U64 = np.uint64
STEP, MIX = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Buckets of 64-bit hashes; features of another salt fall elsewhere."""
    h = (h ^ U64(salt + 1)) * MIX
    h ^= h >> U64(32)
    return ((h * STEP) >> U64(64 - bits)).astype(np.int64)


class Letters:
    """The code points of many words, one after another, each word between < and >."""

    def __init__(self, words: list[str]):
        self.code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
        self.size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.start = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(self.code)) - self.start[self.word]
        power = np.cumprod(np.full(int(self.size.max(initial=1)), STEP), dtype=U64)
        self.sums = np.cumsum((self.code + U64(1)) * power[self.place], dtype=U64)

    def whole(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, word) of each word."""
        return self._begun(self.size, np.arange(len(self.size)), 1, bits)

    def beginnings(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, word) of the first n characters of each longer word."""
        which = np.flatnonzero(self.size - 2 > n)
        return self._begun(np.full(len(which), n + 1), which, 0, bits)

    def _begun(self, length: np.ndarray, which: np.ndarray, salt: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        first = self.start[which]
        before = np.where(first > 0, self.sums[first - 1], U64(0))
        return _mixed(self.sums[first + length - 1] - before + length.astype(U64), salt, bits), which

    def grams(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, word) of each n-gram of each word, its marks included."""
        at = np.flatnonzero(self.place + n <= self.size[self.word])
        h = np.zeros(len(at), U64)
        for k in range(n):
            h = (h ^ (self.code[at + k] + U64(1))) * STEP
            h ^= h >> U64(31)
        return _mixed(h, n, bits), self.word[at]


class WordValues(dict):
    """word -> a number, made for many words at once; starts anew when its words take ``budget`` bytes, about."""

    def __init__(self, values_of: Callable[[list[str]], list], budget: int = CACHE_BYTES):
        super().__init__()
        self.values_of, self.budget, self.used = values_of, budget, 0

    def learn(self, words: Iterable[str]) -> None:
        """Make what isn't there yet; until the next call all of ``words`` are."""
        words = set(words)
        if self.used > self.budget:
            self.clear()
            self.used = 0
        new = sorted(words - self.keys())
        if new:
            self.update(zip(new, self.values_of(new), strict=True))
            self.used += sum(map(len, new)) + 200 * len(new)
