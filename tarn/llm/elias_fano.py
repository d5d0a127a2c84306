"""Elias-Fano sequences, and an n-gram trie of them in memory-mapped files."""

from __future__ import annotations

import tempfile
from functools import cached_property

import numpy as np

U64 = np.uint64


class EliasFano:
    """A non-decreasing sequence below 2**63: low bits packed, high bits in unary with a rank directory.

    Three arrays (low, high, ranks) and three numbers (n, low bits, greatest high part) are all there is, and any of
    the arrays may be mapped from a file.
    """

    def __init__(self, n: int, bits: int, top: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.bits, self.top, self.low, self.high, self.ranks = n, bits, top, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=U64)
        n = len(values)
        bits = max(0, int(np.log2(max(1, int(values[-1]) // max(1, n))))) if n else 0
        low = np.zeros(n * bits // 64 + 2, dtype=U64)
        if bits:
            part = values & U64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(low, word, part << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        part = (values >> U64(bits)).astype(np.int64)
        top = int(part[-1]) if n else 0
        at = part + np.arange(n)  # the i-th one stands after as many zeros as its high part
        high = np.zeros((n + top + 1) // 64 + 1, dtype=U64)
        np.bitwise_or.at(high, at >> 6, U64(1) << (at & 63).astype(U64))
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return cls(n, bits, top, low, high, ranks)

    @staticmethod
    def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 0) set bit in each word."""
        words, k, at = words.copy(), k.astype(np.int64), np.zeros(len(k), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(words & U64((1 << width) - 1)).astype(np.int64)
            up = k >= count
            k -= np.where(up, count, 0)
            at += np.where(up, width, 0)
            words = np.where(up, words >> U64(width), words)
        return at

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        i = np.asarray(i, dtype=np.int64)
        word = np.searchsorted(self.ranks, i, side="right") - 1
        high = (word * 64 + self._select(self.high[word], i - self.ranks[word]) - i).astype(U64)
        return (high << U64(self.bits)) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=U64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(U64)
        out = self.low[word] >> shift
        over = (at & 63) + self.bits > 64
        out[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return out & U64((1 << self.bits) - 1)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``high``: the ones before its first zero less."""
        zeros = np.arange(len(self.ranks)) * 64 - self.ranks
        out = np.zeros(len(high), dtype=np.int64)
        some = high > 0
        k = high[some] - 1  # the zero that ends the part before
        word = np.searchsorted(zeros, k, side="right") - 1
        out[some] = word * 64 + self._select(~self.high[word], k - zeros[word]) - k
        return out

    @cached_property
    def _starts(self) -> np.ndarray:
        """``_below`` of every high part and of one more, for many searches: made once, in memory only."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        return np.searchsorted(ones - np.arange(len(ones)), np.arange(self.top + 2))

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value >= x, whether it is x)."""
        high = (x >> U64(self.bits)).astype(np.int64)
        out, same = np.full(len(x), self.n, dtype=np.int64), np.zeros(len(x), bool)
        inside = np.flatnonzero(high <= self.top)
        high = high[inside]
        lo, end = (self._starts[high], self._starts[high + 1]) if len(x) > 64 else (self._below(high), self._below(high + 1))
        hi = end.copy()
        want = x[inside] & U64((1 << self.bits) - 1) if self.bits else np.zeros(len(inside), dtype=U64)
        open_ = np.flatnonzero(lo < hi)
        while open_.size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        out[inside] = lo
        there = np.flatnonzero(lo < end)
        same[inside[there]] = self._low(lo[there]) == want[there]
        return out, same

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value >= x, n where there is none."""
        return self._search(np.asarray(x, dtype=U64))[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x (its first one), -1 where it isn't there."""
        at, same = self._search(np.asarray(x, dtype=U64))
        return np.where(same, at, -1)


#: Codes of probabilities: 0 is none; 1 to 255 stand for 1 down to 10**-DECADES, closest together near 1.
DECADES = 9
BOOK = np.concatenate([[0.0], 10.0 ** (-DECADES * (np.arange(255) / 254) ** 2)])


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; those above 0 never get the code of none."""
    with np.errstate(divide="ignore"):
        place = 254 * np.sqrt(np.clip(-np.log10(p) / DECADES, 0, 1))
    return np.where(p > 0, 1 + np.rint(place), 0).astype(np.uint8)


class NgramTrie:
    """Roots -> keys -> keys, a level for each order, in Elias-Fano sequences.

    A level holds the keys of all nodes, each raised by its parent's number times ``SPAN``, so that it is one monotone
    sequence, searched relative to the parent: the successor of (parent, key) is the node, if there is one. Pointers
    say where each parent's children begin, monotone too. Roots have exact counts, as differences of their running
    sum, and all nodes codes of smoothed probabilities: ``alpha`` of a node after its parent, ``gamma`` of what a node
    leaves to the shorter context.
    """

    SPAN = U64(1 << 33)

    def __init__(self, levels: list[EliasFano], pointers: list[EliasFano], counts: EliasFano, alpha: list[np.ndarray], gamma: list[np.ndarray]):
        self.levels, self.pointers, self.counts, self.alpha, self.gamma = levels, pointers, counts, alpha, gamma

    @classmethod
    def build(cls, roots: np.ndarray, keys: list[np.ndarray], n: np.ndarray, discount: float) -> NgramTrie:
        """From rows sorted by (root, *keys), each once, with counts above 0; keys below 2**32, where 0 means that the n-gram is shorter.

        Interpolated absolute discounting: alpha is (count - discount) / (count of the context), gamma the discount times
        the distinct successors over the same.
        """
        levels, pointers, alpha, gamma, counts = [], [], [], [], EliasFano.of(np.zeros(1))
        columns, parent, parents = [roots, *keys], np.zeros(len(roots), np.int64), 0
        for depth in range(len(columns)):
            if depth:
                # rows whose n-gram ends here go no further
                keep = columns[depth] != 0
                columns, parent, n = [c[keep] for c in columns], parent[keep], n[keep]
            raised = columns[depth].astype(U64) + parent.astype(U64) * cls.SPAN if depth else roots.astype(U64)
            first = np.flatnonzero(np.concatenate([[True], raised[1:] != raised[:-1]])) if len(raised) else np.empty(0, np.int64)
            total = np.add.reduceat(n, first).astype(np.int64) if len(first) else np.empty(0, np.int64)
            levels.append(EliasFano.of(raised[first]))
            if depth:
                of = parent[first]
                inside, distinct = np.bincount(of, total, parents), np.bincount(of, minlength=parents)
                alpha.append(quantised((total - discount) / inside[of]))
                gamma.append(quantised(discount * distinct / np.maximum(inside, 1)))
                pointers.append(EliasFano.of(np.searchsorted(of, np.arange(parents + 1))))
            else:
                counts = EliasFano.of(np.concatenate([[0], np.cumsum(total)]))
            parent, parents = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(raised)))), len(first)
        return cls(levels, pointers, counts, alpha, gamma)

    def find(self, roots: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(count of each root, codes alpha of each order from the second, codes gamma of each order but the last), 0 where there is none."""
        node = self.levels[0].find(roots.astype(U64))
        count = np.zeros(len(roots), np.int64)
        some = node >= 0
        count[some] = self.counts.get(node[some] + 1).astype(np.int64) - self.counts.get(node[some]).astype(np.int64)
        alphas, gammas = [], []
        for level, alpha, gamma, key in zip(self.levels[1:], self.alpha, self.gamma, keys, strict=True):
            codes = np.zeros((2, len(roots)), np.uint8)
            some = np.flatnonzero(node >= 0)
            codes[1, some] = gamma[node[some]]
            some = some[key[some] != 0]
            child = level.find(node[some].astype(U64) * self.SPAN + key[some].astype(U64))
            node = np.full(len(roots), -1)
            node[some] = child
            codes[0, some[child >= 0]] = alpha[child[child >= 0]]
            alphas.append(codes[0])
            gammas.append(codes[1])
        return count, alphas, gammas

    def to_bytes(self) -> bytes:
        """A header of numbers, then the arrays, each at a multiple of 8 bytes."""
        head, arrays = [len(self.levels)], []
        for s in (*self.levels, *self.pointers, self.counts):
            head += [s.n, s.bits, s.top, len(s.low), len(s.high), len(s.ranks)]
            arrays += [s.low, s.high, s.ranks]
        for a in (*self.alpha, *self.gamma):
            head.append(len(a))
            arrays.append(np.concatenate([a, np.zeros(-len(a) % 8, np.uint8)]))
        return np.array([len(head), *head], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def load(cls, data: np.ndarray) -> NgramTrie:
        """From bytes as an array, which may be mapped from a file: its pages are read as they are needed."""
        size = int(data[:8].view(np.int64)[0])
        head = data[8 : 8 * (size + 1)].view(np.int64).tolist()
        at, k = 8 * (size + 1), head[0]

        def part(n, kind):
            nonlocal at
            out = data[at : at + n * np.dtype(kind).itemsize].view(kind)
            at += n * np.dtype(kind).itemsize
            return out

        sequences = []
        for j in range(2 * k):
            n, bits, top, low, high, ranks = head[1 + 6 * j : 7 + 6 * j]
            sequences.append(EliasFano(n, bits, top, part(low, U64), part(high, U64), part(ranks, np.int64)))
        codes = []
        for n in head[1 + 12 * k :]:
            codes.append(part(n + -n % 8, np.uint8)[:n])
        return cls(sequences[:k], sequences[k : 2 * k - 1], sequences[2 * k - 1], codes[: k - 1], codes[k - 1 :])


def mapped(data: bytes, folder: str) -> NgramTrie:
    """The trie of these bytes in a mapped file; the file is unlinked at once and lives as long as the mapping."""
    with tempfile.NamedTemporaryFile(dir=folder) as f:
        f.write(data)
        f.flush()
        return NgramTrie.load(np.memmap(f.name, dtype=np.uint8, mode="r"))
