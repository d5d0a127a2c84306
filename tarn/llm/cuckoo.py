"""A cuckoo filter over 64-bit keys, in numpy: insert, delete and look up many keys at a time."""

from __future__ import annotations

import numpy as np

SLOTS = 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; a key's two buckets differ by the hash of its fingerprint.

    Never denies a key that was inserted and not deleted. Keys are a set: the caller inserts a key once (its exact
    table knows whether it is there) and deletes only keys that are there.
    """

    def __init__(self, capacity: int = 64):
        self._new(max(16, 1 << int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85))))))

    def _new(self, buckets: int) -> None:
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.stash: list[int] = []  # keys that found no place: kept whole until the next rebuild

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mix(keys)
        mask = np.uint64(len(self.table) - 1)
        prints = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = h & mask
        return prints, one.astype(np.int64), ((one ^ _mix(prints.astype(np.uint64))) & mask).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.uint64)
        prints, one, two = self._where(keys)
        found = (self.table[one] == prints[:, None]).any(axis=1) | (self.table[two] == prints[:, None]).any(axis=1)
        return found | np.isin(keys, np.array(self.stash, dtype=np.uint64)) if self.stash else found

    def insert(self, keys: np.ndarray) -> None:
        left = np.unique(np.asarray(keys, dtype=np.uint64))
        for turn in range(2 * SLOTS):
            if not len(left):
                return
            prints, *buckets = self._where(left)
            bucket = buckets[turn % 2]
            free = self.table[bucket] == 0
            room = np.flatnonzero(free.any(axis=1))
            _, first = np.unique(bucket[room], return_index=True)  # one key a bucket at a time
            at = room[first]
            self.table[bucket[at], free[at].argmax(axis=1)] = prints[at]
            keep = np.ones(len(left), dtype=bool)
            keep[at] = False
            left = left[keep]
        for key in left:
            self._push(key)

    def _push(self, key: np.uint64) -> None:
        """Move fingerprints to their other buckets until one finds a free slot; undo the moves and stash the key if none does."""
        prints, one, two = self._where(np.array([key], dtype=np.uint64))
        mark, bucket, moves = prints[0], int(two[0]), []
        mask = len(self.table) - 1
        for b in (int(one[0]), bucket):
            if (free := np.flatnonzero(self.table[b] == 0)).size:
                self.table[b, free[0]] = mark
                return
        for k in range(200):
            slot = (k * 7 + int(mark)) % SLOTS
            moves.append((bucket, slot, self.table[bucket, slot]))
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = (bucket ^ int(_mix(np.array([mark], dtype=np.uint64))[0])) & mask
            if (free := np.flatnonzero(self.table[bucket] == 0)).size:
                self.table[bucket, free[0]] = mark
                return
        for b, slot, old in reversed(moves):
            self.table[b, slot] = old
        self.stash.append(int(key))

    def delete(self, keys: np.ndarray) -> None:
        for key in np.unique(np.asarray(keys, dtype=np.uint64)):
            if int(key) in self.stash:
                self.stash.remove(int(key))
                continue
            prints, one, two = self._where(np.array([key], dtype=np.uint64))
            for b in (int(one[0]), int(two[0])):
                if (at := np.flatnonzero(self.table[b] == prints[0])).size:
                    self.table[b, at[0]] = 0
                    break

    @property
    def room(self) -> int:
        """Keys that find a place without long moves."""
        return int(self.table.size * 0.85)

    @property
    def full(self) -> bool:
        """Time to build a larger one from the exact table."""
        return len(self.stash) > 8 or np.count_nonzero(self.table) > 0.93 * self.table.size

    def to_bytes(self) -> bytes:
        stash = np.array(self.stash, dtype=np.uint64)
        return np.array([len(self.table), len(stash)], dtype=np.int64).tobytes() + stash.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        buckets, n = np.frombuffer(data, dtype=np.int64, count=2)
        out.stash = np.frombuffer(data, dtype=np.uint64, count=n, offset=16).tolist()
        out.table = np.frombuffer(data, dtype=np.uint16, offset=16 + 8 * int(n)).reshape(int(buckets), SLOTS).copy()
        return out
