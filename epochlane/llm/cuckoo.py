"""Cuckoo filter: set membership with deletion, as one array of fingerprints."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500


class CuckooFilter:
    """Buckets of four 16-bit fingerprints. A key, a 64-bit hash, may be in two buckets: the
    second is the first XOR a hash of the fingerprint, so either gives the other."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.mask = len(table) - 1

    @classmethod
    def empty(cls, keys: int, load: float = 0.5) -> CuckooFilter:
        buckets = 1 << max(1, int(keys / load / SLOTS)).bit_length()
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        n = max(16, len(keys))
        while True:
            made = cls.empty(n)
            if made.insert_many(keys):
                return made
            n *= 2

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def _places(self, key: int) -> tuple[int, int, int]:
        mark = (key >> 48 & 0xFFFF) or 1
        first = key & self.mask
        return mark, first, (first ^ mark * 0x5BD1E995) & self.mask

    def insert(self, key: int) -> bool:
        """False if the filter is too full; it then needs building anew, larger."""
        mark, i, j = self._places(key)
        for b in (i, j):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        b = j
        for kick in range(KICKS):
            slot = (mark + kick) % SLOTS
            mark, self.table[b, slot] = int(self.table[b, slot]), mark
            b = (b ^ mark * 0x5BD1E995) & self.mask
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        return False

    def insert_many(self, keys: np.ndarray) -> bool:
        """Keys that find a free slot in their first or second bucket go in together, the rest one by one."""
        mark = (keys >> np.uint64(48)).astype(np.int64)
        mark[mark == 0] = 1
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        for _ in range(2):
            order = np.argsort(at, kind="stable")
            own = at[order]
            start = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1])))
            place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
            taken = self.table[own] != 0
            fits = place < SLOTS - taken.sum(axis=1)
            slots = np.argsort(taken, axis=1, kind="stable")[np.flatnonzero(fits), place[fits]]
            self.table[own[fits], slots] = mark[order[fits]]
            left = order[~fits]
            keys, mark, at = keys[left], mark[left], (at[left] ^ mark[left] * 0x5BD1E995) & self.mask
        return all(self.insert(k) for k in keys.tolist())

    def delete(self, key: int) -> bool:
        """Takes out one copy of a key that was inserted."""
        mark, i, j = self._places(key)
        for b in (i, j):
            at = np.flatnonzero(self.table[b] == mark)
            if len(at):
                self.table[b, at[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """For each 64-bit hash whether it may be in; never false for one that is."""
        mark = (keys >> np.uint64(48)).astype(np.int64)
        mark[mark == 0] = 1
        first = (keys & np.uint64(self.mask)).astype(np.int64)
        second = (first ^ mark * 0x5BD1E995) & self.mask
        return ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(axis=1)
