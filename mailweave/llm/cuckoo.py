"""Cuckoo filter over 128-bit keys, with whole batches of keys handled at once.

Four slots of 16-bit fingerprints a bucket.  Keys that find no place go to an exact stash, so no key is ever lost.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

SLOTS = 4
LOAD = 0.8
ROUNDS = 200


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``keys``: n x 16 bytes."""
    words = np.ascontiguousarray(keys, dtype=np.uint8).view("<u8").reshape(-1, 2)
    return words[:, 0], words[:, 1]


def as_keys(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, 16)


@dataclass
class CuckooFilter:
    """``table``: buckets x 4 fingerprints, 0 is free."""

    table: np.ndarray
    stash: list[bytes] = field(default_factory=list)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def load(cls, blob: bytes, stash: bytes = b"") -> CuckooFilter:
        table = np.frombuffer(blob, dtype="<u2").reshape(-1, SLOTS).copy()
        return cls(table, [stash[i:i + 16] for i in range(0, len(stash), 16)])

    def dump(self) -> tuple[bytes, bytes]:
        return self.table.astype("<u2").tobytes(), b"".join(self.stash)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = _halves(keys)
        prints = (high % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (low & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        turn = (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return bucket ^ (turn & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key inserted and not deleted; rarely true for another."""
        if not len(keys):
            return np.zeros(0, dtype=bool)
        prints, first, second = self._places(keys)
        found = ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)
        if self.stash:
            stash = set(self.stash)
            found |= np.array([bytes(k) in stash for k in keys])
        return found

    def insert(self, keys: np.ndarray) -> None:
        """Insert distinct keys that are not in the filter yet.

        Should moving residents not free enough places, the table goes back to the state before any move and the keys that
        still wait are stashed whole.
        """
        if not len(keys):
            return
        prints, first, second = self._places(keys)
        owner = self._fill(prints, first, np.arange(len(keys)))[2]
        owner = self._fill(prints[owner], second[owner], owner)[2]
        settled = self.table.copy()
        waiting, bucket = prints[owner], second[owner]
        for step in range(ROUNDS):
            if not len(waiting):
                return
            # One waiting fingerprint of each bucket takes the place of a resident, which moves to its other bucket.
            _, lead = np.unique(bucket, return_index=True)
            slot = (step + bucket[lead]) % SLOTS
            out = self.table[bucket[lead], slot].copy()
            self.table[bucket[lead], slot] = waiting[lead]
            wait = np.ones(len(waiting), dtype=bool)
            wait[lead] = False
            moved = np.concatenate([waiting[wait], out])
            target = np.concatenate([self._other(bucket[wait], waiting[wait]), self._other(bucket[lead], out)])
            waiting, bucket, _ = self._fill(moved, target, np.zeros(len(moved), dtype=np.int64))
        self.table = settled
        self.stash.extend(bytes(keys[i]) for i in owner)

    def _fill(self, prints, bucket, owner):
        """Put fingerprints into free slots of their bucket; returns those that wait."""
        if not len(prints):
            return prints, bucket, owner
        order = np.argsort(bucket, kind="stable")
        prints, bucket, owner = prints[order], bucket[order], owner[order]
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rank = np.arange(len(bucket)) - np.repeat(start, np.diff(np.r_[start, len(bucket)]))
        free = self.table[bucket] == 0
        fits = rank < free.sum(axis=1)
        places = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
        self.table[bucket[fits], places] = prints[fits]
        return prints[~fits], bucket[~fits], owner[~fits]

    def delete(self, keys: np.ndarray) -> None:
        """Delete keys that are in the filter (the caller's exact table says so)."""
        if self.stash and len(keys):
            stashed = set(self.stash)
            held = np.array([bytes(k) in stashed for k in keys])
            away = {bytes(k) for k in keys[held]}
            self.stash = [k for k in self.stash if k not in away]
            keys = keys[~held]
        if not len(keys):
            return
        prints, first, second = self._places(keys)
        left = self._clear(prints, first, np.arange(len(keys)))
        self._clear(prints[left], second[left], left)

    def _clear(self, prints: np.ndarray, bucket: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Free one slot that holds the fingerprint for each entry; returns the owners of those that found none."""
        order = np.lexsort((prints, bucket))
        prints, bucket, owner = prints[order], bucket[order], owner[order]
        start = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (prints[1:] != prints[:-1])]) if len(prints) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(bucket)) - np.repeat(start, np.diff(np.r_[start, len(bucket)]))
        same = self.table[bucket] == prints[:, None]
        fits = rank < same.sum(axis=1)
        places = np.argsort(~same[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
        self.table[bucket[fits], places] = 0
        return owner[~fits]
