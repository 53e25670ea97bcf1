"""Minimal perfect hashes over shards of keys, with the keys stored for verification.

A shard holds some thousand keys. Its buckets, of three keys on average, each get a displacement
that sends their keys to free slots; the last buckets, of one key, name their slot itself. n keys
fill the slots 0 to n - 1. A lookup computes one slot and compares the key that is stored there.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from vanewatch.llm import ragged
from vanewatch.llm.symbols import Sums, mixed

#: Keys of a shard, on average.
SHARD_KEYS = 4096
STEP = np.uint64(0x9E3779B97F4A7C15)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of keys; another seed gives another family."""
    symbols = np.random.default_rng(seed).integers(0, 1 << 62, 256, dtype=np.uint64)
    return Sums(symbols[data]).spans(starts, ends)


def _buckets(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bucket of each hash in a shard of ``n`` keys."""
    return ((h >> np.uint64(32)) % (n // 3 + 1).astype(np.uint64)).astype(np.int64)


def _slots(h: np.ndarray, displacement: np.ndarray, n: np.ndarray) -> np.ndarray:
    moved = mixed(h + (displacement + 1).astype(np.uint64) * STEP)
    return np.where(displacement < 0, -displacement - 1, (moved % n.astype(np.uint64)).astype(np.int64))


def build(h: np.ndarray) -> np.ndarray | None:
    """The displacement of each bucket; None if two hashes are equal."""
    n = len(h)
    if len(np.unique(h)) < n:
        return None
    size = np.array([n])
    order, heads = ragged.groups(_buckets(h, size))
    members = np.split(order, heads[1:])
    out = np.zeros(n // 3 + 1, dtype=np.int64)
    taken = np.zeros(n, dtype=bool)
    for own in sorted(members, key=len, reverse=True):
        bucket = _buckets(h[own[:1]], size)[0]
        if len(own) == 1:
            break
        tries, found = np.arange(64), None
        while found is None:
            slots = _slots(h[own][None, :], tries[:, None], size)
            ordered = np.sort(slots, axis=1)
            good = np.flatnonzero(~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
            if len(good):
                found = good[0]
            else:
                tries = np.arange(tries[-1] + 1, tries[-1] + 1 + 2 * len(tries))
        out[bucket] = tries[found]
        taken[slots[found]] = True
    free = np.flatnonzero(~taken)
    alone = np.array([own[0] for own in members if len(own) == 1], dtype=np.int64)
    out[_buckets(h[alone], size)] = -free[: len(alone)] - 1
    return out


class Index:
    """Some shards of one key set, end to end; slots are numbered through all of them."""

    def __init__(self, shards: Iterable[dict], n_shards: int):
        """``shards`` have shard, displacements, key_sizes (both int32 bytes) and keys, in order of slots."""
        shards = sorted(shards, key=lambda s: s["shard"])
        self.n_shards = n_shards
        number = np.array([s["shard"] for s in shards], dtype=np.int64)
        moves = [np.frombuffer(s["displacements"], dtype=np.int32).astype(np.int64) for s in shards]
        sizes = [np.frombuffer(s["key_sizes"], dtype=np.int32).astype(np.int64) for s in shards]
        counts = np.array([len(x) for x in sizes], dtype=np.int64)
        self.count, self.base, self.head = (np.zeros(n_shards, dtype=np.int64) for _ in range(3))
        self.count[number] = counts
        self.base[number] = np.cumsum(counts) - counts
        self.head[number] = np.cumsum([len(x) for x in moves]) - [len(x) for x in moves]
        self.moves, self.sizes = np.concatenate(moves), np.concatenate(sizes)
        self.keys = np.frombuffer(b"".join(s["keys"] for s in shards), dtype=np.uint8)
        self.lo = np.cumsum(self.sizes) - self.sizes
        #: Slot of each place as one number: the shard and the slot inside it.
        self.slots = np.repeat(number << 32, counts) + np.arange(len(self.sizes)) - np.repeat(self.base[number], counts)

    def __len__(self) -> int:
        return len(self.sizes)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Place of each stretch of ``data`` with the hash ``h``, -1 for those that are no key."""
        shard = (h % np.uint64(self.n_shards)).astype(np.int64)
        out = np.full(len(h), -1, dtype=np.int64)
        at = np.flatnonzero(self.count[shard] > 0)
        h, shard = h[at], shard[at]
        n = self.count[shard]
        place = self.base[shard] + _slots(h, self.moves[self.head[shard] + _buckets(h, n)], n)
        sizes = (ends - starts)[at]
        alike = np.flatnonzero(self.sizes[place] == sizes)
        at, place, sizes = at[alike], place[alike], sizes[alike]
        right = ragged.same(data, starts[at], self.keys, self.lo[place], sizes)
        out[at[right]] = place[right]
        return out
