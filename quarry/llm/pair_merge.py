"""Batched pair merging for merge-type (BPE) vocabularies.

``PairTable`` maps an adjacent pair of symbol ids to (priority, merged id) by
a hash table in numpy. ``merge_rows`` keeps, for every unit of a batch at
once, an agenda of its adjacent pairs and each round merges every unit's best
pair (lowest priority number, leftmost on ties); ``merge_one`` does the same
for one long unit with a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

import numpy as np

NONE = np.int32(2**31 - 1)


class PairTable:
    _MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, priority: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(8, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.priority = np.full(size, NONE, np.int32)
        self.merged = np.full(size, -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):                       # linear probing, one step for all at once
            free = todo[self.keys[slot[todo]] == np.uint64(2**64 - 1)]
            self.keys[slot[free]] = keys[free]
            done = todo[self.keys[slot[todo]] == keys[todo]]
            self.priority[slot[done]], self.merged[slot[done]] = priority[done], merged[done]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)
            self.probes += 1
        self._one: dict | None = None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self._MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        priority, merged = self.priority[slot], self.merged[slot]
        other = np.flatnonzero(self.keys[slot] != keys)
        priority[other], merged[other] = NONE, -1
        for _ in range(1, self.probes):
            if not len(other):
                break
            slot[other] = (slot[other] + 1) & (len(self.keys) - 1)
            hit = other[self.keys[slot[other]] == keys[other]]
            priority[hit], merged[hit] = self.priority[slot[hit]], self.merged[slot[hit]]
            other = other[(self.keys[slot[other]] != keys[other]) & (self.priority[slot[other]] != NONE)]
        return priority, merged

    def as_dict(self) -> dict[tuple[int, int], tuple[int, int]]:
        if self._one is None:
            at = np.flatnonzero(self.priority != NONE)
            k = self.keys[at]
            self._one = dict(zip(zip((k >> np.uint64(32)).tolist(), (k & np.uint64(2**32 - 1)).tolist()),
                                 zip(self.priority[at].tolist(), self.merged[at].tolist())))
        return self._one


def merge_rows(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``symbols``: all units' ids one after another. The same form comes back."""
    n, width = len(lengths), int(lengths.max(initial=0))
    if n == 0 or width == 0:
        return symbols, lengths
    inside = np.arange(width) < lengths[:, None]
    s = np.full(n * width, -1, np.int32)                   # -1: no symbol (any more)
    s[inside.ravel()] = symbols
    after = np.arange(1, n * width + 1, dtype=np.int32)    # the next symbol's place, -1 at the end
    before = np.arange(-1, n * width - 1, dtype=np.int32)
    after[np.arange(n) * width + lengths - 1] = -1
    before[np.arange(n) * width] = -1
    p = np.full((n, width), NONE, np.int32)                # of the pair that starts at a place
    m = np.full(n * width, -1, np.int32)
    first = np.flatnonzero(inside[:, 1:].ravel()) if width > 1 else np.empty(0, np.int64)
    if len(first):
        first += first // (width - 1)
        p.ravel()[first], m[first] = table.find(s[first], s[first + 1])
    base = np.arange(n) * width                            # of the rows that p still holds
    while len(base):
        i = p.argmin(axis=1)
        k = np.flatnonzero(p[np.arange(len(p)), i] != NONE)
        if len(k) < 0.7 * len(base):
            p, base, i = p[k], base[k], i[k]
            k = np.arange(len(k))
        if not len(k):
            break
        own = base[k]
        g = own + i[k]
        j = after[g]
        s[g], s[j] = m[g], -1
        far = after[j]
        after[g] = far
        p[k, j - own] = NONE
        p[k, i[k]] = NONE
        right, left = np.flatnonzero(far >= 0), np.flatnonzero(before[g] >= 0)
        before[far[right]] = g[right]
        starts = np.concatenate([g[right], before[g[left]]])
        rows = np.concatenate([k[right], k[left]])
        found, merged = table.find(s[starts], s[np.concatenate([far[right], g[left]])])
        p[rows, starts - base[rows]], m[starts] = found, merged
    left_over = (s >= 0).reshape(n, width)
    return s[s >= 0], left_over.sum(axis=1)


def merge_one(table: PairTable, s: list[int]) -> list[int]:
    pairs = table.as_dict()
    s = list(s)
    nxt, prv = [*range(1, len(s)), -1], [*range(-1, len(s) - 1)]
    heap = [(f[0], i, a, b, f[1]) for i, (a, b) in enumerate(zip(s, s[1:])) if (f := pairs.get((a, b)))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, ab = heapq.heappop(heap)
        j = nxt[i]
        if s[i] != a or j < 0 or s[j] != b:
            continue                                       # one side was merged meanwhile
        s[i], s[j] = ab, -1
        nxt[i] = nxt[j]
        if nxt[i] >= 0:
            prv[nxt[i]] = i
        for left, right in ((prv[i], i), (i, nxt[i])):
            if left >= 0 and right >= 0 and (f := pairs.get((s[left], s[right]))):
                heapq.heappush(heap, (f[0], left, s[left], s[right], f[1]))
    out, i = [], 0
    while i >= 0 and s:
        out.append(s[i])
        i = nxt[i]
    return out


LONG = 48    # symbols from which a unit takes the heap


def spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start + size]`` one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - (ends - size), size)]


def merge_units(table: PairTable, symbols: np.ndarray, lengths: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """``symbols`` holds all units (none empty) one after another; the merged
    ids in the same form. Units of like length share a padded block."""
    start = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    n_short = int(np.searchsorted(lengths[order], LONG, side="right"))
    parts, sizes = [], []
    for a in range(0, n_short, block):
        part = order[a:min(a + block, n_short)]
        flat, size = merge_rows(table, spread(symbols, start[part], lengths[part]), lengths[part])
        parts.append(flat)
        sizes.append(size)
    for x in order[n_short:].tolist():
        one = merge_one(table, symbols[start[x]:start[x] + lengths[x]].tolist())
        parts.append(np.array(one, np.int32))
        sizes.append(np.array([len(one)]))
    if not parts:
        return symbols, lengths
    flat, size = np.concatenate(parts), np.concatenate(sizes).astype(np.int64)
    back = np.argsort(order)
    return spread(flat, (np.cumsum(size) - size)[back], size[back]), size[back]


class Memo:
    """``compute(list of new keys) -> values``, remembered for two generations
    of at most ``cap`` entries; keys used again move to the young one."""

    def __init__(self, compute: Callable[[list], Iterable], cap: int):
        self.compute, self.cap, self.young, self.old = compute, cap, {}, {}

    def look_up(self, keys: set) -> dict:
        """A dict that holds at least ``keys``."""
        new = keys.difference(self.young)
        if len(self.young) + len(new) > self.cap:
            self.old, self.young, new = self.young, {}, keys
        old = self.old
        again = [k for k in new if k in old]
        self.young.update((k, old[k]) for k in again)
        new = list(new.difference(again))
        if new:
            self.young.update(zip(new, self.compute(new)))
        return self.young
