"""A set of positions in containers of 65,536 that finds its k-th member fast.

Each container holds the low 16 bits of its members in the smallest of three forms:
a sorted array, a bitmap, or runs (first member and length). Cumulative cardinalities of
the containers lead to the container of the k-th member; within it, an array is indexed,
a bitmap is searched by the cumulative counts of its bytes, runs by their cumulative
lengths.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 16
ARRAY, BITMAP, RUN = "array", "bitmap", "run"
ONES = np.array([b.bit_count() for b in range(256)], dtype=np.int64)


class Container:
    """Members of one chunk, as low 16 bits in ascending order."""

    def __init__(self, low: np.ndarray):
        self.size = len(low)
        breaks = np.flatnonzero(np.diff(low.astype(np.int32)) != 1) + 1
        costs = {ARRAY: 2 * len(low), BITMAP: CHUNK // 8, RUN: 4 * (len(breaks) + 1)}
        self.kind = min(costs, key=costs.get)
        if self.kind == ARRAY:
            self.members = low.astype(np.uint16)
        elif self.kind == BITMAP:
            bits = np.zeros(CHUNK, dtype=np.uint8)
            bits[low] = 1
            self.bits = np.packbits(bits, bitorder="little")
            self.ends = np.cumsum(ONES[self.bits])
        else:
            edges = np.concatenate([[0], breaks, [len(low)]])
            self.firsts = low[edges[:-1]].astype(np.uint16)
            self.ends = edges[1:]

    def select(self, k: int) -> int:
        """The member of rank ``k``, counted from 0."""
        if self.kind == ARRAY:
            return int(self.members[k])
        at = int(np.searchsorted(self.ends, k, side="right"))
        before = int(self.ends[at - 1]) if at else 0
        if self.kind == RUN:
            return int(self.firsts[at]) + k - before
        places = np.flatnonzero(np.unpackbits(self.bits[at : at + 1], bitorder="little"))
        return 8 * at + int(places[k - before])


class BoundarySet:
    """Distinct positions, given in ascending order."""

    def __init__(self, positions: np.ndarray):
        high = positions >> 16
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[starts]
        edges = np.append(starts, len(positions))
        self.containers = [
            Container(positions[a:b] & (CHUNK - 1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
        ]
        self.ends = edges[1:]

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def select(self, k: int) -> int:
        """The position of rank ``k``, counted from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.ends, k, side="right"))
        before = int(self.ends[at - 1]) if at else 0
        return (int(self.keys[at]) << 16) + self.containers[at].select(k - before)
