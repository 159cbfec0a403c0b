"""Candidates (pair, conditioning set) of a level by their numbers: none is stored or shuffled until it is asked for.

The sets of k neighbours of a pair's base end, without its other end, are numbered in lexicographic order by the
combinatorial number system; a level's candidates are numbered through by prefix sums of their counts, so tasks get equal
ranges of numbers and make their own candidates from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Counts from here on can't be told apart; a level whose pairs have so many candidates can't be numbered.
MOST = 1 << 62


def binomials(n: int, k: int) -> np.ndarray:
    """(k + 1) x (n + 1): the number of sets of t among m things, at most MOST."""
    out = np.zeros((k + 1, n + 1), np.int64)
    out[0] = 1
    for t in range(1, k + 1):
        for m in range(t, n + 1):
            out[t, m] = min(MOST, int(out[t, m - 1]) + int(out[t - 1, m - 1]))
    return out


@dataclass(frozen=True)
class Level:
    """The pairs i < j of a graph in order, each with the end whose neighbours its sets are taken from (with both ends, a pair
    stands twice), and the neighbours of all nodes in one piece: those of v are near[starts[v] : starts[v + 1]]."""

    k: int
    i: np.ndarray
    j: np.ndarray
    base: np.ndarray
    near: np.ndarray
    starts: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(adjacent: np.ndarray, k: int, sides: str = "first", pairs: np.ndarray | None = None) -> Level:
        """adjacent: symmetric p x p booleans. pairs: which entries i < j of it are wanted, all by default."""
        i, j = np.nonzero(np.triu(adjacent if pairs is None else pairs, 1))
        starts = np.concatenate([[0], np.cumsum(adjacent.sum(axis=1))])
        base = i
        if sides == "both":
            order = np.argsort(np.concatenate([2 * np.arange(len(i)), 2 * np.arange(len(i)) + 1]), kind="stable")
            base, i, j = np.concatenate([i, j])[order], np.concatenate([i, i])[order], np.concatenate([j, j])[order]
        most = int(np.diff(starts).max(initial=1))
        level = Level(k, i.astype(np.int32), j.astype(np.int32), base.astype(np.int32), np.nonzero(adjacent)[1].astype(np.int32), starts, binomials(max(most, k), k))
        if len(i) and level.counts().max() >= MOST:
            raise OverflowError(f"Over {MOST} sets of {k} for one pair")
        return level

    def counts(self) -> np.ndarray:
        """Candidates of each pair."""
        return self.table[self.k][np.maximum(np.diff(self.starts)[self.base] - 1, 0)]

    def sets(self, pair: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The nodes of the rank-th set (from 0) of each pair, ascending."""
        base = self.base[pair]
        other = np.where(base == self.i[pair], self.j[pair], self.i[pair])
        first, n = self.starts[base], np.diff(self.starts)[base] - 1
        # the rank from the end, greedily by the largest binomials, gives the places counted from the end
        left, out = self.table[self.k][n] - 1 - rank, np.empty((len(pair), self.k), np.int64)
        for t in range(self.k, 0, -1):
            c = np.searchsorted(self.table[t], left, side="right") - 1
            out[:, self.k - t] = n - 1 - c
            left = left - self.table[t][c]
        # places among the neighbours without the other end: those from its own place on are one further
        own = _places(self.near, first, n + 1, other)
        return self.near[first[:, None] + out + (out >= own[:, None])].astype(np.int64)


def _places(near: np.ndarray, first: np.ndarray, n: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The place of each node among the ascending neighbours near[first : first + n], by halving."""
    low, high = np.zeros(len(first), np.int64), n.astype(np.int64)
    while (low < high).any():
        mid = (low + high) // 2
        less = near[np.minimum(first + mid, len(near) - 1)] < node
        low, high = np.where(less & (low < high), mid + 1, low), np.where(less | (low >= high), high, mid)
    return low


def numbered(ends: np.ndarray, begins: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, rank) of the candidates numbered low to high - 1, where pair q has the numbers up to ends[q], the first of
    which is its set begins[q]."""
    number = np.arange(low, high)
    pair = np.searchsorted(ends, number, side="right")
    before = np.concatenate([[0], ends])[pair]
    return pair, begins[pair] + number - before
