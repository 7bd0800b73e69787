"""Exact similarity self-join of sets held in memory, skipping by relations between sets.

Sets come by ascending size. Tokens are ordered by how many sets have them, and
an index lists, for each token, the sets that have it with its position there,
in blocks with the most tokens that any of the block's sets has left from that
position on: a block is skipped when that can't reach the overlap needed. A set
that is highly similar to one whose overlaps with all others are known gets its
own from those: minus the counts of tokens that it lacks, plus those it adds.
"""

from __future__ import annotations

import numpy as np

#: Entries of a block of an index list.
BLOCK = 16
#: From this similarity on, overlaps are derived instead of searched for; and of so many sets overlaps are kept.
DERIVE, KEPT = 0.8, 32


class Roots:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def of(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.of(a), self.of(b)
        self.up[max(a, b)] = min(a, b)


def linked(overlap, a, b, percent: int):
    """100 * intersection >= percent * union."""
    return (100 + percent) * overlap >= percent * (a + b)


class SetJoin:
    def __init__(self, sets: list[np.ndarray], percent: int = 75):
        """sets: distinct tokens of each, as sorted arrays."""
        self.percent, self.n = percent, len(sets)
        self.by_size = np.argsort([len(s) for s in sets], kind="stable")
        self.sizes = np.array([len(sets[k]) for k in self.by_size], np.int64)
        owner = np.repeat(np.arange(self.n), self.sizes)
        tokens = np.concatenate([sets[k] for k in self.by_size]) if self.n else np.zeros(0, np.uint64)
        _, ids, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))  # rare tokens first
        ids = rank[ids]
        order = np.lexsort((ids, owner))
        self.tokens, self.offsets = ids[order], np.concatenate([[0], np.cumsum(self.sizes)])
        position = np.arange(len(ids)) - self.offsets[owner]
        by_token = np.argsort(self.tokens, kind="stable")  # owners stay ascending, so sizes do
        self.list_owner = owner[by_token]
        self.list_left = self.sizes[self.list_owner] - position[by_token]
        self.list_at = np.concatenate([[0], np.cumsum(np.bincount(self.tokens, minlength=len(counts)))])
        self.roots = Roots(self.n)
        self.compared = self.skipped = self.derived = 0

    def set(self, x: int) -> np.ndarray:
        return self.tokens[self.offsets[x] : self.offsets[x + 1]]

    def _counts(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set has."""
        first, size = self.list_at[tokens], self.list_at[tokens + 1] - self.list_at[tokens]
        size_before = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(first - size_before, size)
        return np.bincount(self.list_owner[at], minlength=self.n)

    def needed(self, a: int, b: int) -> int:
        return -(-self.percent * (a + b) // (100 + self.percent))

    def _candidates(self, x: int) -> set[int]:
        """Smaller sets, or earlier ones of equal size, that share a prefix token and may reach the overlap needed."""
        mine, size = self.set(x), int(self.sizes[x])
        smallest = int(np.searchsorted(self.sizes, -(-self.percent * size // 100)))
        found: set[int] = set()
        for i, token in enumerate(mine[: size - -(-self.percent * size // 100) + 1].tolist()):
            a, b = int(self.list_at[token]), int(self.list_at[token + 1])
            a += int(np.searchsorted(self.list_owner[a:b], smallest))
            b = a + int(np.searchsorted(self.list_owner[a:b], x))
            for at in range(a, b, BLOCK):
                owners, left = self.list_owner[at : min(b, at + BLOCK)], self.list_left[at : min(b, at + BLOCK)]
                if min(size - i, int(left.max())) < self.needed(size, int(self.sizes[owners[0]])):
                    self.skipped += 1
                    continue
                fit = (100 + self.percent) * np.minimum(left, size - i) >= self.percent * (size + self.sizes[owners])
                found.update(owners[fit].tolist())
        return found

    def run(self) -> None:
        """Join the roots of all sets that are linked, directly or through others here."""
        known: list[tuple[int, np.ndarray]] = []  # sets with their overlaps with all others
        for x in range(self.n):
            size = int(self.sizes[x])
            if not size:
                continue
            parent = max(known, key=lambda k: k[1][x] / (size + self.sizes[k[0]] - k[1][x]), default=None)
            if parent is not None and linked(parent[1][x], size, self.sizes[parent[0]], int(100 * DERIVE)):
                theirs, mine = self.set(parent[0]), self.set(x)
                counts = parent[1] - self._counts(np.setdiff1d(theirs, mine, True)) + self._counts(np.setdiff1d(mine, theirs, True))
                self.derived += 1
                for y in np.flatnonzero(linked(counts, size, self.sizes, self.percent) & (counts > 0)).tolist():
                    self.roots.join(x, y)
                known = [(x, counts), *known][:KEPT]
                continue
            hits = 0
            for y in self._candidates(x):
                if self.roots.of(x) != self.roots.of(y):
                    self.compared += 1
                    overlap = len(np.intersect1d(self.set(x), self.set(y), True))
                    if linked(overlap, size, int(self.sizes[y]), self.percent):
                        self.roots.join(x, y)
                        hits += 1
            if hits or self.n <= KEPT:
                known = [(x, self._counts(self.set(x))), *known][:KEPT]

    def labels(self) -> np.ndarray:
        """For each set the place in the input of the first of its group."""
        root = np.array([self.roots.of(k) for k in range(self.n)], np.int64)
        first = np.full(self.n, self.n, np.int64)
        np.minimum.at(first, root, self.by_size)
        found = np.empty(self.n, np.int64)
        found[self.by_size] = first[root]
        return found
