"""BK-trees of many shards side by side, as arrays.

A node's children are keyed by their integer Hamming distance to it. Trees grow level by
level: of the members that stand at a node with one distance the first becomes the child
and the others move on to it. A search follows only the edges whose distance is within
the radius of the member's own, for many members at once, and only to earlier members.

Links are kept as labels: members that are linked bear one label. A subtree of one label
is left out for members of that label, so a large group of near copies costs little once
its members are linked, and no pair within it is listed.
"""

from __future__ import annotations

import numpy as np

#: Distances are below this.
EDGE = 128
#: Members that search before labels are brought up to date, and places that are looked at together.
QUERIES, FRONT = 2_048, 1 << 17


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int64)


class Forest:
    """fp: distinct members (unsigned) of each shard, one shard after the other; bounds: where shards start, and the end."""

    def __init__(self, fp: np.ndarray, bounds: np.ndarray):
        self.fp, n = fp, len(fp)
        self.label = np.arange(n)
        self.parent = np.full(n, -1)
        self.edge = np.zeros(n, np.int64)
        self.levels: list[np.ndarray] = []  # members of each depth below the roots
        at = np.repeat(bounds[:-1], np.diff(bounds))
        rest = np.flatnonzero(at != np.arange(n))
        while len(rest):
            d = distance(fp[rest], fp[at[rest]])
            key = at[rest] * EDGE + d
            _, first, whose = np.unique(key, return_index=True, return_inverse=True)
            new = rest[first]
            self.parent[new], self.edge[new] = at[new], d[first]
            self.levels.append(new)
            at[rest] = new[whose]
            rest = rest[at[rest] != rest]
        below = np.flatnonzero(self.parent >= 0)
        key = self.parent[below] * EDGE + self.edge[below]
        order = np.argsort(key)
        self.keys, self.kids = key[order], below[order]
        self.root = np.repeat(bounds[:-1], np.diff(bounds))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Give linked members one label, the least of the two."""
        while True:
            x, y = self.label[a], self.label[b]
            if (x == y).all():
                return
            to = np.arange(len(self.label))
            np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
            while (to != to[to]).any():
                to = to[to]
            self.label = to[self.label]

    def uniform(self) -> np.ndarray:
        """The label of all members of the subtree of each, or -1."""
        low, high = self.label.copy(), self.label.copy()
        for level in reversed(self.levels):
            up = self.parent[level]
            np.minimum.at(low, up, low[level])
            np.maximum.at(high, up, high[level])
        return np.where(low == high, low, -1)

    def _search(self, who: np.ndarray, radius: int, same: np.ndarray) -> None:
        """Link members with all earlier ones within the radius."""
        todo = [(who, self.root[who])]
        while todo:
            who, at = todo.pop()
            if len(who) > FRONT:
                half = len(who) // 2
                todo += [(who[:half], at[:half]), (who[half:], at[half:])]
                continue
            open_ = (at < who) & (same[at] != self.label[who])
            who, at = who[open_], at[open_]
            if not len(who):
                continue
            d = distance(self.fp[who], self.fp[at])
            near = d <= radius
            if near.any():
                self.join(who[near], at[near])
            low = np.searchsorted(self.keys, at * EDGE + np.maximum(1, d - radius))
            many = np.searchsorted(self.keys, at * EDGE + d + radius, "right") - low
            total = int(many.sum())
            if total:
                place = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                todo.append((np.repeat(who, many), self.kids[place]))

    def link(self, radius: int) -> np.ndarray:
        """Label of every member (the place of the first it is linked with): linked are all pairs within the radius, and what they reach."""
        close = np.flatnonzero((self.parent >= 0) & (self.edge <= radius))
        self.join(close, self.parent[close])
        for i in range(0, len(self.fp), QUERIES):
            same = self.uniform()
            if (same[np.unique(self.root)] >= 0).all():
                break
            self._search(np.arange(i, min(i + QUERIES, len(self.fp))), radius, same)
        return self.label
