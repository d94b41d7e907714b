"""A path through colours that always goes on to the nearest one not yet used."""

from __future__ import annotations

from math import inf, sqrt

import numpy as np

#: Colours in a leaf.
LEAF = 8


class Unused:
    """A k-d tree over distinct points from which points are taken; empty branches are never entered again."""

    def __init__(self, points: np.ndarray, rank: list[int]):
        """rank: which of equally near points comes first."""
        self.at, self.rank = points.tolist(), rank
        self.low, self.high, self.kids, self.left, self.up, self.leaf_of = [], [], [], [], [], [0] * len(points)
        self.members: list[list[int]] = []
        waiting = [(np.arange(len(points)), -1)]
        while waiting:
            own, parent = waiting.pop()
            node, some = len(self.low), points[own]
            low, high = some.min(0), some.max(0)
            self.low.append(low.tolist())
            self.high.append(high.tolist())
            self.left.append(len(own))
            self.up.append(parent)
            self.kids.append(None)
            self.members.append([])
            if parent >= 0:
                self.kids[parent] = (self.kids[parent] or ()) + (node,)
            if len(own) <= LEAF:
                self.members[node] = own.tolist()
                for i in self.members[node]:
                    self.leaf_of[i] = node
            else:
                order, middle = np.argsort(some[:, (high - low).argmax()], kind="stable"), len(own) // 2
                waiting += [(own[order[:middle]], node), (own[order[middle:]], node)]

    def take(self, i: int) -> None:
        node = self.leaf_of[i]
        self.members[node].remove(i)
        while node >= 0:
            self.left[node] -= 1
            node = self.up[node]

    def nearest(self, i: int) -> int:
        """The point left that is nearest to point i; of equals the one of the smallest rank."""
        x, y, z = self.at[i]
        best, found, first = inf, -1, 0
        waiting = [(0.0, 0)]
        while waiting:
            bound, node = waiting.pop()
            if bound > best * best * (1 + 1e-12) or not self.left[node]:
                continue
            if self.kids[node] is None:
                for j in self.members[node]:
                    u, v, w = self.at[j]
                    d = sqrt((u - x) * (u - x) + (v - y) * (v - y) + (w - z) * (w - z))
                    if d < best or (d == best and self.rank[j] < first):
                        best, found, first = d, j, self.rank[j]
                continue
            ahead = []
            for kid in self.kids[node]:
                (a, b, c), (p, q, r) = self.low[kid], self.high[kid]
                dx = a - x if x < a else (x - p if x > p else 0.0)
                dy = b - y if y < b else (y - q if y > q else 0.0)
                dz = c - z if z < c else (z - r if z > r else 0.0)
                ahead.append((dx * dx + dy * dy + dz * dz, kid))
            waiting += ahead if ahead[0][0] > ahead[1][0] else ahead[::-1]  # the nearer one is looked at first
        return found


def nearest_path(colours: np.ndarray) -> list[int]:
    """Rows of colours (n by 3) in the order of the path from the first of the least first coordinate; of equally near rows the first.

    Equal colours follow each other, so only distinct ones are searched: about log n steps for each.
    """
    distinct, first, of = np.unique(colours, axis=0, return_index=True, return_inverse=True)
    same = np.split(np.argsort(of.ravel(), kind="stable"), np.cumsum(np.bincount(of.ravel()))[:-1])
    tree, at = Unused(distinct, first.tolist()), int(of.ravel()[colours[:, 0].argmin()])
    order = same[at].tolist()
    tree.take(at)
    for _ in range(len(distinct) - 1):
        at = tree.nearest(at)
        tree.take(at)
        order += same[at].tolist()
    return order
