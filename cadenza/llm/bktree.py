"""BK-trees over 64-bit fingerprints, searched for many values at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A subtree of at most this many values is one leaf, compared value by value.
LEAF = 64
#: Values that walk the tree together; bounds what one step holds.
TOGETHER = 1024


class PackedBKTree:
    """A BK-tree over an array: children hang on the edge that is their Hamming distance to the parent.

    A whole set of queries goes down an edge at once, those only whose own distance to the parent is
    within the radius of the edge.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        # a node is (its value's position, [(edge, child), ...]); a leaf is (positions, None)
        self.root = self._node(np.arange(len(values)))

    def _node(self, own: np.ndarray) -> tuple:
        top: list = []
        waiting = [(own, top, 0)]
        while waiting:  # trees of near copies are deep: no recursion
            own, siblings, edge = waiting.pop()
            if len(own) <= LEAF:
                siblings.append((edge, (own, None)))
                continue
            below: list = []
            siblings.append((edge, (own[0], below)))
            rest = own[1:]
            apart = np.bitwise_count(self.values[rest] ^ self.values[own[0]])
            order = np.argsort(apart, kind="stable")
            rest, apart = rest[order], apart[order]
            for part in np.split(np.arange(len(rest)), np.flatnonzero(np.diff(apart)) + 1):
                waiting.append((rest[part], below, int(apart[part[0]])))
        return top[0][1]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in ``queries``, position in the tree's array) of all values at most ``radius`` apart, in parts."""
        for at in range(0, len(queries), TOGETHER):
            stack = [(self.root, np.arange(at, min(at + TOGETHER, len(queries))))]
            while stack:
                (own, below), asked = stack.pop()
                if below is None:
                    i, j = np.nonzero(np.bitwise_count(queries[asked][:, None] ^ self.values[own][None, :]) <= radius)
                    if len(i):
                        yield asked[i], own[j]
                    continue
                apart = np.bitwise_count(queries[asked] ^ self.values[own]).astype(np.int64)
                near = asked[apart <= radius]
                if len(near):
                    yield near, np.full(len(near), own)
                for edge, child in below:
                    go = asked[np.abs(apart - edge) <= radius]
                    if len(go):
                        stack.append((child, go))
