"""BK-trees over 64-bit fingerprints, many at once as numpy arrays.

A forest holds one tree for each shard. Children are keyed by their Hamming distance to
the parent, and a search follows only edges whose key differs from the distance at hand by
no more than the radius. Both building and searching advance all shards level by level, so
thousands of small trees cost no more Python than one.
"""

from __future__ import annotations

import numpy as np

#: (query, node) pairs that a search holds at once.
FRONTIER = 1 << 18


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """Trees over ``values``; ``shard`` names the tree of each value (0, 1, 2, ...)."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values, self.shard = values, shard
        size = len(values)
        self.root = np.full(int(shard.max(initial=-1)) + 1, -1, np.int64)
        first = np.unique(shard, return_index=True)
        self.root[first[0]] = first[1]
        parent, edge = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        waiting = np.setdiff1d(np.arange(size), self.root)
        at = self.root[shard[waiting]]
        while len(waiting):
            distance = hamming(values[waiting], values[at])
            key, lead, group = np.unique(at * 65 + distance, return_index=True, return_inverse=True)
            child = waiting[lead]
            parent[child], edge[child] = key // 65, key % 65
            stays = np.ones(len(waiting), bool)
            stays[lead] = False
            waiting, at = waiting[stays], child[group[stays]]
        order = np.argsort(parent * 65 + edge, kind="stable")
        self.children = order[np.searchsorted(parent[order], 0) :]
        self.key = parent[self.children] * 65 + edge[self.children]

    def within(self, queries: np.ndarray, radius: int):
        """Yields arrays (query, value, distance): all values of a query's own tree within
        the radius, for queries given as indexes of values, itself included."""
        for part in np.array_split(queries, max(1, len(queries) // 1024)):
            yield from self._search(part, self.root[self.shard[part]], radius)

    def _search(self, query: np.ndarray, node: np.ndarray, radius: int):
        while len(query):
            if len(query) > FRONTIER:
                half = len(query) // 2
                yield from self._search(query[:half], node[:half], radius)
                query, node = query[half:], node[half:]
                continue
            distance = hamming(self.values[query], self.values[node])
            near = distance <= radius
            if near.any():
                yield query[near], node[near], distance[near]
            low = np.searchsorted(self.key, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.key, node * 65 + np.minimum(distance + radius, 64), side="right")
            fan = high - low
            total = np.cumsum(fan)
            step = np.arange(total[-1] if len(total) else 0) - np.repeat(total - fan, fan)
            query, node = np.repeat(query, fan), self.children[np.repeat(low, fan) + step]


def components(size: int, left: np.ndarray, right: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index reachable from each of ``size`` nodes over the edges given, on
    top of an earlier labelling."""
    label = np.arange(size) if label is None else label
    while True:
        a, b = label[left], label[right]
        differ = a != b
        if not differ.any():
            return label
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]
