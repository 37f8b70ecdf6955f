"""Gradient-boosted trees from sums over all rows, wherever the rows are; scoring in numpy anywhere."""

from collections.abc import Callable

import numpy as np

from corrobora.llm.logistic import sigmoid

BINS = 32
SCALE = 1 << 24  # slopes and curves are summed as whole numbers of this part, so the order of rows plays no part


class BoostedTrees:
    """Complete trees of one depth over binned columns, for the logistic loss."""

    def __init__(self, trees=40, depth=3, rate=0.2, ridge=1.0):
        self.trees, self.depth, self.rate, self.ridge = trees, depth, rate, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """From rows in memory."""
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        columns, once = self.binned(x), np.ones(len(y))
        return self.grow(len(y), int(y.sum()), lambda: self.sums(columns, y, once))

    def edges_from(self, counts: np.ndarray):
        """The edges of ``fit`` from how often each column (row of ``counts``) has the values 0, 1, ..."""
        upto = counts.cumsum(axis=1)
        ranks = np.floor((upto[0, -1] - 1) * np.linspace(0, 1, BINS + 1)[1:-1])
        self.edges = [np.unique(np.searchsorted(c, ranks, side="right")).astype(float) for c in upto]

    def grow(self, n: int, ones: int, told: Callable[[], np.ndarray]) -> "BoostedTrees":
        """Trees for ``n`` rows, ``ones`` of label 1. ``told()`` gives ``sums`` over all of them, for the trees so far."""
        inner, leaves, width = 2 ** self.depth - 1, 2 ** self.depth, len(self.edges)
        self.base = float(np.log((ones + 1) / (n - ones + 1)))
        self.features = np.zeros((self.trees, inner), dtype=np.int64)
        self.cuts = np.full((self.trees, inner), BINS, dtype=np.int64)  # bins above the cut go right
        self.values = np.zeros((self.trees, leaves))
        for t in range(self.trees):
            for level in range(self.depth):
                self.grown, self.level = t, level
                there = 2 ** level
                g, h = told().reshape(2, there, width, BINS).cumsum(axis=3) / SCALE
                all_g, all_h = g[:, :, -1:], h[:, :, -1:]
                gain = (g ** 2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge)
                        - all_g ** 2 / (all_h + self.ridge)).reshape(there, -1)
                best, each = gain.argmax(axis=1), np.arange(there)
                worth = gain[each, best] > 1e-6
                first = there - 1
                self.features[t, first:first + there] = best // BINS
                self.cuts[t, first:first + there] = np.where(worth, best % BINS, BINS)
            cut = np.where(worth, best % BINS, BINS - 1)
            left = [v[each, best // BINS, cut] for v in (g, h)]
            right = [v[each, best // BINS, -1] - part for v, part in zip((g, h), left)]
            self.values[t] = -self.rate * np.stack(
                [a / (b + self.ridge) for a, b in (left, right)], axis=1).ravel()
        self.grown = self.trees
        return self

    def sums(self, columns: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Slopes and curves of the rows, each counted ``times``, by node of the level in work, column and bin."""
        p = sigmoid(self.raw(columns))
        slope, curve = (np.rint(v * SCALE) * times for v in (p - y, p * (1 - p)))
        there = 2 ** self.level
        node = self.nodes(columns, self.grown, self.level).astype(np.int64) * BINS
        out = np.empty((2, there, len(columns), BINS))
        for k, column in enumerate(columns):
            where = node + column
            for i, v in enumerate((slope, curve)):
                out[i, :, k] = np.bincount(where, v, there * BINS).reshape(there, BINS)
        return out.astype(np.int64)

    def nodes(self, columns: np.ndarray, tree: int, depth: int) -> np.ndarray:
        node = np.zeros(columns.shape[1], dtype=np.uint8)
        for level in range(depth):
            right = np.zeros(len(node), dtype=bool)
            for k in range(2 ** level):
                at = 2 ** level - 1 + k
                right |= (node == k) & (columns[self.features[tree, at]] > self.cuts[tree, at])
            node = 2 * node + right
        return node

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins by column, then row."""
        if x.dtype == np.uint8:  # each value is placed once
            return np.stack([np.searchsorted(e, np.arange(256), side="left").astype(np.uint8)[c] for e, c in zip(self.edges, x.T)])
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)]).astype(np.uint8)

    def raw(self, columns: np.ndarray) -> np.ndarray:
        out = np.full(columns.shape[1], self.base)
        for t in range(self.grown):
            out += self.values[t, self.nodes(columns, t, self.depth)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        return self.raw(self.binned(x))
