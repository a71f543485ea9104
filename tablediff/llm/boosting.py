"""Gradient-boosted trees with logistic loss over binned dense features, and isotonic calibration.

A tree grows level by level from sums of its rows (gradients, second derivatives, counts) over nodes, features and bins, and the
sums of parts of the rows add up to those of all; so rows may lie in any number of tasks. Gradients are rounded to EXACT, which
makes sums of doubles exact and the trees independent of the order of the rows.
"""

from __future__ import annotations

import numpy as np

BINS = 32
#: Gradients are multiples of it, so that doubles add up to 2**33 of them without an error.
EXACT = 2.0**-20


class BoostedTrees:
    """Complete trees of a fixed depth; a row goes right where its bin exceeds the node's cut."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, smooth: float = 1.0, least: int = 10):
        self.trees, self.depth, self.rate, self.smooth, self.least = trees, depth, rate, smooth, least

    def start(self, edges: list[np.ndarray], share: float) -> BoostedTrees:
        """No trees yet; edges: of each feature the upper ends of its bins but the last, share: of rows that are 1."""
        self.edges = [np.asarray(e, np.float32) for e in edges]
        share = np.clip(share, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.feature, self.cut, self.value, self.level = [], [], [], self.depth
        return self

    def bins(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32, copy=False)
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def _node(self, columns: np.ndarray, tree: int, levels: int) -> np.ndarray:
        """The place of each row (columns: the rows' bins by feature) among the nodes behind so many levels."""
        below = [np.zeros(columns.shape[1], np.uint8)]
        for level in reversed(range(levels)):
            first, half = (1 << level) - 1, np.uint8(1 << (levels - 1 - level))
            right = [columns[self.feature[tree][k]] > int(self.cut[tree][k]) for k in range(first, 2 * first + 1)]
            below = [r.view(np.uint8) if len(below) == 1 else np.where(r, below[2 * k + 1] + half, below[2 * k]) for k, r in enumerate(right)]
        return below[0]

    def sums(self, binned: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the rows, for the level that grows next: gradient, second derivative and count by node, feature and bin."""
        n, f = binned.shape
        grown = self.level % self.depth  # levels of the open tree
        p = 1 / (1 + np.exp(-self.margin_of(binned)))
        width = 1 << grown
        node = self._node(np.ascontiguousarray(binned.T), len(self.value), grown).astype(np.int64)
        at = (node[:, None] * (f * BINS) + binned + np.arange(f) * BINS).ravel()
        values = np.rint((y - p) / EXACT) * EXACT, np.rint(p * (1 - p) / EXACT) * EXACT, np.ones(n)
        return np.stack([np.bincount(at, np.repeat(v, f), width * f * BINS) for v in values]).reshape(3, width, f, BINS)

    def grow(self, sums: np.ndarray) -> None:
        """Grows a level from the sums of all rows; behind the last one the tree has its values."""
        grown, inner = self.level % self.depth, (1 << self.depth) - 1
        if not grown:
            self.level = 0
            self.feature.append(np.zeros(inner, np.int32))
            self.cut.append(np.full(inner, BINS, np.int32))
        left = sums.cumsum(3)
        total = left[..., -1:]
        right = total - left
        gain = left[0] ** 2 / (left[1] + self.smooth) + right[0] ** 2 / (right[1] + self.smooth) - total[0] ** 2 / (total[1] + self.smooth)
        gain[(left[2] < self.least) | (right[2] < self.least)] = -1
        width = sums.shape[1]
        gain, nodes = gain.reshape(width, -1), np.arange(width)
        best = gain.argmax(1)
        good, first = gain[nodes, best] > 1e-9, width - 1
        self.feature[-1][first : first + width] = best // BINS
        self.cut[-1][first : first + width] = np.where(good, best % BINS, BINS)
        self.level += 1
        if self.level == self.depth:
            own = left[:, nodes, best // BINS, np.where(good, best % BINS, BINS - 1)]
            leaf = np.stack([own, total[:, nodes, 0, 0] - own], 2).reshape(3, -1)
            self.value.append(self.rate * leaf[0] / (leaf[1] + self.smooth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x = x.astype(np.float32)
        self.start([np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])], y.mean())
        binned = self.bins(x)
        for _ in range(self.trees * self.depth):
            self.grow(self.sums(binned, y))
        return self

    def margin_of(self, binned: np.ndarray) -> np.ndarray:
        """The margins of rows of bins, by the trees that have grown."""
        out, columns = np.full(len(binned), self.base), np.ascontiguousarray(binned.T)
        for tree, value in enumerate(self.value):
            out += value[self._node(columns, tree, self.depth)]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.margin_of(self.bins(x))


class Isotonic:
    """Non-decreasing map from margins to probabilities by pooling adjacent violators."""

    def fit(self, margin: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> Isotonic:
        """y: for each margin the sum of its n rows, which are one if n is not given."""
        n = np.ones(len(margin)) if n is None else n
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum, size, margin sum
        for m, v, k in zip(margin[order], y[order], n[order]):
            blocks.append([float(v), float(k), float(m * k)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, k, t = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + k, blocks[-1][2] + t]
        self.x = np.array([t / k for s, k, t in blocks])
        self.p = np.array([s / k for s, k, t in blocks])
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        # a trace of the margin itself keeps rows of one block in order
        return np.clip(0.998 * np.interp(margin, self.x, self.p) + 0.002 / (1 + np.exp(-margin)), 0.0, 1.0)
