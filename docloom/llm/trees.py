"""Gradient-boosted regression trees over binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Forest:
    """Softmax boosting: each round grows one tree for each class on the gradients of the log-loss."""

    def __init__(self, classes: int, rounds: int = 30, depth: int = 5, rate: float = 0.25, smooth: float = 1.0, least: float = 0.5):
        self.classes, self.rounds, self.depth, self.rate, self.smooth, self.least = classes, rounds, depth, rate, smooth, least
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.start = np.zeros(classes)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete binary tree: split feature and bin of each inner node, value of each leaf."""
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        place = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        several = [j for j, e in enumerate(self.edges) if len(e) > 1]
        for level in range(self.depth):
            width, first = 1 << level, (1 << level) - 1
            local = place - first
            best = np.full(width, 1e-6)
            g_all, h_all = np.bincount(local, g, width), np.bincount(local, h, width)

            def gain(gl: np.ndarray, hl: np.ndarray) -> np.ndarray:
                gr, hr = g_all[:, None] - gl, h_all[:, None] - hl
                out = gl**2 / (hl + self.smooth) + gr**2 / (hr + self.smooth) - (g_all**2 / (h_all + self.smooth))[:, None]
                out[(hl < self.least) | (hr < self.least)] = 0
                return out

            def take(j: np.ndarray, at: np.ndarray, top: np.ndarray) -> None:
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j[better]
                cut[first : first + width][better] = at[better]

            for j in several:
                key = local * BINS + bins[:, j]
                found = gain(*(np.cumsum(np.bincount(key, v, width * BINS).reshape(width, BINS), axis=1) for v in (g, h)))
                at = found.argmax(axis=1)
                take(np.full(width, j), at, found[np.arange(width), at])
            if len(self.twofold):  # columns of two values: all at once
                sums = []
                for v in (g, h):
                    spread = np.zeros((len(bins), width), np.float32)
                    spread[rows, local] = v
                    sums.append((spread.T @ self.low).astype(np.float64))
                found = gain(*sums)
                at = found.argmax(axis=1)
                take(self.twofold[at], np.zeros(width, np.int64), found[np.arange(width), at])
            place = 2 * place + 1 + (bins[rows, feature[place]] > cut[place])
        leaf = place - inner
        n = 1 << self.depth
        value = -np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + self.smooth) * self.rate
        return feature, cut, value

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        # a column of one value tells nothing; one of two needs a single edge between them
        self.edges = [e if len(e) > 1 else np.unique(x[:, j])[:-1][:1] for j, e in enumerate(self.edges)]
        bins = self.binned(x)
        self.twofold = np.array([j for j, e in enumerate(self.edges) if len(e) == 1], np.int64)
        self.low = (bins[:, self.twofold] == 0).astype(np.float32)
        self.start = np.log(np.bincount(y, minlength=self.classes) / len(y) + 1e-3)
        total = np.tile(self.start, (len(y), 1))
        truth = np.eye(self.classes)[y]
        for _ in range(self.rounds):
            e = np.exp(total - total.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            grown = [self.grow(bins, p[:, c] - truth[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)) for c in range(self.classes)]
            self.trees.append(grown)
            for c, tree in enumerate(grown):
                total[:, c] += self.leaves(bins, tree)
        del self.low
        return self

    def leaves(self, bins: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        place, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            place = 2 * place + 1 + (bins[rows, feature[place]] > cut[place])
        return value[place - len(feature)]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        total = np.tile(self.start, (len(x), 1))
        for grown in self.trees:
            for c, tree in enumerate(grown):
                total[:, c] += self.leaves(bins, tree)
        total -= total.max(axis=1, keepdims=True)
        return total - np.log(np.exp(total).sum(axis=1, keepdims=True))
