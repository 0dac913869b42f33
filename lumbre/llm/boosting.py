"""Gradient-boosted trees on small feature tables, in numpy: fitted on the driver, scored in the executors."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary classifier of boosted trees with logistic loss over binned features, calibrated on held-out rows.

    Fitting takes a bounded sample (the caller's parameter); scoring is vectorised and the fitted object is a few kilobytes.
    """

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0, beta: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.beta = rounds, depth, rate, bins, l2, beta

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1).astype(np.int32) if x.shape[1] else np.zeros(x.shape, np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> "Boosted":
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        held = np.random.default_rng(seed).random(len(y)) < 0.25
        self.edges = []
        for i in range(x.shape[1]):
            values = np.unique(x[:, i])
            mid = (values[1:] + values[:-1]) / 2
            self.edges.append(mid if len(mid) < self.bins else np.unique(np.quantile(x[:, i], np.linspace(0, 1, self.bins + 1)[1:-1])))
        return self.fit_counted(self._bin(x), y, np.ones(len(y)), held)

    def edge(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Borders of the bins of a feature of which all distinct values, in order, and their counts are known."""
        mid = (values[1:] + values[:-1]) / 2
        if len(mid) < self.bins:
            return mid
        at, ends = np.linspace(0, 1, self.bins + 1)[1:-1] * (counts.sum() - 1), np.cumsum(counts)
        low, high = (values[np.searchsorted(ends, f(at), side="right")] for f in (np.floor, np.ceil))
        return np.unique(low + (high - low) * (at % 1))

    def fit_counted(self, b: np.ndarray, y: np.ndarray, n: np.ndarray, held: np.ndarray) -> "Boosted":
        """Fit on rows of bins that occur ``n`` times each; ``edges`` are set, ``held`` rows are for the calibration."""
        train, n_features, n_bins, weight = np.flatnonzero(~held), b.shape[1], self.bins + 1, n[~held]
        p = min(max(np.average(y[train], weights=weight) if len(train) else 0.5, 1e-3), 1 - 1e-3)
        self.base = np.log(p / (1 - p))
        score = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score[train]))
            g, h = weight * (y[train] - q), weight * np.maximum(q * (1 - q), 1e-6)
            node = np.zeros(len(train), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int32), np.full(2**self.depth - 1, n_bins, np.int32)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                for f in range(n_features):
                    key = node * n_bins + b[train, f]
                    gs = np.bincount(key, g, width * n_bins).reshape(width, n_bins).cumsum(1)
                    hs = np.bincount(key, h, width * n_bins).reshape(width, n_bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[:, -1] = 0
                    at = gain.argmax(1)
                    value = gain[np.arange(width), at]
                    better = value > best
                    best[better] = value[better]
                    feature[first : first + width][better] = f
                    cut[first : first + width][better] = at[better]
                own = first + node
                node = node * 2 + (b[train, feature[own]] > cut[own])
            gs, hs = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            leaf = self.rate * gs / (hs + self.l2)
            self.trees.append((feature, cut, leaf))
            score += leaf[self._leaf(b, feature, cut)]
        self._calibrate(score[held], y[held], n[held])
        return self

    def _leaf(self, b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for level in range(self.depth):
            own = 2**level - 1 + node
            node = node * 2 + (b[rows, feature[own]] > cut[own])
        return node

    def _calibrate(self, s: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Platt scaling on the held-out rows by a few Newton steps, then the probability with the best F measure as
        threshold; ``beta`` above 1 weighs recall more."""
        a, c = 1.0, 0.0
        size, hits = n.sum(), (n * y).sum()
        if size >= 20 and 0 < hits < size:
            t = np.where(y > 0, (hits + 1) / (hits + 2), 1 / (size - hits + 2))
            for _ in range(25):
                q = 1 / (1 + np.exp(-(a * s + c)))
                w = n * np.maximum(q * (1 - q), 1e-9)
                grad = np.array([(n * (t - q) * s).sum() - 1e-3 * (a - 1), (n * (t - q)).sum()])
                hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
                step = np.linalg.solve(hess, grad)
                a, c = a + np.clip(step[0], -1, 1), c + np.clip(step[1], -2, 2)
        self.a, self.c = max(a, 1e-2), c
        q = 1 / (1 + np.exp(-(self.a * s + self.c)))
        grid = np.linspace(0.2 if self.beta <= 1 else 0.08, 0.8, 31)
        w = self.beta**2
        f1 = [(1 + w) * n[(q >= v) & (y > 0)].sum() / max(1, n[q >= v].sum() + w * hits) for v in grid]
        best = [v for v, f in zip(grid, f1) if f >= max(f1) - 1e-9] if len(y) else [0.5]
        self.threshold = float(min(best, key=lambda v: abs(v - 0.5)))
        self.held_f1 = float(max(f1)) if len(y) else float("nan")

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        if not len(x):
            return np.zeros(0)
        b = self._bin(np.asarray(x, np.float64))
        score = np.full(len(b), self.base)
        for feature, cut, leaf in self.trees:
            score += leaf[self._leaf(b, feature, cut)]
        return 1 / (1 + np.exp(-np.clip(self.a * score + self.c, -40, 40)))
