"""Boosted trees over binned features, fitted with numpy on a bounded sample: gradient boosting and an additive model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner bin edges per feature, at its quantiles."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(c, at)) for c in x.T]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)], axis=1) if len(edges) else np.zeros(x.shape, np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Trees:
    """Complete binary trees of one depth: node i has children 2i+1 and 2i+2; a leaf adds its value."""

    edges: list[np.ndarray]
    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = to_bins(x, self.edges), np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += v[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss."""
    edges = quantile_edges(x, bins)
    b, n_feat = to_bins(x, edges), x.shape[1]
    p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p0 / (1 - p0)))
    z, inner, leaves = np.full(len(y), base), 2 ** depth - 1, 2 ** depth
    feature, cut, value = np.zeros((trees, inner), np.int64), np.zeros((trees, inner), np.int64), np.zeros((trees, leaves))
    for t in range(trees):
        p = sigmoid(z)
        g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            low, wide = 2 ** level - 1, 2 ** level
            at = (((node - low)[:, None] * n_feat + np.arange(n_feat)) * bins + b).ravel()
            size = wide * n_feat * bins
            gs = np.bincount(at, np.repeat(g, n_feat), size).reshape(wide, n_feat, bins).cumsum(2)
            hs = np.bincount(at, np.repeat(h, n_feat), size).reshape(wide, n_feat, bins).cumsum(2)
            total_g, total_h = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs ** 2 / (hs + l2) + (total_g - gs) ** 2 / (total_h - hs + l2)
            best = gain.reshape(wide, -1).argmax(1)
            feature[t, low:low + wide], cut[t, low:low + wide] = best // bins, best % bins
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[t, node]] > cut[t, node])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        z += value[t, leaf]
    return Trees(edges, base, feature, cut, value)


def monotone_probability(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic calibration: scores and the probability from each of them on (pool adjacent violators).

    With `n`, row i stands for n[i] rows of score z[i], y[i] of them positive.
    """
    blocks: list[list[float]] = []  # first score, sum, count
    order = np.argsort(z, kind="stable")
    for s, v, c in zip(z[order], y[order], np.ones(len(z)) if n is None else n[order]):
        blocks.append([float(s), float(v), float(c)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, v2, n2 = blocks.pop()
            blocks[-1][1] += v2
            blocks[-1][2] += n2
    return np.array([b[0] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])


@dataclass
class Additive:
    """A generalised additive model: a table per feature and per pair of features, looked up by bin and summed."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        b, c = to_bins(x, self.edges), to_bins(x, self.pair_edges)
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[c[:, i], c[:, j]]
        return out


def _line_tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Newton steps of a shallow tree over ordered bins: the best cut again and again, up to so many leaves."""
    gs, hs = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + l2)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best, where = 1e-12, None
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                if gain.max() > best:
                    best, where = gain.max(), int(m[gain.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + l2)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """Newton steps of a tree over a grid: the best cut of one axis, then of the other on each side. Also its gain."""
    best, out = -1.0, np.zeros(g.shape)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for m in range(1, len(a)):
            gain, step = 0.0, np.zeros(a.shape)
            for part in (slice(0, m), slice(m, None)):
                gs, hs = a[part].sum(0).cumsum(), b[part].sum(0).cumsum()
                worth = gs[:-1] ** 2 / (hs[:-1] + l2) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + l2)
                k = int(worth.argmax())
                gain += float(worth[k])
                step[part, :k + 1] = gs[k] / (hs[k] + l2)
                step[part, k + 1:] = (gs[-1] - gs[k]) / (hs[-1] - hs[k] + l2)
            if gain > best:
                best, out = gain, step.T if flip else step
    return out, best


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 48, leaves: int = 4, pairs: int = 6,
                 pair_bins: int = 8, pair_rounds: int = 60, l2: float = 2.0) -> Additive:
    """Cyclic boosting: in every round each feature in turn gets a shallow tree on what is left; then the pairs that gain most."""
    edges, pair_edges = quantile_edges(x, bins), quantile_edges(x, pair_bins)
    b, c = to_bins(x, edges), to_bins(x, pair_edges)
    p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p0 / (1 - p0)))
    z, tables = np.full(len(y), base), [np.zeros(len(e) + 1) for e in edges]
    for _ in range(rounds):
        for j, t in enumerate(tables):
            p = sigmoid(z)
            step = rate * _line_tree(np.bincount(b[:, j], y - p, len(t)), np.bincount(b[:, j], p * (1 - p), len(t)), leaves, l2)
            t += step
            z += step[b[:, j]]
    p = sigmoid(z)

    def grid(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(pair_edges[i]) + 1, len(pair_edges[j]) + 1
        at = c[:, i] * shape[1] + c[:, j]
        return np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    able = [j for j, e in enumerate(pair_edges) if len(e)]
    ranked = sorted(((_grid_tree(*grid(i, j, p), l2)[1], i, j) for i in able for j in able if i < j), reverse=True)
    chosen = [(i, j) for _, i, j in ranked[:pairs]]
    pair_tables = [np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)) for i, j in chosen]
    for _ in range(pair_rounds):
        for (i, j), t in zip(chosen, pair_tables):
            step = rate * _grid_tree(*grid(i, j, sigmoid(z)), l2)[0]
            t += step
            z += step[c[:, i], c[:, j]]
    return Additive(edges, base, tables, chosen, pair_edges, pair_tables)
