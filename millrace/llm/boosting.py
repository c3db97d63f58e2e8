"""Gradient-boosted trees with monotonic constraints, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """One row of nodes a tree. A leaf points at itself, so every row walks ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``; all trees are walked at once."""
        n_trees = len(self.feature)
        if not n_trees or not len(x):
            return np.full(len(x), self.start)
        tree = np.arange(n_trees)[None, :]
        node = np.zeros((len(x), n_trees), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[tree, node]] <= self.threshold[tree, node]
            node = np.where(goes_left, self.left[tree, node], self.right[tree, node])
        return self.start + self.value[tree, node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _best_split(binned, g, h, rows, n_bins, sign, low, high, least, l2):
    """(gain, feature, bin, left value, right value) or None."""
    best = None
    parent = g[rows].sum() ** 2 / (h[rows].sum() + l2)
    for f in range(binned.shape[1]):
        b = binned[rows, f]
        gs = np.cumsum(np.bincount(b, g[rows], n_bins))
        hs = np.cumsum(np.bincount(b, h[rows], n_bins))
        ns = np.cumsum(np.bincount(b, minlength=n_bins))
        gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
        gr, hr, nr = gs[-1] - gl, hs[-1] - hl, ns[-1] - nl
        vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
        gain = -(2 * gl * vl + (hl + l2) * vl**2) - (2 * gr * vr + (hr + l2) * vr**2) - parent
        allowed = (nl >= least) & (nr >= least) & (sign[f] * (vr - vl) >= 0)
        if allowed.any():
            gain = np.where(allowed, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k, vl[k], vr[k])
    return best


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int] | None = None,
    n_trees: int = 80,
    depth: int = 3,
    rate: float = 0.15,
    n_bins: int = 64,
    least: int = 5,
    l2: float = 1.0,
) -> Trees:
    """Boost trees on log-loss. ``monotone`` maps a feature to 1 (the score never falls as it grows) or -1:
    a split whose children go the other way is not taken, and the middle of their values bounds all below."""
    n, d = x.shape
    sign = np.array([(monotone or {}).get(f, 0) for f in range(d)])
    mean = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(mean / (1 - mean)))
    nodes = 2 ** (depth + 1) - 1
    if n == 0 or y.min() == y.max():
        none = np.zeros((0, nodes), np.int64)
        return Trees(none, none.astype(float), none, none, none.astype(float), start, depth)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins)[1:-1])) for f in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, out = np.full(n, start), {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(nodes, np.int64), np.zeros(nodes)
        left, right, value = np.arange(nodes), np.arange(nodes), np.zeros(nodes)
        todo, free = [(0, np.arange(n), 0, -8.0, 8.0)], 1
        value[0] = -g.sum() / (h.sum() + l2)
        step = np.zeros(n)
        while todo:
            node, rows, level, low, high = todo.pop()
            split = level < depth and _best_split(binned, g, h, rows, n_bins, sign, low, high, least, l2)
            if not split:
                step[rows] = value[node]
                continue
            _, f, k, vl, vr = split
            feature[node], threshold[node] = f, edges[f][k] if k < len(edges[f]) else np.inf
            left[node], right[node] = free, free + 1
            value[free], value[free + 1] = vl, vr
            goes = binned[rows, f] <= k
            middle = (vl + vr) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high),) * 2}[sign[f]]
            todo += [(free, rows[goes], level + 1, *bounds[0]), (free + 1, rows[~goes], level + 1, *bounds[1])]
            free += 2
        margin += rate * step
        for name, values in zip(out, (feature, threshold, left, right, rate * value)):
            out[name].append(values)
    return Trees(**{k: np.stack(v) for k, v in out.items()}, start=start, depth=depth)
