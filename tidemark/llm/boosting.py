"""Gradient-boosted trees for a 0/1 label, with monotonic constraints, flattened into numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """All nodes of all trees, one after another; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 by boosted trees, whose leaves add to the log-odds."""
        return sigmoid(self.vote(x))

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Base and sum of the leaves that each row falls into."""
        out = np.full(len(x), self.base)
        for low in range(0, len(x), 4096):
            rows = x[low : low + 4096]
            node = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
            each = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                feature = self.feature[node]
                below = rows[each, np.maximum(feature, 0)] <= self.threshold[node]
                node = np.where(feature < 0, node, np.where(below, self.left[node], self.right[node]))
            out[low : low + 4096] += self.value[node].sum(axis=1)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 2.0, least: int = 10) -> Trees:
    """Newton boosting on the logistic loss over quantile bins.

    ``monotone`` maps a feature to +1 or -1: the score never falls (rises) as it grows. A
    split against its constraint is not taken, and the values below a constrained split
    stay on their side of the middle between its two halves.
    """
    n, width = x.shape
    direction = np.zeros(width)
    for k, sign in (monotone or {}).items():
        direction[k] = sign
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(width)]
    binned = np.column_stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(width)]) + np.arange(width) * BINS
    nodes: list[list[float]] = []
    roots = []
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(n, base)
    for _ in range(trees):
        p = sigmoid(margin)
        slope, bend = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([-1, 0, -1, -1, 0])
        open_nodes = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while open_nodes:
            at, rows, low, high, level = open_nodes.pop()
            g, h = slope[rows].sum(), bend[rows].sum()
            own = np.clip(-g / (h + ridge), low, high)
            split = _split(binned[rows], slope[rows], bend[rows], g, h, own, direction, low, high, ridge, least, width) if level < depth else None
            if split is None:
                nodes[at][4] = rate * own
                margin[rows] += rate * own
                continue
            k, b, w_left, w_right = split
            mid = (w_left + w_right) / 2
            under = binned[rows, k] <= k * BINS + b
            bounds = [(low, high), (low, high)]
            if direction[k] > 0:
                bounds = [(low, mid), (mid, high)]
            elif direction[k] < 0:
                bounds = [(mid, high), (low, mid)]
            nodes[at][:4] = [k, edges[k][b], len(nodes), len(nodes) + 1]
            for part, (a, z) in zip((rows[under], rows[~under]), bounds):
                open_nodes.append((len(nodes), part, a, z, level + 1))
                nodes.append([-1, 0, -1, -1, 0])
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots), depth, base)


def _split(binned, slope, bend, g, h, own, direction, low, high, ridge, least, width, usable=None):
    """Feature, bin and halves' values of the best allowed split, or None."""
    flat = binned.ravel()
    sums = [np.bincount(flat, weights=np.repeat(w, width) if w is not None else None, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)[:, :-1] for w in (slope, bend, None)]
    g_left, h_left, n_left = sums
    w_left = np.clip(-g_left / (h_left + ridge), low, high)
    w_right = np.clip(-(g - g_left) / (h - h_left + ridge), low, high)
    worth = lambda gg, hh, w: -(gg * w + 0.5 * (hh + ridge) * w * w)
    gain = worth(g_left, h_left, w_left) + worth(g - g_left, h - h_left, w_right) - worth(g, h, own)
    allowed = (n_left >= least) & (len(binned) - n_left >= least) & (direction[:, None] * (w_right - w_left) >= 0)
    gain = np.where(allowed if usable is None else allowed & usable[:, None], gain, -np.inf)
    k, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(k), int(b), w_left[k, b], w_right[k, b]) if gain[k, b] > 1e-6 else None


def forest(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 10, least: int = 2, seed: int = 7) -> Trees:
    """Random forest: every tree sees a bootstrap sample, every split a third of the features.

    A leaf holds its share of label 1, divided by the number of trees, so that vote() is a plain sum.
    """
    rng = np.random.default_rng(seed)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(width)]
    binned = np.column_stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(width)]) + np.arange(width) * BINS
    nodes: list[list[float]] = []
    roots = []
    for _ in range(trees):
        roots.append(len(nodes))
        nodes.append([-1, 0, -1, -1, 0])
        open_nodes = [(roots[-1], rng.integers(0, n, n), 0)]
        while open_nodes:
            at, rows, level = open_nodes.pop()
            share = y[rows].mean()
            usable = np.zeros(width, dtype=bool)
            usable[rng.choice(width, max(1, width // 3), replace=False)] = True
            split = None
            if level < depth and 0 < share < 1:
                split = _split(binned[rows], -y[rows], np.ones(len(rows)), -y[rows].sum(), len(rows), share, np.zeros(width), 0.0, 1.0, 1e-9, least, width, usable)
            if split is None:
                nodes[at][4] = share / trees
                continue
            k, b = split[:2]
            under = binned[rows, k] <= k * BINS + b
            nodes[at][:4] = [k, edges[k][b], len(nodes), len(nodes) + 1]
            for part in (rows[under], rows[~under]):
                open_nodes.append((len(nodes), part, level + 1))
                nodes.append([-1, 0, -1, -1, 0])
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots), depth, 0.0)
