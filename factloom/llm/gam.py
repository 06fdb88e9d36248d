"""Generalised additive model with pairwise interactions, fitted by cyclic boosting of shallow trees.

Features are binned; a tree over one feature's bins (or a split into four of two features' bins) adds to that
feature's (pair's) lookup table.  Boosting goes round the features with a small rate, so each table
takes only what the others leave.  Scoring adds up table entries, vectorised over rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Gam:
    edges: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # per feature: coarse bin of each bin

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if not self.tables:
            return total
        bins = self.bins(x)
        for table, b in zip(self.tables, bins, strict=True):
            total += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Newton steps per bin of the tree with up to ``leaves`` leaves that gains most, split by split."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                at = int(np.argmax(gain))
                best = max(best, (float(gain[at]), int(m[at])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        step[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The split of a grid into four parts that gains most: its gain and the steps."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    n, m = g.shape
    best = (-1.0, np.zeros_like(g))
    for i in range(1, n):
        for j in range(1, m):
            gain, steps = 0.0, np.empty_like(g)
            for a, b in ((0, i), (i, n)):
                for c, d in ((0, j), (j, m)):
                    gg, hh = (x[b, d] - x[a, d] - x[b, c] + x[a, c] for x in (cg, ch))
                    gain += gg * gg / (hh + ridge)
                    steps[a:b, c:d] = -gg / (hh + ridge)
            if gain > best[0]:
                best = (gain, steps)
    return best


def fit_gam(x: np.ndarray, y: np.ndarray, *, rounds: int = 120, rate: float = 0.15, leaves: int = 4, bins: int = 32, n_pairs: int = 6, coarse_bins: int = 6, ridge: float = 1.0) -> Gam:
    """Without rows of both labels: the share of label 1 (0.5 without rows) for every text."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Gam(intercept=float(np.log(share / (1 - share))))
    model = Gam(intercept=float(np.log(y.mean() / (1 - y.mean()))))
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [np.arange(len(e) + 1) * min(coarse_bins, len(e) + 1) // (len(e) + 1) for e in model.edges]
    own, total = model.bins(x), np.full(len(y), model.intercept)

    def newton(cell: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(total)
        return np.bincount(cell, p - y, size), np.bincount(cell, p * (1 - p), size)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            if len(table) > 1:
                step = rate * shallow_tree(*newton(own[f], len(table)), leaves, ridge)
                table += step
                total += step[own[f]]
    sizes = [int(c[-1]) + 1 for c in model.coarse]
    cells = {(i, j): model.coarse[i][own[i]] * sizes[j] + model.coarse[j][own[j]] for i in range(x.shape[1]) for j in range(i + 1, x.shape[1]) if sizes[i] > 1 and sizes[j] > 1}
    grid = lambda ij: (v.reshape(sizes[ij[0]], sizes[ij[1]]) for v in newton(cells[ij], sizes[ij[0]] * sizes[ij[1]]))
    model.pairs = sorted(cells, key=lambda ij: -_quadrants(*grid(ij), ridge)[0])[:n_pairs]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(rounds // 4):
        for ij, table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * _quadrants(*grid(ij), ridge)[1]
            table += step
            total += step.ravel()[cells[ij]]
    return model
