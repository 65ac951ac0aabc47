"""Histogram gradient-boosted trees in flat arrays, and isotonic calibration.

Fitting takes one bounded sample (see ``samples``); scoring runs wherever Spark has the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete trees of one depth. ``feature`` and ``threshold`` are (trees, inner nodes),
    ``value`` (trees, leaves); node i has the children 2i+1 (not above) and 2i+2 (above)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_forest(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64,
    rate: float = 0.15, l2: float = 1.0, least: float = 1.0,
) -> Forest:
    """Boosting on log loss. Features are cut at quantiles once; each level's splits come from
    per-node histograms of gradients. Without rows or with one class the forest is constant."""
    n, width = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    mean = (y.sum() + 1) / (n + 2)
    forest = Forest(
        float(np.log(mean / (1 - mean))), np.zeros((trees, inner), dtype=np.int64),
        np.full((trees, inner), np.inf), np.zeros((trees, leaves)),
    )
    if n == 0 or y.min() == y.max():
        return forest
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(n, forest.base)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            nodes, low = 1 << level, (1 << level) - 1
            best = np.full(nodes, 1e-9)
            choice = [None] * nodes
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                slots = len(cut) + 1
                key = (at - low) * slots + binned[:, j]
                g = np.bincount(key, grad, nodes * slots).reshape(nodes, slots).cumsum(1)
                h = np.bincount(key, hess, nodes * slots).reshape(nodes, slots).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                left, right = h[:, :-1], ht - h[:, :-1]
                gain = g[:, :-1] ** 2 / (left + l2) + (gt - g[:, :-1]) ** 2 / (right + l2) - gt**2 / (ht + l2)
                gain[(left < least) | (right < least)] = 0
                k = gain.argmax(1)
                for node in np.flatnonzero(gain[np.arange(nodes), k] > best):
                    best[node] = gain[node, k[node]]
                    choice[node] = (j, int(k[node]))
            go = np.zeros(n, dtype=np.int64)
            for node, split in enumerate(choice):
                if split is not None:
                    forest.feature[tree, low + node], forest.threshold[tree, low + node] = split[0], cuts[split[0]][split[1]]
                    here = at == low + node
                    go[here] = binned[here, split[0]] > split[1]
            at = 2 * at + 1 + go
        leaf = at - inner
        value = np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + l2)
        forest.value[tree] = rate * value
        margin += forest.value[tree][leaf]
    return forest


@dataclass
class Isotonic:
    """A rising curve through block means; between blocks it is linear."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value) if len(self.at) else score


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators. Without both classes scores stay as they are."""
    if not len(y) or y.min() == y.max():
        return Isotonic(np.empty(0), np.empty(0))
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, label in zip(score[order], y[order]):
        blocks.append([float(label), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    made = np.array(blocks)
    # One row of each class more, so that no block is certain.
    prior = y.mean()
    at, value = made[:, 2] / made[:, 1], (made[:, 0] + prior) / (made[:, 1] + 1)
    return Isotonic(at, np.maximum.accumulate(value))
