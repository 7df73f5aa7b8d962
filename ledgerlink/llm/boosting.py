"""Gradient-boosted trees for two classes over small integer features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Complete binary trees: feature and split of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1; row goes right where its feature is at least the split."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, split, leaf in zip(self.feature, self.split, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] >= split[node])
            out += leaf[node - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, ridge: float = 2.0) -> Boosted:
    """Trees on the logistic loss, grown level by level by the best second-order gain.

    ``x`` holds integers from 0 on; histograms have one bin per value.
    """
    bins = int(x.max()) + 1 if x.size else 1
    count = x.shape[1]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    logits = np.full(len(y), base)
    cells = x + np.arange(count) * bins
    features, splits, leaves = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-logits))
        grad, hess = y - prob, prob * (1 - prob)
        feature, split = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, bins, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (count * bins) + cells).ravel()
            g, h = (np.bincount(at, np.repeat(v, count), minlength=width * count * bins).reshape(width, count, bins) for v in (grad, hess))
            right_g, right_h = (v[:, :, ::-1].cumsum(2)[:, :, ::-1] for v in (g, h))
            all_g, all_h = right_g[:, :, :1], right_h[:, :, :1]
            gain = right_g**2 / (right_h + ridge) + (all_g - right_g) ** 2 / (all_h - right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[:, :, 0] = 0
            best = gain.reshape(width, -1).argmax(1)
            useful = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            feature[first:first + width] = np.where(useful, best // bins, 0)
            split[first:first + width] = np.where(useful, best % bins, bins)
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] >= split[node])
        own = node - (2**depth - 1)
        value = rate * np.bincount(own, grad, minlength=2**depth) / (np.bincount(own, hess, minlength=2**depth) + ridge)
        logits += value[own]
        features.append(feature)
        splits.append(split)
        leaves.append(value)
    return Boosted(base, np.array(features), np.array(splits), np.array(leaves))
