"""Histogram gradient-boosted trees for two classes, fitted on a bounded sample and kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import remainder


@dataclass
class Trees:
    """Complete binary trees side by side: node k of a tree has the children 2k + 1 and 2k + 2; leaves come last."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; all rows go down all trees together, one level at a time."""
        out = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if not trees or not len(x):
            return out
        tree = np.arange(trees)
        for k in range(0, len(x), 1024):
            part = x[k : k + 1024]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                right = part[row, self.feature[tree, node]] > self.threshold[tree, node]
                node = 2 * node + 1 + right
            out[k : k + 1024] += self.value[tree, node - inner].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 4.0
) -> Trees:
    """Boost on the logistic loss. Each level takes every node's best split from one histogram of gradients.

    ``least`` is the smallest sum of second derivatives in a leaf. Without rows or with one class the base rate stands.
    """
    inner = 2**depth - 1
    rate_of = float(np.clip((y.sum() + 0.5) / (len(y) + 1.0), 1e-4, 1 - 1e-4))
    base = float(np.log(rate_of / (1 - rate_of)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, width = x.shape
    edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    margin = np.full(n, base)
    column = np.arange(width)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            cell = (((node - first)[:, None] * width + column) * bins + binned).ravel()
            shape = (nodes, width, bins)
            hg = np.bincount(cell, np.repeat(g, width), nodes * width * bins).reshape(shape).cumsum(axis=2)
            hh = np.bincount(cell, np.repeat(h, width), nodes * width * bins).reshape(shape).cumsum(axis=2)
            all_g, all_h = hg[:, :1, -1:], hh[:, :1, -1:]
            right_g, right_h = all_g - hg, all_h - hh
            gain = hg**2 / (hh + 1) + right_g**2 / (right_h + 1) - all_g**2 / (all_h + 1)
            gain[(hh < least) | (right_h < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), bins)
                if gain[k, f, cut] > 1e-9 and cut < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += value[t][leaf]
    return Trees(base, feature, threshold, value)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibration points: pools of neighbours whose label rates would fall, merged until rates only rise."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([s, v, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            s2, v2, n2 = pools.pop()
            s1, v1, n1 = pools[-1]
            pools[-1] = [(s1 * n1 + s2 * n2) / (n1 + n2), v1 + v2, n1 + n2]
    points = np.array(pools).reshape(-1, 3)
    # A little of the overall rate keeps small pools away from 0 and 1.
    return points[:, 0], (points[:, 1] + y.mean()) / (points[:, 2] + 1) if len(y) else points[:, 1]


def held_out(key: str = "doc_id", parts: int = 5) -> Column:
    """Documents kept from training; a null key is held out."""
    return F.coalesce(remainder(key, parts) == 0, F.lit(True))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", columns: tuple[str, ...] = ()
) -> DataFrame:
    """(key, text, further columns, y) of at most ``most`` labelled rows outside the held-out part, by the order of a hash of the key.

    Of several labels of one key the largest stands; labels other than 0 and 1 are left out.
    """
    known = (
        labels.where(~held_out(key) & F.col(label).isin(0, 1))
        .groupBy(key)
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64(key), key)
        .limit(most)
    )
    # At most ``most`` keys and labels are broadcast.
    texts = docs.select(key, F.col("text").cast("string").alias("text"), *columns)
    return texts.join(F.broadcast(known), key).dropDuplicates([key])
