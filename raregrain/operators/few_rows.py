"""Boosting on chunks of few rows in memory, as Spark ML grows its trees.

A chunk of some hundred rows pays for Spark jobs, not for rows: a tree of three levels is about ten jobs. :class:`FewRows` holds
such a chunk; ``boost`` and ``round_metrics`` of :mod:`raregrain.operators.boosting` take it in place of a table. Splits are
Spark's: quantiles of the distinct values of a feature by weight, variance as impurity, the first of equal gains,
leaves of one prediction merged. What Spark samples or bins otherwise (more rows, nominal features, other settings) is not for this module.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa

#: Rows up to which Spark reads all of a table for its splits.
MOST_ROWS = 10_000
#: Rows times features that are in memory at a time.
MOST_CELLS = 1 << 21
#: Settings of a regression tree that are followed here, with Spark's defaults.
SETTINGS = {"maxDepth": 5, "maxBins": 32, "minInstancesPerNode": 1, "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0, "seed": None}


@dataclass
class FewRows:
    """Features, 0/1 label (or not a number), weight and margin so far of the rows of a chunk, in any order.

    ``margins`` has a column per round that was fitted last on them.
    """

    x: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    margin: np.ndarray
    margins: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @staticmethod
    def of(table: pa.Table, features: str, label: str, margin: str) -> FewRows | None:
        """From columns ``features`` (arrays), ``label`` and ``margin``; rows without features take no part.

        Weights balance the classes as :func:`raregrain.operators.stats.class_weights` does, over all rows of the table.
        None where arrays differ in length or hold what is not a finite number.
        """
        table = table.combine_chunks()
        y = table.column(label).to_numpy().astype(float)
        n0, n1 = int((y == 0).sum()), int((y == 1).sum())
        weight = np.full(len(y), np.nan)
        for k, n in ((0, n0), (1, n1)):
            weight[y == k] = len(y) / (2 * n) if n else np.nan
        known = table.column(features).is_valid().to_numpy()
        lists = table.column(features).filter(pa.array(known)).combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        n = int(known.sum())
        if len(np.unique(np.diff(lists.offsets.to_numpy()))) > 1 or not np.isfinite(flat).all():
            return None
        x = flat.reshape(n, -1) if n else np.zeros((0, 1))
        return FewRows(x, y[known], weight[known], table.column(margin).filter(pa.array(known)).to_numpy().astype(float))

    def add(self, nodes: pd.DataFrame | None) -> None:
        """Add the steps of more trees, whose nodes are sorted by round and node, to the margin, one after the other."""
        if nodes is None or not len(nodes):
            return
        tree = nodes["round"].to_numpy() - int(nodes["round"].iloc[0])
        starts = np.searchsorted(tree, np.arange(tree[-1] + 1))
        feature, threshold = nodes["feature"].to_numpy(), nodes["threshold"].to_numpy()
        below, above = (nodes[c].to_numpy() + starts[tree] for c in ("lower", "upper"))
        step = nodes["weight"].to_numpy() * nodes["value"].to_numpy()
        every = np.arange(len(self.x))[:, None]
        at = np.tile(starts, (len(self.x), 1))
        while (inner := feature[at] >= 0).any():
            down = self.x[every, np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(down, below[at], above[at]), at)
        # summed in the order of the rounds, as over the whole ensemble
        self.margin = np.cumsum(np.concatenate((self.margin[:, None], step[at]), axis=1), axis=1)[:, -1]

    def trained(self) -> np.ndarray:
        """Which rows a fit takes: those with a label and a positive weight."""
        return np.isin(self.label, (0, 1)) & (self.weight > 0)


def feature_splits(x: np.ndarray, w: np.ndarray, most: int) -> np.ndarray:
    """Thresholds by the weight of the values, not a number behind the last; ``most`` bins at most."""
    n = min(most, len(x)) - 1
    total, eps = float(w.sum()), sys.float_info.epsilon
    stride = total / (n + 1)
    out = np.full((x.shape[1], max(n, 1)), np.nan)
    for f in range(x.shape[1]):
        some = x[:, f] != 0
        values, at = np.unique(x[some, f], return_inverse=True)
        if not len(values):
            continue
        weights = np.bincount(at, weights=w[some], minlength=len(values))
        zero = total - float(weights.sum())
        if zero > eps * int(some.sum()) * 100:
            place = int(np.searchsorted(values, 0.0))
            values, weights = np.insert(values, place, 0.0), np.insert(weights, place, zero)
        between = ((values[:-1] + values[1:]) / 2).tolist()
        if len(between) > n:
            weights = weights.tolist()
            held, goal, found = weights[0], stride, []
            for i, more in enumerate(weights[1:]):
                now = held + more
                if abs(held - goal) < abs(now - goal):
                    found.append(between[i])
                    goal += stride
                held = now
            between = found
        out[f, : len(between)] = between
    return out


def _variance(count: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return np.where(count == 0, 0.0, (squares - total * total / np.where(count == 0, 1, count)) / np.where(count == 0, 1, count))


class TreeGrower:
    """Grows regression trees on the same rows, features and weights, for one target after another."""

    def __init__(self, x: np.ndarray, w: np.ndarray, settings: Mapping[str, object]):
        self.settings = {**SETTINGS, **settings}
        self.w = w
        self.splits = feature_splits(x, w, self.settings["maxBins"])
        self.bins = np.empty(x.shape, np.int64)
        for f, row in enumerate(self.splits):
            self.bins[:, f] = np.searchsorted(row[~np.isnan(row)], x[:, f])
        self.width = self.splits.shape[1] + 1
        self.flat = self.bins + np.arange(x.shape[1]) * self.width
        self.valid = ~np.isnan(self.splits)
        self.least = self.settings["minWeightFractionPerNode"] * float(w.sum())

    def _sums(self, rows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        flat, d = self.flat[rows].ravel(), self.flat.shape[1]
        w = self.w[rows]
        columns = (w, w * target[rows], w * target[rows] * target[rows], None)
        size = d * self.width
        return [np.cumsum(np.bincount(flat, None if c is None else np.repeat(c, d), size).reshape(d, self.width), axis=1) for c in columns]

    def grow(self, target: np.ndarray) -> tuple[list[list], np.ndarray]:
        """Nodes ``feature, threshold, lower, upper, value`` of a tree, numbered from its root on, and the value of every row."""
        values = np.zeros(len(target))
        tree = self._node(np.arange(len(target)), target, 0, None, values)
        nodes: list[list] = []

        def number(node: tuple) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, node[0]])
            if len(node) > 1:
                nodes[at][:2] = node[1:3]
                nodes[at][2], nodes[at][3] = number(node[3]), number(node[4])
            return at

        number(tree)
        return nodes, values

    def _node(self, rows: np.ndarray, target: np.ndarray, level: int, sums: tuple[float, float, float] | None, values: np.ndarray) -> tuple:
        """``(value,)`` or ``(value, feature, threshold, lower, upper)``; ``sums`` are those that its parent's split gave it."""

        def leaf() -> tuple:
            value = sums[1] / sums[0] if sums[0] else 0.0
            values[rows] = value
            return (value,)

        impurity = None if sums is None else float(_variance(*(np.array(s) for s in sums)))
        if level == self.settings["maxDepth"] and sums is not None or (level and abs(impurity) < sys.float_info.epsilon):
            return leaf()
        count, total, squares, raw = self._sums(rows, target)
        left = [c[:, :-1] for c in (count, total, squares, raw)]
        right = [c[:, -1:] - c[:, :-1] for c in (count, total, squares, raw)]
        if sums is None:
            sums = (float(count[0, -1]), float(total[0, -1]), float(squares[0, -1]))
            impurity = float(_variance(*(np.array(s) for s in sums)))
            if self.settings["maxDepth"] == 0:
                return leaf()
        whole = left[0] + right[0]
        gain = impurity - left[0] / whole * _variance(*left[:3]) - right[0] / whole * _variance(*right[:3])
        few, least = self.settings["minInstancesPerNode"], self.least
        ok = self.valid & (left[3] >= few) & (right[3] >= few) & (left[0] >= least) & (right[0] >= least) & (gain >= self.settings["minInfoGain"])
        gain = np.where(ok, gain, -np.inf)
        feature, split = divmod(int(gain.argmax()), gain.shape[1])
        if not gain[feature, split] > 0:
            return leaf()
        down = self.bins[rows, feature] <= split
        parts = [tuple(float(s[feature, split]) for s in side[:3]) for side in (left, right)]
        lower, upper = (self._node(rows[side], target, level + 1, part, values) for side, part in zip((down, ~down), parts))
        if len(lower) == len(upper) == 1 and lower[0] == upper[0]:
            return lower
        return sums[1] / sums[0], feature, float(self.splits[feature, split]), lower, upper


def boost_few(rows: FewRows, done: int, rounds: int, step: float, settings: Mapping[str, object]) -> list[tuple[int, float, list[list]]]:
    """``(round, weight, nodes)`` of ``rounds`` trees after ``done`` earlier ones; the margins after each are left in ``rows``."""
    fit = rows.trained()
    if not fit.any():
        raise ValueError("no labelled rows to boost on")
    y, w = np.where(rows.label[fit] == 1, 1.0, -1.0), rows.weight[fit]
    grower, margin = TreeGrower(rows.x[fit], w, settings), rows.margin[fit]
    trees, steps = [], []
    with np.errstate(over="ignore"):
        for i in range(done + 1, done + rounds + 1):
            nodes, values = grower.grow(4 * y / (1 + np.exp(2 * y * margin)) if i > 1 else y)
            scale = step if i > 1 else 1.0
            margin = margin + scale * values
            trees.append((i, scale, nodes))
            steps.append(margin)
    rows.margins = np.full((len(rows.label), rounds), np.nan)
    rows.margins[fit] = np.stack(steps, axis=1)
    return trees


def few_metrics(rows: FewRows, column: int) -> tuple[float, float | None]:
    """Log loss and average precision of the margins after one of the rounds that were fitted last, ties grouped."""
    fit = rows.trained()
    score, back = np.unique(-rows.margins[fit, column], return_inverse=True)
    y, w = rows.label[fit], rows.weight[fit]
    pos, neg = (np.bincount(back, np.where(y == k, w, 0.0), len(score)) for k in (1, 0))
    with np.errstate(over="ignore"):
        loss = pos * np.log1p(np.exp(2 * score)) + neg * np.log1p(np.exp(-2 * score))
    tp, fp = np.cumsum(pos), np.cumsum(neg)
    gained = np.where(pos > 0, pos * tp / np.where(tp + fp == 0, 1, tp + fp), 0.0)
    return float(loss.sum() / (pos + neg).sum()), float(gained.sum() / pos.sum()) if pos.sum() else None
