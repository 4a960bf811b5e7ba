"""Boosted regression trees for two classes, each model trained in one task on binned features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.forest import BINS, dealt, keys_of_tasks, thresholds

#: Features whose bins are counted together, as one number; counts of each are sums over the others.
TOGETHER = 3


class Boosted:
    """Trees of one depth as arrays: of each tree the features and limits of its inner nodes by level (a node that does not split sends all left), and its leaves' values times the tree's weight."""

    def __init__(self, nodes: np.ndarray, limits: np.ndarray, values: np.ndarray, importances: np.ndarray) -> None:
        self.nodes, self.limits, self.values, self.importances = nodes, limits, values, importances

    def margins(self, columns: list[np.ndarray]) -> np.ndarray:
        """The sum of the trees for each row, above 0 for label 1; half of its log odds."""
        x = np.stack([np.asarray(c, dtype=np.float32) for c in columns])
        rows, out = np.arange(x.shape[1]), np.zeros(x.shape[1])
        for nodes, limits, values in zip(self.nodes, self.limits, self.values):
            at = np.zeros(x.shape[1], dtype=np.int64)
            while at.size and at[0] < len(nodes):  # all rows are on one level
                at = 2 * at + 1 + (x[nodes[at], rows] > limits[at])
            out += values[at - len(nodes)]
        return out


def _counted(codes: np.ndarray, features: int, weights: np.ndarray | None) -> np.ndarray:
    """Features x bins: sums of ``weights``, or counts."""
    out = []
    for code in codes:
        cube = np.bincount(code, weights=weights, minlength=BINS**TOGETHER).reshape((BINS,) * TOGETHER)
        out += [cube.sum(axis=tuple(a for a in range(TOGETHER) if a != k)) for k in range(TOGETHER)]
    return np.stack(out[:features])


def train(columns: list[np.ndarray], label: np.ndarray, trees: int, depth: int, rate: float) -> Boosted:
    """``trees`` of ``depth`` on log loss: the first on the labels as 1 and -1, the others on what is left, times ``rate``; splits by variance at the limits of quantile bins.

    Of two siblings only the smaller one's rows are counted; the other's counts are what is missing to their parent's.
    """
    columns = [np.asarray(c, dtype=np.float32) for c in columns]
    cuts = [thresholds(c) for c in columns]
    codes = np.zeros((-(-len(columns) // TOGETHER), len(label)), dtype=np.int64)
    for f, (c, cut) in enumerate(zip(columns, cuts)):
        codes[f // TOGETHER] += np.searchsorted(cut, c, side="left") * BINS ** (TOGETHER - 1 - f % TOGETHER)
    y = np.where(label > 0, 1.0, -1.0)
    margin, inner, wide = np.zeros(len(y)), 2**depth - 1, len(columns)
    nodes, limits, values = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    importances, everywhere, all_counts = np.zeros(wide), np.arange(len(y)), _counted(codes, wide, None)
    for t in range(trees):
        wanted = y if t == 0 else 4 * y / (1 + np.exp(2 * y * margin))
        held = {0: (everywhere, all_counts, _counted(codes, wide, wanted))}
        for node in range(inner):
            if node not in held:
                continue
            rows, n, s = held.pop(node)
            size, total = np.cumsum(n, axis=1)[:, :-1], np.cumsum(s, axis=1)[:, :-1]
            whole, count = s[0].sum(), len(rows)
            gain = np.where((size > 0) & (size < count), total**2 / np.maximum(size, 1) + (whole - total) ** 2 / np.maximum(count - size, 1), -np.inf) - whole**2 / max(count, 1)
            f, k = divmod(int(np.argmax(gain)), BINS - 1)
            inside = np.ones(count, dtype=bool)
            if gain[f, k] > 1e-12 * max(1.0, count):
                nodes[t, node], limits[t, node] = f, cuts[f][k]
                importances[f] += gain[f, k]
                inside = columns[f][rows] <= cuts[f][k]
            parts = (rows[inside], rows[~inside])
            if 2 * node + 1 >= inner:
                for side, part in enumerate(parts):
                    if len(part):
                        value = wanted[part].mean() * (1.0 if t == 0 else rate)
                        values[t, 2 * node + 1 + side - inner] = value
                        margin[part] += value
                continue
            small = int(len(parts[1]) <= len(parts[0]))
            few = parts[small]
            here = codes[:, few]
            counted = (_counted(here, wide, None), _counted(here, wide, wanted[few]))
            for side, counts in ((small, counted), (1 - small, (n - counted[0], s - counted[1]))):
                if len(parts[side]):
                    held[2 * node + 1 + side] = (parts[side], *counts)
    return Boosted(nodes, limits, values, importances / max(importances.sum(), 1e-300))


def _numbers(rows: DataFrame, features: list[str]) -> DataFrame:
    """(fold, label, id, features as single-precision numbers): an id by which rows have one order in any partitioning."""
    return rows.select("fold", "label", F.xxhash64("label", "fold", *features).alias("id"), *(F.col(f).cast("float").alias(f) for f in features))


def fitted(rows: DataFrame, features: list[str], trees: int, depth: int, rate: float) -> Boosted:
    """The model of all ``rows`` (fold, label, features)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "label"])
        model = train([part[f].to_numpy() for f in features], part["label"].to_numpy(), trees, depth, rate)
        return pd.DataFrame([[x.astype(np.float64).tobytes() for x in (model.nodes, model.limits, model.values, model.importances)]], columns=["nodes", "limits", "values", "importances"])

    one = dealt(_numbers(rows, features), [0]).groupBy("_task").applyInPandas(run, "nodes binary, limits binary, values binary, importances binary").first()
    nodes, limits, values, importances = (np.frombuffer(x) for x in one)
    return Boosted(nodes.astype(np.int64).reshape(trees, -1), limits.reshape(trees, -1), values.reshape(trees, -1), importances)


def boosted_cv(rows: DataFrame, features: list[str], folds: int, trees: int, depth: int, rate: float) -> list[tuple[int, int, float]]:
    """(fold, n, accuracy) over ``rows`` (fold, label, features): one task a fold, trained on the rows of the others. Folds in which a side is missing are left out."""
    keys = keys_of_tasks(rows.sparkSession, folds)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        k, part = keys.index(int(key[0])), part.sort_values(["id", "label"])
        inside, label = (part["fold"] != k).to_numpy(), part["label"].to_numpy()
        if inside.all() or len(set(label[inside])) < 2:
            return pd.DataFrame({"fold": [], "n": [], "accuracy": []})
        columns = [part[f].to_numpy() for f in features]
        model = train([c[inside] for c in columns], label[inside], trees, depth, rate)
        right = (model.margins([c[~inside] for c in columns]) > 0) == (label[~inside] > 0)
        return pd.DataFrame({"fold": [k], "n": [len(right)], "accuracy": [right.mean()]})

    found = dealt(_numbers(rows, features), keys).groupBy("_task").applyInPandas(run, "fold int, n long, accuracy double")
    return sorted(tuple(r) for r in found.collect())
