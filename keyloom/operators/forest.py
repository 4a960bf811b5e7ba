"""Random forests over very many classes, a tree a time on binned features, with class counts kept only where there are any."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS, DEPTH = 32, 5
#: Largest shares of a leaf that are added up before all of them are.
FIRST = 64
_LEAVES = "fold int, slice int, tree int, leaves binary, labels binary, starts binary, classes binary, shares binary"


def thresholds(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Limits of at most ``bins`` bins: halfway between distinct values if they are few, else at equal shares of the rows."""
    ordered = np.sort(values)
    distinct = ordered[np.append(True, ordered[1:] != ordered[:-1])]
    if len(distinct) <= bins:
        return (distinct[:-1] + distinct[1:]) / 2
    return np.unique(ordered[np.arange(1, bins) * len(ordered) // bins])[: bins - 1]


def best_split(classes: np.ndarray, weights: np.ndarray, binned: np.ndarray) -> tuple[float, int]:
    """(sum of squared class counts over size, both sides added; last bin on the left) of the best split by Gini of one feature.

    In the order of class and bin a row of weight w after c of its class adds w (2c + w) to the squares on its left.
    """
    key = np.sort((classes * BINS + binned) * 64 + weights)
    w, b, c = key & 63, (key >> 6) % BINS, (key >> 6) // BINS
    opens = np.append(True, c[1:] != c[:-1])
    before = np.cumsum(w) - w
    held = before - np.maximum.accumulate(np.where(opens, before, 0))
    of = np.cumsum(opens) - 1
    total = np.bincount(of, weights=w)
    size = np.cumsum(np.bincount(b, weights=w, minlength=BINS))
    left = np.cumsum(np.bincount(b, weights=w * (2 * held + w), minlength=BINS))
    right = (total**2).sum() - 2 * np.cumsum(np.bincount(b, weights=w * total[of], minlength=BINS)) + left
    other = size[-1] - size
    score = np.where((size > 0) & (other > 0), left / np.maximum(size, 1) + right / np.maximum(other, 1), -1.0)
    k = int(np.argmax(score))
    return float(score[k]), k


def grown(binned: np.ndarray, labels: np.ndarray, train: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(leaf of each row, weight of each row in the bootstrap, 0 outside ``train``) of one tree. ``binned``: features x rows."""
    weights = np.zeros(len(labels), dtype=np.int64)
    weights[train] = np.minimum(rng.poisson(1.0, int(train.sum())), 63)
    leaf, tried = np.zeros(len(labels), dtype=np.int32), int(np.ceil(np.sqrt(len(binned))))
    open_nodes = [(0, np.arange(len(labels)))]
    for _ in range(depth):
        following = []
        for node, rows in open_nodes:
            inside = rows[weights[rows] > 0]
            features = rng.choice(len(binned), tried, replace=False)
            if len(inside) < 2:
                continue
            w, c = weights[inside], labels[inside]
            counts = np.bincount(c, weights=w)
            found = max(((*best_split(c, w, binned[f][inside]), int(f)) for f in features), key=lambda x: x[0])
            if found[0] <= (counts**2).sum() / w.sum() * (1 + 1e-12):
                continue
            left = binned[found[2]][rows] <= found[1]
            leaf[rows] = 2 * node + 2 - left
            following += [(2 * node + 1, rows[left]), (2 * node + 2, rows[~left])]
        open_nodes = following
    return leaf, weights


def leaf_shares(leaf: np.ndarray, labels: np.ndarray, weights: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, classes, shares): of each node number, from its start to the next one's, its classes and their shares, the largest first."""
    inside = weights > 0
    n = int(labels.max()) + 1
    key, at = np.unique(leaf[inside].astype(np.int64) * n + labels[inside], return_inverse=True)
    count = np.bincount(at, weights=weights[inside])
    nodes, classes = key // n, key % n
    shares = count / np.bincount(nodes, weights=count)[nodes]
    order = np.lexsort((classes, -shares, nodes))
    return np.searchsorted(nodes, np.arange(2 ** (depth + 1))), classes[order].astype(np.int32), shares[order]


def hits(leaves: list[np.ndarray], trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> int:
    """Rows whose label has the largest sum of shares over all trees, of several the least one.

    A row is wrong as soon as the largest shares of its leaves alone give another class more than its label has in all; only for others are all shares added.
    """
    n = int(max([labels.max(), *(c.max() for _, c, _ in trees)])) + 1
    own = np.zeros(len(labels))
    for leaf, (starts, classes, shares) in zip(leaves, trees):
        nodes = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(classes))))
        key = nodes * n + classes
        order = np.argsort(key)
        wanted = leaf.astype(np.int64) * n + labels
        k = np.minimum(np.searchsorted(key, wanted, sorter=order), len(key) - 1)
        own += np.where(key[order[k]] == wanted, shares[order[k]], 0.0)
    ends = [np.append(starts, len(classes))[1:] for starts, classes, _ in trees]
    right = 0
    for i in np.flatnonzero(own > 0):
        spans = [(t, int(starts[leaf[i]]), int(end[leaf[i]])) for t, ((starts, _, _), leaf, end) in enumerate(zip(trees, leaves, ends))]
        for most in (FIRST, n):
            classes = np.concatenate([trees[t][1][a : min(a + most, b)] for t, a, b in spans])
            shares = np.concatenate([trees[t][2][a : min(a + most, b)] for t, a, b in spans])
            score = np.bincount(classes, weights=shares, minlength=n)
            if score.max() > own[i] + 1e-9:
                break
        else:
            right += int(np.flatnonzero(score > own[i] - 1e-9)[0] == labels[i])
    return right


def keys_of_tasks(spark: SparkSession, n: int) -> list[int]:
    """``n`` whole numbers that hash partitioning puts into ``n`` partitions, one each."""
    each = spark.range(256 * n).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).orderBy("p")
    return [r["k"] for r in each.collect()]


def dealt(rows: DataFrame, keys: list[int]) -> DataFrame:
    """All of ``rows`` once for each of ``keys_of_tasks`` as ``_task``, in a partition of its own."""
    return rows.withColumn("_task", F.explode(F.array(*map(F.lit, keys)))).repartition(len(keys), "_task")


def forest_cv(rows: DataFrame, features: list[str], folds: int, trees: int, seed: int) -> list[tuple[int, int, float]]:
    """(fold, n, accuracy) of forests over rows of (fold, label, id, features); ``label`` and ``id`` are 64-bit hashes.

    Trees are dealt out to tasks, each of which holds all rows, as single-precision numbers; the trees' leaves then meet by fold and slice of its rows.
    """
    tasks = max(1, min(trees, rows.sparkSession.sparkContext.defaultParallelism))
    keys = keys_of_tasks(rows.sparkSession, tasks)
    slices = -(-tasks // folds)

    def train(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        mine, part = keys.index(int(key[0])), part.sort_values(["label", "id"], ignore_index=True)
        _, label, counts = np.unique(part["label"].to_numpy(), return_inverse=True, return_counts=True)
        # As an indexer does: the class with most rows first.
        number = np.empty(len(counts), dtype=np.int64)
        number[np.lexsort((np.arange(len(counts)), -counts))] = np.arange(len(counts))
        label, fold = number[label], part["fold"].to_numpy()
        columns = [part[f].to_numpy() for f in features]
        out = []
        for k in range(folds):
            inside, test = fold != k, np.flatnonzero(fold == k)
            if not inside.any() or not len(test):
                continue
            binned = np.stack([np.searchsorted(thresholds(x[inside]), x, side="left").astype(np.uint8) for x in columns])
            for t in range(mine, trees, tasks):
                leaf, weights = grown(binned, label, inside, np.random.default_rng([seed, k, t]))
                if not weights.any():
                    continue
                shared = [x.tobytes() for x in leaf_shares(leaf, label, weights)]
                out += [(k, s, t, leaf[at].astype(np.uint8).tobytes(), label[at].tobytes(), *shared) for s, at in enumerate(np.array_split(test, slices)) if len(at)]
        return pd.DataFrame(out, columns=["fold", "slice", "tree", "leaves", "labels", "starts", "classes", "shares"])

    def score(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("tree")
        read = lambda name, kind: [np.frombuffer(x, dtype=kind) for x in part[name]]
        labels = np.frombuffer(part["labels"].iloc[0], dtype=np.int64)
        found = hits(read("leaves", np.uint8), list(zip(read("starts", np.int64), read("classes", np.int32), read("shares", np.float64))), labels)
        return pd.DataFrame({"fold": [key[0]], "n": [len(labels)], "right": [found]})

    numbers = [F.col(f).cast("float").alias(f) for f in features]
    leaves = dealt(rows.select("fold", "label", "id", *numbers), keys).groupBy("_task").applyInPandas(train, _LEAVES)
    scored = leaves.repartition(folds * slices, "fold", "slice").groupBy("fold", "slice").applyInPandas(score, "fold int, n long, right long")
    every = scored.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("right").alias("right")).orderBy("fold")
    return [(r["fold"], r["n"], r["right"] / r["n"]) for r in every.collect()]
