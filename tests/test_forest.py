import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.operators import classify, forest


def test_best_split_against_all_splits():
    r = np.random.default_rng(3)
    for _ in range(60):
        n = int(r.integers(2, 40))
        classes, weights, binned = r.integers(0, 6, n), r.integers(1, 4, n), r.integers(0, 5, n).astype(np.uint8)
        squares = lambda at: (np.bincount(classes[at], weights=weights[at]) ** 2).sum() / weights[at].sum()  # noqa: E731, B023
        brute = [squares(binned <= k) + squares(binned > k) for k in range(5) if 0 < (binned <= k).sum() < n]
        got, k = forest.best_split(classes, weights, binned)
        assert got == pytest.approx(max(brute) if brute else -1.0) and (not brute or squares(binned <= k) + squares(binned > k) == pytest.approx(got))
    assert len(forest.thresholds(r.normal(size=1_000))) == 31 and forest.thresholds(np.array([1.0, 3.0, 1.0])).tolist() == [2.0]


def test_hits_against_all_shares(monkeypatch):
    r = np.random.default_rng(4)
    n, rows = 30, 200
    labels = r.integers(0, n, rows)
    trees, leaves, scores = [], [], np.zeros((rows, n))
    for _ in range(6):
        leaf, weights = r.integers(31, 35, rows), r.poisson(1.0, rows)
        starts, classes, shares = forest.leaf_shares(leaf, labels, weights)
        dense = np.zeros((64, n))
        ends = np.append(starts, len(classes))
        for node in range(64):
            dense[node, classes[ends[node] : ends[node + 1]]] = shares[ends[node] : ends[node + 1]]
        assert np.allclose(dense[31:35].sum(1), 1.0)
        scores += dense[leaf]
        trees.append((starts, classes, shares))
        leaves.append(leaf.astype(np.uint8))
    best = (scores > scores.max(1, keepdims=True) - 1e-9).argmax(1)
    for first in (1, 4, 64):
        monkeypatch.setattr(forest, "FIRST", first)
        assert forest.hits(leaves, trees, labels) == (best == labels).sum() > 0


def test_thousands_of_writers_are_told_apart(spark):
    rows = spark.range(12_000).select(
        (F.col("id") % 3_000).alias("writer"), F.col("id").alias("session_id"), F.lit(1).alias("label"), *((F.xxhash64(F.col("id") % 3_000, F.lit(k)) % 1_000 + F.col("id") / 12_000).alias(f"f{k}") for k in range(4))
    )
    folds = [classify.writer_identification(rows.repartition(p), [f"f{k}" for k in range(4)], trees=8).collect() for p in (1, 5)]
    assert folds[0] == folds[1] and sum(f.n for f in folds[0]) == 12_000 and [f.fold for f in folds[0]] == [0, 1, 2]
    assert min(f.accuracy for f in folds[0]) > 0.003, folds[0]  # by chance 0.0003
