import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.operators import boosted, classify


def test_trees_against_plain_boosting():
    r = np.random.default_rng(5)
    columns = [r.integers(0, 9, 300).astype(float), r.normal(size=300), np.zeros(300), r.integers(0, 2, 300).astype(float)]
    label = ((columns[0] > 4) ^ (columns[3] > 0)).astype(int)
    model = boosted.train(columns, label, 6, 3, 0.1)
    x, y = np.stack(columns).astype(np.float32), np.where(label > 0, 1.0, -1.0)
    cuts = [boosted.thresholds(c) for c in x]

    def tree(rows, wanted, depth):
        splits = [(sum(((wanted[p] - wanted[p].mean()) ** 2).sum() for p in (rows[x[f][rows] <= c], rows[x[f][rows] > c])), f, c) for f in range(4) for c in cuts[f] if 0 < (x[f][rows] <= c).sum() < len(rows)] if depth else []
        spread = ((wanted[rows] - wanted[rows].mean()) ** 2).sum()
        if not splits or min(splits)[0] >= spread - 1e-9:
            return {int(i): wanted[rows].mean() for i in rows}
        _, f, c = min(splits)
        return tree(rows[x[f][rows] <= c], wanted, depth - 1) | tree(rows[x[f][rows] > c], wanted, depth - 1)

    margin = np.zeros(300)
    for t in range(6):
        found = tree(np.arange(300), y if t == 0 else 4 * y / (1 + np.exp(2 * y * margin)), 3)
        margin += np.array([found[i] for i in range(300)]) * (1.0 if t == 0 else 0.1)
    assert model.margins(columns) == pytest.approx(margin) and ((margin > 0) == (label > 0)).mean() > 0.95
    assert model.importances.sum() == pytest.approx(1.0) and model.importances[2] == 0.0


def test_folds_train_in_one_job_each(spark):
    rows = spark.range(4_000).select(F.floor(F.col("id") / 80).alias("writer"), (F.col("id") % 2).cast("int").alias("label"), (F.rand(1) + F.col("id") % 2 * 0.4).alias("a"), F.lit(None).cast("double").alias("b")).localCheckpoint()
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("folds"))
    spark.sparkContext.setJobGroup("folds", "")
    try:
        one = classify.discriminator_cv(rows, ["a", "b"], ["writer"], trees=40)
        assert jobs() < 20  # not several for every tree of every fold
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    again = classify.discriminator_cv(rows.repartition(7), ["a", "b"], ["writer"], trees=40)
    assert one.collect() == again.collect() and one.agg(F.sum("n")).first()[0] == 4_000 and min(r.accuracy for r in one.collect()) > 0.6
