"""Classifiers over session features, with folds that do not leak."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.boosted import Boosted, boosted_cv, fitted
from keyloom.operators.forest import forest_cv
from keyloom.operators.writer_split import hash_share

FOLDS = 5
TREES, DEPTH, RATE = 100, 3, 0.1


def with_folds(rows: DataFrame, group: list[str], folds: int = FOLDS, seed: int = 0) -> DataFrame:
    """``rows`` with ``fold``: rows of one group (a pair, or a writer) share a fold, chosen by a seeded hash."""
    return rows.withColumn("fold", F.floor(hash_share(seed, F.concat_ws("|", *(F.col(g).cast("string") for g in group))) * folds).cast("int"))


def _clean(rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` in which NaN and null features count as 0."""
    return rows.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})


def discriminator_cv(rows: DataFrame, features: list[str], group: list[str], folds: int = FOLDS, trees: int = TREES, seed: int = 0) -> DataFrame:
    """(fold, n, accuracy) of boosted trees that tell label 1 from 0, trained on the other folds. Folds in which a side is missing are skipped."""
    data = _clean(with_folds(rows, group, folds, seed), features)
    return rows.sparkSession.createDataFrame(boosted_cv(data, features, folds, trees, DEPTH, RATE), "fold int, n long, accuracy double")


def fit_discriminator(rows: DataFrame, features: list[str], trees: int = TREES) -> Boosted:
    """The same trees on all rows."""
    return fitted(_clean(rows, features).withColumn("fold", F.lit(0)), features, trees, DEPTH, RATE)


def importances(model: Boosted, features: list[str], top: int = 12) -> list[tuple[str, float]]:
    """The ``top`` features by importance."""
    ranked = sorted(zip(features, model.importances.tolist()), key=lambda x: (-x[1], x[0]))
    return ranked[:top]


def best_candidates(candidates: DataFrame, features: list[str], model: Boosted, target: str) -> DataFrame:
    """Of each target's candidates the one the model takes for real most likely, with ``p_real``; label 1 is real."""
    shared = candidates.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def real(*columns: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-2 * shared.value.margins([c.to_numpy() for c in columns]))))

    scored = _clean(candidates, features).withColumn("p_real", real(*features))
    kept = [c for c in candidates.columns if c != target]
    best = scored.groupBy(target).agg(F.max_by(F.struct(*kept, "p_real"), "p_real").alias("b"))
    return best.select(target, "b.*")


def writer_identification(rows: DataFrame, features: list[str], writer: str = "writer", least: int = 3, folds: int = 3, trees: int = 50, seed: int = 0) -> DataFrame:
    """(fold, n, accuracy) of naming the writer among those with at least ``least`` sessions. Folds without rows inside or outside are skipped.

    The forest is that of MLlib's defaults (bins, depth, square root of the features, bootstrap, shares added over trees), with counts of only the classes that a node has.
    """
    many = rows.groupBy(writer).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(writer)
    kept = rows.drop("label").join(many, writer, "left_semi")
    group = [c for c in ("writer", "session_id") if c in rows.columns] or [writer]
    hashed = {"label": F.xxhash64(F.col(writer).cast("string")), "id": F.xxhash64(*(F.col(c).cast("string") for c in dict.fromkeys([writer, *group])), *features)}
    data = _clean(with_folds(kept.withColumns(hashed), group, folds, seed), features)
    return rows.sparkSession.createDataFrame(forest_cv(data, features, folds, trees, seed), "fold int, n long, accuracy double")
