"""Distances between distributions of pooled values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, SMOOTHING, LEAST = 64, 1e-9, 10
LIFT = 1e-3


def checked_values(pool: DataFrame) -> DataFrame:
    """``pool`` with values lifted to at least 0.001; a negative or non-finite value is an error, as time cannot run back."""
    v = F.col("value")
    bad = (v < 0) | F.isnan(v) | (v == float("inf"))
    return pool.withColumn("value", F.when(bad, F.raise_error(F.lit("a timing is negative or not finite")).cast("double")).otherwise(F.greatest(v, F.lit(LIFT))))


def kl_divergence(pool: DataFrame) -> DataFrame:
    """(feature, n_a, n_b, kl) for ``pool`` (feature, side in a/b, value): symmetrised KL over 64 logarithmic bins from the least to the largest value.

    Null if a side has fewer than 10 values. Limits are one row a feature; bins are counted where the values lie.
    """
    values = checked_values(pool.filter("value is not null"))
    limits = values.groupBy("feature").agg(F.min("value").alias("lo"), (F.max("value") + 1.0).alias("hi"), F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"))
    edge = lambda i: F.col("lo") * F.pow(F.col("hi") / F.col("lo"), i / float(BINS))
    guess = F.floor(F.log(F.col("value") / F.col("lo")) / F.log(F.col("hi") / F.col("lo")) * BINS)
    settled = F.when(F.col("value") < edge(guess), guess - 1).when(F.col("value") >= edge(guess + 1), guess + 1).otherwise(guess)
    binned = values.join(limits, "feature").withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), settled)).cast("int"))
    counts = binned.groupBy("feature", "bin").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    smooth = SMOOTHING * BINS
    joined = limits.select("feature", "n_a", "n_b", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin")).join(counts, ["feature", "bin"], "left")
    p = (F.coalesce("a", F.lit(0)) / F.col("n_a") + SMOOTHING) / (1.0 + smooth)
    q = (F.coalesce("b", F.lit(0)) / F.col("n_b") + SMOOTHING) / (1.0 + smooth)
    enough = (F.col("n_a") >= LEAST) & (F.col("n_b") >= LEAST)
    term = F.when(enough, 0.5 * (p - q) * F.log(p / q))
    return joined.groupBy("feature", "n_a", "n_b").agg(F.sum(term).alias("kl"))


def frechet_distance(pool: DataFrame) -> DataFrame:
    """(feature, frechet): squared difference of means plus of deviations of log1p values; null below 10 values a side."""
    logs = checked_values(pool.filter("value is not null")).withColumn("x", F.log1p("value"))
    side = lambda s: F.when(F.col("side") == s, F.col("x"))
    one = logs.groupBy("feature").agg(
        *(f(side(s)).alias(f"{n}_{s}") for s in "ab" for n, f in (("m", F.avg), ("s", F.stddev_pop), ("n", F.count)))
    )
    value = F.pow(F.col("m_a") - F.col("m_b"), 2) + F.pow(F.col("s_a") - F.col("s_b"), 2)
    return one.select("feature", F.when((F.col("n_a") >= LEAST) & (F.col("n_b") >= LEAST), value).alias("frechet"))


def compare_pools(pool: DataFrame) -> DataFrame:
    """(feature, n_a, n_b, kl, frechet): both distances for every feature in one job."""
    return kl_divergence(pool).join(frechet_distance(pool), "feature", "left")


def sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two pools (feature, value) as one with ``side``."""
    return a.select("feature", "value", F.lit("a").alias("side")).unionByName(b.select("feature", "value", F.lit("b").alias("side")))
