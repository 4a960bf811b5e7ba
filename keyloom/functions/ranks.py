"""Row numbers over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hashed_rank(df: DataFrame, keys: list[str], unique: list[str], name: str, buckets: int = 1024, seed: int = 17) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2... within each group of ``keys``, in the order of a seeded hash of ``unique``.

    A group is cut into hash buckets: rows are numbered inside a bucket, and bucket counts (at most ``buckets`` rows a
    group) give what lies before it, so no task holds a group. ``df`` is read twice; cut its lineage if it is costly.
    """
    hashed = df.withColumn("_h", F.xxhash64(*unique, F.lit(seed))).withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    counts = hashed.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = counts.select(*keys, "_b", F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = hashed.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_h", *unique)))
    return ranked.join(before, [*keys, "_b"]).withColumn(name, F.col("_r") + F.col("_before") - 1).drop("_h", "_b", "_r", "_before")
