"""Controls that a classifier must tell from real sessions, or must not."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.operators.timing import KEYS
from keyloom.operators.writer_split import hash_share


def _normal(seed: int, key: Column, stream: str) -> Column:
    """A standard normal number fixed by seed and key (Box-Muller over two hashed shares)."""
    u = F.greatest(hash_share(seed, F.concat(F.lit(stream + "u"), key)), F.lit(1e-12))
    v = hash_share(seed, F.concat(F.lit(stream + "v"), key))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def heuristic_baseline(targets: DataFrame, keys: tuple[str, ...] = KEYS, target: str = "target", wpm: str = "wpm", seed: int = 0) -> DataFrame:
    """Long events that type each target without errors: gaps about 60,000 / (5 wpm) ms with 15 % deviation, holds about 80 ms with 12; whole ms, at least 1."""
    chars = targets.select(*keys, F.col(wpm).alias("_w"), F.posexplode(F.split(target, "")).alias("i", "ch")).filter(F.length("ch") > 0)
    name = F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.col("i").cast("string"))
    mean = 60_000.0 / (5.0 * F.greatest(F.col("_w"), F.lit(1.0)))
    gap = F.greatest(F.floor(mean * (1.0 + 0.15 * _normal(seed, name, "g"))), F.lit(1)).cast("double")
    hold = F.greatest(F.floor(80.0 + 12.0 * _normal(seed, name, "h")), F.lit(1)).cast("double")
    order = W.partitionBy(*keys).orderBy("i")
    timed = chars.withColumns({"_g": F.when(F.col("i") > 0, gap).otherwise(0.0), "_h": hold}).withColumn("press", F.sum("_g").over(order.rowsBetween(W.unboundedPreceding, 0)))
    null = F.lit(None).cast("int")
    return timed.select(*keys, (F.col("i") + 1).alias("seq"), F.lit("key").alias("type"), "press", (F.col("press") + F.col("_h")).alias("release"), "ch", null.alias("pos"), null.alias("sel_start"), null.alias("sel_end"))


def shuffle_timing(events: DataFrame, keys: tuple[str, ...] = KEYS, seed: int = 0) -> DataFrame:
    """``events`` with the gaps of each session in another, seeded order; characters and holds stay. Sessions of under three events are as they were."""
    order = W.partitionBy(*keys).orderBy("seq")
    whole = W.partitionBy(*keys)
    gaps = events.withColumns({"_i": F.row_number().over(order), "_g": F.col("press") - F.lag("press").over(order), "_n": F.count("*").over(whole), "_first": F.min("press").over(whole)})
    name = F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.col("_i").cast("string"))
    drawn = F.when(F.col("_i") > 1, hash_share(seed, name))
    # The k-th gap in the drawn order goes to the k-th place: both are in one sorted array of the session.
    ordered = F.sort_array(F.collect_list(F.when(F.col("_i") > 1, F.struct(drawn.alias("u"), F.col("_i").alias("i"), F.col("_g").alias("g")))).over(whole))
    mixed = gaps.withColumn("_m", F.when(F.col("_i") > 1, F.when(F.col("_n") < 3, F.col("_g")).otherwise(F.get(ordered, F.col("_i") - 2)["g"])).otherwise(0.0))
    timed = mixed.withColumn("_p", F.col("_first") + F.sum("_m").over(order.rowsBetween(W.unboundedPreceding, 0)))
    hold = F.col("release") - F.col("press")
    return timed.withColumn("release", F.col("_p") + hold).withColumn("press", F.col("_p")).drop("_i", "_g", "_n", "_first", "_m", "_p")


def halves(rows: DataFrame, keys: tuple[str, ...] = KEYS, seed: int = 0, of: int | None = None) -> DataFrame:
    """``rows``, or those with the label ``of``, with ``label`` 0 or 1 by a seeded hash of the session: two samples of the same kind, which nothing should tell apart."""
    rows = rows if of is None else rows.filter(F.col("label") == of)
    return rows.withColumn("label", (hash_share(seed, F.concat_ws("|", *(F.col(k).cast("string") for k in keys))) < 0.5).cast("int"))
