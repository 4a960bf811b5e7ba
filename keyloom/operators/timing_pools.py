"""Pools of real timings, and draws from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.ranks import hashed_rank
from keyloom.operators.replay import CLAUSE, WITHIN, WORD, with_pause_classes
from keyloom.session import cut_lineage

THINK, OPERATION = "think", "operation"


def harvest_timings(sessions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, i, pool, gap, hold): gap and hold of keys by pause class, and gaps before cursor and seldel events.

    An operation right after another has an operation gap, any other a think pause. Gaps and holds that are not above 0 are left out.
    """
    flat = with_pause_classes(sessions).select(*keys, F.posexplode(F.arrays_zip("events", "classes")).alias("i", "z"))
    order = W.partitionBy(*keys).orderBy("i")
    e = F.col("z.events")
    rows = flat.select(*keys, "i", e["type"].alias("type"), F.col("z.classes").alias("cls"), (e["press"] - F.lag(e["press"]).over(order)).alias("gap"), (e["release"] - e["press"]).alias("hold"), F.lag(e["type"]).over(order).alias("before")).filter("gap > 0")
    moves = F.col("type").isin("cursor", "seldel")
    pool = F.when((F.col("type") == "key") & (F.col("hold") > 0), F.col("cls")).when(moves & F.col("before").isin("cursor", "seldel"), OPERATION).when(moves, THINK)
    return rows.select(*keys, "i", pool.alias("pool"), "gap", F.when(F.col("type") == "key", F.col("hold")).alias("hold")).filter("pool is not null")


def complete_pools(harvest: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(pool, nr, n, gap, hold): every pool numbered from 0 in the order of a hash, empty ones filled from their nearest neighbour.

    ``harvest`` is written to the shared folder, as every pool reads it. Pools are numbered in hash buckets, so none is one task.

    Word boundaries borrow from within words, clause boundaries from word boundaries, operations from within words, think pauses take
    the three slowest clause gaps. Without any timing within words the result is empty.
    """
    harvest = cut_lineage(harvest)
    sources = {WITHIN: [WITHIN], WORD: [WORD, WITHIN], CLAUSE: [CLAUSE, WORD, WITHIN], OPERATION: [OPERATION, WITHIN], THINK: [THINK]}
    have = harvest.groupBy("pool").agg(F.count("*").alias("n"))
    there = F.broadcast(have.agg(F.collect_set("pool").alias("there")))
    chosen = None
    for pool, chain in sources.items():
        source = F.lit(None).cast("string")
        for s in reversed(chain):
            source = F.when(F.array_contains("there", s), s).otherwise(source)
        part = harvest.crossJoin(there).filter(F.array_contains("there", WITHIN) & (F.col("pool") == source)).select(*keys, "i", F.lit(pool).alias("pool"), "gap", "hold")
        chosen = part if chosen is None else chosen.unionByName(part)
    clause = chosen.filter(F.col("pool") == CLAUSE).crossJoin(there).filter(~F.array_contains("there", THINK))
    slow = clause.orderBy(F.desc("gap"), *keys, "i").limit(3).select(*keys, "i", F.lit(THINK).alias("pool"), "gap", F.lit(None).cast("double").alias("hold"))
    every = chosen.unionByName(slow)
    numbered = hashed_rank(every, ["pool"], [*keys, "i", "gap"], "nr")
    sizes = every.groupBy("pool").agg(F.count("*").alias("n"))  # five rows at most
    return numbered.join(F.broadcast(sizes), "pool").select("pool", "nr", "n", "gap", "hold")


def draw(wanted: DataFrame, pools: DataFrame, key: Column, seed: int = 0) -> DataFrame:
    """``wanted`` (with ``pool``) with a gap and hold drawn by a seeded hash of ``key``: the same draw on every run."""
    sizes = pools.select("pool", "n").distinct()
    numbered = wanted.join(F.broadcast(sizes), "pool", "left").withColumn("nr", F.pmod(F.xxhash64(F.lit(seed), key), F.col("n")))
    return numbered.join(pools.drop("n"), ["pool", "nr"], "left").drop("nr", "n")
