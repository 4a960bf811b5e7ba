"""Train and test sides by writer, and samples by hash."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_share(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the first 60 bits of md5(seed:key); the same in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("double") / float(16**15)


def split_by_writer(rows: DataFrame, writer: str = "writer", test_share: float = 0.1, seed: int = 0) -> DataFrame:
    """(writer, side): each writer's side depends on its name and the seed alone, so subsets split as the whole does. Null writers have none."""
    one = rows.select(writer).filter(F.col(writer).isNotNull()).distinct()
    return one.select(writer, F.when(hash_share(seed, F.col(writer)) < test_share, "test").otherwise("train").alias("side"))


def split_by_blake2b(rows: DataFrame, writer: str = "writer", test_share: float = 0.1, seed: int = 0) -> DataFrame:
    """The same with an 8-byte BLAKE2b digest of ``seed:writer`` against the share of 2^64, for parity with existing split files."""
    limit = int(test_share * 2**64)

    @F.pandas_udf(T.BooleanType())
    def test(name: pd.Series) -> pd.Series:
        return name.map(lambda w: int.from_bytes(hashlib.blake2b(f"{seed}:{w}".encode(), digest_size=8).digest(), "big") < limit)

    one = rows.select(F.col(writer).cast("string").alias(writer)).filter(F.col(writer).isNotNull()).distinct()
    return one.select(writer, F.when(test(writer), "test").otherwise("train").alias("side"))


def split_overlap(train: DataFrame, test: DataFrame, writer: str = "writer") -> DataFrame:
    """Writers on both sides; must be empty."""
    return train.select(writer).intersect(test.select(writer))


def check_sides(rows: DataFrame, side: str = "side") -> None:
    """Raises if a side is empty."""
    sides = {r[0] for r in rows.select(side).distinct().collect()}
    if not {"train", "test"} <= sides:
        raise ValueError(f"empty side: have only {sorted(map(str, sides))}")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by the order of a seeded hash of ``key``: the same rows wherever they lie."""
    return rows.withColumn("_o", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))).orderBy("_o", key).limit(n).drop("_o")


def capped_per_writer(sessions: DataFrame, cap: int, order: list[str], writer: str = "writer") -> DataFrame:
    """At most ``cap`` sessions of each writer, in ``order``; a group limit is pushed before the exchange."""
    from pyspark.sql import Window as W

    return sessions.withColumn("_r", F.row_number().over(W.partitionBy(writer).orderBy(*order))).filter(F.col("_r") <= cap).drop("_r")


def union_corpora(corpora: dict[str, DataFrame], writer: str = "writer") -> DataFrame:
    """One table of several corpora, writers prefixed by the corpus."""
    out = None
    for name, df in corpora.items():
        named = df.withColumn(writer, F.concat(F.lit(f"{name}:"), F.col(writer).cast("string")))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each ``key`` in ``order``; rows with a null key are left out."""
    columns = [c for c in rows.columns if c != key]
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in columns))
