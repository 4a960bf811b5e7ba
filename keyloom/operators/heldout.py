"""Held-out sessions: membership, sampling and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.operators.writer_split import hash_share, seeded_sample

PREFIX = 12


def heldout(rows: DataFrame, split: DataFrame, side: str = "test", writer: str = "writer") -> DataFrame:
    """Rows whose writer is on ``side``."""
    return rows.join(split.filter(F.col("side") == side).select(writer), writer, "left_semi")


def without(rows: DataFrame, split: DataFrame, side: str = "test", writer: str = "writer") -> DataFrame:
    """Rows whose writer is not on ``side``; writers of neither side stay."""
    return rows.join(split.filter(F.col("side") == side).select(writer), writer, "left_anti")


def sample_sessions(sessions: DataFrame, n: int, seed: int = 0, least_chars: int = 8, writer: str = "writer", session: str = "session_id", target: str = "target") -> DataFrame:
    """``n`` sessions with targets of at least ``least_chars`` characters, one a writer, all by seeded hashes."""
    fit = sessions.filter(F.length(target) >= least_chars)
    order = W.partitionBy(writer).orderBy(hash_share(seed, F.col(session)), session)
    return seeded_sample(fit.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r"), writer, n, seed)


def corpora_of(split: DataFrame, writer: str = "writer") -> DataFrame:
    """(corpus, side, writers): the corpora a split covers, by the prefix of its writers."""
    return split.groupBy(F.split_part(F.col(writer), F.lit(":"), F.lit(1)).alias("corpus"), "side").agg(F.countDistinct(writer).alias("writers"))


def session_key(events: str = "events", n: int = PREFIX):  # noqa: ANN201
    """Digest of a session's first events (type, character, press), by which the same session is known elsewhere."""
    return F.md5(F.to_json(F.transform(F.slice(events, 1, n), lambda e: F.struct(e["type"].alias("t"), e["ch"].alias("c"), F.round(e["press"], 3).alias("p")))).cast("binary"))


def recover_writers(dump: DataFrame, corpus: DataFrame, writer: str = "writer", order: str = "session_id") -> DataFrame:
    """``dump`` (with events) with the writer of the first corpus session that starts the same; null where none does."""
    known = corpus.filter(F.size("events") > 0).groupBy(session_key().alias("_key")).agg(F.min_by(writer, order).alias(writer))
    return dump.withColumn("_key", F.when(F.size("events") > 0, session_key())).join(known, "_key", "left").drop("_key")
