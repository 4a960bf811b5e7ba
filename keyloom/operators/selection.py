"""Choosing examples and sessions for training and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.operators.codec import SUPPORTED
from keyloom.operators.heldout import heldout
from keyloom.operators.writer_split import capped_per_writer

MODES = {"transcription": "<MODE:T>", "composition": "<MODE:C>"}
TARGET_CHARS = 400
CAP = 3


def by_mode(examples: DataFrame, *modes: str) -> DataFrame:
    """Examples whose prompt opens with the marker of one of ``modes``; an unknown mode is an error."""
    wanted = [MODES[m] for m in modes]
    return examples.filter(reduce(lambda a, b: a | b, (F.col("prompt").startswith(m) for m in wanted)))


def encodable(examples: DataFrame) -> DataFrame:
    """Examples whose prompt a vocabulary of printable ASCII, line end and tab can encode."""
    return examples.filter(F.col("prompt").rlike(rf"\A{SUPPORTED}*\z"))


def concatenated(*exports: DataFrame) -> DataFrame:
    """Several exports as one, columns by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), exports)


def line_sample(rows: DataFrame, limit: int, total: int, seed: int = 0) -> DataFrame:
    """Each row with the chance limit / total: about ``limit`` rows from everywhere in one pass, all rows if there are no more."""
    share = min(1.0, limit / max(total, 1))
    return rows if share >= 1.0 else rows.sample(False, share, seed)


def evaluation_sessions(sessions: DataFrame, split: DataFrame, n: int, order: list[str], cap: int = CAP, writer: str = "writer") -> DataFrame:
    """The first ``n`` held-out sessions in ``order``, at most ``cap`` a writer."""
    return capped_per_writer(heldout(sessions, split, writer=writer), cap, order, writer).orderBy(*order).limit(n)


def composition_targets(sessions: DataFrame, order: list[str], chars: int = TARGET_CHARS, writer: str = "writer", target: str = "target") -> DataFrame:
    """One session a writer, the first in ``order``, with its target cut to ``chars`` characters; empty targets are no sessions."""
    first = sessions.filter(F.length(target) > 0).withColumn("_r", F.row_number().over(W.partitionBy(writer).orderBy(*order))).filter("_r = 1").drop("_r")
    return first.withColumn(target, F.left(F.col(target), F.lit(chars)))
