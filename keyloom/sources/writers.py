"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.labels import repeat_revisions
from keyloom.operators.writer_split import check_sides


def write_examples(examples: DataFrame, split: DataFrame, folder: str, order: list[str], factor: int = 1, least_bin: int = 0) -> None:
    """``folder``/train.jsonl and test.jsonl (folders of part files) of (writer, prompt, completion), in ``order`` from part to part.

    Repeats are for the train side only. An empty side is an error before anything is written. Writers without a side are left out.
    """
    placed = examples.join(split, "writer")
    check_sides(placed)
    for side in ("train", "test"):
        rows = placed.filter(F.col("side") == side)
        if side == "train" and factor > 1:
            rows = repeat_revisions(rows, factor, least_bin)
        keys = [*order, "copy_no"] if "copy_no" in rows.columns else order
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("prompt", "completion").write.mode("overwrite").json(f"{folder}/{side}.jsonl")


#: Writers a split file may name; its lists are one object, so they must fit one task.
MAX_WRITERS = 1_000_000


def write_split(split: DataFrame, path: str, seed: int, test_share: float) -> None:
    """The split as JSON with sorted lists; one object, as its readers expect it. More than MAX_WRITERS are an error: keep such a split as a table."""
    if split.count() > MAX_WRITERS:
        raise ValueError(f"a split file holds at most {MAX_WRITERS} writers")
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("writer")))).alias(f"{s}_writers")
    one = split.agg(side("train"), side("test")).select(F.lit(seed).alias("seed"), F.lit(test_share).alias("test_frac"), "train_writers", "test_writers")
    one.coalesce(1).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """An evaluation report; NaN and infinities become null."""
    from keyloom.operators.gates import report_json

    report_json(report).coalesce(1).write.mode("overwrite").text(path)


def write_winners(best: DataFrame, path: str) -> None:
    """Chosen candidates (prompt, completion) as JSON lines."""
    best.select("prompt", "completion").write.mode("overwrite").json(path)
