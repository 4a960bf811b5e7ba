"""Streams of events: sessions as they close, and running intervals. An addition; the batch operators are the standard."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyloom.operators.activity_sessions import EARLIEST_MS, GAP_MS, canonical_kind


def streaming_sessions(events: DataFrame, gap_ms: float = GAP_MS, late: str = "10 minutes") -> DataFrame:
    """(writer, session_start, session_end, n_events) of a stream of key events, each once its gap has passed the watermark.

    A delivery that repeats an event_id within the watermark counts once. A session of exactly the gap counts as two here, since windows
    are half open; the batch operator keeps it as one.
    """
    usable = (F.trim("writer") != "") & (F.col("press_time") >= EARLIEST_MS) & (F.col("press_time") < float("inf"))
    timed = events.filter(usable).select("event_id", "writer", F.timestamp_millis(F.col("press_time").cast("long")).alias("at")).withWatermark("at", late)
    once = timed.dropDuplicatesWithinWatermark(["event_id"])
    window = F.session_window("at", f"{int(gap_ms)} milliseconds")
    return once.groupBy("writer", window.alias("w")).agg(F.count("*").alias("n_events")).select("writer", F.col("w.start").alias("session_start"), (F.col("w.end") - F.expr(f"interval {int(gap_ms)} milliseconds")).alias("session_end"), "n_events")


def streaming_intervals(events: DataFrame, gap_ms: float = GAP_MS) -> DataFrame:
    """(writer, n, total_ms, pauses) so far of a stream's press intervals within sessions; state is one press time and three sums a writer.

    Events of a batch are taken in order of press; one that comes after a later one was counted opens no interval.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, total, pauses = state.get if state.exists else (None, 0, 0.0, 0)
        presses = pd.concat([p["press_time"] for p in parts]).sort_values()
        for p in presses:
            if last is not None and p >= last and p - last <= gap_ms:
                n, total, pauses = n + 1, total + p - last, pauses + (p - last > 1000.0)
            last = p if last is None else max(last, p)
        state.update((last, n, total, pauses))
        yield pd.DataFrame({"writer": [key[0]], "n": [n], "total_ms": [total], "pauses": [pauses]})

    usable = events.filter((F.trim("writer") != "") & (F.col("press_time") >= EARLIEST_MS) & (F.col("press_time") < float("inf"))).select("writer", "press_time")
    return usable.groupBy("writer").applyInPandasWithState(
        update, "writer string, n long, total_ms double, pauses long", "last double, n long, total_ms double, pauses long", "update", GroupStateTimeout.NoTimeout
    )


def live_kinds(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, kind, n) of a stream of key events by fixed windows of press time."""
    timed = events.filter((F.col("press_time") >= EARLIEST_MS) & (F.col("press_time") < float("inf"))).select(F.timestamp_millis(F.col("press_time").cast("long")).alias("at"), canonical_kind(F.col("event_type")).alias("kind"))
    return timed.withWatermark("at", late).groupBy(F.window("at", width).alias("window"), "kind").agg(F.count("*").alias("n"))
