"""Grouping activity into sessions separated by inactivity gaps (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_MS = 1_800_000.0
#: 2000-01-01T00:00:00Z in epoch milliseconds.
EARLIEST_MS = 946_684_800_000.0
KINDS = ("key", "bksp", "cursor", "seldel")


def canonical_kind(column: Column) -> Column:
    """Event types without their spelling variants; null and unknown names become ``other``."""
    plain = F.lower(F.trim(column))
    plain = F.when(plain == "backspace", "bksp").otherwise(plain)
    return F.when(plain.isin(*KINDS), plain).otherwise(F.lit("other"))


def usable_events(events: DataFrame, earliest_ms: float = EARLIEST_MS) -> DataFrame:
    """Events that can belong to a session, once per event_id.

    Left out: null event_id, null or blank writer, and press times that are null, NaN, infinite or before
    ``earliest_ms``. If deliveries of one event_id disagree, the smallest (press_time, writer, kind) counts.
    """
    press = F.col("press_time")
    rows = events.select("event_id", "writer", press.cast("double").alias("press_time"), canonical_kind(F.col("event_type")).alias("kind")).filter(
        F.col("event_id").isNotNull() & (F.trim("writer") != "") & press.isNotNull() & ~F.isnan(press) & (press >= earliest_ms) & (press < float("inf"))
    )
    # The explicit exchange leaves both halves of the aggregate in one stage: one sort, no useless map-side pass.
    one = rows.repartition("event_id").groupBy("event_id").agg(F.min(F.struct("press_time", "writer", "kind")).alias("e"))
    return one.select("event_id", "e.*")


def activity_sessions(events: DataFrame, gap_ms: float = GAP_MS, earliest_ms: float = EARLIEST_MS) -> DataFrame:
    """Sessions of each writer: (writer, session_no, start_ms, end_ms, duration_ms, first_event_id, last_event_id, n_events, n_<kind>...).

    A session is a longest run of a writer's events, ordered by (press_time, event_id), with no step of more than
    ``gap_ms``. Extra columns of ``events`` are ignored; an empty input gives no rows.

    Plan: time is cut into chunks of ``gap_ms``. Two events of one chunk are closer than the gap, so a chunk of a
    writer is one local session and needs neither sort nor window: an aggregate with map-side combine, which a
    writer with a third of all rows cannot skew. Only these partial sessions go to the writer's window, where
    neighbours with a small enough boundary gap are merged. Their number per writer is bounded by the time
    covered (48 a day at half an hour), whatever the number of events.
    """
    rows = usable_events(events, earliest_ms)
    chunk = F.col("press_time") - F.col("press_time") % F.lit(float(gap_ms))
    at = F.struct("press_time", "event_id")
    counts = [F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in (*KINDS, "other")]
    local = rows.groupBy("writer", chunk.alias("chunk")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n_events"), *counts)

    in_order = W.partitionBy("writer").orderBy("chunk")
    opens = F.coalesce(F.col("first.press_time") - F.lag("last.press_time").over(in_order) > gap_ms, F.lit(True))
    merged = local.withColumn("opens", opens.cast("long")).withColumn("session_no", F.sum("opens").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    sums = [F.sum(c).alias(c) for c in ("n_events", *(f"n_{k}" for k in (*KINDS, "other")))]
    out = merged.groupBy("writer", "session_no").agg(F.min("first").alias("first"), F.max("last").alias("last"), *sums)
    return out.select(
        "writer",
        "session_no",
        F.col("first.press_time").alias("start_ms"),
        F.col("last.press_time").alias("end_ms"),
        (F.col("last.press_time") - F.col("first.press_time")).alias("duration_ms"),
        F.col("first.event_id").alias("first_event_id"),
        F.col("last.event_id").alias("last_event_id"),
        "n_events",
        *(f"n_{k}" for k in (*KINDS, "other")),
    )
