"""Sessions held as event arrays, such as generation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.transcription import EVENT_FIELDS


def canonical_events(events: Column) -> Column:
    """Struct elements in the canonical fields, with one spelling of each type."""

    def one(e: Column) -> Column:
        kind = F.lower(F.trim(e["event_type"]))
        return F.struct(
            F.when(kind == "backspace", "bksp").otherwise(kind).alias("type"),
            e["press_time"].alias("press"),
            e["release_time"].alias("release"),
            e["key_char"].alias("ch"),
            e["pos"].alias("pos"),
            e["sel_start"].alias("sel_start"),
            e["sel_end"].alias("sel_end"),
        )

    return F.transform(events, one)


def generated_sessions(results: DataFrame) -> DataFrame:
    """(result_id, prompt, text, was_terminated, steps, events): each result once, its list without nulls and without elements sent twice.

    An element counts as sent twice if it equals the one right before it in every field. A null list is an empty session.
    Of repeated deliveries the one with most events stays.
    """
    present = results.filter("result_id is not null").select("result_id", "prompt", "text", "was_terminated", "steps", F.filter(F.coalesce("events", F.array()), lambda e: e.isNotNull()).alias("events"))
    clean = present.withColumn("events", F.filter("events", lambda e, i: (i == 0) | ~e.eqNullSafe(F.get("events", i - 1))))
    wanted = F.struct(F.size("events").alias("n"), canonical_events(F.col("events")).alias("events"), "prompt", "text", "was_terminated", "steps")
    one = clean.groupBy("result_id").agg(F.max(wanted).alias("r"))
    return one.select("result_id", "r.prompt", "r.text", "r.was_terminated", "r.steps", "r.events")


def long_events(sessions: DataFrame, keys: tuple[str, ...] = ("result_id",)) -> DataFrame:
    """One row an event, with seq from 1; sessions without events vanish."""
    return sessions.select(*keys, F.posexplode("events").alias("seq", "e")).select(*keys, (F.col("seq") + 1).alias("seq"), *(F.col(f"e.{f}").alias(f) for f in EVENT_FIELDS))
