"""Transcription logs to canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Least similarity of the replayed to the submitted text.
REPLAY_SIMILARITY = 0.90
PHYSICAL_KEYBOARDS = ("full", "laptop")


def parse_transcription(keystrokes: DataFrame) -> DataFrame:
    """Long events (writer, session_id, seq, type, press, release, ch, pos, sel_start, sel_end, target, submitted, unlogged).

    A session is a (participant_id, test_section_id). Rows are ordered by press_time, then keystroke_id; repeated
    deliveries (equal in all but loaded_at) count once. Rows without press_time are skipped; a missing release, or one
    before the press, becomes the press. BKSP, BACKSPACE and the backspace character delete, single characters are keys,
    other names are no events. ``unlogged`` marks sessions with a null letter, whose text cannot be trusted. Times
    start at 0 with the first event. Rows without participant or section belong to no session.

    One exchange by session serves the deduplication, the order and everything that follows per session.
    """
    letter = F.col("letter")
    rows = keystrokes.filter("participant_id is not null and test_section_id is not null").select(
        F.col("participant_id").alias("writer"), F.col("test_section_id").alias("session_id"), "keystroke_id", "press_time", "release_time", "letter", F.col("sentence").alias("target"), F.col("user_input").alias("submitted")
    )
    session = W.partitionBy("writer", "session_id")
    order = session.orderBy(F.col("press_time").asc_nulls_first(), "keystroke_id", "letter", "release_time")
    same = F.lit(True)
    for c in ("press_time", "keystroke_id", "letter", "release_time"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(order))
    first = F.row_number().over(order) == 1
    once = rows.withColumn("_same", same & ~first).filter("not _same").withColumn("unlogged", F.max(letter.isNull()).over(session))
    kind = F.when(F.upper(letter).isin("BKSP", "BACKSPACE", "\b"), "bksp").when(F.length(letter) == 1, "key")
    press = F.col("press_time").cast("double")
    events = once.withColumn("type", kind).filter("type is not null and press_time is not null")
    start = F.min(press).over(session)
    return events.select(
        "writer",
        "session_id",
        F.row_number().over(order).alias("seq"),
        "type",
        (press - start).alias("press"),
        (F.greatest(F.coalesce(F.col("release_time"), F.col("press_time")), F.col("press_time")).cast("double") - start).alias("release"),
        F.when(F.col("type") == "key", letter).alias("ch"),
        F.lit(None).cast("int").alias("pos"),
        F.lit(None).cast("int").alias("sel_start"),
        F.lit(None).cast("int").alias("sel_end"),
        "target",
        "submitted",
        "unlogged",
    )


EVENT_FIELDS = ("type", "press", "release", "ch", "pos", "sel_start", "sel_end")


def sessions_of(events: DataFrame, keys: tuple[str, ...] = ("writer", "session_id"), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a session: keys, the first value of each ``carry`` column, and ``events`` in order of seq."""
    gathered = events.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in carry), F.sort_array(F.collect_list(F.struct("seq", *EVENT_FIELDS))).alias("events"))
    return gathered.withColumn("events", F.transform("events", lambda e: F.struct(*(e[f].alias(f) for f in EVENT_FIELDS))))


def similarity(produced: Column, submitted: Column) -> Column:
    """1 - edits / length of the submitted text (at least 1)."""
    return 1.0 - F.levenshtein(produced, submitted) / F.greatest(F.length(submitted), F.lit(1))


def verified_sessions(keystrokes: DataFrame, least: float = REPLAY_SIMILARITY) -> DataFrame:
    """(writer, session_id, target, submitted, events, produced, similarity, reason): every session; ``reason`` is null for the sound ones.

    Reasons: ``unlogged_letter``, ``no_submission``, ``replay_mismatch``. The fold is only run where the first two do not apply.
    """
    from keyloom.operators.replay import replay

    sessions = sessions_of(parse_transcription(keystrokes), carry=("target", "submitted", "unlogged"))
    early = F.when(F.col("unlogged"), "unlogged_letter").when(F.col("submitted").isNull(), "no_submission")
    folded = sessions.withColumn("reason", early).withColumn("produced", F.when(F.col("reason").isNull(), replay(F.col("events"))["text"]))
    scored = folded.withColumn("similarity", similarity(F.col("produced"), F.col("submitted")))
    return scored.withColumn("reason", F.coalesce("reason", F.when(F.col("similarity") < least, "replay_mismatch"))).drop("unlogged")


def physical_keyboard_writers(participants: DataFrame) -> DataFrame:
    """participant_id of those who type on a keyboard of keys."""
    return participants.filter(F.lower(F.trim("keyboard_type")).isin(*PHYSICAL_KEYBOARDS)).select("participant_id").distinct()
