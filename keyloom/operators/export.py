"""The whole way from logs to training examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.codec import supported
from keyloom.operators.labels import session_labels, training_examples, windows
from keyloom.operators.transcription import verified_sessions
from keyloom.operators.writer_split import split_by_writer


def transcription_examples(keystrokes: DataFrame, participants: DataFrame | None = None) -> DataFrame:
    """(writer, session_id, window_no, rev, prompt, completion) of all sound sessions, of physical keyboards only if ``participants`` are given.

    One exchange by session carries everything from the log's rows to the examples; texts are replayed once for the gate and once
    for the windows, in the JVM.
    """
    from keyloom.operators.transcription import physical_keyboard_writers

    rows = keystrokes
    if participants is not None:
        rows = rows.join(physical_keyboard_writers(participants), "participant_id", "left_semi")
    sound = verified_sessions(rows).filter("reason is null").select(F.concat(F.lit("aalto:"), F.col("writer").cast("string")).alias("writer"), "session_id", "target", "events")
    keys = ("writer", "session_id")
    # Sessions that would be refused anyway leave before labels and windows are worked out.
    fit = sound.filter(F.col("target").isNotNull() & supported(F.col("events")))
    return training_examples(windows(session_labels(fit), keys), keys, "transcription")


def exported(keystrokes: DataFrame, participants: DataFrame | None = None, test_share: float = 0.1, seed: int = 0) -> DataFrame:
    """The same with each writer's ``side``."""
    examples = transcription_examples(keystrokes, participants)
    sides = split_by_writer(keystrokes.select(F.concat(F.lit("aalto:"), F.col("participant_id").cast("string")).alias("writer")), "writer", test_share, seed)
    return examples.join(sides, "writer")
