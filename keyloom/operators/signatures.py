"""Signatures of composition: where writers pause, how they burst, how they revise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.operators.replay import replay, with_pause_classes
from keyloom.operators.timing import P_BURST_MS, PAUSE_MS, burst_lengths, with_gaps
from keyloom.operators.transcription import similarity


def pauses_at_boundaries(sessions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, feature, value): intervals that end in a key, by the class of the text before the caret at that moment.

    The class is read from the replayed buffer, never from the order of typing; events after a broken replay have none.
    """
    flat = with_pause_classes(sessions).select(*keys, F.posexplode(F.arrays_zip("events", "classes")).alias("i", "z"))
    iki = F.col("z.events.press") - F.lag("z.events.press").over(W.partitionBy(*keys).orderBy("i"))
    return flat.select(*keys, F.concat(F.lit("pause_"), F.col("z.classes")).alias("feature"), iki.alias("value"), F.col("z.events.type").alias("type")).filter("type = 'key' and value is not null and feature is not null").drop("type")


def revision_episodes(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, feature, value): lengths of runs of backspaces right after each other."""
    order = W.partitionBy(*keys).orderBy("seq")
    runs = events.withColumn("_o", F.row_number().over(order)).filter("type = 'bksp'").withColumn("_g", F.col("_o") - F.row_number().over(order))
    return runs.groupBy(*keys, "_g").agg(F.count("*").cast("double").alias("value")).select(*keys, F.lit("revision_episode_lengths").alias("feature"), "value")


def revision_ops(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, bksp_frac, cursor_count, seldel_count) of each session."""
    return events.groupBy(*keys).agg(
        (F.count_if(F.col("type") == "bksp") / F.count("*")).alias("bksp_frac"),
        F.count_if(F.col("type") == "cursor").alias("cursor_count"),
        F.count_if(F.col("type") == "seldel").alias("seldel_count"),
    )


def pooled_signatures(sessions: DataFrame, events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, feature, value) of the eight signature classes; ``events`` is the long form of ``sessions``."""
    ops = revision_ops(events, keys)
    scalars = ops.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in ("bksp_frac", "cursor_count", "seldel_count")))).alias("s")).select(*keys, "s.*")
    return (
        pauses_at_boundaries(sessions, keys)
        .unionByName(burst_lengths(events, P_BURST_MS, keys, "p_burst"))
        .unionByName(revision_episodes(events, keys))
        .unionByName(scalars)
    )


def event_mix(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, type, n, share) of each session."""
    counted = events.groupBy(*keys, "type").agg(F.count("*").alias("n"))
    return counted.select(*keys, "type", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy(*keys)), 6).alias("share"))


def pause_fraction(events: DataFrame, keys: tuple[str, ...], pause_ms: float = PAUSE_MS) -> DataFrame:
    """(keys, pause_fraction): share of intervals above ``pause_ms``, 0 without intervals."""
    return with_gaps(events, keys).groupBy(*keys).agg(F.round(F.coalesce(F.avg((F.col("iki") > pause_ms).cast("double")), F.lit(0.0)), 4).alias("pause_fraction"))


def session_stats(sessions: DataFrame, keys: tuple[str, ...], target: str = "target") -> DataFrame:
    """One row a session: produced text, error, similarity and exactness against the target, span, words a minute over it, events, backspaces.

    The span runs from the first press to the last press or release. Sessions without events have span 0 and produce nothing.
    """
    last = F.array_max(F.transform("events", lambda e: F.greatest(e["press"], F.coalesce(e["release"], e["press"]))))
    first = F.array_min(F.transform("events", lambda e: e["press"]))
    folded = sessions.withColumn("_r", replay(F.col("events"))).withColumn("span_ms", F.coalesce(last - first, F.lit(0.0)))
    produced = F.col("_r.text")
    return folded.select(
        *keys,
        produced.alias("produced"),
        F.col("_r.err").alias("error"),
        F.round(similarity(produced, F.col(target)), 3).alias("similarity"),
        (produced == F.col(target)).alias("exact"),
        F.round("span_ms", 6).alias("span_ms"),
        F.round(F.when(F.col("span_ms") > 0, F.length(produced) / 5.0 / (F.col("span_ms") / 60_000.0)).otherwise(0.0), 6).alias("realized_wpm"),
        F.size("events").alias("n_events"),
        F.size(F.filter("events", lambda e: e["type"] == "bksp")).alias("backspaces"),
    )


def validity(sessions: DataFrame, keys: tuple[str, ...], mode: str = "transcription", least: float = 0.80, target: str = "target") -> DataFrame:
    """(keys, valid, reason): an empty session, one whose replay breaks, one too far from its target, and in transcription one with anything but keys and backspaces is not valid; reasons are joined by '; '."""
    folded = sessions.withColumn("_r", replay(F.col("events")))
    off = F.exists("events", lambda e: ~F.coalesce(e["type"].isin("key", "bksp"), F.lit(False)))
    reasons = F.array_compact(
        F.array(
            F.when(F.size("events") == 0, "no events"),
            F.when(F.col("_r.err").isNotNull(), "replay error"),
            F.when(F.lit(mode == "transcription") & off, "off-type events"),
            F.when((F.size("events") > 0) & ~F.coalesce(similarity(F.col("_r.text"), F.col(target)) >= least, F.lit(False)), "too far from the target"),
        )
    )
    return folded.select(*keys, (F.size(reasons) == 0).alias("valid"), F.nullif(F.array_join(reasons, "; "), F.lit("")).alias("reason"))


def event_rows(sessions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, i, json): each event as a JSON object with times to one decimal; fields that a type does not have are absent."""
    e = F.col("e")
    when = lambda kind, f: F.when(e["type"] == kind, e[f])
    obj = F.struct(
        e["type"].alias("type"), F.round(e["press"], 1).alias("press"), F.round(e["release"], 1).alias("release"), e["ch"].alias("char"),
        when("cursor", "pos").alias("pos"), when("seldel", "sel_start").alias("start"), when("seldel", "sel_end").alias("end"),
    )
    return sessions.select(*keys, F.posexplode("events").alias("i", "e")).select(*keys, "i", F.to_json(obj).alias("json"))
