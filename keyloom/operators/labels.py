"""Behavioural labels, windows, prompts and training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.bins import pct_bin, rev_bin, wpm_bin
from keyloom.operators.codec import has_marker, serialize, supported
from keyloom.operators.replay import replay, window_starts

WINDOW = 512
WRITTEN_TAIL = 500
RATES = ("wpm", "corrected_error_rate", "uncorrected_error_rate", "revision_rate")


def _counts(events: Column) -> dict[str, Column]:
    n = lambda *kinds: F.size(F.filter(events, lambda e: e["type"].isin(*kinds)))
    width = F.aggregate(events, F.lit(0).cast("long"), lambda s, e: s + F.when(e["type"] == "seldel", e["sel_end"] - e["sel_start"]).otherwise(0).cast("long"))
    return {"keys": n("key"), "bksp": n("bksp"), "moves": n("cursor", "seldel"), "width": width, "all": F.size(events)}


def _rates(events: Column, grown: Column, uncorrected: Column) -> list[Column]:
    c = _counts(events)
    some = c["all"] > 0
    minutes = (F.element_at(events, -1)["press"] - F.element_at(events, 1)["press"]) / 60_000.0
    zero = F.lit(0.0)
    return [
        F.when(some & (minutes > 0), (grown / 5.0) / minutes).otherwise(zero).alias("wpm"),
        F.when(some & (c["keys"] > 0), F.least((c["bksp"] + c["width"]) / c["keys"], F.lit(1.0))).otherwise(zero).alias("corrected_error_rate"),
        uncorrected.alias("uncorrected_error_rate"),
        F.when(some, c["moves"] / c["all"]).otherwise(zero).alias("revision_rate"),
    ]


def session_labels(sessions: DataFrame, target: str = "target") -> DataFrame:
    """``sessions`` (events, target) with ``produced``, ``replay_error`` and the four RATES.

    wpm counts five kept characters a word over the time from first to last press; corrected errors are backspaces and
    deleted widths per key, at most 1; uncorrected errors are edits from produced to target per target character, at
    most 1, 0 without a target; revision is the share of cursor and seldel events. Sessions without events get zeros. A session whose replay
    breaks is labelled by the text up to there.
    """
    folded = sessions.withColumn("_r", replay(F.col("events")))
    produced = F.col("_r.text")
    wrong = F.when((F.size("events") > 0) & (F.length(target) > 0), F.least(F.levenshtein(produced, F.col(target)) / F.length(target), F.lit(1.0))).otherwise(F.lit(0.0))
    return folded.select(*sessions.columns, produced.alias("produced"), F.col("_r.err").alias("replay_error"), *_rates(F.col("events"), F.length(produced), wrong))


def label_tokens(mode: Column) -> Column:
    """The five condition tokens of the RATES columns in scope."""
    letter = F.when(mode == "transcription", "T").otherwise("C")
    return F.concat(
        F.lit("<MODE:"), letter, F.lit("><WPM:"), wpm_bin(F.col("wpm")).cast("string"), F.lit("><ECOR:"), pct_bin(F.col("corrected_error_rate")).cast("string"),
        F.lit("><EUNC:"), pct_bin(F.col("uncorrected_error_rate")).cast("string"), F.lit("><REV:"), rev_bin(F.col("revision_rate")).cast("string"), F.lit(">"),
    )


def windows(labelled: DataFrame, keys: tuple[str, ...], size: int = WINDOW) -> DataFrame:
    """Windows of at most ``size`` consecutive events with their own labels and the state they start from.

    (keys, carried columns, window_no, start_text, start_cursor, prev_press, events, RATES). wpm counts what the text grows by in the window,
    uncorrected errors are the session's. Sessions whose replay breaks, or without events, give no windows.
    """
    carried = [c for c in labelled.columns if c not in (*keys, "events", "produced", "replay_error", *RATES)]
    sound = F.when(F.col("replay_error").isNull(), window_starts(F.col("events"), size))
    cut = labelled.select(*keys, *carried, F.col("uncorrected_error_rate").alias("_unc"), "events", F.posexplode_outer(sound).alias("window_no", "_s")).filter("_s is not null")
    first = F.col("window_no") * size
    one = cut.select(
        *keys, *carried, "_unc", "window_no", F.col("_s.text").alias("start_text"), F.col("_s.cursor").alias("start_cursor"),
        F.when(F.col("window_no") > 0, F.get("events", first - 1)["press"]).alias("prev_press"), F.slice("events", first + 1, F.lit(size)).alias("events"),
    )
    after = one.withColumn("_text", replay(F.col("events"), F.col("start_text"), F.col("start_cursor"))["text"])
    grown = F.greatest(F.length("_text") - F.length("start_text"), F.lit(0))
    return after.select(*keys, *carried, "window_no", "start_text", "start_cursor", "prev_press", "events", *_rates(F.col("events"), grown, F.col("_unc")))


def build_prompt(target: Column, mode: Column, written: Column, cursor: Column) -> Column:
    """Condition tokens, target and, where ``cursor`` is not null, the end of what is written and the caret."""
    state = F.when(cursor.isNotNull(), F.concat(F.lit("<WRITTEN>"), F.right(written, F.lit(WRITTEN_TAIL)), F.lit("<CUR:"), cursor.cast("string"), F.lit(">"))).otherwise("")
    return F.concat(label_tokens(mode), F.lit("<TARGET>"), target, state, F.lit("<PROCESS>"))


def training_examples(windowed: DataFrame, keys: tuple[str, ...], mode: str, target: str = "target") -> DataFrame:
    """(keys, window_no, rev, prompt, completion) of windows whose session has only supported characters and no marker in its texts."""
    clean = windowed.filter(~has_marker(F.col(target)) & ~has_marker(F.col("start_text")) & supported(F.col("events")) & F.col(target).isNotNull())
    later = F.col("window_no") > 0
    prompt = build_prompt(F.col(target), F.lit(mode), F.when(later, F.col("start_text")), F.when(later, F.col("start_cursor")))
    return clean.select(*keys, "window_no", rev_bin(F.col("revision_rate")).alias("rev"), prompt.alias("prompt"), serialize("events", F.col("prev_press")).alias("completion"))


def repeat_revisions(examples: DataFrame, factor: int, least_bin: int, train: Column | None = None) -> DataFrame:
    """``examples`` with ``copy_no``: those of the train side whose prompt asks for revisions of ``least_bin`` or more stand ``factor`` times."""
    asked = F.regexp_extract("prompt", r"<REV:(\d+)>", 1).try_cast("int")
    chosen = F.coalesce(asked >= least_bin, F.lit(False)) & (F.lit(True) if train is None else train)
    copies = F.when(chosen & F.lit(factor > 1), F.lit(factor)).otherwise(F.lit(1))
    return examples.withColumn("copy_no", F.explode(F.sequence(F.lit(1), copies)))


def label_audit(examples: DataFrame) -> DataFrame:
    """One row: how often the prompt's revision bin equals the one its completion shows."""
    moves = F.regexp_count("completion", F.lit(r"<CUR:\d+>")) + F.regexp_count("completion", F.lit(r"<SELDEL:\d+-\d+>"))
    events = F.regexp_count("completion", F.lit(r"<(?:CUR|SELDEL|BKSP|SPC|NL|TAB|LT|GT|[^<>]):[\d-]+>"))
    seen = rev_bin(moves / F.nullif(events, F.lit(0)))
    asked = F.regexp_extract("prompt", r"<REV:(\d+)>", 1).try_cast("int")
    return examples.agg(F.count("*").alias("n"), F.round(F.avg((seen == asked).cast("double")), 6).alias("share_equal"), F.count_if((asked == 0) & (moves > 0)).alias("hidden_revisions"))
