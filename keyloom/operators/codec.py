"""Token streams: events as text on the time grid, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.bins import PCT_MAX, TIME_BINS, WPM_BINS, from_bin, to_bin

# Names of characters that cannot stand in a token, prompt markers, and the characters a token can hold.
ESCAPES = {" ": "SPC", "\n": "NL", "\t": "TAB", "<": "LT", ">": "GT"}
MARKERS = ("<TARGET>", "<WRITTEN>", "<PROCESS>")
SUPPORTED = r"[\n\t\x20-\x7E]"
# Renderings of plain characters that word processors put in.
SAME_WIDTH = {
    "'": "‘’‚‛′", '"': "“”„‟″", "-": "‐‑‒–—―−", " ": "  " + "".join(map(chr, range(0x2000, 0x200B))),
}
VANISHING = "​‌‍﻿"
# Fixed value: the grammar of a token.
TOKEN = r"<DT:\d+>|<CUR:\d+>|<SELDEL:\d+-\d+>|<BKSP:\d+>|<(?:SPC|NL|TAB|LT|GT|[^<>]):\d+>"


def escape_char(ch: Column) -> Column:
    out = ch
    for plain, name in ESCAPES.items():
        out = F.when(ch == plain, name).otherwise(out)
    return out


def unescape_char(name: Column) -> Column:
    out = name
    for plain, n in ESCAPES.items():
        out = F.when(name == n, plain).otherwise(out)
    return out


def normalize_typable(text: Column) -> Column:
    """Word-processor renderings as the plain characters they stand for; line ends as \\n. All else passes unchanged."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.replace(out, F.lit("…"), F.lit("..."))
    wide, plain = "".join(SAME_WIDTH.values()), "".join(k * len(v) for k, v in SAME_WIDTH.items())
    return F.translate(out, wide + VANISHING, plain)


def supported(events: Column) -> Column:
    """Whether every typed character has a token."""
    return ~F.exists(events, lambda e: (e["type"] == "key") & ~F.coalesce(e["ch"].rlike(rf"\A{SUPPORTED}\z"), F.lit(False)))


def has_marker(text: Column) -> Column:
    """Whether a text holds a prompt marker and must be refused; null holds none."""
    found = F.lit(False)
    for m in MARKERS:
        found = found | F.contains(text, F.lit(m))
    return F.coalesce(found, F.lit(False))


def _number(k: Column) -> Column:
    return k.cast("string")


def event_token(e: Column) -> Column:
    hold = _number(to_bin(e["release"] - e["press"]))
    return (
        F.when(e["type"] == "key", F.concat(F.lit("<"), escape_char(e["ch"]), F.lit(":"), hold, F.lit(">")))
        .when(e["type"] == "bksp", F.concat(F.lit("<BKSP:"), hold, F.lit(">")))
        .when(e["type"] == "cursor", F.concat(F.lit("<CUR:"), _number(e["pos"]), F.lit(">")))
        .when(e["type"] == "seldel", F.concat(F.lit("<SELDEL:"), _number(e["sel_start"]), F.lit("-"), _number(e["sel_end"]), F.lit(">")))
    )


def serialize(events: str, previous_press: Column | None = None) -> Column:
    """Token stream of an array column: a gap token before each event, before the first only if ``previous_press`` is not null.

    An event that has no token (no release of a key, unknown type) leaves its token out.
    """
    before_first = F.lit(None).cast("double") if previous_press is None else previous_press

    def one(e: Column, i: Column) -> Column:
        previous = F.when(i == 0, before_first).otherwise(F.get(events, i - 1)["press"])
        gap = F.coalesce(F.concat(F.lit("<DT:"), _number(to_bin(e["press"] - previous)), F.lit(">")), F.lit(""))
        return F.concat(gap, F.coalesce(event_token(e), F.lit("")))

    return F.array_join(F.transform(events, one), "")


def parse_tokens(streams: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, type, press, release, ch, pos, sel_start, sel_end): events of the streams that keep the grammar; see ``grammar_errors``."""
    sound = F.when(grammar_error(F.col(text)).isNull(), F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)))
    tokens = streams.select(key, F.posexplode_outer(sound).alias("i", "t")).filter("t is not null")
    order = W.partitionBy(key).orderBy("i")
    gap = F.when(F.col("t").startswith("<DT:"), F.regexp_extract("t", r"<DT:(\d+)>", 1).cast("int"))
    timed = tokens.withColumn("gap", gap).withColumn("press", F.coalesce(F.sum(from_bin(F.col("gap"))).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))).filter("gap is null")
    t = F.col("t")
    kind = F.when(t.rlike(r"\A<BKSP:\d+>"), "bksp").when(t.rlike(r"\A<CUR:\d+>"), "cursor").when(t.rlike(r"\A<SELDEL:"), "seldel").otherwise("key")
    number = lambda p: F.regexp_extract(t, p, 1).try_cast("int")
    hold = number(r":(\d+)>\z")
    return timed.withColumn("type", kind).select(
        key,
        F.row_number().over(order).alias("seq"),
        "type",
        "press",
        F.when(F.col("type").isin("key", "bksp"), F.col("press") + from_bin(hold)).alias("release"),
        F.when(F.col("type") == "key", unescape_char(F.regexp_extract(t, r"(?s)\A<(.*):\d+>\z", 1))).alias("ch"),
        F.when(F.col("type") == "cursor", number(r"\A<CUR:(\d+)>")).alias("pos"),
        F.when(F.col("type") == "seldel", number(r"\A<SELDEL:(\d+)-")).alias("sel_start"),
        F.when(F.col("type") == "seldel", number(r"-(\d+)>\z")).alias("sel_end"),
    )


def grammar_error(text: Column) -> Column:
    """The first thing wrong with a stream: stray text, a bin out of range, two gaps in a row, an event without a gap before it, or a gap at the end.

    One pass over the tokens with one state; the list of tokens is named once, so it is made once however the plan is rewritten.
    """

    def step(s: Column, t: Column) -> Column:
        gap = t.startswith("<DT:")
        bad_bin = F.coalesce(F.regexp_extract(t, r"<(?:DT|BKSP|SPC|NL|TAB|LT|GT|[^<>]):(\d+)>", 1).try_cast("int") >= TIME_BINS, t.rlike(r"<(?:DT|BKSP|SPC|NL|TAB|LT|GT|[^<>]):\d{10,}>"))
        err = F.when(bad_bin, "bin_range").when(s["gap"] & gap, "double_gap").when(~s["gap"] & ~gap, "missing_gap")
        return F.struct(gap.alias("gap"), F.coalesce(s["err"], err).alias("err"))

    start = F.struct(F.lit(None).cast("boolean").alias("gap"), F.lit(None).cast("string").alias("err"))
    tokens = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    walked = F.aggregate(tokens, start, step, lambda s: F.coalesce(s["err"], F.when(s["gap"], "dangling_gap")))
    return F.when(F.length(F.regexp_replace(text, TOKEN, "")) > 0, "stray_text").otherwise(walked)


def grammar_errors(streams: DataFrame, key: str, text: str) -> DataFrame:
    """(key, error), null for sound streams."""
    return streams.select(key, grammar_error(F.col(text)).alias("error"))


def sound_prefix(text: Column) -> Column:
    """The longest start of a stream that keeps the grammar, for streams cut off or damaged at the end."""
    event = r"(?:<CUR:\d+>|<SELDEL:\d+-\d+>|<BKSP:\d+>|<(?:SPC|NL|TAB|LT|GT|[^<>]):\d+>)"
    return F.regexp_extract(text, rf"\A((?:<DT:\d+>)?{event}(?:<DT:\d+>{event})*)", 1)


def shift_events(events: DataFrame, offset_ms: Column) -> DataFrame:
    """Events of a window on the session's clock."""
    return events.withColumns({"press": F.col("press") + offset_ms, "release": F.col("release") + offset_ms})


def roundtrip(events: DataFrame, keys: tuple[str, ...] = ("writer", "session_id")) -> DataFrame:
    """Events as they come back from their own token stream: gaps and holds at bin centres. No text is made; doing it twice changes nothing."""
    order = W.partitionBy(*keys).orderBy("seq")
    gap = from_bin(to_bin(F.col("press") - F.lag("press").over(order)))
    hold = from_bin(to_bin(F.col("release") - F.col("press")))
    binned = events.withColumns({"_g": F.coalesce(gap, F.lit(0.0)), "_h": F.when(F.col("type").isin("key", "bksp"), hold)})
    timed = binned.withColumn("press", F.sum("_g").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return timed.withColumn("release", F.col("press") + F.col("_h")).drop("_g", "_h")


def rollovers(events: DataFrame, keys: tuple[str, ...] = ("writer", "session_id")) -> DataFrame:
    """``events`` with ``rollover``: whether a key's hold bin exceeds the gap bin that follows; null for a session's last event."""
    after = F.lead("press").over(W.partitionBy(*keys).orderBy("seq")) - F.col("press")
    return events.withColumn("rollover", to_bin(F.col("release") - F.col("press")) > to_bin(after))


def vocabulary(spark: SparkSession) -> DataFrame:
    """(token): every token of the format; positions are text and only their prefixes are listed."""
    names = [chr(c) for c in range(0x20, 0x7F) if chr(c) not in ESCAPES] + list(ESCAPES.values())
    held = spark.createDataFrame([(n,) for n in (*names, "BKSP")], "name string")
    bins = spark.range(TIME_BINS).select(F.col("id").cast("string").alias("b"))
    keyed = held.crossJoin(bins).select(F.format_string("<%s:%s>", "name", "b").alias("token"))
    knobs = [f"<WPM:{b}>" for b in range(WPM_BINS)] + [f"<{k}:{b}>" for k in ("ECOR", "EUNC", "REV") for b in range(PCT_MAX + 1)]
    fixed = ["<CUR:", "<SELDEL:", "<MODE:T>", "<MODE:C>", *knobs, *MARKERS]
    gaps = bins.select(F.format_string("<DT:%s>", "b").alias("token"))
    return keyed.unionByName(gaps).unionByName(spark.createDataFrame([(t,) for t in fixed], "token string"))


def prompt_parts(prompt: Column) -> Column:
    """struct<mode, wpm, ecor, eunc, rev, target>: what a prompt asks for; parts that are missing are null."""
    number = lambda k: F.regexp_extract(prompt, rf"<{k}:(\d+)>", 1).try_cast("int").alias(k.lower())
    target = F.regexp_extract(prompt, r"(?s)<TARGET>(.*?)(?:<WRITTEN>|<PROCESS>)", 1)
    return F.struct(
        F.nullif(F.regexp_extract(prompt, r"<MODE:([TC])>", 1), F.lit("")).alias("mode"), number("WPM"), number("ECOR"), number("EUNC"), number("REV"), F.when(F.contains(prompt, F.lit("<TARGET>")), target).alias("target")
    )
