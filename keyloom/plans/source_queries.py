"""Round trips: the driver's tables written as native files into the shared folder, read back and compared with the tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import labels, writer_split
from keyloom.plans.array_queries import KEY, results, typed_windows
from keyloom.plans.catalog import ORACLE, query
from keyloom.plans.sql import GENERATED, share
from keyloom.session import shared_folder, table
from keyloom.sources import readers, writers


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid4().hex}"


def _digest(*names: str) -> list:
    """Texts as digests, so that every character counts and none gets lost in a comparison of rows; empty fields of a file are nulls."""
    return [F.md5(F.nullif(F.col(n), F.lit("")).cast("binary")).alias(n) for n in names]


def _sql_digest(*names: str) -> str:
    return ", ".join(f"md5(nullif({n}, '')) AS {n}" for n in names)


_NUMBERS = ("participant_id", "test_section_id", "keystroke_id", "press_time", "release_time", "keycode")
_TEXTS = ("sentence", "user_input", "letter")


@query("source_transcription", f"SELECT {', '.join(_NUMBERS)}, {_sql_digest(*_TEXTS)} FROM keystrokes WHERE NOT regexp_matches(concat(sentence, user_input, letter), '[\\t\\n\\r]')")
def source_transcription(spark: SparkSession, d: str) -> DataFrame:
    """The transcription log through its tab-separated files; texts with tabs or line ends are none that a file without quotes can hold."""
    place = _place(spark)
    rows = table(spark, d, "keystrokes").filter(~F.concat_ws("", *_TEXTS).rlike(r"[\t\n\r]"))
    named = rows.select(*(F.col(to).alias(name) for name, to in readers.TRANSCRIPTION.items()))
    named.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(place)
    return readers.read_transcription(spark, place, "*.csv").select(*_NUMBERS, *_digest(*_TEXTS))


_LOG_NUMBERS = ("row_no", "down_time", "up_time", "action_time", "cursor_position", "pause_time", "word_count")
_LOG_TEXTS = ("down_event", "up_event", "text_change", "activity")


@query("source_composition", f"SELECT {', '.join(_LOG_NUMBERS)}, {_sql_digest(*_LOG_TEXTS)} FROM composition_log")
def source_composition(spark: SparkSession, d: str) -> DataFrame:
    """The editing log through its comma-separated files with quoting."""
    place = _place(spark)
    named = table(spark, d, "composition_log").select(*(F.col(to).alias(name) for name, to in readers.COMPOSITION.items()))
    named.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(place)
    return readers.read_composition(spark, place).select(*_LOG_NUMBERS, *_digest(*_LOG_TEXTS))


@query(
    "source_participants",
    "SELECT participant_id, md5(nullif(keyboard_type, '')) AS keyboard_type, md5(nullif(native_language, '')) AS native_language FROM participants WHERE NOT regexp_matches(concat(keyboard_type, native_language), '[\\t\\n\\r]')",
)
def source_participants(spark: SparkSession, d: str) -> DataFrame:
    """The participants file."""
    place = _place(spark)
    rows = table(spark, d, "participants").filter(~F.concat_ws("", "keyboard_type", "native_language").rlike(r"[\t\n\r]"))
    named = rows.select(*(F.col(to).alias(name) for name, to in readers.PARTICIPANT.items()))
    named.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(place)
    return readers.read_participants(spark, place).select("participant_id", *_digest("keyboard_type", "native_language"))


@query("source_split", ORACLE["writer_split"].replace("participant_id AS writer", "participant_id::VARCHAR AS writer", 1))
def source_split(spark: SparkSession, d: str) -> DataFrame:
    """The split of all writers through its file."""
    place = _place(spark)
    rows = table(spark, d, "keystrokes").select(F.col("participant_id").alias("writer"))
    writers.write_split(writer_split.split_by_writer(rows).select(F.col("writer").cast("string").alias("writer"), "side"), place, 0, 0.1)
    return readers.read_split(spark, place)


@query(
    "source_examples",
    f"""{ORACLE['typed_examples'].removesuffix(' SELECT * FROM ex')},
    o AS (SELECT *, CASE WHEN {share(0, 'result_id')} < 0.1 THEN 'test' ELSE 'train' END AS side, regexp_extract(prompt, '<REV:([0-9]+)>', 1)::INTEGER AS rev FROM ex)
    SELECT side, md5(prompt) AS prompt, md5(completion) AS completion FROM (SELECT *, unnest(range(1, CASE WHEN side = 'train' AND rev >= 5 THEN 4 ELSE 2 END)) AS copy_no FROM o)""",
)
def source_examples(spark: SparkSession, d: str) -> DataFrame:
    """Training examples of long sessions through their JSON lines, revisions three times on the train side."""
    place = _place(spark)
    examples = labels.training_examples(typed_windows(spark, d), KEY, "composition").withColumnRenamed("result_id", "writer")
    writers.write_examples(examples, writer_split.split_by_writer(examples), place, ["writer", "window_no"], factor=3, least_bin=5)
    sides = [readers.read_examples(spark, f"{place}/{s}.jsonl").select(F.lit(s).alias("side"), *_digest("prompt", "completion")) for s in ("train", "test")]
    return sides[0].unionByName(sides[1])


@query(
    "source_generations",
    f"WITH {GENERATED} SELECT md5(target) AS target, len(ev)::INTEGER AS n, round(list_sum(list_transform(ev, lambda x: x.press)), 3) AS presses, len(list_filter(ev, lambda x: x.ch = 'e'))::INTEGER AS e FROM r WHERE target <> ''",
)
def source_generations(spark: SparkSession, d: str) -> DataFrame:
    """Generated sessions through the dump of (type, character, press, release) lists."""
    place = _place(spark)
    kept = results(spark, d).filter("target <> ''")
    listed = F.transform("events", lambda e: F.array(e["type"], e["ch"], e["press"].cast("string"), e["release"].cast("string")))
    kept.select("target", F.array().cast("array<array<string>>").alias("real"), listed.alias("generated")).write.option("ignoreNullFields", False).json(place)
    read = readers.read_generations(spark, place)
    presses = F.round(F.aggregate(F.filter(F.transform("generated", lambda e: e["press"]), lambda p: p.isNotNull()), F.lit(0.0), lambda a, p: a + p), 3)
    some = F.exists("generated", lambda e: e["press"].isNotNull())
    return read.select(*_digest("target"), F.size("generated").alias("n"), F.when(some, presses).alias("presses"), F.size(F.filter("generated", lambda e: e["ch"] == "e")).alias("e"))
