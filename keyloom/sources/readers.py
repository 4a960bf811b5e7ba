"""Readers of the native formats; every schema is explicit and every column optional in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the native files.
TRANSCRIPTION = {
    "PARTICIPANT_ID": "participant_id", "TEST_SECTION_ID": "test_section_id", "SENTENCE": "sentence", "USER_INPUT": "user_input", "KEYSTROKE_ID": "keystroke_id",
    "PRESS_TIME": "press_time", "RELEASE_TIME": "release_time", "LETTER": "letter", "KEYCODE": "keycode",
}
COMPOSITION = {
    "_c0": "row_no", "DownTime": "down_time", "UpTime": "up_time", "ActionTime": "action_time", "DownEvent": "down_event", "UpEvent": "up_event", "TextChange": "text_change",
    "Activity": "activity", "CursorPosition": "cursor_position", "PauseTime": "pause_time", "WordCount": "word_count",
}
ANNOTATED = {
    "_c0": "row_no", "user_id": "writer", "stimulus_id": "session_id", "stimulus": "target", "current_input": "submitted", "input_time": "input_time", "input": "input", "key_symbol": "key_symbol", "finger": "finger",
}
PARTICIPANT = {"PARTICIPANT_ID": "participant_id", "KEYBOARD_TYPE": "keyboard_type", "NATIVE_LANGUAGE": "native_language"}
#: Columns that are numbers; a value that is none becomes null.
NUMBERS = {
    "participant_id": "long", "test_section_id": "long", "keystroke_id": "long", "press_time": "long", "release_time": "long", "keycode": "int", "row_no": "long", "down_time": "long",
    "up_time": "long", "action_time": "long", "cursor_position": "long", "word_count": "long", "pause_time": "long", "input_time": "double",
}


def _named(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The wanted columns by name; those a file lacks are null, all others are left where they are."""
    have = set(raw.columns)
    out = []
    for name, to in columns.items():
        c = F.col(f"`{name}`") if name in have else F.lit(None).cast("string")
        out.append((c.try_cast(NUMBERS[to]) if to in NUMBERS else c).alias(to))
    return raw.select(*out, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"))


def _delimited(spark: SparkSession, path: str | list[str], sep: str, quoted: bool, glob: str | None, columns: dict[str, str]) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).option("recursiveFileLookup", True)
    reader = reader.option("quote", '"').option("escape", '"').option("multiLine", True) if quoted else reader.option("quote", "")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _named(reader.csv(path), columns)


def _by_name(spark: SparkSession, path: str | list[str], glob: str, columns: dict[str, str]) -> DataFrame:
    """Tab-separated files with quoting whose columns may stand elsewhere in each file: every line meets its own file's header.

    The header is the first line of a file in reading order. Fields may hold doubled quotes and tabs, not line ends.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).text(path)
    raw = F.regexp_extract_all(F.concat(F.lit("\t"), F.regexp_replace("value", r"\r\z", "")), F.lit(r'\t("(?:[^"]|"")*"|[^\t]*)'), F.lit(1))
    plain = F.transform(raw, lambda f: F.when(f.startswith('"') & (F.length(f) > 1), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    fields = lines.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("_at"), plain.alias("_f"))
    heads = fields.groupBy(F.col("file_path").alias("_path")).agg(F.min_by("_f", "_at").alias("_head"), F.min("_at").alias("_first"))
    body = fields.join(heads, F.col("file_path") == F.col("_path")).filter(F.col("_at") > F.col("_first"))
    out = []
    for name, to in columns.items():
        at = F.array_position("_head", "" if name == "_c0" else name)
        c = F.nullif(F.when(at > 0, F.get("_f", (at - 1).cast("int"))), F.lit(""))
        out.append((c.try_cast(NUMBERS[to]) if to in NUMBERS else c).alias(to))
    return body.select(*out, "file_path", "file_name")


def read_transcription(spark: SparkSession, path: str | list[str], glob: str = "*_keystrokes.txt") -> DataFrame:
    """Tab-separated transcription logs without quoting; invalid bytes become U+FFFD, short and long lines are kept, casts that fail give null."""
    return _delimited(spark, path, "\t", False, glob, TRANSCRIPTION)


def read_participants(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The participants file of the transcription corpus."""
    return _delimited(spark, path, "\t", False, None, PARTICIPANT)


def file_stem(file_name: Column) -> Column:
    """Name of a file without its folder and last extension."""
    return F.regexp_replace(file_name, r"\.[^.]*\z", "")


def read_composition(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> DataFrame:
    """Comma-separated editing logs with quoting; the writer is the file's stem."""
    raw = _delimited(spark, path, ",", True, glob, COMPOSITION)
    return raw.withColumns({"writer": file_stem(F.col("file_name")), "log_id": F.col("row_no")})


def read_annotated(spark: SparkSession, path: str | list[str], glob: str = "*_matched.txt") -> DataFrame:
    """Tab-separated annotated logs with doubled quotes, columns by name; ``row_no`` is the unnamed counter of the file."""
    return _by_name(spark, path, glob, ANNOTATED)


REVISION = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("revision_depth", T.IntegerType()),
        T.StructField("before_revision", T.StringType()),
        T.StructField("after_revision", T.StringType()),
        T.StructField("before_sent", T.StringType()),
        T.StructField("after_sent", T.StringType()),
        T.StructField(
            "edit_actions",
            T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n.endswith("pos") else T.StringType()) for n in ("type", "before", "after", "start_char_pos", "end_char_pos")])),
        ),
    ]
)


def read_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """Revision documents from the JSON-lines files train, dev and test of a folder; missing files and blank lines are skipped."""
    return spark.read.schema(REVISION).option("pathGlobFilter", "{train,dev,test}.json").json(folder).filter("doc_id is not null")


def read_texts(spark: SparkSession, path: str | list[str], glob: str = "*.txt") -> DataFrame:
    """(stem, folder, text): whole text files."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return raw.select(file_stem(F.col("_metadata.file_name")).alias("stem"), F.regexp_replace("_metadata.file_path", r"/[^/]*\z", "").alias("folder"), F.col("value").alias("text"))


def gold_texts(texts: DataFrame, logs: DataFrame, places: tuple[str, ...] = ("", "/../texts", "/../../texts")) -> DataFrame:
    """(writer, gold): for each log (writer, folder) the text of its stem in the first of ``places`` that has one, relative to the log's folder.

    ``..`` steps are resolved by name, so this is one equi-join on stem and folder.
    """

    def at(folder: Column, place: str) -> Column:
        out = folder
        for step in filter(None, place.split("/")):
            out = F.regexp_replace(out, r"/[^/]*\z", "") if step == ".." else F.concat(out, F.lit("/" + step))
        return out

    wanted = F.array(*(F.struct(F.lit(i).alias("rank"), at(F.col("folder"), p).alias("place")) for i, p in enumerate(places)))
    candidates = logs.select("writer", F.explode(wanted).alias("w")).select("writer", "w.rank", "w.place")
    found = candidates.join(texts.select(F.col("stem").alias("writer"), F.col("folder").alias("place"), "text"), ["writer", "place"])
    return found.groupBy("writer").agg(F.min_by("text", "rank").alias("gold"))


def read_examples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(prompt, completion) of training JSON lines; several exports are simply read together."""
    return spark.read.schema("prompt string, completion string").json(path)


def read_generations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(target, real, generated): dumped pairs of sessions whose events are lists of type, character, press and release."""
    raw = spark.read.schema("target string, real string, generated string").json(path)
    kind = "array<array<string>>"
    events = lambda c: F.transform(
        F.from_json(c, kind), lambda e: F.struct(F.get(e, F.lit(0)).alias("type"), F.get(e, F.lit(2)).try_cast("double").alias("press"), F.get(e, F.lit(3)).try_cast("double").alias("release"), F.get(e, F.lit(1)).alias("ch"))
    )
    return raw.select("target", events("real").alias("real"), events("generated").alias("generated"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(writer, side) from a split file; a writer on both sides is an error."""
    raw = spark.read.schema("seed long, test_frac double, train_writers array<string>, test_writers array<string>").option("multiLine", True).json(path)
    sides = [raw.select(F.explode(f"{s}_writers").alias("writer"), F.lit(s).alias("side")) for s in ("train", "test")]
    both = sides[0].select("writer").intersect(sides[1].select("writer")).head(1)
    if both:
        raise ValueError(f"{both[0]['writer']} is on both sides of the split")
    return sides[0].unionByName(sides[1])


def resolve_split(spark: SparkSession, bound: str | None, explicit: str | None, allow_none: bool = False) -> DataFrame | None:
    """The split that lies with a model if there is one, else the one named; none at all is an error unless allowed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in filter(None, (bound, explicit)):
        p = hadoop(path)
        if p.getFileSystem(conf).exists(p):
            return read_split(spark, path)
    if allow_none:
        return None
    raise FileNotFoundError("no split file: results would not be held out")


def read_training_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(step, total, loss, entropy, mean_token_accuracy, epoch): progress bars and loss records in a training log; lines with neither are left out."""
    line = F.col("value")
    number = lambda k: F.regexp_extract(line, rf"'{k}': '?([-+0-9.eE]+)", 1).try_cast("double").alias(k)
    step = F.regexp_extract(line, r"\| (\d+)/(\d+) \[", 1).try_cast("long").alias("step")
    total = F.regexp_extract(line, r"\| (\d+)/(\d+) \[", 2).try_cast("long").alias("total")
    return spark.read.option("lineSep", "\n").text(path).select(step, total, *map(number, ("loss", "entropy", "mean_token_accuracy", "epoch"))).filter("step is not null or loss is not null")


def describe(df: DataFrame, column: str) -> DataFrame:
    """(value, n): how often each value of a column occurs."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
