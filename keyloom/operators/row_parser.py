"""Rows that fail to parse: a quote-aware tokenizer over raw records (problem 3)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The nine fields of a log line, in order.
FIELDS = ("participant_id", "test_section_id", "sentence", "user_input", "keystroke_id", "press_time", "release_time", "letter", "keycode")

# States of the tokenizer and classes of its input symbols.
START, PLAIN, QUOTED, CLOSED, BAD, DONE = range(6)
OTHER, TAB, QUOTE, END, PAD = range(5)
#: NEXT[class, state]; BAD and DONE absorb, PAD leaves every state as it is.
NEXT = np.array(
    [
        [PLAIN, PLAIN, QUOTED, BAD, BAD, DONE],
        [START, START, QUOTED, START, BAD, DONE],
        [QUOTED, BAD, CLOSED, QUOTED, BAD, DONE],
        [DONE, DONE, BAD, DONE, BAD, DONE],
        [START, PLAIN, QUOTED, CLOSED, BAD, DONE],
    ],
    dtype=np.uint8,
)
#: Symbols per chunk.
CHUNK = 64


def _chunks(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol classes as a matrix of chunks (each record closed by END, then padded), the record of each chunk, each record's first chunk and length."""
    length = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    per_record = length // CHUNK + 1
    first = np.concatenate(([0], np.cumsum(per_record)[:-1]))
    flat = np.full(int(per_record.sum()) * CHUNK, PAD, dtype=np.uint8)
    place = np.arange(len(points)) + np.repeat(first * CHUNK - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    flat[place] = np.where(points == 9, TAB, np.where(points == 34, QUOTE, OTHER))
    flat[first * CHUNK + length] = END
    return flat.reshape(-1, CHUNK), np.repeat(np.arange(len(lines)), per_record), first, length


def run_automaton(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State before each symbol, class of each symbol (both flat over padded records) and each record's offset in them.

    Every chunk is first read from all states at once, which gives its transition function. Functions of
    neighbouring chunks of a record are composed by a segmented doubling scan, so each chunk learns its true
    entry state without the chunks before it being read again; a second pass then emits the states.
    """
    kinds, record, first, _ = _chunks(lines)
    function = np.broadcast_to(np.arange(6, dtype=np.uint8), (len(kinds), 6)).copy()
    for j in range(CHUNK):
        function = NEXT[kinds[:, j, None], function]
    step = 1
    longest = int(np.bincount(record).max()) if len(record) else 0
    while step < longest:
        joined = np.flatnonzero(record[step:] == record[:-step]) + step
        composed = np.take_along_axis(function[joined], function[joined - step].astype(np.int64), axis=1)
        function = function.copy()
        function[joined] = composed
        step *= 2
    state = np.full(len(kinds), START, dtype=np.uint8)
    inner = np.flatnonzero(record[1:] == record[:-1]) + 1
    state[inner] = function[inner - 1, START]
    before = np.empty_like(kinds)
    for j in range(CHUNK):
        before[:, j] = state
        state = NEXT[kinds[:, j], state]
    return before.ravel(), kinds.ravel(), first * CHUNK


def tokenize(lines: list[str]) -> tuple[list[list[str] | None], list[list[int] | None], list[int]]:
    """Fields, their start offsets, and the offset of the first quoting error (-1: none), for each line."""
    if not lines:
        return [], [], []
    before, kinds, at = run_automaton(lines)
    after = NEXT[kinds, before]
    ends = np.flatnonzero(((kinds == TAB) & (after == START)) | ((kinds == END) & (after == DONE)))
    errors = np.flatnonzero((after == BAD) & (before != BAD))
    owner = np.searchsorted(at, errors, side="right") - 1
    wrong = np.full(len(lines), -1, dtype=np.int64)
    wrong[owner] = errors - at[owner]
    bounds = np.searchsorted(ends, np.append(at, len(kinds)))
    fields: list[list[str] | None] = []
    starts: list[list[int] | None] = []
    for i, line in enumerate(lines):
        if wrong[i] >= 0:
            fields.append(None)
            starts.append(None)
            continue
        stop = (ends[bounds[i] : bounds[i + 1]] - at[i]).tolist()
        begin = [0, *(e + 1 for e in stop[:-1])]
        parts = [line[a:b] for a, b in zip(begin, stop)]
        if '"' in line:
            parts = [p[1:-1].replace('""', '"') if p[:1] == '"' else p for p in parts]
        fields.append(parts)
        starts.append(begin)
    return fields, starts, wrong.tolist()


#: The tokenizer's result for one line.
TOKENS = T.StructType([T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("quote_at", T.IntegerType())])


@F.pandas_udf(TOKENS)
def _tokens(line: pd.Series) -> pd.DataFrame:
    text = line.fillna("")
    fields, starts, wrong = tokenize([t[:-1] if t.endswith("\r") else t for t in text])
    return pd.DataFrame({"fields": fields, "starts": starts, "quote_at": wrong})


def _whole(column: Column, pattern: str) -> Column:
    return column.rlike(rf"\A(?:{pattern})\z")


def _field_checks(field: dict[str, Column]) -> dict[str, Column]:
    """For each field in order, whether its text is valid."""
    number = {n: _whole(field[n], "[0-9]{1,18}") & ~_whole(field[n], "0+") for n in ("participant_id", "test_section_id", "keystroke_id")}
    text = {n: ~_whole(field[n], r"[\t \x{A0}\x{202F}\x{2007}]*") & ~field[n].rlike(r"[\x{FFFD}\x{7F}\x00-\x08\x0A-\x1F]") for n in ("sentence", "user_input")}
    return {
        "participant_id": number["participant_id"],
        "test_section_id": number["test_section_id"],
        "sentence": text["sentence"],
        "user_input": text["user_input"],
        "keystroke_id": number["keystroke_id"],
        "press_time": _whole(field["press_time"], "1[0-9]{12}"),
        "release_time": _whole(field["release_time"], "(?:1[0-9]{12})?"),
        "letter": _whole(field["letter"], r"BKSP|SHIFT|CAPS_LOCK|CTRL|ALT|TAB|[^\x00-\x1F\x7F\x{FFFD}]"),
        "keycode": _whole(field["keycode"], "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"),
    }


def parse_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """All columns of ``lines`` plus ``row`` (typed struct, null for a reject), ``reason`` (null for a good row) and ``error_at``.

    ``reason`` is ``quoting``, ``column_count`` or the name of the first invalid field; ``error_at`` is the offset
    in characters of the offending quote, of the first surplus field (the line's length if fields are missing) or
    of the invalid field. A null or empty line is a reject with ``column_count``. Nothing is shuffled: the
    tokenizer runs per Arrow batch, the checks are JVM expressions, and rows of any length are read in chunks.
    """
    tokens = lines.withColumn("_t", _tokens(F.col(line)))
    field = {n: F.get(F.col("_t.fields"), F.lit(i)) for i, n in enumerate(FIELDS)}
    n_fields = F.coalesce(F.size("_t.fields"), F.lit(0))
    checks = _field_checks(field)
    reason = F.when(F.col("_t.quote_at") >= 0, "quoting").when(n_fields != len(FIELDS), "column_count")
    where = F.when(F.col("_t.quote_at") >= 0, F.col("_t.quote_at")).when(
        n_fields != len(FIELDS), F.coalesce(F.get(F.col("_t.starts"), F.lit(len(FIELDS))), F.length(F.regexp_replace(F.col(line), r"\r\z", "")), F.lit(0))
    )
    for i, n in enumerate(FIELDS):
        reason = reason.when(~checks[n], n)
        where = where.when(~checks[n], F.get(F.col("_t.starts"), F.lit(i)))
    tokens = tokens.withColumn("reason", reason).withColumn("error_at", where)
    typed = {n: F.when(field[n] != "", field[n]).try_cast("long") for n in ("participant_id", "test_section_id", "keystroke_id", "press_time", "release_time")}
    typed |= {"keycode": field["keycode"].try_cast("int")} | {n: field[n] for n in ("sentence", "user_input", "letter")}
    row = F.struct(*(typed[n].alias(n) for n in FIELDS))
    return tokens.withColumn("row", F.when(F.col("reason").isNull(), row)).drop("_t")


def good_rows(lines: DataFrame) -> DataFrame:
    """(line_id, the nine typed fields) of the lines that parse."""
    return parse_rows(lines.select("line_id", "line")).filter("reason is null").select("line_id", "row.*")


def rejected_rows(lines: DataFrame) -> DataFrame:
    """(line_id, reason, error_at) of the lines that do not."""
    return parse_rows(lines.select("line_id", "line")).filter("reason is not null").select("line_id", "reason", "error_at")
