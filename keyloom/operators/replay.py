"""Replaying events through a text buffer."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element of a session's event array.
EVENT = "struct<type:string,press:double,release:double,ch:string,pos:int,sel_start:int,sel_end:int>"
WITHIN, WORD, CLAUSE = "within_word", "word_boundary", "clause_boundary"


def replay(events: Column, start_text: Column | None = None, start_cursor: Column | None = None) -> Column:
    """struct<text, cursor, err, at>: the buffer after an array of events, as one JVM fold.

    Keys insert, backspaces delete (nothing at 0), cursor and seldel move or cut within the text. The first event
    that is out of range or of no known type stops the replay: ``err`` names it, ``at`` is its index (-1: none), and text and
    cursor are those before it. A null array gives null.
    """
    text0 = F.lit("") if start_text is None else start_text
    start = F.struct(text0.alias("text"), (F.length(text0) if start_cursor is None else start_cursor).cast("int").alias("cursor"), F.lit(None).cast("string").alias("err"), F.lit(-1).alias("at"), F.lit(0).alias("i"))

    def step(s: Column, e: Column) -> Column:
        new = _applied(s, e)
        return F.struct(*(new[f].alias(f) for f in ("text", "cursor", "err", "at", "i")))

    return F.aggregate(events, start, step, lambda s: F.struct(s["text"].alias("text"), s["cursor"].alias("cursor"), s["err"].alias("err"), s["at"].alias("at")))


def _applied(s: Column, e: Column) -> dict[str, Column]:
    """The fields of state ``s`` (text, cursor, err, at, i) after event ``e``."""
    text, cur, size = s["text"], s["cursor"], F.length(s["text"])
    kind = e["type"]
    err = (
        F.when(kind.isNull() | ~kind.isin("key", "bksp", "cursor", "seldel"), "unknown type")
        .when((kind == "key") & (F.coalesce(F.length(e["ch"]), F.lit(0)) != 1), "key without one character")
        .when((kind == "cursor") & ~F.coalesce(e["pos"].between(F.lit(0), size), F.lit(False)), "cursor outside the text")
        .when((kind == "seldel") & ~F.coalesce((e["sel_start"] >= 0) & (e["sel_start"] < e["sel_end"]) & (e["sel_end"] <= size), F.lit(False)), "selection outside the text")
    )
    new_text = (
        F.when(kind == "key", F.concat(F.left(text, cur), e["ch"], F.substr(text, cur + 1)))
        .when((kind == "bksp") & (cur > 0), F.concat(F.left(text, cur - 1), F.substr(text, cur + 1)))
        .when(kind == "seldel", F.concat(F.left(text, e["sel_start"]), F.substr(text, e["sel_end"] + 1)))
        .otherwise(text)
    )
    new_cur = F.when(kind == "key", cur + 1).when(kind == "bksp", F.greatest(cur - 1, F.lit(0))).when(kind == "cursor", e["pos"]).when(kind == "seldel", e["sel_start"]).otherwise(cur)
    stopped = s["err"].isNotNull() | err.isNotNull()
    return {
        "text": F.when(stopped, text).otherwise(new_text),
        "cursor": F.when(stopped, cur).otherwise(new_cur).cast("int"),
        "err": F.coalesce(s["err"], err),
        "at": F.when(s["err"].isNull() & err.isNotNull(), s["i"]).otherwise(s["at"]),
        "i": s["i"] + 1,
    }


class TextBuffer:
    """The buffer for Python paths, where each event's surroundings are needed: text left of the caret as a list, right of it reversed."""

    def __init__(self, text: str = "", cursor: int | None = None) -> None:
        at = len(text) if cursor is None else cursor
        self.left, self.right = list(text[:at]), list(text[at:][::-1])

    @property
    def text(self) -> str:
        return "".join(self.left) + "".join(reversed(self.right))

    @property
    def cursor(self) -> int:
        return len(self.left)

    def __len__(self) -> int:
        return len(self.left) + len(self.right)

    def move(self, at: int) -> None:
        """To a position between 0 and the length; costs the distance moved."""
        if at < len(self.left):
            self.right.extend(reversed(self.left[at:]))
            del self.left[at:]
        elif at > len(self.left):
            n = at - len(self.left)
            self.left.extend(reversed(self.right[len(self.right) - n :]))
            del self.right[len(self.right) - n :]

    def apply(self, kind: str | None, ch: str | None, pos: float | None, a: float | None, b: float | None) -> str | None:
        """Why the event cannot be applied, or None after applying it. Offsets may come as floats with NaN for null, as pandas has them."""
        pos, a, b = (None if x is None or x != x else int(x) for x in (pos, a, b))
        if kind == "key":
            if ch is None or len(ch) != 1:
                return "key without one character"
            self.left.append(ch)
        elif kind == "bksp":
            if self.left:
                self.left.pop()
        elif kind == "cursor":
            if pos is None or not 0 <= pos <= len(self):
                return "cursor outside the text"
            self.move(pos)
        elif kind == "seldel":
            if a is None or b is None or not 0 <= a < b <= len(self):
                return "selection outside the text"
            self.move(a)
            del self.right[len(self.right) - (b - a) :]
        else:
            return "unknown type"
        return None


def pause_class_of(left: list[str]) -> str:
    """Class of a pause by the text before the caret: after punctuation and a space, after another space, or elsewhere."""
    if left and left[-1] == " ":
        return CLAUSE if len(left) > 1 and left[-2] in ".,;!?" else WORD
    return WITHIN


def pause_class(text: Column) -> Column:
    """The same for a text column."""
    return F.when(F.right(text, F.lit(1)) == " ", F.when(F.substr(text, F.length(text) - 1, F.lit(1)).isin(".", ",", ";", "!", "?") & (F.length(text) > 1), CLAUSE).otherwise(WORD)).otherwise(WITHIN)


def states(rows: Iterable[dict]) -> list[str | None]:
    """Pause class before each event, None from the first event on that cannot be applied."""
    buf, out, broken = TextBuffer(), [], False
    for e in rows:
        out.append(None if broken else pause_class_of(buf.left))
        broken = broken or buf.apply(e["type"], e["ch"], e["pos"], e["sel_start"], e["sel_end"]) is not None
    return out


def with_pause_classes(sessions: DataFrame, events: str = "events") -> DataFrame:
    """``sessions`` with ``classes``: the pause class before each event, read from the live buffer; one row is one session, no shuffle."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def classes(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else states(x) for x in lists])

    return sessions.withColumn("classes", classes(events))


def window_starts(events: Column, size: int = 512) -> Column:
    """array<struct<text, cursor>>: the buffer as each window of ``size`` events begins, by one JVM fold; null if the replay breaks."""
    mark = lambda s: F.array(F.struct(s["text"].alias("text"), s["cursor"].alias("cursor")))
    start = F.struct(
        F.lit("").alias("text"), F.lit(0).alias("cursor"), F.lit(None).cast("string").alias("err"), F.lit(-1).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<text:string,cursor:int>>").alias("marks")
    )

    def step(s: Column, e: Column) -> Column:
        new = _applied(s, e)
        marks = F.when(s["i"] % size == 0, F.concat(s["marks"], mark(s))).otherwise(s["marks"])
        return F.struct(*(new[f].alias(f) for f in ("text", "cursor", "err", "at", "i")), marks.alias("marks"))

    return F.aggregate(events, start, step, lambda s: F.when(s["err"].isNull(), s["marks"]))
