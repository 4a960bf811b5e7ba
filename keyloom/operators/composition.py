"""Composition logs to canonical events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.replay import TextBuffer

INSERTING, DELETING, REPLACING = ("input",), ("remove/cut",), "replace"
EVENTS = "array<struct<type:string,press:double,release:double,ch:string,pos:int,sel_start:int,sel_end:int>>"


def unescaped_change(column):  # noqa: ANN001, ANN201
    """The text of a change: escapes of line end, quote and backslash undone one after the other, in this order; no change is empty."""
    out = column
    for escaped, plain in (("\\n", "\n"), ('\\"', '"'), ("\\\\", "\\")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return F.when(column.isNull() | (column == "NoChange"), "").otherwise(out)


class _Stop(Exception):
    """The session cannot be parsed; the text says why."""


class _Writer:
    """Replays log rows and records the events they amount to.

    Logs give the caret after an edit. A caret move becomes an event only if the caret really moves, and gets the time of the last
    navigation row if that row went to the same place.
    """

    def __init__(self) -> None:
        self.buf = TextBuffer()
        self.events: list[tuple] = []
        self.navigated: tuple[int, float] | None = None

    def _do(self, kind: str, press: float, release: float | None = None, ch: str | None = None, pos: int | None = None, a: int | None = None, b: int | None = None) -> None:
        if (why := self.buf.apply(kind, ch, pos, a, b)) is not None:
            raise _Stop(why)
        self.events.append((kind, press, release, ch, pos, a, b))

    def go(self, to: int, press: float, remembered: bool = True) -> None:
        if to == self.buf.cursor:
            return
        if not 0 <= to <= len(self.buf):
            raise _Stop("cursor outside the text")
        if remembered and self.navigated is not None and self.navigated[0] == to:
            press = self.navigated[1]
        self._do("cursor", press, pos=to)

    def type(self, text: str, press: float, release: float) -> None:
        for ch in text:
            self._do("key", press, release, ch)

    def navigate(self, to: int, press: float) -> None:
        if to != self.buf.cursor and 0 <= to <= len(self.buf):
            self.navigated = (to, press)

    def insert(self, text: str, after: int, press: float, release: float) -> None:
        self.go(after - len(text), press)
        self.type(text, press, release)

    def delete(self, text: str, at: int, press: float, release: float) -> bool:
        n = len(text)
        if not n:
            return False
        if at + n > len(self.buf):
            raise _Stop("deletion outside the text")
        if n == 1:
            self.go(at + 1, press)
            self._do("bksp", press, release)
        else:
            self.go(at, press)
            self._do("seldel", press, a=at, b=at + n)
        return True

    def replace(self, change: str, after: int, press: float, release: float) -> None:
        old, mark, new = change.rpartition(" => ")
        if not mark:
            raise _Stop("malformed replacement")
        start = after - len(new)
        if start < 0 or start + len(old) > len(self.buf):
            raise _Stop("replacement outside the text")
        if old:
            self.go(start, press)
            self._do("seldel", press, a=start, b=start + len(old))
        self.go(start, press, remembered=False)
        self.type(new, press, release)


def parse_rows(rows: Iterator[tuple]) -> tuple[str, list[tuple], str | None]:
    """(text, events, reason) of one session's rows (down, up, activity, change, cursor), already in order.

    Rows without activity or cursor are skipped. A paste or a move of text ends the session with a reason, as does a position outside the
    text; text and events are then those up to there. Times start at 0 with the first event.
    """
    w = _Writer()
    reason = None
    start: float | None = None
    try:
        for down, up, activity, change, cursor in rows:
            if start is None:
                if down is None:
                    raise _Stop("no time in the first row")
                start = down
            if activity is None or cursor is None or down is None:
                continue
            press, at, kind = float(down - start), int(cursor), activity.strip().lower()
            release = press if up is None else max(float(up - start), press)
            if kind == "nonproduction":
                w.navigate(at, press)
                continue
            if kind == "paste" or kind.startswith("move"):
                raise _Stop(f"unsupported: {kind.split(' ')[0]}")
            if kind in INSERTING:
                w.insert(change, at, press, release)
            elif kind in DELETING:
                if not w.delete(change, at, press, release):
                    continue  # an empty deletion does not forget the navigation either
            elif kind == REPLACING:
                w.replace(change, at, press, release)
            w.navigated = None
    except _Stop as stop:
        reason = str(stop)
    first = w.events[0][1] if w.events else 0.0
    events = [(k, p - first, None if r is None else r - first, *rest) for k, p, r, *rest in w.events]
    return w.buf.text, events, reason


def parse_composition(log: DataFrame) -> DataFrame:
    """(writer, text, events, reason) of each writer's session in an editing log.

    Rows are taken in order of down_time, then log_id; repeated deliveries of a log_id count once. Events depend on the text as
    it stands, so a session is replayed by one Python state machine; a session is one person's sitting and bounds what a task holds.
    Rows without a writer belong to no session.
    """
    rows = log.filter("writer is not null").select("writer", "log_id", "down_time", "up_time", "activity", unescaped_change(F.col("text_change")).alias("change"), "cursor_position")
    fields = ("down_time", "up_time", "activity", "change", "cursor_position")

    def parse(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ordered = part.drop_duplicates("log_id").sort_values(["down_time", "log_id"], na_position="first")
        values = zip(*(ordered[f].astype(object).where(ordered[f].notna(), None) for f in fields))
        text, events, reason = parse_rows(values)
        names = ("type", "press", "release", "ch", "pos", "sel_start", "sel_end")
        return pd.DataFrame({"writer": [key[0]], "text": [text], "events": [[dict(zip(names, e)) for e in events]], "reason": [reason]})

    return rows.groupBy("writer").applyInPandas(parse, f"writer string, text string, events {EVENTS}, reason string")


def exact_sessions(parsed: DataFrame, gold: DataFrame) -> DataFrame:
    """``parsed`` sessions without a reason whose text equals the published ``gold`` (writer, gold) apart from line ends at the end."""
    bare = lambda c: F.regexp_replace(c, r"\n+\z", "")
    return parsed.filter("reason is null").join(gold, "writer").filter(bare(F.col("text")) == bare(F.col("gold")))
