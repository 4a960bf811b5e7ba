"""Whether and at what cost a text under way reaches its target."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the decoding budget: tokens kept in reserve, patience with a wrong text and its growth per edit, caret moves in a row.
MARGIN, PATIENCE, PATIENCE_PER_EDIT, MAX_HOPS = 8, 10, 2, 3
CURSOR_TOKENS, SELECTION_TOKENS = 1, 1


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common head of two texts, by halving."""
    steps = F.sequence(F.lit(30), F.lit(0), F.lit(-1))
    limit = F.least(F.length(a), F.length(b))

    def longer(n: Column, k: Column) -> Column:
        more = n + F.pow(F.lit(2), k).cast("int")
        return F.when((more <= limit) & (F.left(a, more) == F.left(b, more)), more).otherwise(n)

    return F.aggregate(steps, F.lit(0), longer)


def prefix_depth(text: str, target: str) -> int:
    """Least number of one-character edits from ``text`` to any head of ``target``, row by row of the edit table."""
    own = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    along = np.arange(len(own) + 1)
    row, best = along.copy(), len(own)
    for i, c in enumerate(np.frombuffer(target.encode("utf-32-le"), dtype=np.uint32), 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (own != c))
        # Insertions along the row: the running minimum of what each cell costs less its distance.
        row = np.minimum.accumulate(np.concatenate(([i], step)) - along) + along
        best = min(best, int(row[-1]))
        if not best:
            break
    return best


@F.pandas_udf(T.IntegerType())
def prefix_edit_depth(text: pd.Series, target: pd.Series) -> pd.Series:
    """``prefix_depth`` of two columns, null if either is."""
    return pd.Series([None if a is None or b is None else prefix_depth(a, b) for a, b in zip(text, target)], dtype="Int32")


def number_moves(digits: str, low: int, high: int) -> tuple[str, bool]:
    """Digits that may follow in a number between ``low`` and ``high`` without leading zeros, and whether it may end here."""

    def reachable(head: int) -> bool:
        wide = 1
        while head * wide <= high:
            if head * wide + wide > low:
                return True
            if not head:
                return False
            wide *= 10
        return False

    closed = digits != "" and low <= int(digits) <= high
    if digits == "0":
        return "", closed
    return "".join(d for d in "0123456789" if (low == 0 if not digits and d == "0" else reachable(int(digits + d)))), closed


def finish_tokens(text: Column, cursor: Column, target: Column, revisions: bool = True) -> Column:
    """Tokens of the cheapest way that can be enforced from a text and caret to the target, null if there is none.

    Two a key or backspace, one to end; moving the caret or cutting costs its digits too. Without ``revisions`` only a tail that the caret
    stands behind can be removed.
    """
    head, size, n = common_prefix(text, target), F.length(text), F.length(target)
    digits = lambda k: F.length(k.cast("string"))
    typing = 2 * (n - head) + 1
    move = lambda to: F.when(cursor != to, CURSOR_TOKENS + digits(to) + 2).otherwise(0)
    if revisions:
        cut = SELECTION_TOKENS + digits(head) + 1 + digits(size) + 2
        way = F.when(size > head, move(head) + cut + typing).otherwise(move(size) + typing)
    else:
        way = F.when(cursor == size, 2 * (size - head) + typing)
    return F.when(text == target, F.lit(1)).otherwise(way)


def affordable(text: Column, cursor: Column, target: Column, left: Column) -> Column:
    """Whether the target can still be reached with ``left`` tokens and the reserve."""
    return F.coalesce(finish_tokens(text, cursor, target) + MARGIN <= left, F.lit(False))


AUDIT = T.StructType([T.StructField(n, T.IntegerType()) for n in ("on_path", "deepest", "stalest", "most_hops", "stale_breaks", "hop_breaks")])


def audit(sessions: DataFrame, target: str = "target") -> DataFrame:
    """``sessions`` (events, target) with ``audit``: how a finished stream stood towards its target.

    on_path: characters right at the end; deepest: most edits from any head of the target at any event; stalest: longest run of
    events with a wrong text; most_hops: most caret moves without progress; and at how many events patience or the hop limit was exceeded.
    """
    from keyloom.operators.replay import TextBuffer

    def walk(events, wanted: str) -> tuple[int, ...]:  # noqa: ANN001
        buf, stale, hops, prefix = TextBuffer(), 0, 0, 0
        deepest = stalest = most = late = over = 0
        for e in events:
            if buf.apply(e["type"], e["ch"], e["pos"], e["sel_start"], e["sel_end"]) is not None:
                break
            text = buf.text
            same = next((i for i, (a, b) in enumerate(zip(text, wanted)) if a != b), min(len(text), len(wanted)))
            depth = 0 if same == len(text) else prefix_depth(text, wanted)
            stale = stale + 1 if depth else 0
            hops = 0 if same > prefix else hops + (e["type"] == "cursor")
            prefix = max(prefix, same)
            deepest, stalest, most = max(deepest, depth), max(stalest, stale), max(most, hops)
            late += bool(depth) and stale > PATIENCE + PATIENCE_PER_EDIT * depth
            over += hops > MAX_HOPS
        text = buf.text
        same = next((i for i, (a, b) in enumerate(zip(text, wanted)) if a != b), min(len(text), len(wanted)))
        return same, deepest, stalest, most, late, over

    @F.pandas_udf(AUDIT)
    def run(events: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        empty = (None,) * len(AUDIT)
        return pd.DataFrame([empty if e is None or t is None else walk(e, t) for e, t in zip(events, wanted)], columns=AUDIT.names).astype("Int32")

    return sessions.withColumn("audit", run("events", target))


def window_progress(windowed: DataFrame, keys: tuple[str, ...], target: str = "target") -> DataFrame:
    """(keys, window_no, on_path, gained, revised, stalled): right characters after each window, and whether a later window neither gained any nor revised."""
    from pyspark.sql import Window as W

    from keyloom.operators.replay import replay

    after = windowed.withColumn("_t", replay(F.col("events"), F.col("start_text"), F.col("start_cursor"))["text"])
    order = W.partitionBy(*keys).orderBy("window_no")
    reached = after.select(*keys, "window_no", common_prefix(F.col("_t"), F.col(target)).alias("on_path"), F.exists("events", lambda e: e["type"].isin("cursor", "seldel")).alias("revised"))
    gained = F.col("on_path") - F.lag("on_path").over(order)
    return reached.withColumn("gained", gained).withColumn("stalled", F.coalesce((F.col("gained") <= 0) & ~F.col("revised"), F.lit(False)))


def alternation_errors(streams: DataFrame, key: str, text: str) -> DataFrame:
    """(key, errors): tokens out of turn in streams that must alternate event and gap, starting with an event and ending after one."""
    from keyloom.operators.codec import TOKEN

    tokens = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    out_of_turn = F.filter(tokens, lambda t, i: t.startswith("<DT:") != (i % 2 == 1))
    end = F.when(F.element_at(F.when(F.size(tokens) > 0, tokens), -1).startswith("<DT:"), 1).otherwise(0)
    return streams.select(key, (F.size(out_of_turn) + F.coalesce(end, F.lit(0))).alias("errors"))
