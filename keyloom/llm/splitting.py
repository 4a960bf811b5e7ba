"""Splitting oversized items at natural boundaries (problem 5)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 512, 32
#: Pause before an event, in ms, that ends a burst of typing.
PAUSE_MS = 2000.0
#: Boundary strengths in order of preference, each with the least share of the limit a piece must fill to end there.
PREFERENCE = ((3, 0.75), (2, 0.75), (1, 0.75), (1, 0.5), (1, 0.0))

PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("strength", T.IntegerType())]))


def clean_events(results: DataFrame) -> DataFrame:
    """(result_id, events): null elements dropped, then elements equal in every field to the one then right before them. Null lists become empty."""
    present = results.select("result_id", F.filter(F.coalesce("events", F.array()), lambda e: e.isNotNull()).alias("events"))
    return present.select("result_id", F.filter("events", lambda e, i: (i == 0) | ~e.eqNullSafe(F.get("events", i - 1))).alias("events"))


def _strength(e: Column, before: Column, earlier: Column) -> Column:
    """How natural a cut right before ``e`` is: 3 line end or pause, 2 sentence end, 1 word end or the start of a jump or deletion, 0 none."""
    typed = F.lower(F.trim(before["event_type"])) == "key"
    ends = before["key_char"].isin(".", "!", "?", "…") | ((before["key_char"] == " ") & earlier["key_char"].isin(".", "!", "?", "…"))
    return (
        F.when((typed & (before["key_char"] == "\n")) | (e["press_time"] - before["press_time"] >= PAUSE_MS), 3)
        .when(typed & ends, 2)
        .when((typed & (before["key_char"] == " ")) | F.lower(F.trim(e["event_type"])).isin("cursor", "seldel"), 1)
        .otherwise(0)
        .cast("byte")
    )


def greedy_cuts(strengths: list[np.ndarray], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple[int, int, int]]]:
    """(start, stop, strength of the boundary at stop) of all pieces of all items; the last piece of an item has strength -1.

    Every position of every item is joined to the end of the piece that would start there: the farthest boundary
    within the limit, by preference. The next piece starts ``overlap`` before that end, which makes a successor table.
    Squaring the table doubles the steps it takes, so marks spread from the items' first positions to all piece
    starts in as many rounds as the largest number of pieces has binary digits, for all items at once.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half of the limit")
    size = np.fromiter(map(len, strengths), dtype=np.int64, count=len(strengths))
    if not size.sum():
        return [[] for _ in strengths]
    flat = np.concatenate(strengths).astype(np.int8)
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.arange(len(flat))
    end = np.repeat(base + size, size)
    reach = np.minimum(at + limit, end)
    stop = reach.copy()
    open_ = reach < end
    chosen = ~open_
    for least, share in PREFERENCE:
        last = np.maximum.accumulate(np.where(flat >= least, at, -1))
        cut = last[np.minimum(reach, len(flat) - 1)]
        good = ~chosen & (cut >= at + max(int(limit * share), overlap + 1))
        stop[good] = cut[good]
        chosen |= good
    after = np.where(open_, stop - overlap, at)
    marked = np.zeros(len(flat), dtype=bool)
    marked[base[size > 0]] = True
    while True:
        more = after[marked]
        if marked[more].all():
            break
        marked[more] = True
        after = after[after]
    out: list[list[tuple[int, int, int]]] = [[] for _ in strengths]
    starts = np.flatnonzero(marked)
    owner = np.searchsorted(base + size, starts, side="right")
    for i, s in zip(owner.tolist(), starts.tolist()):
        e = int(stop[s])
        out[i].append((s - int(base[i]), e - int(base[i]), int(flat[e]) if e < base[i] + size[i] else -1))
    return out


def _cuts(results: DataFrame, limit: int, overlap: int, *more: str) -> DataFrame:
    """(result_id, c): the cut list of each result_id with its number of events and the columns ``more`` of the same delivery."""

    @F.pandas_udf(PIECES)
    def cut(strength: pd.Series) -> pd.Series:
        found = greedy_cuts([np.asarray(s, dtype=np.int8) for s in strength], limit, overlap)
        return pd.Series([[{"start": a, "stop": b, "strength": k} for a, b, k in f] for f in found])

    cleaned = clean_events(results.filter("result_id is not null"))
    strength = F.transform("events", lambda e, i: F.coalesce(_strength(e, F.get("events", i - 1), F.get("events", i - 2)), F.lit(0).cast("byte")))
    cuts = cleaned.select("result_id", *more, strength.alias("s")).select("result_id", *more, F.size("s").alias("n"), cut("s").alias("cuts"))
    return cuts.groupBy("result_id").agg(F.max(F.struct("n", "cuts", *more)).alias("c"))


def pieces(results: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(result_id, n_events, piece_no, start, stop, strength): pieces of at most ``limit`` events, neighbours sharing ``overlap``.

    Offsets are into the cleaned list. Items within the limit are one piece; empty and null lists give none. Rows without
    a result_id are left out, repeated ones give one item (of deliveries that differ, the longest, then the largest cut list).
    Only boundary strengths, a byte an event, reach Python; only cut lists are shuffled.
    """
    one = _cuts(results, limit, overlap)
    return one.select("result_id", F.col("c.n").alias("n_events"), F.posexplode("c.cuts").alias("piece_no", "p")).select("result_id", "n_events", "piece_no", "p.*")


def piece_events(results: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``pieces`` with the events of each piece, from the very delivery that was cut (of equal ones, the largest list of events)."""
    one = _cuts(results, limit, overlap, "events").select("result_id", F.col("c.n").alias("n_events"), F.col("c.events").alias("_e"), F.posexplode("c.cuts").alias("piece_no", "p"))
    return one.select("result_id", "n_events", "piece_no", "p.*", F.slice("_e", F.col("p.start") + 1, F.col("p.stop") - F.col("p.start")).alias("events"))
