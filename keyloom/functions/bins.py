"""Time and knob bins as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The logarithmic time grid and the knob ranges.
TIME_BINS, MIN_MS, MAX_MS = 128, 1.0, 120_000.0
WPM_WIDTH, WPM_BINS, PCT_MAX = 5, 40, 30
REV_MIN, REV_MAX = 0.001, 0.30

#: The grid's limits and the geometric centre of each bin.
EDGES = [float(x) for x in np.geomspace(MIN_MS, MAX_MS, TIME_BINS + 1)]
CENTERS = [math.sqrt(a * b) for a, b in zip(EDGES, EDGES[1:])]
_REV_STEP = math.log(REV_MAX / REV_MIN) / (PCT_MAX - 1)


def _numbers(values: list[float]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def to_bin(ms: Column) -> Column:
    """Time bin 0..127 of a duration; out of range counts as the nearest limit, null stays null.

    The logarithm proposes a bin, and comparing with the two literal limits around it settles rounding at the edges.
    """
    edges = _numbers(EDGES)
    x = F.greatest(F.lit(MIN_MS), F.least(F.lit(MAX_MS), ms.cast("double")))
    near = F.least(F.lit(TIME_BINS - 1), F.floor(F.log(x) * (TIME_BINS / math.log(MAX_MS)))).cast("int")
    settled = F.when(x < F.get(edges, near), near - 1).when(x >= F.get(edges, near + 1), near + 1).otherwise(near)
    return F.when(ms.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(TIME_BINS - 1), settled)).cast("int"))


def from_bin(k: Column) -> Column:
    """Geometric centre of a time bin; null outside 0..127."""
    return F.get(_numbers(CENTERS), k.cast("int"))


def wpm_bin(wpm: Column) -> Column:
    return F.least(F.greatest(F.floor(wpm / WPM_WIDTH), F.lit(0)), F.lit(WPM_BINS - 1)).cast("int")


def pct_bin(rate: Column) -> Column:
    """Whole per cent, rounded half to even, at most 30."""
    return F.least(F.greatest(F.bround(rate * 100), F.lit(0)), F.lit(PCT_MAX)).cast("int")


def rev_bin(rate: Column) -> Column:
    """Geometric bin 1..30 of a revision rate, 0 for none."""
    within = F.greatest(F.lit(REV_MIN), F.least(F.lit(REV_MAX), rate))
    k = F.bround(F.log(within / REV_MIN) / _REV_STEP) + 1
    return F.when(rate <= 0, 0).otherwise(F.least(F.greatest(k, F.lit(1)), F.lit(PCT_MAX))).cast("int")


def rev_from_bin(k: Column) -> Column:
    return F.when(k <= 0, 0.0).otherwise(REV_MIN * F.exp(_REV_STEP * (F.least(k, F.lit(PCT_MAX)) - 1)))
