"""Acceptance gates over metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The bands of the two evaluations.
TIER1 = {"teeth": (0.90, 1.0), "shuffle_teeth": (0.75, 1.0), "model": (0.40, 0.55), "validity": (0.90, 1.0), "control": (0.40, 0.60)}
TIER2 = {"convergence": (0.95, 1.0), "model": (0.40, 0.55), "shuffle_teeth": (0.75, 1.0), "control": (0.40, 0.60)}
LEAST_PAIRS, LEAST_SESSIONS = 5, 10


def apply_gates(metrics: DataFrame, bands: dict[str, tuple[float, float]], n: str, least: int) -> DataFrame:
    """``metrics`` (one row, one column a metric) with ``<metric>_ok`` and ``passed``; with fewer than ``least`` cases nothing passes. Missing metrics fail."""
    ok = {f"{m}_ok": F.coalesce(F.nanvl(F.col(m), F.lit(None)).between(lo, hi), F.lit(False)) for m, (lo, hi) in bands.items()}
    every = F.col(n) >= least
    for name in ok:
        every = every & F.col(name)
    return metrics.withColumns(ok).withColumn("passed", every)


def report_json(report: DataFrame) -> DataFrame:
    """(json): each row as a JSON object, NaN and infinities as null."""
    clean = []
    for name, kind in report.dtypes:
        c = F.col(f"`{name}`")
        finite = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) if kind in ("double", "float") else c
        clean.append(finite.alias(name))
    return report.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))
