"""How far sessions follow the labels they were asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.labels import RATES


def knob_fidelity(requested: DataFrame, realized: DataFrame, key: str) -> DataFrame:
    """(knob, n, r, mae) over pairs with equal ``key``: Pearson correlation (null below two pairs or for a constant side) and mean absolute error."""
    pairs = requested.select(key, *(F.col(k).alias(f"a_{k}") for k in RATES)).join(realized.select(key, *(F.col(k).alias(f"b_{k}") for k in RATES)), key)
    long = pairs.select(F.explode(F.array(*(F.struct(F.lit(k).alias("knob"), F.col(f"a_{k}").alias("a"), F.col(f"b_{k}").alias("b")) for k in RATES))).alias("p")).select("p.*").filter("a is not null and b is not null")
    constant = (F.max("a") == F.min("a")) | (F.max("b") == F.min("b"))
    r = F.covar_pop("a", "b") / F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))
    return long.groupBy("knob").agg(F.count("*").alias("n"), F.when((F.count("*") > 1) & ~constant, r).alias("r"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"))


def sweep_grid(base: DataFrame, wpm: list[float], ecor: list[float]) -> DataFrame:
    """Every label row of ``base`` at every given speed and correction rate; the other two labels stay. The grid is as large as its two lists."""
    spark = base.sparkSession
    grid = spark.createDataFrame([(float(w), float(e)) for w in wpm for e in ecor], "_w double, _e double")
    return base.crossJoin(F.broadcast(grid)).withColumns({"wpm": F.col("_w"), "corrected_error_rate": F.col("_e")}).drop("_w", "_e")
