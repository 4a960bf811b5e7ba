"""Serial features beside the band that real sessions keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.codec import roundtrip
from keyloom.operators.timing import KEYS, SERIAL, SERIAL_NULL, serial_features


def _long(features: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(null).alias("null_value"), F.col(f).alias("value")) for f, null in zip(SERIAL, SERIAL_NULL)))
    return features.select(*keys, F.explode(each).alias("f")).select(*keys, "f.*")


def real_band(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(feature, p10, median, p90) over sessions brought onto the token grid, to four decimals."""
    long = _long(serial_features(roundtrip(events, keys), keys), keys)
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return long.groupBy("feature").agg(q.alias("q")).select("feature", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p10", "median", "p90"))))


def serial_readout(events: DataFrame, band: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, feature, null_value, value, p10, median, p90, in_band): nine rows a session. The band has nine rows and is broadcast."""
    long = _long(serial_features(events, keys), keys)
    joined = long.join(F.broadcast(band), "feature", "left")
    return joined.select(*keys, "feature", "null_value", F.round("value", 4).alias("value"), "p10", "median", "p90", F.col("value").between(F.col("p10"), F.col("p90")).alias("in_band"))


def control_readouts(events: DataFrame, targets: DataFrame, keys: tuple[str, ...] = KEYS, seed: int = 0) -> DataFrame:
    """``serial_readout`` with ``side``: the sessions as they are, typed evenly (``targets``: keys, target, wpm) and with shuffled timing, all on the token grid."""
    from keyloom.operators.controls import heuristic_baseline, shuffle_timing

    band = real_band(events, keys)
    columns = [*keys, "seq", "type", "press", "release", "ch"]
    made = {"sample": events, "heuristic": heuristic_baseline(targets, keys, seed=seed), "shuffled": shuffle_timing(events, keys, seed)}
    parts = [serial_readout(roundtrip(df.select(*columns), keys), band, keys).withColumn("side", F.lit(side)) for side, df in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
