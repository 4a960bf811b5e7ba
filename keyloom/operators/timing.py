"""Timing and serial-order features of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("writer", "session_id")
PAUSE_MS, P_BURST_MS = 1000.0, 2000.0
FEATURES = ("iki", "hold", "pause", "burst")
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
SERIAL = ("lag1", "lag2", "lag3", "von_neumann", "markov_excess", "local_spread", "drift", "hold_gap", "word_boundary")
#: Value of each serial feature when order carries nothing.
SERIAL_NULL = (0.0, 0.0, 0.0, 2.0, 0.0, 1.0, 0.0, 0.0, 0.0)


def with_gaps(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``events`` with ``iki``: time since the press before, null for a session's first event."""
    return events.withColumn("iki", F.col("press") - F.lag("press").over(W.partitionBy(*keys).orderBy("seq")))


def _with_bursts(events: DataFrame, pause_ms: float, keys: tuple[str, ...]) -> DataFrame:
    """``with_gaps`` and ``burst``: at the last event of each run without a pause longer than ``pause_ms`` the run's length, else null.

    A run starts where the largest row number so far that follows a pause lies, so one window sort does without a group per run.
    """
    order = W.partitionBy(*keys).orderBy("seq")
    gaps = with_gaps(events, keys).withColumn("_n", F.row_number().over(order))
    start = F.max(F.when(F.col("iki").isNull() | (F.col("iki") > pause_ms), F.col("_n"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    following = F.lead("iki").over(order)
    ends = following.isNull() | (following > pause_ms)
    return gaps.withColumn("burst", F.when(ends, F.col("_n") - start + 1).cast("double")).drop("_n")


def burst_lengths(events: DataFrame, pause_ms: float = PAUSE_MS, keys: tuple[str, ...] = KEYS, name: str = "burst") -> DataFrame:
    """(keys, feature, value): lengths of runs of events without a pause longer than ``pause_ms``, the last included."""
    return _with_bursts(events, pause_ms, keys).filter("burst is not null").select(*keys, F.lit(name).alias("feature"), F.col("burst").alias("value"))


def _timed(bursts: DataFrame, pause_ms: float) -> DataFrame:
    """``bursts`` (of ``_with_bursts``) with a column for each of FEATURES, null where an event has none."""
    return bursts.withColumns({"hold": F.col("release") - F.col("press"), "pause": F.when(F.col("iki") > pause_ms, F.col("iki"))})


def feature_pool(events: DataFrame, pause_ms: float = PAUSE_MS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, feature, value) of iki, hold, pause and burst; sessions never touch each other. One pass over the events."""
    each = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in FEATURES))
    return _timed(_with_bursts(events, pause_ms, keys), pause_ms).select(*keys, F.explode(each).alias("f")).select(*keys, "f.*").filter("value is not null")


def timing_profile(events: DataFrame) -> DataFrame:
    """Per writer: sessions, events, mean and median iki, share of pauses, bursts, share of rollovers (a key held past the next press)."""
    order = W.partitionBy(*KEYS).orderBy("seq")
    rows = with_gaps(events).withColumn("next", F.lead("press").over(order))
    paused = F.col("iki") > PAUSE_MS
    return rows.groupBy("writer").agg(
        F.countDistinct("session_id").alias("n_sessions"),
        F.count("*").alias("n_events"),
        F.round(F.avg("iki"), 6).alias("mean_iki"),
        F.round(F.percentile("iki", 0.5), 6).alias("median_iki"),
        F.round(F.coalesce(F.avg(paused.cast("double")), F.lit(0.0)), 6).alias("pause_share"),
        (F.count_if(paused) + F.countDistinct("session_id")).alias("n_bursts"),
        F.round(F.coalesce(F.avg(F.when(F.col("next").isNotNull(), (F.col("release") > F.col("next")).cast("double"))), F.lit(0.0)), 6).alias("rollover_share"),
    )


def iki_histogram(events: DataFrame, edges: tuple[float, ...] = (50, 100, 150, 200, 300, 500, 1000, 2000, 5000)) -> DataFrame:
    """(bucket, upper, n, share): press intervals by fixed limits; bucket i holds values below ``upper`` and not below the limit before."""
    bucket = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        bucket = F.when(F.col("iki") < e, i).otherwise(bucket)
    counted = with_gaps(events).filter("iki is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("bucket", F.get(F.array(*(F.lit(float(e)) for e in edges)), F.col("bucket")).alias("upper"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def iki_quantiles(events: DataFrame, points: tuple[float, ...] = (0.5, 0.9, 0.99, 0.999)) -> DataFrame:
    """One row of exact quantiles of all press intervals."""
    q = F.percentile("iki", F.array(*map(F.lit, points)))
    one = with_gaps(events).agg(q.alias("q"), F.count("iki").alias("n"))
    return one.select("n", *(F.round(F.col("q")[i], 6).alias(f"p{p * 100:g}".replace(".", "_")) for i, p in enumerate(points)))


def session_spread(events: DataFrame) -> DataFrame:
    """Spread between sessions: deviation of the sessions' mean and deviation of log intervals, mean number of events."""
    per = with_gaps(events).groupBy(*KEYS).agg(F.avg(F.log1p("iki")).alias("m"), F.stddev_pop(F.log1p("iki")).alias("s"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_sessions"), F.round(F.stddev_pop("m"), 6).alias("sd_of_means"), F.round(F.stddev_pop("s"), 6).alias("sd_of_sds"), F.round(F.avg("n"), 6).alias("mean_events"))


def _corr(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def _serial_rows(events: DataFrame, keys: tuple[str, ...], carried: tuple[str, ...] = ()) -> DataFrame:
    """What the serial features are aggregated from, a row an event: x_i = log1p of the interval after event i, n of them."""
    order = W.partitionBy(*keys).orderBy("seq")
    whole, block = W.partitionBy(*keys), W.partitionBy(*keys, "block")
    base = events.select(*keys, "seq", "press", "release", "ch", *carried).withColumns({"_next": F.lead("press").over(order), "i": F.row_number().over(order) - 1})
    # To the nanosecond: sums of bin centres would otherwise break ties with the median by their rounding. The last event has no x and keeps its session.
    gap = F.round(F.col("_next") - F.col("press"), 6)
    timed = F.col("_next").isNotNull()
    rows = base.withColumns({"x": F.when(timed, F.log1p(F.greatest(gap, F.lit(0.0)))), "h": F.when(timed & F.col("release").isNotNull(), F.log1p(F.greatest(F.col("release") - F.col("press"), F.lit(0.0)))), "block": F.floor(F.col("i") / 8)})
    rows = rows.withColumns({f"x{k}": F.lead("x", k).over(order) for k in (1, 2, 3)} | {"n": F.count("x").over(whole), "med": F.percentile("x", 0.5).over(whole), "bs": F.stddev_pop("x").over(block), "bc": F.count("x").over(block)})
    return rows.withColumns({"fast": F.col("x") <= F.col("med"), "next_fast": F.col("x1") <= F.col("med"), "half": F.col("i") < F.floor(F.col("n") / 2), "spaced": F.coalesce(F.col("ch") == " ", F.lit(False))})


def _serial_sums() -> list[Column]:
    return [
        F.first("n").alias("n"),
        F.stddev_pop("x").alias("sd"),
        *(_corr(F.col("x"), F.col(f"x{k}")).alias(f"r{k}") for k in (1, 2, 3)),
        F.avg(F.pow(F.col("x1") - F.col("x"), 2)).alias("msd"),
        F.count_if(F.col("fast") & F.col("next_fast")).alias("ff"),
        F.count_if(F.col("fast") & F.col("x1").isNotNull()).alias("f"),
        F.avg(F.col("fast").cast("double")).alias("pf"),
        F.avg(F.when(F.col("half"), F.col("x"))).alias("m1"),
        F.avg(F.when(~F.col("half"), F.col("x"))).alias("m2"),
        F.avg(F.when((F.col("i") % 8 == 7) & (F.col("bc") == 8), F.col("bs"))).alias("local_sd"),
        _corr(F.col("h"), F.col("x")).alias("rh"),
        F.count("h").alias("nh"),
        F.coalesce(F.stddev_pop("h"), F.lit(0.0)).alias("sh"),
        F.coalesce(F.stddev_pop(F.when(F.col("h").isNotNull(), F.col("x"))), F.lit(0.0)).alias("sxh"),
        F.avg(F.when(F.col("spaced"), F.col("x"))).alias("mw"),
        F.avg(F.when(~F.col("spaced"), F.col("x"))).alias("mo"),
        F.count_if(F.col("spaced") & F.col("x").isNotNull()).alias("nw"),
    ]


def _serial_values() -> list[Column]:
    """The nine SERIAL columns of the sums of a session."""
    n, sd = F.col("n"), F.col("sd")
    varied = sd > 1e-9
    either = lambda ok, value, null: F.coalesce(F.when(ok, value), F.lit(null))
    return [
        *(either((n > k + 2) & varied, F.col(f"r{k}"), 0.0).alias(f"lag{k}") for k in (1, 2, 3)),
        either((n > 3) & (sd * sd > 1e-12), F.col("msd") / F.nullif(sd * sd, F.lit(0.0)), 2.0).alias("von_neumann"),
        either(n > 4, F.col("ff") / F.greatest(F.col("f"), F.lit(1)) - F.col("pf"), 0.0).alias("markov_excess"),
        either((n >= 16) & varied, F.col("local_sd") / F.nullif(sd, F.lit(0.0)), 1.0).alias("local_spread"),
        either((n >= 8) & varied, F.abs(F.col("m1") - F.col("m2")) / F.nullif(sd, F.lit(0.0)), 0.0).alias("drift"),
        either((n > 3) & (F.col("nh") > 3) & (F.col("sh") > 1e-9) & (F.col("sxh") > 1e-9), F.col("rh"), 0.0).alias("hold_gap"),
        either((n > 3) & (F.col("nw") >= 1) & (n - F.col("nw") >= 3), F.col("mw") - F.col("mo"), 0.0).alias("word_boundary"),
    ]


def serial_features(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, the nine SERIAL columns): order-sensitive features of a session's log intervals; too short sessions get each feature's null value.

    One exchange by session, windows, one aggregate; no join.
    """
    return _serial_rows(events, keys).groupBy(*keys).agg(*_serial_sums()).select(*keys, *_serial_values())


def feature_vector(events: DataFrame, counts: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """41 named columns a session (37 without counts): per feature five log quantiles, mean, deviation and count, then the serial ones.

    The events are made, ordered and aggregated once for all of them.
    """
    named = _timed(_with_bursts(events, PAUSE_MS, keys), PAUSE_MS)
    rows = _serial_rows(named, keys, FEATURES)
    aggs = []
    for f in FEATURES:
        v = F.log1p(f)
        aggs += [F.percentile(v, F.array(*map(F.lit, QUANTILES))).alias(f"_{f}"), F.avg(v).alias(f"{f}_mean"), F.stddev_pop(v).alias(f"{f}_sd"), F.count(v).cast("double").alias(f"{f}_count")]
    wide = rows.groupBy(*keys).agg(*aggs, *_serial_sums())
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    columns = []
    for f in FEATURES:
        columns += [zero(F.get(F.col(f"_{f}"), F.lit(i))).alias(f"{f}_q{q * 100:g}") for i, q in enumerate(QUANTILES)]
        columns += [zero(F.col(f"{f}_mean")).alias(f"{f}_mean"), zero(F.col(f"{f}_sd")).alias(f"{f}_sd")]
        columns += [zero(F.col(f"{f}_count")).alias(f"{f}_count")] if counts else []
    return wide.select(*keys, *columns, *_serial_values())
