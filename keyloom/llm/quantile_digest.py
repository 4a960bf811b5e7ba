"""Percentiles of very large numeric columns by mergeable centroid digests (problem 7)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.session import cut_lineage

#: Clusters of a digest. A cluster holds at most about pi / (2 * SIZE) of a group's values, fewer towards both ends.
SIZE = 200
PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
DAY_MS, HOUR_MS, GAP_MS = 86_400_000, 3_600_000, 1_800_000
EARLIEST_MS = 946_684_800_000
#: Values of a group in a chunk of time that make one partial digest; a chunk with more of them makes several.
BLOCK = 65_536
#: Groups of estimates that are broadcast to the values they are certified against (about 150 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 200_000
CENTROID = "struct<mean:double,w:bigint,lo:double,hi:double,before:bigint>"
LEAF = ("measure", "writer", "day", "key_a", "key_b")


def _centroid(mean: Column, w: Column, lo: Column, hi: Column, before: Column) -> Column:
    return F.struct(mean.cast("double").alias("mean"), w.cast("bigint").alias("w"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), before.cast("bigint").alias("before"))


def digest_of_sorted(values: str, size: int = SIZE) -> Column:
    """Digest of a sorted array column: up to ``size`` values singly, more in clusters that are widest at the median.

    The cluster limits follow the size function k(q) = size * (asin(2q - 1) / pi + 1/2), whose inverse gives the ranks.
    """
    v, n = F.col(values), F.size(values)
    single = F.transform(v, lambda x, i: _centroid(x, F.lit(1), x, x, i))
    edge = lambda k: F.round(n * (F.sin((k / F.lit(float(size)) - 0.5) * math.pi) + 1.0) / 2.0).cast("int")
    spans = F.filter(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.struct(edge(k).alias("a"), edge(k + 1).alias("b"))), lambda s: s["b"] > s["a"])

    def cluster(s: Column) -> Column:
        part = F.slice(v, s["a"] + 1, s["b"] - s["a"])
        return _centroid(F.aggregate(part, F.lit(0.0), lambda t, x: t + x) / (s["b"] - s["a"]), s["b"] - s["a"], F.get(v, s["a"]), F.get(v, s["b"] - 1), s["a"])

    return F.when(n <= size, single).otherwise(F.transform(spans, cluster))


def recluster(centroids: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """(keys, digest): centroids (keys, mean, w, lo, hi) sorted by mean and clustered again under the size function.

    Plain values are centroids of weight 1. Up to ``size`` values in all stay single. Sorting spills, so the number of
    centroids in a group is not limited by memory; the digest itself has at most ``size`` + 1 elements.
    """
    order = W.partitionBy(*keys).orderBy("mean", "lo", "hi", "w")
    whole = W.partitionBy(*keys)
    upto = F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("w").over(whole)
    q = (F.col("_upto") - F.col("w") / 2.0) / F.col("_n")
    k = F.when(F.col("_n") <= size, F.col("_i")).otherwise(F.floor(size * (F.asin(2.0 * q - 1.0) / math.pi + 0.5)))
    marked = centroids.select(*keys, "mean", "w", "lo", "hi", upto.alias("_upto"), total.alias("_n"), F.row_number().over(order).cast("bigint").alias("_i")).withColumn("_k", k)
    clusters = marked.groupBy(*keys, "_k").agg(
        (F.sum(F.col("mean") * F.col("w")) / F.sum("w")).alias("mean"), F.sum("w").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.col("_upto") - F.col("w")).alias("before")
    )
    element = F.struct("before", "mean", "w", "lo", "hi")
    gathered = clusters.groupBy(*keys).agg(F.sort_array(F.collect_list(element)).alias("d"))
    return gathered.select(*keys, F.transform("d", lambda c: _centroid(c["mean"], c["w"], c["lo"], c["hi"], c["before"])).alias("digest"))


def merge_digests(digests: DataFrame, keys: list[str], size: int = SIZE, parts: int = 64, spread: tuple[str, ...] = ()) -> DataFrame:
    """(keys, digest): all digests of a group merged into one by clustering their centroids again.

    A group is merged in ``parts`` first (by a hash of the digests and the columns ``spread``), so one that holds a third of all rows is spread;
    the second step sees at most ``parts`` * (``size`` + 1) centroids of a group. Null and empty digests add nothing.
    """
    part = F.pmod(F.xxhash64(*spread, "digest", "_at"), F.lit(parts)).cast("int")
    flat = digests.select("*", F.posexplode("digest").alias("_at", "c")).select(*keys, part.alias("_part"), "c.mean", "c.w", "c.lo", "c.hi")
    if parts > 1:
        flat = recluster(flat, [*keys, "_part"], size).select(*keys, F.explode("digest").alias("c")).select(*keys, "c.mean", "c.w", "c.lo", "c.hi")
    return recluster(flat, keys, size)


def merge_gathered(gathered: DataFrame, column: str, size: int = SIZE) -> DataFrame:
    """``gathered`` with ``digest`` in place of an array column of digests: their centroids sorted and clustered again under the size function, in one pass.

    For groups whose digests are few enough to lie in one row; ``merge_digests`` has no such bound.
    """
    kept = [c for c in gathered.columns if c != column]
    # One column after another, so that what is used often is worked out once.
    alone = F.size(column) == 1  # a digest alone is sorted and numbered as it is
    sums = gathered.select(*kept, alone.alias("_alone"), F.when(alone, F.get(column, F.lit(0))).otherwise(F.sort_array(F.flatten(F.col(column)))).alias("_every"))
    sums = sums.select(*kept, "_alone", "_every", F.aggregate("_every", F.lit(0).cast("bigint"), lambda t, c: t + c["w"]).alias("_n"))
    nothing = F.struct(F.array().cast(f"array<{CENTROID}>").alias("out"), F.lit(None).cast(CENTROID).alias("cur"), F.lit(-1).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("upto"))
    k_of = lambda upto, w: F.floor(size * (F.asin(2.0 * (upto + w / 2.0) / F.col("_n") - 1.0) / math.pi + 0.5))

    def add(a: Column, c: Column) -> Column:
        """The open cluster carries the sum of its values in place of the mean, and the number of its cluster."""
        more = F.struct(
            a["out"].alias("out"),
            _centroid(a["cur"]["mean"] + c["mean"] * c["w"], a["cur"]["w"] + c["w"], F.least(a["cur"]["lo"], c["lo"]), F.greatest(a["cur"]["hi"], c["hi"]), a["cur"]["before"]).alias("cur"),
            a["k"].alias("k"),
            (a["upto"] + c["w"]).alias("upto"),
        )
        fresh = F.struct(
            F.when(a["cur"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))).alias("out"),
            _centroid(c["mean"] * c["w"], c["w"], c["lo"], c["hi"], a["upto"]).alias("cur"),
            k_of(a["upto"], c["w"]).alias("k"),
            (a["upto"] + c["w"]).alias("upto"),
        )
        return F.when(k_of(a["upto"], c["w"]) == a["k"], more).otherwise(fresh)

    single = F.transform("_every", lambda c, i: _centroid(c["mean"], c["w"], c["lo"], c["hi"], i))
    finish = lambda a: F.transform(F.concat(a["out"], F.array(a["cur"])), lambda c: _centroid(c["mean"] / c["w"], c["w"], c["lo"], c["hi"], c["before"]))
    return sums.select(*kept, F.when(F.col("_alone") & (F.col("_n") <= size), F.col("_every")).when(F.col("_n") <= size, single).otherwise(F.aggregate("_every", nothing, add, finish)).alias("digest"))


def digest_text(digest: Column) -> Column:
    """A digest as text, to be stored and merged elsewhere: values in whole thousandths, and mean:weight:least:largest where one stands for several."""
    whole = lambda x: F.floor(x * 1000 + 0.5).cast("string")
    return F.array_join(F.transform(digest, lambda c: F.when(c["w"] == 1, whole(c["mean"])).otherwise(F.concat_ws(":", whole(c["mean"]), c["w"].cast("string"), whole(c["lo"]), whole(c["hi"])))), " ")


def digest_of_text(text: Column) -> Column:
    """The digest that ``digest_text`` wrote; null for null, empty for an empty text."""
    number = lambda parts, i, other: F.coalesce(F.get(parts, F.lit(i)).cast("double"), other)

    def centroid(x: Column) -> Column:
        parts = F.split(x, ":")
        mean = F.get(parts, F.lit(0)).cast("double") / 1000.0
        return _centroid(mean, number(parts, 1, F.lit(1.0)), number(parts, 2, mean * 1000.0) / 1000.0, number(parts, 3, mean * 1000.0) / 1000.0, F.lit(0))

    # ``before`` is counted again by a merge of the one digest.
    return F.when(text == "", F.array().cast(f"array<{CENTROID}>")).otherwise(F.transform(F.split(text, " "), centroid))


def digest_count(digest: Column) -> Column:
    """Number of values a digest stands for."""
    last = F.get(digest, F.size(digest) - 1)
    return F.coalesce(last["before"] + last["w"], F.lit(0))


def with_estimates(digests: DataFrame, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """``digests`` with ``n`` and ``estimates``, an array in the order of ``percentiles``.

    An estimate is linear between the middle ranks of the last centroid up to its rank and of the first beyond it, and the least and
    largest value at the ends. For single values that is the usual linear interpolation; an empty or null digest gives nulls.
    """
    middle = lambda c: f"({c}.before + ({c}.w - 1) / 2.0D)"
    estimate = f"""transform(array({", ".join(f"{p}D" for p in percentiles)}), p -> get(transform(array(size(filter(digest, c -> {middle("c")} <= p * (n - 1)))),
        i -> get(transform(array(named_struct('a', get(digest, i - 1), 'b', get(digest, i))),
            s -> get(transform(array(named_struct(
                'ra', coalesce({middle("s.a")}, 0D), 'va', coalesce(s.a.mean, s.b.lo), 'rb', coalesce({middle("s.b")}, CAST(n - 1 AS DOUBLE)), 'vb', coalesce(s.b.mean, s.a.hi))),
                x -> CASE WHEN x.rb > x.ra THEN x.va + (x.vb - x.va) * (p * (n - 1) - x.ra) / (x.rb - x.ra) ELSE x.va END), 0)), 0)), 0))"""
    return digests.withColumn("n", digest_count(F.col("digest"))).withColumn("estimates", F.expr(estimate))


def _rank_error(below: Column, upto: Column, n: Column, p: Column) -> Column:
    return F.greatest(F.lit(0.0), below / n - p, p - upto / n)


def _ranks_of(values: str, x: Column) -> tuple[Column, Column]:
    """How many of an array's values lie below x, and how many not above it."""
    return F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v <= x))


def certify(values: DataFrame, estimated: DataFrame, keys: list[str], percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """``estimated`` with ``rank_error``: the largest distance, over the percentiles, between p and the true ranks of its estimate.

    The second counting pass: values are counted by group and value before anything moves, then compared with their
    group's estimates. Ranks are exact, so the error is a certificate and not a forecast. ``estimated`` is written to the
    shared folder first, as it is read twice; up to BROADCAST_GROUPS groups of it go to the values, more are joined by a shuffle.
    """
    estimated = cut_lineage(estimated)
    sent = F.broadcast(estimated) if estimated.count() <= BROADCAST_GROUPS else estimated
    counted = values.groupBy(*keys, "value").agg(F.count("*").alias("c"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    pairs = counted.alias("c").join(sent.alias("e"), condition).select(*(F.col(f"e.{k}") for k in keys), "value", "c", "estimates")
    sums = []
    for i in range(len(percentiles)):
        x = F.col("estimates")[i]
        sums += [F.sum(F.when(F.col("value") < x, F.col("c")).otherwise(0)).alias(f"_b{i}"), F.sum(F.when(F.col("value") <= x, F.col("c")).otherwise(0)).alias(f"_u{i}")]
    ranks = pairs.groupBy(*keys).agg(F.sum("c").alias("_n"), *sums)
    worst = F.array_max(F.array(*(_rank_error(F.col(f"_b{i}"), F.col(f"_u{i}"), F.col("_n"), F.lit(p)) for i, p in enumerate(percentiles))))
    errors = ranks.select(*(F.col(k).alias(f"_{k}") for k in keys), worst.alias("rank_error"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return estimated.join(errors, condition, "left").drop(*(f"_{k}" for k in keys))


def _presses(events: DataFrame) -> DataFrame:
    """Usable events, once per event_id, with the fields timings need; hold is null unless release is a number not before press.

    If deliveries of one event_id disagree, the smallest (press, writer, ...) counts, as in the sessions of problem 1.
    """
    press, release = F.col("press_time").cast("double"), F.col("release_time").cast("double")
    usable = F.col("event_id").isNotNull() & (F.trim("writer") != "") & press.isNotNull() & ~F.isnan(press) & (press >= EARLIEST_MS) & (press < float("inf"))
    kind = F.lower(F.trim("event_type")) == "key"
    hold = F.when((release >= press) & ~F.isnan(release) & (release < float("inf")), release - press)
    rows = events.filter(usable).select("event_id", press.alias("press"), "writer", F.when(kind, F.col("key_char")).alias("char"), F.when(kind, hold).alias("hold"))
    one = rows.repartition("event_id").groupBy("event_id").agg(F.min(F.struct("press", "writer", "char", "hold")).alias("e"))
    return one.select("event_id", "e.*")


def key_timings(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """(writer, chunk, block, measure, day, key_a, key_b, value) of all gaps and holds; day counts from 1970-01-01, key_b is empty for holds.

    Time is cut into chunks of the longest gap, so the press before an event lies in its chunk or is the last one of the
    chunk before: each chunk is handed that one event, and gaps are worked out per writer and chunk. Longer gaps part two
    sessions and are no gaps in typing. ``block`` numbers a chunk's values in portions.
    """
    presses = _presses(events)
    own = presses.select("writer", F.floor(F.col("press") / GAP_MS).alias("chunk"), F.struct("press", "event_id", "char", "hold").alias("e"))
    carried = own.groupBy("writer", "chunk").agg(F.max("e").alias("e")).select("writer", (F.col("chunk") + 1).alias("chunk"), "e")
    rows = own.withColumn("own", F.lit(True)).unionByName(carried.withColumn("own", F.lit(False))).select("writer", "chunk", "e.*", "own")
    order = W.partitionBy("writer", "chunk").orderBy("press", "event_id")
    paired = rows.withColumns({"_p": F.lag("press").over(order), "_c": F.lag("char").over(order), "_i": F.row_number().over(order)}).filter("own")
    step = F.col("press") - F.col("_p")
    gap = F.when(F.col("char").isNotNull() & F.col("_c").isNotNull() & (step <= GAP_MS), step)
    long = F.array(
        F.struct(F.lit("gap").alias("measure"), F.col("_c").alias("key_a"), F.col("char").alias("key_b"), gap.alias("value")),
        F.struct(F.lit("hold").alias("measure"), F.col("char").alias("key_a"), F.lit("").alias("key_b"), F.when(F.col("char").isNotNull(), F.col("hold")).alias("value")),
    )
    day, portion = F.floor(F.col("chunk") * GAP_MS / DAY_MS).cast("int").alias("day"), F.floor(F.col("_i") / block).alias("block")
    return paired.select("writer", "chunk", portion, day, F.explode(long).alias("t")).select("writer", "chunk", "block", "day", "t.*").filter("value is not null")


def _sorted_parts(timings: DataFrame) -> DataFrame:
    """The values of each group in each chunk and block as one sorted array ``v``; no exchange, as chunks lie together."""
    return timings.groupBy("writer", "chunk", "block", "day", "measure", "key_a", "key_b").agg(F.sort_array(F.collect_list("value")).alias("v"))


def _unkeyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key_b", F.when(F.col("measure") == "gap", F.col("key_b")))


def key_percentiles(events: DataFrame, percentiles: tuple[float, ...] = PERCENTILES, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """(measure, writer, day, key_a, key_b, n, digest, estimates, rank_error) of each writer's day and key pair.

    measure is ``gap`` (press of key_a to the press of key_b right after it) or ``hold`` (key_a, no key_b).
    Chunks of half an hour are worked on apart, so a writer's day is spread over many tasks. Each chunk's values of a group are
    sorted and go once to the group's task, in arrays of at most ``block`` values; there every array becomes a digest, the digests
    are merged, and a second pass over the same arrays counts the ranks of the estimates. What a group's task holds at a time is
    one array and the digests: ``size`` + 1 centroids for each chunk of the day and each ``block`` values.
    Events that cannot be used (see ``_presses``) have no timing; an empty table gives no rows.
    """
    # Both passes read this exchange.
    parts = _sorted_parts(key_timings(events, block)).select(*LEAF, "v").repartition(*LEAF)
    gathered = parts.select(*LEAF, digest_of_sorted("v", size).alias("d")).groupBy(*LEAF).agg(F.collect_list("d").alias("d"))
    merged = with_estimates(merge_gathered(gathered, "d", size), percentiles)
    ranks = []
    for i in range(len(percentiles)):
        below, upto = _ranks_of("v", F.col("estimates")[i])
        ranks += [F.sum(below).alias(f"_b{i}"), F.sum(upto).alias(f"_u{i}")]
    counted = parts.join(merged, list(LEAF)).groupBy(*LEAF).agg(*(F.first(c).alias(f"_{c}") for c in ("n", "digest", "estimates")), *ranks)
    worst = F.array_max(F.array(*(_rank_error(F.col(f"_b{i}"), F.col(f"_u{i}"), F.col("_n"), F.lit(p)) for i, p in enumerate(percentiles))))
    return _unkeyed(counted.select(*LEAF, F.col("_n").alias("n"), F.col("_digest").alias("digest"), F.col("_estimates").alias("estimates"), worst.alias("rank_error")))


def pair_percentiles(events: DataFrame, percentiles: tuple[float, ...] = PERCENTILES, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """(measure, key_a, key_b, n, digest, estimates, rank_error) over all writers and days.

    The digests of all chunks are merged without regard to who typed; a pair that holds a third of all rows is merged in parts.
    """
    keys = ["measure", "key_a", "key_b"]
    timings = key_timings(events, block)
    leaf = _sorted_parts(timings).select(*keys, "writer", "chunk", digest_of_sorted("v", size).alias("digest"))
    merged = with_estimates(merge_digests(leaf, keys, size, spread=("writer", "chunk")), percentiles)
    return _unkeyed(certify(timings.select(*keys, "value"), merged, keys, percentiles))


def millionths(x: Column) -> Column:
    """A double rounded to six places in plain arithmetic; decimal rounding would cost more than the percentiles do."""
    return F.floor(x * 1_000_000.0 + 0.5) / 1_000_000.0


def named(estimated: DataFrame, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """The estimates and the rank error rounded to six places, the former as columns p10, p25 ... instead of an array, and the digest as text."""
    named_columns = [millionths(F.col("estimates")[i]).alias("p" + f"{p * 100:g}".replace(".", "_")) for i, p in enumerate(percentiles)]
    made = {"digest": digest_text(F.col("digest")), "rank_error": millionths(F.col("rank_error"))}
    return estimated.select(*(made.get(c, F.col(c)).alias(c) for c in estimated.columns if c != "estimates"), *named_columns)


def repaired_medians(stats: DataFrame) -> DataFrame:
    """digraph_stats once per (stat_day, shard, key_a, key_b), with ``median`` in ms or null where none can be trusted.

    A median within a factor of 10 of the geometric mean is taken as it is. Otherwise a power of 1,000 that brings it
    there is undone (seconds or microseconds), and a sign that a positive median cannot have is dropped.
    """
    one = stats.groupBy("stat_day", "shard", "key_a", "key_b").agg(F.max("n").alias("n"), F.max("geo_mean_ms").alias("geo"), F.max("median_ms").alias("m"))
    size = F.abs("m")
    power = F.round(F.log(F.col("geo") / F.nullif(size, F.lit(0.0))) / math.log(1000.0))
    fixed = size * F.pow(F.lit(1000.0), power)
    sound = (F.col("geo") > 0) & (F.abs(F.log(fixed / F.col("geo"))) <= math.log(10.0)) & (F.abs(power) <= 2)
    return one.filter("n > 0").select("stat_day", "shard", "key_a", "key_b", "n", F.col("geo").alias("geo_mean_ms"), F.when(sound, fixed).alias("median"))


def combined_medians(stats: DataFrame) -> DataFrame:
    """(key_a, key_b, n, n_unknown, median, lowest, highest, rank_low, rank_high): medians of shards and days combined.

    Each shard's median is a centroid of the weight n. The combined median lies between ``lowest`` and ``highest``;
    ``rank_low`` and ``rank_high`` bound the true rank of ``median``, since half of a shard lies on either side of its
    own. Values of shards without a usable median (``n_unknown``) could lie anywhere and widen the bounds.
    """
    shards = repaired_medians(stats)
    keys = ["key_a", "key_b"]
    known = shards.filter("median is not null")
    order = W.partitionBy(*keys).orderBy("median")
    middle = known.select(*keys, "median", "n", F.sum("n").over(order).alias("upto"), F.sum("n").over(W.partitionBy(*keys)).alias("total"))
    picked = middle.filter("2 * upto >= total").groupBy(*keys).agg(F.min("median").alias("median"))
    totals = shards.groupBy(*keys).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("median").isNull(), F.col("n"))), F.lit(0)).alias("n_unknown"), F.min("median").alias("lowest"), F.max("median").alias("highest"))
    at = known.join(picked.withColumnRenamed("median", "pick"), keys)
    halves = at.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("median") <= F.col("pick"), F.col("n") / 2)), F.lit(0.0)).alias("low"),
        F.coalesce(F.sum(F.when(F.col("median") >= F.col("pick"), F.col("n") / 2)), F.lit(0.0)).alias("high"),
    )
    out = totals.join(picked, keys, "left").join(halves, keys, "left")
    return out.select(*keys, "n", "n_unknown", "median", "lowest", "highest", (F.col("low") / F.col("n")).alias("rank_low"), (1.0 - F.col("high") / F.col("n")).alias("rank_high"))
