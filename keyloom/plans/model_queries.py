"""Queries that train classifiers or run streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import classify, codec, compare, controls, gates, timing
from keyloom.operators.timing import FEATURES, KEYS, QUANTILES, SERIAL
from keyloom.plans.array_queries import validity
from keyloom.plans.catalog import query
from keyloom.plans.session_queries import rounded, typed
from keyloom.session import cut_lineage, shared_folder, table

COLUMNS = [c for f in FEATURES for c in (*(f"{f}_q{q * 100:g}" for q in QUANTILES), f"{f}_mean", f"{f}_sd", f"{f}_count")] + list(SERIAL)


def _features(events: DataFrame, label: int) -> DataFrame:
    """Feature vectors of sessions brought onto the token grid, as either side must be."""
    return timing.feature_vector(codec.roundtrip(events)).withColumn("label", F.lit(label))


def _real_and_shuffled(spark: SparkSession, d: str) -> DataFrame:
    events = typed(spark, d)
    # Each row is one session, read again for every fold: the table is written once.
    return cut_lineage(_features(events, 1).unionByName(_features(controls.shuffle_timing(events), 0)))


@query("discriminator_cv")
def discriminator_cv(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy per writer-grouped fold of telling sessions from their shuffled timing."""
    return rounded(classify.discriminator_cv(_real_and_shuffled(spark, d), COLUMNS, ["writer"]))


@query("feature_importances")
def feature_importances(spark: SparkSession, d: str) -> DataFrame:
    """The features by which the same classifier decides."""
    rows = _real_and_shuffled(spark, d)
    return spark.createDataFrame(classify.importances(classify.fit_discriminator(rows, COLUMNS), COLUMNS), "feature string, importance double")


@query("best_candidates")
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Of each section's session and its shuffled twin the one that looks real."""
    rows = _real_and_shuffled(spark, d)
    best = classify.best_candidates(rows, COLUMNS, classify.fit_discriminator(rows, COLUMNS), "session_id")
    return rounded(best.select("session_id", "writer", "label", "p_real"))


@query("writer_identification")
def writer_identification(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy per fold of naming the writer of a session."""
    return rounded(classify.writer_identification(cut_lineage(_features(typed(spark, d), 1)), COLUMNS))


@query("codec_ceiling")
def codec_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy per fold of telling sessions from their own round trip through the token grid."""
    events = typed(spark, d)
    rows = cut_lineage(timing.feature_vector(events).withColumn("label", F.lit(1)).unionByName(_features(events, 0)))
    return rounded(classify.discriminator_cv(rows, COLUMNS, ["writer"]))


@query("real_vs_real")
def real_vs_real(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy per fold of telling one half of the sessions from the other, which should be chance."""
    rows = cut_lineage(controls.halves(timing.feature_vector(codec.roundtrip(typed(spark, d)))))
    return rounded(classify.discriminator_cv(rows, COLUMNS, ["writer"]))


def _gate_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is told apart: sessions from even typing of their targets, from their shuffled timing, and from those shuffled ones that look most real."""
    events, both = typed(spark, d), _real_and_shuffled(spark, d)
    real = both.filter("label = 1")
    targets = events.groupBy(*KEYS).agg(F.first("target").alias("target")).filter("target is not null").withColumn("wpm", F.lit(50.0))
    even = cut_lineage(real.unionByName(_features(controls.heuristic_baseline(targets), 0), allowMissingColumns=True))
    best = classify.best_candidates(both.filter("label = 0"), COLUMNS, classify.fit_discriminator(both, COLUMNS), "writer").select(*real.columns)
    return even, both, cut_lineage(real.join(best.select(*KEYS), list(KEYS), "left_semi").unionByName(best))


@query("tier1_gates")
def tier1_gates(spark: SparkSession, d: str) -> DataFrame:
    """The gates over what can be measured here.

    The even-typing heuristic is the crude fake that must be told apart (teeth), shuffled sessions the subtle one (shuffle_teeth); in place of a
    model's output stand each writer's shuffled session that the classifier takes for the most real (model). Validity is that of the generated results.
    """
    mean = lambda rows, name: classify.discriminator_cv(rows, COLUMNS, ["writer"]).agg(F.avg("accuracy").alias(name), F.sum("n").alias(f"_{name}"))
    even, both, best = _gate_sides(spark, d)
    metrics = mean(even, "teeth").crossJoin(mean(both, "shuffle_teeth")).crossJoin(mean(best, "model"))
    metrics = metrics.crossJoin(validity(spark, d).agg(F.avg(F.col("valid").cast("double")).alias("validity"))).crossJoin(mean(controls.halves(both, KEYS, 0, 1), "control").drop("_control"))
    metrics = metrics.select("teeth", "shuffle_teeth", "model", "validity", "control", F.col("_shuffle_teeth").alias("n"))
    return rounded(gates.apply_gates(metrics, gates.TIER1, "n", gates.LEAST_PAIRS))


@query("shuffle_diagnostic")
def shuffle_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    """Mean lag-1 correlation before and after shuffling, and sessions whose burst statistics the shuffle changes."""
    rows = _real_and_shuffled(spark, d)
    bursts = [c for c in COLUMNS if c.startswith("burst") and not c.endswith("count")]
    a = rows.filter("label = 1").select(*KEYS, "lag1", *bursts)
    b = rows.filter("label = 0").select(*KEYS, F.col("lag1").alias("_lag1"), *(F.col(c).alias(f"_{c}") for c in bursts))
    moved = F.lit(False)
    for c in bursts:
        moved = moved | (F.abs(F.col(c) - F.col(f"_{c}")) > 1e-8 + 1e-5 * F.abs(F.col(f"_{c}")))
    one = a.join(b, list(KEYS)).agg(F.count("*").alias("n"), F.avg("lag1").alias("lag1_real"), F.avg("_lag1").alias("lag1_shuffled"), F.avg(moved.cast("double")).alias("share_changed"))
    return rounded(one)


@query("compare_shuffled")
def compare_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """Distances between sessions and the same sessions with shuffled timing, per timing feature."""
    events = typed(spark, d)
    return rounded(compare.compare_pools(compare.sides(timing.feature_pool(events), timing.feature_pool(controls.shuffle_timing(events)))))


@query("streaming_sessions")
def streaming_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the key events read as a stream, to the end of what is there."""
    from keyloom.streaming.activity import streaming_sessions as sessions

    source = spark.readStream.schema(table(spark, d, "key_events").schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    base = shared_folder(spark)
    from uuid import uuid4

    place = f"{base.rstrip('/')}/stream-{uuid4().hex}"
    # A file source takes a folder: the table's own, or the folder that holds its one file.
    path = f"{d}/key_events.parquet"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    stream = source.option("pathGlobFilter", "key_events.parquet").load(d) if single else source.load(path)
    run = sessions(stream).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("writer string, session_start timestamp, session_end timestamp, n_events long").parquet(f"{place}/out")
