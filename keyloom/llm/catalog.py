"""Named queries of this subpackage and their SQL, where there is any."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import contamination, grouped_split, mojibake, packing, quantile_digest, quantile_sql, reading_level, splitting, structure_sql, visible_text
from keyloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that read like a stimulus but differ from it in their characters."""
    texts = visible_text.composed_texts(table(spark, d, "real_sessions"), table(spark, d, "composition_log"))
    return visible_text.match_stimuli(texts, table(spark, d, "stimuli")).filter("not exact").select("field", "record_id", "stimulus_id")


@query("p2_consistent")
def p2_consistent(spark: SparkSession, d: str) -> DataFrame:
    """All target texts and all texts of text_change, whatever the activity, in their consistent forms."""
    return visible_text.consistent_texts(visible_text.composed_texts(table(spark, d, "real_sessions"), table(spark, d, "composition_log"), None))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Garbled texts and the stimulus each stands for."""
    texts = mojibake.logged_texts(table(spark, d, "keystrokes"), table(spark, d, "composition_log"))
    return mojibake.garbled_texts(texts, table(spark, d, "stimuli"))


@query("p4_restored")
def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled texts with what they originally said."""
    texts = mojibake.logged_texts(table(spark, d, "keystrokes"), table(spark, d, "composition_log"))
    return mojibake.restored_texts(texts).filter("garbled").drop("garbled")


@query(
    "p5_found",
    """WITH e AS (SELECT result_id, list_filter(events, lambda x: x IS NOT NULL) AS e FROM generation_results WHERE events IS NOT NULL AND result_id IS NOT NULL),
    c AS (SELECT result_id, len(list_filter(e, lambda x, i: i = 1 OR x IS DISTINCT FROM e[i - 1])) AS n FROM e)
    SELECT DISTINCT result_id FROM c WHERE n > 512""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Results that need more than one piece."""
    return splitting.pieces(table(spark, d, "generation_results")).filter("piece_no = 0 and strength >= 0").select("result_id")


@query("p5_pieces", structure_sql.PIECES_SQL)
def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all results."""
    return splitting.pieces(table(spark, d, "generation_results"))


@query(
    "p6_found",
    r"""WITH RECURSIVE p AS (SELECT DISTINCT participant_id AS id, lower(regexp_replace(contact_code, '[^\p{L}\p{N}]', '', 'g')) AS code, previous_id FROM participants WHERE participant_id IS NOT NULL),
    w AS (SELECT session_id, list_transform(regexp_extract_all(regexp_replace(lower(writer), 'klicke[^0-9]*[0-9]+', ' ', 'g'), '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT)) AS w FROM real_sessions),
    x AS (SELECT session_id, unnest(w) AS id FROM w),
    l AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.previous_id = b.id
          UNION SELECT a.id, b.id FROM p a JOIN p b ON a.code = b.code AND regexp_matches(a.code, '\p{N}')
          UNION SELECT a.id, b.id FROM x a JOIN x b USING (session_id)),
    e AS (SELECT u, v FROM l WHERE u <> v UNION SELECT v, u FROM l WHERE u <> v),
    r(a, b) AS (SELECT u, v FROM e UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
    SELECT a AS participant_a, b AS participant_b FROM r WHERE a < b AND a IN (SELECT id FROM p) AND b IN (SELECT id FROM p)""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of participants that must share a split."""
    return grouped_split.linked_pairs(table(spark, d, "participants"), table(spark, d, "real_sessions"))


@query("p6_splits")
def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every participant, session and section."""
    return grouped_split.person_splits(table(spark, d, "keystrokes"), table(spark, d, "real_sessions"), table(spark, d, "participants"))


@query("p6_sides", ORACLE["p6_found"].replace("SELECT a AS participant_a, b AS participant_b FROM r", "SELECT a AS participant_a, b AS participant_b, TRUE AS same_side FROM r"))
def p6_sides(spark: SparkSession, d: str) -> DataFrame:
    """Whether the participants of each linked pair have got the same side."""
    people = p6_splits(spark, d).filter("kind = 'participant'")
    a, b = (people.select(F.col("record_id").alias(f"participant_{x}"), F.col("split").alias(f"_{x}")) for x in "ab")
    return p6_found(spark, d).join(a, "participant_a").join(b, "participant_b").select("participant_a", "participant_b", (F.col("_a") == F.col("_b")).alias("same_side"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("p7_percentiles", quantile_sql.PERCENTILES_SQL)
def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of gaps and holds per writer, day and key pair, with the certified rank error and the digest that merges with others."""
    return quantile_digest.named(quantile_digest.key_percentiles(table(spark, d, "key_events")))


@query("p7_pairs")
def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same per key pair, from the merged digests of all writers and days, certified against the values."""
    return quantile_digest.named(quantile_digest.pair_percentiles(table(spark, d, "key_events")))


@query("p7_certified", quantile_sql.CERTIFIED_SQL)
def p7_certified(spark: SparkSession, d: str) -> DataFrame:
    """The merged digests held against exact facts: counts, ends, and whether the certified error is within three merges' bound."""
    merged = quantile_digest.pair_percentiles(table(spark, d, "key_events"))
    digest, bound = F.col("digest"), F.lit(3 * math.pi / (2 * quantile_digest.SIZE)) + 1 / F.col("n")
    ends = F.get(digest, F.lit(0))["lo"].alias("least"), F.get(digest, F.size(digest) - 1)["hi"].alias("largest")
    return _rounded(merged.select("measure", "key_a", "key_b", "n", *ends, (F.col("rank_error") <= bound).alias("within")))


@query("p7_shards")
def p7_shards(spark: SparkSession, d: str) -> DataFrame:
    """Medians of log shards and days combined per key pair, with bounds."""
    return _rounded(quantile_digest.combined_medians(table(spark, d, "digraph_stats")))


@query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of one that exceeds the capacity."""
    return packing.pack_documents(table(spark, d, "documents"))


@query("p8_placed", structure_sql.PLACED_SQL)
def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document has been placed, and whether all its containers hold no more than the capacity."""
    packed = packing.pack_documents(table(spark, d, "documents"))
    held = packed.filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("held"))
    fits = F.coalesce(F.max("held") <= packing.CAPACITY, F.lit(True))
    return packed.join(held, "container", "left").groupBy("doc_id").agg((F.count("container") > 0).alias("placed"), fits.alias("fits"))


@query("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Number of containers by the tokens they hold."""
    used = packing.pack_documents(table(spark, d, "documents")).filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("tokens"))
    return used.groupBy("tokens").agg(F.count("*").alias("containers"))


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents holding at least 12 words of an evaluation item in a row."""
    found = contamination.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.filter(F.col("longest") >= contamination.PASSAGE).select("doc_id", "item_id")


@query("p9_leaks")
def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items that leaked into them, word by word or nearly so, and how much of each."""
    return _rounded(contamination.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")))


@query("p10_levels")
def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of every document."""
    documents = table(spark, d, "documents")
    return reading_level.reading_levels(documents, reading_level.fit(documents, table(spark, d, "reading_labels")))


@query("p10_profile")
def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens of text and mean level per source and whole level."""
    documents = table(spark, d, "documents")
    levels = reading_level.reading_levels(documents, reading_level.fit(documents, table(spark, d, "reading_labels")))
    source = F.regexp_replace(F.lower(F.trim("source")), r"[\s\-]+", "_").alias("source")
    joined = documents.select("doc_id", source, F.length("text").alias("chars")).join(levels, "doc_id")
    return joined.groupBy("source", F.floor("level").cast("int").alias("whole_level")).agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.round(F.avg("level"), 6).alias("mean_level"))
