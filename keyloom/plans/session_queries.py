"""Queries over the transcription log's sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions import bins
from keyloom.operators import annotated, codec, compare, controls, export, geometry, heldout, readout, selection, signatures, timing, transcription, writer_split
from keyloom.operators.timing import KEYS
from keyloom.plans.catalog import query
from keyloom.plans.sql import ESCAPED, EVENTS, bin_of, center_of, share
from keyloom.session import table


def typed(spark: SparkSession, d: str) -> DataFrame:
    """Events of all sessions whose letters are all logged."""
    return transcription.parse_transcription(table(spark, d, "keystrokes")).filter("not unlogged").drop("unlogged")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(
    "timing_profile",
    f"""WITH {EVENTS} SELECT writer, count(DISTINCT session_id) AS n_sessions, count(*) AS n_events, round(avg(iki), 6) AS mean_iki, round(quantile_cont(iki, 0.5), 6) AS median_iki,
    round(coalesce(avg(CASE WHEN iki > 1000 THEN 1.0 WHEN iki IS NOT NULL THEN 0.0 END), 0.0), 6) AS pause_share, count(*) FILTER (iki > 1000) + count(DISTINCT session_id) AS n_bursts,
    round(coalesce(avg(CASE WHEN next IS NOT NULL THEN CAST(release > next AS INTEGER) END), 0.0), 6) AS rollover_share FROM i GROUP BY writer""",
)
def timing_profile(spark: SparkSession, d: str) -> DataFrame:
    return timing.timing_profile(typed(spark, d))


_POOL = f"""WITH {EVENTS}, isl AS (SELECT writer, session_id, sum(CASE WHEN iki > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY writer, session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM i),
    pool AS (SELECT writer, session_id, 'iki' AS feature, iki AS value FROM i WHERE iki IS NOT NULL UNION ALL SELECT writer, session_id, 'hold', release - press FROM i
    UNION ALL SELECT writer, session_id, 'pause', iki FROM i WHERE iki > 1000 UNION ALL SELECT writer, session_id, 'burst', count(*)::DOUBLE FROM isl GROUP BY writer, session_id, g)"""


@query("feature_pool", f"{_POOL} SELECT * FROM pool")
def feature_pool(spark: SparkSession, d: str) -> DataFrame:
    return timing.feature_pool(typed(spark, d))


@query(
    "iki_histogram",
    f"""WITH {EVENTS}, b AS (SELECT len(list_filter([50, 100, 150, 200, 300, 500, 1000, 2000, 5000], lambda q: q <= iki)) AS bucket FROM i WHERE iki IS NOT NULL)
    SELECT bucket::INTEGER AS bucket, ([50.0, 100, 150, 200, 300, 500, 1000, 2000, 5000]::DOUBLE[])[bucket + 1] AS upper, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM b GROUP BY bucket""",
)
def iki_histogram(spark: SparkSession, d: str) -> DataFrame:
    return timing.iki_histogram(typed(spark, d))


@query("iki_quantiles", f"WITH {EVENTS} SELECT count(iki) AS n, round(quantile_cont(iki, 0.5), 6) AS p50, round(quantile_cont(iki, 0.9), 6) AS p90, round(quantile_cont(iki, 0.99), 6) AS p99, round(quantile_cont(iki, 0.999), 6) AS p99_9 FROM i")
def iki_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return timing.iki_quantiles(typed(spark, d))


@query(
    "session_spread",
    f"""WITH {EVENTS}, p AS (SELECT avg(ln(1 + iki)) AS m, stddev_pop(ln(1 + iki)) AS s, count(*) AS n FROM i GROUP BY writer, session_id)
    SELECT count(*) AS n_sessions, round(stddev_pop(m), 6) AS sd_of_means, round(stddev_pop(s), 6) AS sd_of_sds, round(avg(n), 6) AS mean_events FROM p""",
)
def session_spread(spark: SparkSession, d: str) -> DataFrame:
    return timing.session_spread(typed(spark, d))


@query(
    "p_burst_lengths",
    f"""WITH {EVENTS}, isl AS (SELECT writer, session_id, sum(CASE WHEN iki > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY writer, session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM i)
    SELECT writer, session_id, 'p_burst' AS feature, count(*)::DOUBLE AS value FROM isl GROUP BY writer, session_id, g""",
)
def p_burst_lengths(spark: SparkSession, d: str) -> DataFrame:
    return timing.burst_lengths(typed(spark, d), timing.P_BURST_MS, name="p_burst")


@query("time_bins", f"WITH {EVENTS} SELECT {bin_of('iki')} AS gap_bin, {bin_of('(release - press)')} AS hold_bin, count(*) AS n FROM i GROUP BY ALL")
def time_bins(spark: SparkSession, d: str) -> DataFrame:
    binned = timing.with_gaps(typed(spark, d)).select(bins.to_bin(F.col("iki")).alias("gap_bin"), bins.to_bin(F.col("release") - F.col("press")).alias("hold_bin"))
    return binned.groupBy("gap_bin", "hold_bin").agg(F.count("*").alias("n"))


@query("bin_centers", f"SELECT k::INTEGER AS k, round({center_of('k')}, 6) AS center_ms, {bin_of(center_of('k'))} AS back FROM range(128) t(k)")
def bin_centers(spark: SparkSession, d: str) -> DataFrame:
    center = bins.from_bin(F.col("k"))
    return spark.range(bins.TIME_BINS).select(F.col("id").cast("int").alias("k")).select("k", F.round(center, 6).alias("center_ms"), bins.to_bin(center).alias("back"))


@query(
    "rollover_rate",
    f"""WITH {EVENTS} SELECT writer, count(next) AS n, round(avg(CASE WHEN next IS NOT NULL THEN CAST({bin_of('(release - press)')} > {bin_of('(next - press)')} AS INTEGER) END), 6) AS share
    FROM i GROUP BY writer""",
)
def rollover_rate(spark: SparkSession, d: str) -> DataFrame:
    return codec.rollovers(typed(spark, d)).groupBy("writer").agg(F.count("rollover").alias("n"), F.round(F.avg(F.col("rollover").cast("double")), 6).alias("share"))


_ROUND = f"""WITH {EVENTS}, b AS (SELECT writer, session_id, seq, type, ch, {bin_of('iki')} AS g, {bin_of('(release - press)')} AS h FROM i),
    c AS (SELECT writer, session_id, seq, type, ch, g, h, sum(coalesce({center_of('g')}, 0.0)) OVER (PARTITION BY writer, session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS press FROM b)"""


@query("codec_roundtrip", f"{_ROUND} SELECT writer, session_id, seq, round(press, 6) AS press, round(press + {center_of('h')}, 6) AS release FROM c")
def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return rounded(codec.roundtrip(typed(spark, d)).select(*KEYS, F.col("seq").cast("long").alias("seq"), "press", "release"))


_STREAM = f"""{_ROUND}, s AS (SELECT writer, session_id, string_agg(CASE WHEN g IS NULL THEN '' ELSE '<DT:' || g || '>' END || CASE WHEN type = 'bksp' THEN '<BKSP:' ELSE '<' || {ESCAPED} || ':' END || h || '>', '' ORDER BY seq) AS stream FROM c GROUP BY writer, session_id)"""


def _streams(spark: SparkSession, d: str) -> DataFrame:
    return transcription.sessions_of(typed(spark, d)).select(*KEYS, codec.serialize("events").alias("stream"))


@query("token_stream", f"{_STREAM} SELECT * FROM s")
def token_stream(spark: SparkSession, d: str) -> DataFrame:
    return _streams(spark, d)


@query("token_parse", f"{_ROUND} SELECT session_id, seq, type, round(press, 6) AS press, round(press + {center_of('h')}, 6) AS release, ch FROM c")
def token_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = codec.parse_tokens(_streams(spark, d), "session_id", "stream")
    return rounded(parsed.select("session_id", F.col("seq").cast("long").alias("seq"), "type", "press", "release", "ch"))


@query(
    "grammar_errors",
    f"""{_STREAM}, cut AS (SELECT session_id, left(stream, length(stream) * 2 // 3) AS t FROM s)
    SELECT session_id, CASE WHEN right(t, 1) <> '>' THEN 'stray_text' WHEN regexp_matches(t, '<DT:[0-9]+>$') THEN 'dangling_gap' END AS error FROM cut""",
)
def grammar_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with streams cut off at two thirds."""
    cut = _streams(spark, d).select("session_id", F.left("stream", F.floor(F.length("stream") * 2 / 3).cast("int")).alias("t"))
    return codec.grammar_errors(cut, "session_id", "t")


@query(
    "sound_prefix",
    f"""{_STREAM}, cut AS (SELECT session_id, left(stream, length(stream) * 2 // 3) AS t FROM s)
    SELECT session_id, regexp_extract(t, '^(((<DT:[0-9]+>)?<([A-Z]+|[^<>]):[0-9]+>)((<DT:[0-9]+>)<([A-Z]+|[^<>]):[0-9]+>)*)', 1) AS kept FROM cut""",
)
def sound_prefix(spark: SparkSession, d: str) -> DataFrame:
    cut = _streams(spark, d).select("session_id", F.left("stream", F.floor(F.length("stream") * 2 / 3).cast("int")).alias("t"))
    return cut.select("session_id", codec.sound_prefix(F.col("t")).alias("kept"))


@query("vocabulary", """WITH n AS (SELECT unnest([chr(c::INTEGER) FOR c IN range(32, 127) IF chr(c::INTEGER) NOT IN (' ', '<', '>')] || ['SPC', 'NL', 'TAB', 'LT', 'GT', 'BKSP']) AS n)
    SELECT '<' || n || ':' || k || '>' AS token FROM n, range(128) t(k) UNION ALL SELECT '<DT:' || k || '>' FROM range(128) t(k) UNION ALL SELECT '<WPM:' || k || '>' FROM range(40) t(k)
    UNION ALL SELECT '<' || x || ':' || k || '>' FROM (VALUES ('ECOR'), ('EUNC'), ('REV')) v(x), range(31) t(k)
    UNION ALL SELECT unnest(['<CUR:', '<SELDEL:', '<MODE:T>', '<MODE:C>', '<TARGET>', '<WRITTEN>', '<PROCESS>'])""")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return codec.vocabulary(spark)


@query("verified_sessions")
def verified_sessions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(transcription.verified_sessions(table(spark, d, "keystrokes")).select(*KEYS, "produced", "similarity", "reason"))


@query("rejects_by_reason")
def rejects_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return transcription.verified_sessions(table(spark, d, "keystrokes")).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("unsupported_sessions", f"WITH {EVENTS} SELECT writer, session_id, bool_or(type = 'key' AND NOT regexp_full_match(ch, '[\\n\\t\\x20-\\x7E]'))::INTEGER AS refused FROM e GROUP BY ALL")
def unsupported_sessions(spark: SparkSession, d: str) -> DataFrame:
    return transcription.sessions_of(typed(spark, d)).select(*KEYS, (~codec.supported(F.col("events"))).cast("int").alias("refused"))


@query("physical_keyboards", "SELECT DISTINCT participant_id FROM participants WHERE lower(trim(keyboard_type)) IN ('full', 'laptop')")
def physical_keyboards(spark: SparkSession, d: str) -> DataFrame:
    return transcription.physical_keyboard_writers(table(spark, d, "participants"))


@query("physical_sessions", f"WITH {EVENTS} SELECT DISTINCT writer, session_id FROM e WHERE writer IN (SELECT participant_id FROM participants WHERE lower(trim(keyboard_type)) IN ('full', 'laptop'))")
def physical_sessions(spark: SparkSession, d: str) -> DataFrame:
    writers = transcription.physical_keyboard_writers(table(spark, d, "participants")).withColumnRenamed("participant_id", "writer")
    return typed(spark, d).join(writers, "writer", "left_semi").select(*KEYS).distinct()


# Revision and mix.
@query("revision_ops", f"WITH {EVENTS} SELECT writer, session_id, round(count(*) FILTER (type = 'bksp') / count(*), 6) AS bksp_frac, 0::BIGINT AS cursor_count, 0::BIGINT AS seldel_count FROM e GROUP BY ALL")
def revision_ops(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signatures.revision_ops(typed(spark, d), KEYS))


@query(
    "revision_episodes",
    f"""WITH {EVENTS}, b AS (SELECT writer, session_id, seq - row_number() OVER (PARTITION BY writer, session_id ORDER BY seq) AS g FROM e WHERE type = 'bksp')
    SELECT writer, session_id, 'revision_episode_lengths' AS feature, count(*)::DOUBLE AS value FROM b GROUP BY writer, session_id, g""",
)
def revision_episodes(spark: SparkSession, d: str) -> DataFrame:
    return signatures.revision_episodes(typed(spark, d), KEYS)


@query("event_mix", f"WITH {EVENTS}, c AS (SELECT writer, session_id, type, count(*) AS n FROM e GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY writer, session_id), 6) AS share FROM c")
def event_mix(spark: SparkSession, d: str) -> DataFrame:
    return signatures.event_mix(typed(spark, d), KEYS)


@query("pause_fraction", f"WITH {EVENTS} SELECT writer, session_id, round(coalesce(avg(CASE WHEN iki IS NOT NULL THEN CAST(iki > 1000 AS INTEGER) END), 0.0), 4) AS pause_fraction FROM i GROUP BY ALL")
def pause_fraction(spark: SparkSession, d: str) -> DataFrame:
    return signatures.pause_fraction(typed(spark, d), KEYS)


# Serial order.
def _serial_sql(source: str) -> str:
    """All nine features of sessions in ``source`` (writer, session_id, seq, press, release, ch)."""
    corr = lambda a, b: f"(covar_pop({a}, {b}) / nullif(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0))"
    return f"""
    q0 AS (SELECT writer, session_id, seq, ch, release - press AS hold, round(lead(press) OVER w - press, 6) AS gap, row_number() OVER w - 1 AS n0 FROM {source} WINDOW w AS (PARTITION BY writer, session_id ORDER BY seq)),
    q1 AS (SELECT *, ln(1 + greatest(gap, 0)) AS x, ln(1 + greatest(hold, 0)) AS h FROM q0 WHERE gap IS NOT NULL),
    q2 AS (SELECT *, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2, lead(x, 3) OVER w AS x3, count(*) OVER s AS n, quantile_cont(x, 0.5) OVER s AS med FROM q1
           WINDOW w AS (PARTITION BY writer, session_id ORDER BY seq), s AS (PARTITION BY writer, session_id)),
    q3 AS (SELECT writer, session_id, n0 // 8 AS blk, stddev_pop(x) AS sd, count(*) AS c FROM q2 GROUP BY ALL),
    q4 AS (SELECT writer, session_id, avg(sd) FILTER (c = 8) AS loc FROM q3 GROUP BY ALL),
    q5 AS (SELECT writer, session_id, any_value(n) AS n, stddev_pop(x) AS sd, {corr('x', 'x1')} AS r1, {corr('x', 'x2')} AS r2, {corr('x', 'x3')} AS r3, avg((x1 - x) ** 2) AS msd,
           count(*) FILTER (x <= med AND x1 <= med) AS ff, count(*) FILTER (x <= med AND x1 IS NOT NULL) AS f, avg(CAST(x <= med AS INTEGER)) AS pf,
           avg(x) FILTER (n0 < n // 2) AS m1, avg(x) FILTER (n0 >= n // 2) AS m2, {corr('h', 'x')} AS rh, count(h) AS nh, coalesce(stddev_pop(h), 0) AS sh,
           avg(x) FILTER (coalesce(ch, '') = ' ') AS mw, avg(x) FILTER (coalesce(ch, '') <> ' ') AS mo, count(*) FILTER (ch = ' ') AS nw FROM q2 GROUP BY ALL),
    serial AS (SELECT k.writer, k.session_id, coalesce(CASE WHEN n > 3 AND sd > 1e-9 THEN r1 END, 0.0) AS lag1, coalesce(CASE WHEN n > 4 AND sd > 1e-9 THEN r2 END, 0.0) AS lag2,
           coalesce(CASE WHEN n > 5 AND sd > 1e-9 THEN r3 END, 0.0) AS lag3, coalesce(CASE WHEN n > 3 AND sd * sd > 1e-12 THEN msd / (sd * sd) END, 2.0) AS von_neumann,
           coalesce(CASE WHEN n > 4 THEN ff / greatest(f, 1) - pf END, 0.0) AS markov_excess, coalesce(CASE WHEN n >= 16 AND sd > 1e-9 THEN loc / sd END, 1.0) AS local_spread,
           coalesce(CASE WHEN n >= 8 AND sd > 1e-9 THEN abs(m1 - m2) / sd END, 0.0) AS drift, coalesce(CASE WHEN n > 3 AND nh > 3 AND sh > 1e-9 AND sd > 1e-9 THEN rh END, 0.0) AS hold_gap,
           coalesce(CASE WHEN n > 3 AND nw >= 1 AND n - nw >= 3 THEN mw - mo END, 0.0) AS word_boundary
           FROM (SELECT DISTINCT writer, session_id FROM {source}) k LEFT JOIN q5 USING (writer, session_id) LEFT JOIN q4 USING (writer, session_id))"""


_SERIAL_COLUMNS = ", ".join(f"round({c}, 6) AS {c}" for c in timing.SERIAL)


@query("serial_features", f"WITH {EVENTS}, {_serial_sql('e')} SELECT writer, session_id, {_SERIAL_COLUMNS} FROM serial")
def serial_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(timing.serial_features(typed(spark, d)))


def _vector_sql() -> str:
    columns = []
    for f in timing.FEATURES:
        x = f"ln(1 + value) FILTER (feature = '{f}')"
        columns += [f"round(coalesce(quantile_cont(CASE WHEN feature = '{f}' THEN ln(1 + value) END, {q}), 0.0), 6) AS {f}_q{q * 100:g}" for q in timing.QUANTILES]
        columns += [f"round(coalesce(avg(CASE WHEN feature = '{f}' THEN ln(1 + value) END), 0.0), 6) AS {f}_mean", f"round(coalesce(stddev_pop(CASE WHEN feature = '{f}' THEN ln(1 + value) END), 0.0), 6) AS {f}_sd", f"count(*) FILTER (feature = '{f}')::DOUBLE AS {f}_count"]
        del x
    return f"{_POOL}, {_serial_sql('e')}, vec AS (SELECT writer, session_id, {', '.join(columns)} FROM pool GROUP BY ALL) SELECT vec.*, {_SERIAL_COLUMNS} FROM vec JOIN serial USING (writer, session_id)"


@query("feature_vector", _vector_sql())
def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    return rounded(timing.feature_vector(typed(spark, d)))


_BAND = f"""{_ROUND}, rt AS (SELECT writer, session_id, seq, ch, press, press + {center_of('h')} AS release FROM c), {_serial_sql('rt')},
    u AS (UNPIVOT (SELECT {', '.join(timing.SERIAL)} FROM serial) ON COLUMNS(*) INTO NAME feature VALUE value),
    band AS (SELECT feature, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.9), 4) AS p90 FROM u GROUP BY feature)"""


@query("real_band", f"{_BAND} SELECT * FROM band")
def real_band(spark: SparkSession, d: str) -> DataFrame:
    return readout.real_band(typed(spark, d))


@query("serial_readout")
def serial_readout(spark: SparkSession, d: str) -> DataFrame:
    events = typed(spark, d)
    return readout.serial_readout(codec.roundtrip(events), readout.real_band(events))


# Comparison: writers by side of the split.
_SIDED = f"{_POOL}, pool2 AS (SELECT feature, value, CASE WHEN {share(0, 'writer')} < 0.5 THEN 'a' ELSE 'b' END AS side FROM pool), lifted AS (SELECT feature, side, greatest(value, 0.001) AS value FROM pool2)"
_COMPARE = """
    lim AS (SELECT feature, min(value) AS lo, max(value) + 1.0 AS hi, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b FROM lifted GROUP BY feature),
    edges AS (SELECT *, list_transform(range(65), lambda j: lo * pow(hi / lo, j / 64.0)) AS edge FROM lim),
    bn AS (SELECT l.feature, side, least(63, greatest(0, len(list_filter(edge, lambda q: q <= value)) - 1)) AS b FROM lifted l JOIN edges USING (feature)),
    cn AS (SELECT feature, b, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS z FROM bn GROUP BY ALL),
    pq AS (SELECT lim.feature, n_a, n_b, (coalesce(a, 0) / n_a + 1e-9) / (1 + 64e-9) AS p, (coalesce(z, 0) / n_b + 1e-9) / (1 + 64e-9) AS q FROM lim, range(64) t(j) LEFT JOIN cn ON cn.feature = lim.feature AND cn.b = j),
    kl AS (SELECT feature, n_a, n_b, round(sum(CASE WHEN n_a >= 10 AND n_b >= 10 THEN 0.5 * (p - q) * ln(p / q) END), 6) AS kl FROM pq GROUP BY ALL),
    fr AS (SELECT feature, round(CASE WHEN count(*) FILTER (side = 'a') >= 10 AND count(*) FILTER (side = 'b') >= 10 THEN
           (avg(ln(1 + value)) FILTER (side = 'a') - avg(ln(1 + value)) FILTER (side = 'b')) ** 2 + (stddev_pop(ln(1 + value)) FILTER (side = 'a') - stddev_pop(ln(1 + value)) FILTER (side = 'b')) ** 2 END, 6) AS frechet FROM lifted GROUP BY feature)"""


@query("compare_features", f"{_SIDED}, {_COMPARE} SELECT feature, n_a, n_b, kl, frechet FROM kl JOIN fr USING (feature)")
def compare_features(spark: SparkSession, d: str) -> DataFrame:
    pool = timing.feature_pool(typed(spark, d)).withColumn("side", F.when(writer_split.hash_share(0, F.col("writer")) < 0.5, "a").otherwise("b"))
    return rounded(compare.compare_pools(pool.select("feature", "side", "value")))


# Controls.
@query(
    "shuffled_timing",
    f"""WITH {EVENTS}, n AS (SELECT *, count(*) OVER (PARTITION BY writer, session_id) AS n, CASE WHEN seq > 1 THEN {share(0, "writer || '|' || session_id || '|' || seq")} END AS u FROM i),
    o AS (SELECT writer, session_id, 1 + row_number() OVER (PARTITION BY writer, session_id ORDER BY u, seq) AS place, iki AS moved FROM n WHERE seq > 1),
    m AS (SELECT n.writer, n.session_id, n.seq, release - press AS hold, CASE WHEN n.seq = 1 THEN 0.0 WHEN n.n < 3 THEN iki ELSE moved END AS g FROM n LEFT JOIN o ON o.writer = n.writer AND o.session_id = n.session_id AND o.place = n.seq),
    t AS (SELECT *, sum(g) OVER (PARTITION BY writer, session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS press FROM m)
    SELECT writer, session_id, seq, round(press, 6) AS press, round(press + hold, 6) AS release FROM t""",
)
def shuffled_timing(spark: SparkSession, d: str) -> DataFrame:
    return rounded(controls.shuffle_timing(typed(spark, d)).select(*KEYS, F.col("seq").cast("long").alias("seq"), "press", "release"))


_NORMAL = lambda s, k: f"(sqrt(-2.0 * ln(greatest({share(0, f"'{s}u' || {k}")}, 1e-12))) * cos(2.0 * pi() * {share(0, f"'{s}v' || {k}")}))"
_NAME = "session_id || '|' || j"


@query(
    "heuristic_baseline",
    f"""WITH s AS (SELECT session_id, target_text FROM real_sessions WHERE session_id IS NOT NULL AND target_text IS NOT NULL GROUP BY ALL),
    c AS (SELECT session_id, unnest(string_split(target_text, '')) AS ch, generate_subscripts(string_split(target_text, ''), 1) - 1 AS j FROM s WHERE target_text <> ''),
    g AS (SELECT session_id, ch, j, CASE WHEN j > 0 THEN greatest(floor(240.0 * (1 + 0.15 * {_NORMAL('g', _NAME)})), 1) ELSE 0 END AS g, greatest(floor(80 + 12 * {_NORMAL('h', _NAME)}), 1) AS h FROM c),
    t AS (SELECT *, sum(g) OVER (PARTITION BY session_id ORDER BY j ROWS UNBOUNDED PRECEDING) AS press FROM g)
    SELECT session_id, j + 1 AS seq, ch, press, press + h AS release FROM t""",
)
def heuristic_baseline(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "real_sessions").filter("session_id is not null and target_text is not null").select("session_id", F.col("target_text").alias("target"), F.lit(50.0).alias("wpm")).distinct()
    return controls.heuristic_baseline(targets, ("session_id",)).select("session_id", F.col("seq").cast("long").alias("seq"), "ch", "press", "release")


_SYMBOLS = {"SHIFT": "Shift_L", "CTRL": "Control_L", "ALT": "Alt_L", "CAPS_LOCK": "Caps_Lock", "BKSP": "BackSpace", " ": "space"}


@query(
    "annotated_events",
    f"""WITH a AS (SELECT DISTINCT participant_id AS writer, test_section_id AS session_id, keystroke_id, press_time AS t, letter,
        CASE letter {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SYMBOLS.items())} ELSE letter END AS sym FROM keystrokes
        WHERE participant_id IS NOT NULL AND test_section_id IS NOT NULL AND press_time IS NOT NULL AND (length(letter) = 1 OR letter IN ('SHIFT', 'CTRL', 'ALT', 'CAPS_LOCK', 'BKSP'))),
    n AS (SELECT *, row_number() OVER (PARTITION BY writer, session_id ORDER BY t, keystroke_id, letter) AS i, sym = 'Shift_L' AS sh, sym IN ('Shift_L', 'Control_L', 'Alt_L', 'Caps_Lock') AS md FROM a),
    m AS (SELECT *, coalesce(max(CASE WHEN sh THEN i END) OVER b > coalesce(max(CASE WHEN NOT md THEN i END) OVER b, 0), false) AS armed FROM n
          WINDOW b AS (PARTITION BY writer, session_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    k AS (SELECT *, CASE WHEN sym = 'BackSpace' THEN NULL WHEN armed THEN upper(letter) ELSE letter END AS ch FROM m WHERE NOT md)
    SELECT writer, session_id, row_number() OVER (PARTITION BY writer, session_id ORDER BY i)::INTEGER AS seq, CASE WHEN ch IS NULL THEN 'bksp' ELSE 'key' END AS type,
        (t - min(t) OVER (PARTITION BY writer, session_id))::DOUBLE AS press, ch FROM k""",
)
def annotated_events(spark: SparkSession, d: str) -> DataFrame:
    """The transcription log in the annotated form, with shifts as rows of their own that arm capitals."""
    letter = F.col("letter")
    symbol = letter
    for name, to in _SYMBOLS.items():
        symbol = F.when(letter == name, to).otherwise(symbol)
    rows = table(spark, d, "keystrokes").filter((F.length(letter) == 1) | letter.isin(*(k for k in _SYMBOLS if k != " "))).filter("participant_id is not null and test_section_id is not null")
    one = rows.select(F.col("participant_id").alias("writer"), F.col("test_section_id").alias("session_id"), "keystroke_id", "press_time", "letter").distinct()
    order = W.partitionBy("writer", "session_id").orderBy("press_time", "keystroke_id", "letter")
    null = F.lit(None).cast("string")
    log = one.select("writer", "session_id", F.row_number().over(order).alias("row_no"), (F.col("press_time") / 1000.0).alias("input_time"), symbol.alias("key_symbol"), letter.alias("input"), null.alias("finger"), null.alias("target"), null.alias("submitted"))
    return annotated.parse_annotated(log).select("writer", "session_id", "seq", "type", "press", "ch")


# Splits, samples, provenance.
@query("writer_split", f"SELECT DISTINCT participant_id AS writer, CASE WHEN {share(0, 'participant_id')} < 0.1 THEN 'test' ELSE 'train' END AS side FROM keystrokes WHERE participant_id IS NOT NULL")
def writer_split_query(spark: SparkSession, d: str) -> DataFrame:
    return writer_split.split_by_writer(table(spark, d, "keystrokes").select(F.col("participant_id").alias("writer")))


@query("writer_split_blake2b")
def writer_split_blake2b(spark: SparkSession, d: str) -> DataFrame:
    return writer_split.split_by_blake2b(table(spark, d, "keystrokes").select(F.col("participant_id").alias("writer")))


_SIDES = f"sp AS (SELECT DISTINCT participant_id AS writer, CASE WHEN {share(0, 'participant_id')} < 0.1 THEN 'test' ELSE 'train' END AS side FROM keystrokes WHERE participant_id IS NOT NULL)"
_SECTIONS = "se AS (SELECT participant_id AS writer, test_section_id AS session_id, min(sentence) AS target FROM keystrokes WHERE participant_id IS NOT NULL AND test_section_id IS NOT NULL GROUP BY ALL)"


def _sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "keystrokes").filter("participant_id is not null and test_section_id is not null")
    return rows.groupBy(F.col("participant_id").alias("writer"), F.col("test_section_id").alias("session_id")).agg(F.min("sentence").alias("target"))


@query("heldout_sessions", f"WITH {_SIDES}, {_SECTIONS} SELECT * FROM se WHERE writer IN (SELECT writer FROM sp WHERE side = 'test')")
def heldout_sessions(spark: SparkSession, d: str) -> DataFrame:
    sections = _sections(spark, d)
    return heldout.heldout(sections, writer_split.split_by_writer(sections)).select("writer", "session_id", "target")


@query("training_sessions", f"WITH {_SIDES}, {_SECTIONS} SELECT * FROM se WHERE writer NOT IN (SELECT writer FROM sp WHERE side = 'test')")
def training_sessions(spark: SparkSession, d: str) -> DataFrame:
    sections = _sections(spark, d)
    return heldout.without(sections, writer_split.split_by_writer(sections)).select("writer", "session_id", "target")


@query("per_writer_cap", f"WITH {_SECTIONS} SELECT writer, session_id FROM se QUALIFY row_number() OVER (PARTITION BY writer ORDER BY session_id) <= 3")
def per_writer_cap(spark: SparkSession, d: str) -> DataFrame:
    return writer_split.capped_per_writer(_sections(spark, d), 3, ["session_id"]).select("writer", "session_id")


@query(
    "heldout_sample",
    f"""WITH {_SECTIONS}, f AS (SELECT * FROM se WHERE length(target) >= 8 QUALIFY row_number() OVER (PARTITION BY writer ORDER BY {share(0, 'session_id')}, session_id) = 1)
    SELECT writer, session_id, target FROM f ORDER BY md5('0:' || writer), writer LIMIT 100""",
)
def heldout_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 100 sessions, one a writer: the sample is the feature."""
    return heldout.sample_sessions(_sections(spark, d), 100).select("writer", "session_id", "target")


@query("first_target_dedupe", f"WITH {_SECTIONS} SELECT target, min(session_id) AS session_id FROM se WHERE target IS NOT NULL GROUP BY target")
def first_target_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return writer_split.first_of_each(_sections(spark, d).select("target", "session_id"), "target", ["session_id"])


@query(
    "corpora_of_split",
    f"""WITH w AS (SELECT DISTINCT 'aalto:' || participant_id AS writer FROM keystrokes WHERE participant_id IS NOT NULL UNION SELECT DISTINCT 'klicke:' || writer FROM composition_log WHERE writer IS NOT NULL),
    s AS (SELECT writer, CASE WHEN {share(0, 'writer')} < 0.1 THEN 'test' ELSE 'train' END AS side FROM w) SELECT split_part(writer, ':', 1) AS corpus, side, count(*) AS writers FROM s GROUP BY ALL""",
)
def corpora_of_split(spark: SparkSession, d: str) -> DataFrame:
    both = writer_split.union_corpora({"aalto": table(spark, d, "keystrokes").select(F.col("participant_id").alias("writer")).distinct(), "klicke": table(spark, d, "composition_log").select("writer").distinct()})
    return heldout.corpora_of(writer_split.split_by_writer(both))


@query("session_provenance", f"WITH {EVENTS} SELECT DISTINCT writer, session_id FROM e")
def session_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Writers found again for sessions whose names were taken away, by how the sessions start."""
    sessions = transcription.sessions_of(typed(spark, d))
    # The first events of two sessions can be the same; session and start together are what a dump holds.
    found = heldout.recover_writers(sessions.drop("writer"), sessions)
    return found.select("writer", "session_id")


@query("letter_counts", "SELECT letter AS value, count(*) AS n FROM keystrokes GROUP BY letter")
def letter_counts(spark: SparkSession, d: str) -> DataFrame:
    from keyloom.sources.readers import describe

    return describe(table(spark, d, "keystrokes"), "letter")


# Geometry.
_DIGRAPHS = f"""WITH {EVENTS}, l AS (SELECT *, lag(ch) OVER w AS ch0, lag(type) OVER w AS type0 FROM i WINDOW w AS (PARTITION BY writer, session_id ORDER BY seq)),
    dg AS (SELECT ch0 AS key_a, ch AS key_b, iki AS gap FROM l WHERE type = 'key' AND type0 = 'key' AND regexp_full_match(ch, '[a-z ]') AND regexp_full_match(ch0, '[a-z ]') AND iki > 0),
    mx AS (SELECT key_a, key_b, count(*) AS n, exp(avg(ln(gap))) AS geo FROM dg GROUP BY ALL)"""


@query("digraph_matrix", f"{_DIGRAPHS} SELECT key_a, key_b, n, round(geo, 6) AS geo_mean_ms, round(CASE WHEN n >= 20 THEN geo END, 6) AS masked_ms FROM mx")
def digraph_matrix(spark: SparkSession, d: str) -> DataFrame:
    return geometry.digraph_matrix(typed(spark, d))


@query(
    "modal_holds",
    f"""WITH {EVENTS}, h AS (SELECT ch AS key, {bin_of('(release - press)')} AS b, count(*) AS n FROM e WHERE regexp_full_match(ch, '[a-z ]') GROUP BY ALL)
    SELECT key, b AS modal_hold FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, b) = 1""",
)
def modal_holds(spark: SparkSession, d: str) -> DataFrame:
    return geometry.modal_holds(typed(spark, d))


@query("modal_gaps", f"{_DIGRAPHS}, h AS (SELECT key_a, key_b, {bin_of('gap')} AS b, count(*) AS n FROM dg GROUP BY ALL) SELECT key_a, key_b, b AS modal_dt FROM h QUALIFY row_number() OVER (PARTITION BY key_a, key_b ORDER BY n DESC, b) = 1")
def modal_gaps(spark: SparkSession, d: str) -> DataFrame:
    return geometry.modal_gaps(typed(spark, d))


@query("global_modal_gap", f"{_DIGRAPHS}, h AS (SELECT {bin_of('gap')} AS b, count(*) AS n FROM dg GROUP BY ALL) SELECT b AS modal_dt FROM h ORDER BY n DESC, b LIMIT 1")
def global_modal_gap(spark: SparkSession, d: str) -> DataFrame:
    return geometry.global_modal_gap(typed(spark, d))


@query(
    "histogram_medians",
    f"""{_DIGRAPHS}, h AS (SELECT key_a, key_b, {bin_of('gap')} AS b, count(*) AS n FROM dg GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY key_a, key_b ORDER BY b ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY key_a, key_b) AS total FROM h),
    m AS (SELECT key_a, key_b, total::BIGINT AS n, min(b) AS b FROM c WHERE upto >= total / 2 GROUP BY ALL) SELECT key_a, key_b, n, round({center_of('b')}, 6) AS median_ms FROM m""",
)
def histogram_medians(spark: SparkSession, d: str) -> DataFrame:
    return geometry.histogram_medians(typed(spark, d))


@query(
    "target_bigrams",
    """WITH p AS (SELECT unnest(list_transform(range(1, length(text)), lambda j: text[j:j+1])) AS p FROM documents WHERE length(text) > 1)
    SELECT p[1] AS key_a, p[2] AS key_b, count(*) AS n FROM p WHERE regexp_full_match(p, '[a-z ]{2}') GROUP BY ALL""",
)
def target_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return geometry.text_bigrams(table(spark, d, "documents"), "text")


_LAYOUT = ", ".join(f"('{k}', {geometry.positions()[k][0]}, {geometry.positions()[k][1]}, '{f[0]}', {f[1]})" for f, chars in geometry.FINGERS.items() for k in chars)
_CLASSED = f"""{_DIGRAPHS}, lay(k, x, y, hand, finger) AS (VALUES {_LAYOUT}),
    cl AS (SELECT mx.*, round(geo, 6) AS ms, CASE WHEN key_a = key_b THEN 'repeat' WHEN a.hand <> b.hand THEN 'alternate' WHEN a.finger = b.finger THEN 'same_finger' ELSE 'same_hand' END AS class,
    sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM mx JOIN lay a ON key_a = a.k JOIN lay b ON key_b = b.k WHERE n >= 20)"""


@query("class_means", f"{_CLASSED} SELECT class, count(*) AS pairs, sum(n)::BIGINT AS n, round(exp(sum(ln(ms) * n) / sum(n)), 6) AS mean_ms FROM cl GROUP BY class")
def class_means(spark: SparkSession, d: str) -> DataFrame:
    return geometry.class_means(geometry.digraph_matrix(typed(spark, d)))


@query("distance_law", f"{_CLASSED} SELECT class, count(*) AS pairs, round(CASE WHEN var_pop(dist) > 1e-12 THEN covar_pop(dist, ln(ms)) / var_pop(dist) END, 6) AS slope FROM cl WHERE key_a <> key_b GROUP BY class")
def distance_law(spark: SparkSession, d: str) -> DataFrame:
    return geometry.distance_law(geometry.digraph_matrix(typed(spark, d)))


@query(
    "same_finger_auc",
    f"""{_CLASSED}, s AS (SELECT p.class, (ln(p.ms) + ln(q.ms)) / 2 AS v FROM cl p JOIN cl q ON p.key_a = q.key_b AND p.key_b = q.key_a WHERE p.key_a < p.key_b),
    rk AS (SELECT class, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM s),
    o AS (SELECT count(*) FILTER (class = 'same_finger') AS positives, count(*) FILTER (class <> 'same_finger') AS negatives, sum(r) FILTER (class = 'same_finger') AS s FROM rk)
    SELECT positives, negatives, round((s - positives * (positives + 1) / 2.0) / nullif(positives * negatives, 0), 6) AS auc FROM o""",
)
def same_finger_auc(spark: SparkSession, d: str) -> DataFrame:
    return geometry.finger_auc(geometry.digraph_matrix(typed(spark, d)))


@query("layout_reconstruction")
def layout_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.layout_reconstruction(geometry.digraph_matrix(typed(spark, d))))


@query("synthetic_layout", "SELECT unnest(['blind', 'finger_aware']) AS mode, 27::BIGINT AS keys, TRUE AS same_finger_found, TRUE AS distances_kept")
def synthetic_layout(spark: SparkSession, d: str) -> DataFrame:
    """The layout rebuilt from latencies made from a known one: same-finger cells are told apart and distances keep their order."""
    made = geometry.synthetic_latencies()
    rows = [(mode, len(f["fitted"]), bool(f["same_finger_auc"] >= 0.9), bool(f["distance_spearman"] >= 0.75)) for mode in ("blind", "finger_aware") for f in [geometry.reconstruct(made, mode)]]
    return spark.createDataFrame(rows, "mode string, keys long, same_finger_found boolean, distances_kept boolean")


@query("export_examples")
def export_examples(spark: SparkSession, d: str) -> DataFrame:
    """Training examples of all sound sessions on physical keyboards, with sides. Without SQL: the gate's edit distance counts bytes there."""
    return export.exported(table(spark, d, "keystrokes"), table(spark, d, "participants"))


@query(
    "evaluation_sessions",
    f"""WITH {_SIDES}, {_SECTIONS}, c AS (SELECT writer, session_id FROM se WHERE writer IN (SELECT writer FROM sp WHERE side = 'test') QUALIFY row_number() OVER (PARTITION BY writer ORDER BY session_id) <= 3)
    SELECT * FROM c ORDER BY session_id, writer LIMIT 200""",
)
def evaluation_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The 200 held-out sessions an evaluation takes, at most three a writer: the number is the feature."""
    sections = _sections(spark, d)
    return selection.evaluation_sessions(sections, writer_split.split_by_writer(sections), 200, ["session_id", "writer"]).select("writer", "session_id")


@query("control_readouts")
def control_readouts(spark: SparkSession, d: str) -> DataFrame:
    """Serial features of sessions beside those of even typing and shuffled timing."""
    events = typed(spark, d)
    targets = events.groupBy(*KEYS).agg(F.first("target").alias("target")).filter("target is not null").withColumn("wpm", F.lit(50.0))
    return readout.control_readouts(events, targets).groupBy("side", "feature").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.avg(F.col("in_band").cast("double")), 4).alias("share_in_band"))
