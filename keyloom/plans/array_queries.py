"""Queries over sessions held as arrays: generation results, editing logs, drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions import bins
from keyloom.operators import codec, compare, composition, convergence, generated, knobs, labels, revision, selection, signatures, timing_pools, writer_split
from keyloom.plans.catalog import ORACLE, query
from keyloom.plans.session_queries import _COMPARE, rounded
from keyloom.plans.sql import ESCAPED, GENERATED, bin_of, share
from keyloom.session import table

KEY = ("result_id",)


def results(spark: SparkSession, d: str) -> DataFrame:
    """Generated sessions with the target and bins that their prompts ask for."""
    one = generated.generated_sessions(table(spark, d, "generation_results"))
    return one.withColumn("asked", codec.prompt_parts(F.col("prompt"))).withColumn("target", F.col("asked.target"))


# The buffer after each result's events; the first event that cannot be applied stops it.
_APPLY = """CASE WHEN s.err IS NOT NULL THEN {'t': s.t, 'c': s.c, 'err': s.err, 'ix': s.ix, 'n': s.n + 1}
    WHEN x.type IS NULL OR x.type NOT IN ('key', 'bksp', 'cursor', 'seldel') THEN {'t': s.t, 'c': s.c, 'err': 'unknown type', 'ix': s.n, 'n': s.n + 1}
    WHEN x.type = 'key' AND coalesce(length(x.ch), 0) <> 1 THEN {'t': s.t, 'c': s.c, 'err': 'key without one character', 'ix': s.n, 'n': s.n + 1}
    WHEN x.type = 'cursor' AND NOT coalesce(x.pos BETWEEN 0 AND length(s.t), false) THEN {'t': s.t, 'c': s.c, 'err': 'cursor outside the text', 'ix': s.n, 'n': s.n + 1}
    WHEN x.type = 'seldel' AND NOT coalesce(x.a >= 0 AND x.a < x.b AND x.b <= length(s.t), false) THEN {'t': s.t, 'c': s.c, 'err': 'selection outside the text', 'ix': s.n, 'n': s.n + 1}
    WHEN x.type = 'key' THEN {'t': left(s.t, s.c) || x.ch || substr(s.t, s.c + 1), 'c': s.c + 1, 'err': NULL, 'ix': -1, 'n': s.n + 1}
    WHEN x.type = 'bksp' AND s.c > 0 THEN {'t': left(s.t, s.c - 1) || substr(s.t, s.c + 1), 'c': s.c - 1, 'err': NULL, 'ix': -1, 'n': s.n + 1}
    WHEN x.type = 'cursor' THEN {'t': s.t, 'c': x.pos, 'err': NULL, 'ix': -1, 'n': s.n + 1}
    WHEN x.type = 'seldel' THEN {'t': left(s.t, x.a) || substr(s.t, x.b + 1), 'c': x.a, 'err': NULL, 'ix': -1, 'n': s.n + 1}
    ELSE {'t': s.t, 'c': s.c, 'err': NULL, 'ix': -1, 'n': s.n + 1} END"""


def _fold(events: str, text: str = "''", cursor: str = "0") -> str:
    start = f"{{'t': {text}, 'c': {cursor}::INTEGER, 'err': NULL::VARCHAR, 'ix': -1::INTEGER, 'n': 0::INTEGER}}"
    return f"list_reduce({events}, lambda s, x: CAST({_APPLY} AS STRUCT(t VARCHAR, c INTEGER, err VARCHAR, ix INTEGER, n INTEGER)), {start})"


_REPLAYED = f"WITH {GENERATED}, f AS (SELECT *, {_fold('ev')} AS z FROM r)"


@query("replay_text", f'{_REPLAYED} SELECT result_id, z.t AS text, z.c AS cursor, z.err AS err, z.ix AS "at" FROM f')
def replay_text(spark: SparkSession, d: str) -> DataFrame:
    from keyloom.operators.replay import replay

    return results(spark, d).select("result_id", replay(F.col("events")).alias("z")).select("result_id", "z.*")


@query(
    "prompt_parts",
    f"""WITH {GENERATED} SELECT result_id, nullif(regexp_extract(prompt, '<MODE:([TC])>', 1), '') AS mode, TRY_CAST(regexp_extract(prompt, '<WPM:([0-9]+)>', 1) AS INTEGER) AS wpm,
    TRY_CAST(regexp_extract(prompt, '<ECOR:([0-9]+)>', 1) AS INTEGER) AS ecor, TRY_CAST(regexp_extract(prompt, '<EUNC:([0-9]+)>', 1) AS INTEGER) AS eunc,
    TRY_CAST(regexp_extract(prompt, '<REV:([0-9]+)>', 1) AS INTEGER) AS rev, target FROM r""",
)
def prompt_parts(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("result_id", "asked.*")


_LABELLED = f"""{_REPLAYED},
    c AS (SELECT result_id, target, ev, z.t AS produced, z.err AS replay_error, len(ev) AS n, len(list_filter(ev, lambda x: x.type = 'key')) AS k,
          len(list_filter(ev, lambda x: x.type = 'bksp')) + coalesce(list_sum(list_transform(list_filter(ev, lambda x: x.type = 'seldel'), lambda x: x.b - x.a)), 0) AS del,
          len(list_filter(ev, lambda x: x.type IN ('cursor', 'seldel'))) AS mv, (ev[-1].press - ev[1].press) / 60000.0 AS mins FROM f),
    lab AS (SELECT *, CASE WHEN n > 0 AND mins > 0 THEN length(produced) / 5.0 / mins ELSE 0.0 END AS wpm, CASE WHEN k > 0 THEN least(del / k, 1.0) ELSE 0.0 END AS corrected_error_rate,
          CASE WHEN n > 0 AND length(target) > 0 THEN least(levenshtein(produced, target) / length(target), 1.0) ELSE 0.0 END AS uncorrected_error_rate,
          CASE WHEN n > 0 THEN mv / n ELSE 0.0 END AS revision_rate FROM c)"""
_RATES = ", ".join(f"round({r}, 6) AS {r}" for r in labels.RATES)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return labels.session_labels(results(spark, d).select("result_id", "target", "events"))


@query("session_labels", f"{_LABELLED} SELECT result_id, replay_error, {_RATES} FROM lab")
def session_labels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labelled(spark, d).select("result_id", "replay_error", *labels.RATES))


def _tokens(mode: str) -> str:
    step = "(ln(300.0) / 29)"
    rev = f"CASE WHEN revision_rate <= 0 THEN 0 ELSE least(30, greatest(1, 1 + round_even(ln(greatest(0.001, least(0.3, revision_rate)) / 0.001) / {step}, 0))) END::INTEGER"
    pct = lambda x: f"least(30, greatest(0, round_even({x} * 100, 0)))::INTEGER"
    return f"'<MODE:{mode}><WPM:' || least(39, greatest(0, floor(wpm / 5)))::INTEGER || '><ECOR:' || {pct('corrected_error_rate')} || '><EUNC:' || {pct('uncorrected_error_rate')} || '><REV:' || {rev} || '>'"


@query("label_tokens", f"{_LABELLED} SELECT result_id, {_tokens('C')} AS tokens FROM lab")
def label_tokens(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("result_id", labels.label_tokens(F.lit("composition")).alias("tokens"))


@query("knob_bins", f"{_LABELLED} SELECT result_id, regexp_extract({_tokens('C')}, 'WPM:([0-9]+)', 1)::INTEGER AS wpm, regexp_extract({_tokens('C')}, 'REV:([0-9]+)', 1)::INTEGER AS rev FROM lab")
def knob_bins(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("result_id", bins.wpm_bin(F.col("wpm")).alias("wpm"), bins.rev_bin(F.col("revision_rate")).alias("rev"))


_WINDOWED = f"""{_LABELLED},
    w0 AS (SELECT result_id, target, ev, uncorrected_error_rate AS unc, unnest(range(0, (n + 511) // 512)) AS window_no FROM lab WHERE replay_error IS NULL AND n > 0),
    w1 AS (SELECT *, ev[window_no * 512 + 1 : window_no * 512 + 512] AS wev, {_fold('ev[1 : window_no * 512]')} AS s0, {_fold('ev[1 : window_no * 512 + 512]')} AS s1 FROM w0),
    w AS (SELECT result_id, target, window_no, s0.t AS start_text, s0.c AS start_cursor, CASE WHEN window_no > 0 THEN ev[window_no * 512].press END AS prev_press, wev, len(wev) AS n,
          greatest(length(s1.t) - length(s0.t), 0) AS grown, (wev[-1].press - wev[1].press) / 60000.0 AS mins, len(list_filter(wev, lambda x: x.type = 'key')) AS k, unc,
          len(list_filter(wev, lambda x: x.type = 'bksp')) + coalesce(list_sum(list_transform(list_filter(wev, lambda x: x.type = 'seldel'), lambda x: x.b - x.a)), 0) AS del,
          len(list_filter(wev, lambda x: x.type IN ('cursor', 'seldel'))) AS mv, s1.t AS after FROM w1),
    wl AS (SELECT *, CASE WHEN mins > 0 THEN grown / 5.0 / mins ELSE 0.0 END AS wpm, CASE WHEN k > 0 THEN least(del / k, 1.0) ELSE 0.0 END AS corrected_error_rate, unc AS uncorrected_error_rate, mv / n AS revision_rate FROM w)"""


def windowed(spark: SparkSession, d: str) -> DataFrame:
    return labels.windows(labelled(spark, d), KEY)


@query("window_labels", f"{_WINDOWED} SELECT result_id, window_no::INTEGER AS window_no, md5(start_text) AS start_text, start_cursor, round(prev_press, 6) AS prev_press, n::INTEGER AS n, {_RATES} FROM wl")
def window_labels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windowed(spark, d).select("result_id", "window_no", F.md5(F.col("start_text").cast("binary")).alias("start_text"), "start_cursor", "prev_press", F.size("events").alias("n"), *labels.RATES))


@query("window_schedule", f"{_WINDOWED} SELECT result_id, string_agg({_tokens('C')}, ' ' ORDER BY window_no) AS schedule FROM wl GROUP BY result_id")
def window_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The label tokens of each session's windows in order."""
    rows = windowed(spark, d).select("result_id", F.struct("window_no", labels.label_tokens(F.lit("composition")).alias("t")).alias("w"))
    return rows.groupBy("result_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["t"]), " ").alias("schedule"))


_EXAMPLES = f"""{_WINDOWED},
    xs AS (SELECT result_id, window_no, unnest(wev) AS x, generate_subscripts(wev, 1) AS j FROM w),
    xg AS (SELECT xs.result_id, xs.window_no, j, x.type AS type, x.ch AS ch, x.pos AS pos, x.a AS a, x.b AS b, x.release - x.press AS hold,
           x.press - coalesce(lag(x.press) OVER (PARTITION BY xs.result_id, xs.window_no ORDER BY j), w.prev_press) AS gap FROM xs JOIN w USING (result_id, window_no)),
    xb AS (SELECT *, {bin_of('gap')} AS g, {bin_of('hold')} AS h FROM xg),
    comp AS (SELECT result_id, window_no, string_agg(coalesce('<DT:' || g || '>', '') || coalesce(CASE type WHEN 'key' THEN '<' || {ESCAPED} || ':' || h || '>' WHEN 'bksp' THEN '<BKSP:' || h || '>'
           WHEN 'cursor' THEN '<CUR:' || pos || '>' WHEN 'seldel' THEN '<SELDEL:' || a || '-' || b || '>' END, ''), '' ORDER BY j) AS completion FROM xb GROUP BY ALL),
    bad AS (SELECT DISTINCT result_id, window_no FROM xs WHERE x.type = 'key' AND NOT regexp_full_match(x.ch, '[\\n\\t\\x20-\\x7E]')),
    ex AS (SELECT result_id, window_no::INTEGER AS window_no, {_tokens('C')} || '<TARGET>' || target || CASE WHEN window_no > 0 THEN '<WRITTEN>' || right(start_text, 500) || '<CUR:' || start_cursor || '>' ELSE '' END || '<PROCESS>' AS prompt, completion
           FROM wl JOIN comp USING (result_id, window_no) ANTI JOIN bad USING (result_id, window_no)
           WHERE NOT regexp_matches(target || start_text, '<TARGET>|<WRITTEN>|<PROCESS>'))"""


def examples(spark: SparkSession, d: str) -> DataFrame:
    return labels.training_examples(windowed(spark, d), KEY, "composition")


@query("training_examples", f"{_EXAMPLES} SELECT * FROM ex")
def training_examples(spark: SparkSession, d: str) -> DataFrame:
    return examples(spark, d).drop("rev")


@query(
    "oversampled_examples",
    f"""{_EXAMPLES}, o AS (SELECT *, CASE WHEN {share(0, 'result_id')} < 0.1 THEN 'test' ELSE 'train' END AS side, regexp_extract(prompt, '<REV:([0-9]+)>', 1)::INTEGER AS rev FROM ex)
    SELECT result_id, window_no, side, unnest(range(1, CASE WHEN side = 'train' AND rev >= 5 THEN 4 ELSE 2 END))::INTEGER AS copy_no FROM o""",
)
def oversampled_examples(spark: SparkSession, d: str) -> DataFrame:
    """Examples with revisions three times, on the train side only."""
    rows = examples(spark, d)
    sides = writer_split.split_by_writer(rows, "result_id")
    return labels.repeat_revisions(rows.join(sides, "result_id"), 3, 5, F.col("side") == "train").select("result_id", "window_no", "side", "copy_no")


@query(
    "label_audit",
    f"""{_EXAMPLES}, m AS (SELECT regexp_extract(prompt, '<REV:([0-9]+)>', 1)::INTEGER AS asked, len(regexp_extract_all(completion, '<(CUR|SELDEL):[0-9-]+>')) AS mv,
    len(regexp_extract_all(completion, '<(CUR|SELDEL|BKSP|SPC|NL|TAB|LT|GT|[^<>]):[0-9-]+>')) AS n FROM ex),
    s AS (SELECT asked, mv, CASE WHEN mv = 0 THEN 0 ELSE least(30, greatest(1, 1 + round_even(ln(greatest(0.001, least(0.3, mv / n)) / 0.001) / (ln(300.0) / 29), 0))) END AS seen FROM m)
    SELECT count(*) AS n, round(avg(CAST(seen = asked AS INTEGER)), 6) AS share_equal, count(*) FILTER (asked = 0 AND mv > 0) AS hidden_revisions FROM s""",
)
def label_audit(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_audit(examples(spark, d))


@query("session_stats", f"""{_REPLAYED}, s AS (SELECT result_id, target, ev, z, coalesce(list_max(list_transform(ev, lambda x: greatest(x.press, coalesce(x.release, x.press)))) - list_min(list_transform(ev, lambda x: x.press)), 0.0) AS span FROM f)
    SELECT result_id, z.t AS produced, z.err AS error, round(1.0 - levenshtein(z.t, target) / greatest(length(target), 1), 3) AS similarity, (z.t = target)::INTEGER AS exact, round(span, 6) AS span_ms,
    round(CASE WHEN span > 0 THEN length(z.t) / 5.0 / (span / 60000.0) ELSE 0.0 END, 6) AS realized_wpm, len(ev)::INTEGER AS n_events, len(list_filter(ev, lambda x: x.type = 'bksp'))::INTEGER AS backspaces FROM s""")
def session_stats(spark: SparkSession, d: str) -> DataFrame:
    return signatures.session_stats(results(spark, d), KEY).withColumn("exact", F.col("exact").cast("int"))


@query(
    "validity",
    f"""{_REPLAYED}, s AS (SELECT result_id, list_filter([CASE WHEN len(ev) = 0 THEN 'no events' END, CASE WHEN z.err IS NOT NULL THEN 'replay error' END,
    CASE WHEN len(list_filter(ev, lambda x: NOT coalesce(x.type IN ('key', 'bksp'), false))) > 0 THEN 'off-type events' END,
    CASE WHEN len(ev) > 0 AND NOT coalesce(1.0 - levenshtein(z.t, target) / greatest(length(target), 1) >= 0.8, false) THEN 'too far from the target' END], lambda x: x IS NOT NULL) AS why FROM f)
    SELECT result_id, (len(why) = 0)::INTEGER AS valid, nullif(array_to_string(why, '; '), '') AS reason FROM s""",
)
def validity(spark: SparkSession, d: str) -> DataFrame:
    return signatures.validity(results(spark, d), KEY).withColumn("valid", F.col("valid").cast("int"))


@query("generated_mix", f"WITH {GENERATED}, c AS (SELECT result_id, type, count(*) AS n FROM ge GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY result_id), 6) AS share FROM c")
def generated_mix(spark: SparkSession, d: str) -> DataFrame:
    return signatures.event_mix(generated.long_events(results(spark, d)), KEY)


@query("event_rows")
def event_rows(spark: SparkSession, d: str) -> DataFrame:
    return signatures.event_rows(results(spark, d), KEY)




@query("pause_classes")
def pause_classes(spark: SparkSession, d: str) -> DataFrame:
    """Intervals by the boundary they fall at. Without SQL: the state before every event makes it quadratic there."""
    return rounded(signatures.pauses_at_boundaries(results(spark, d), KEY))


def _signature_pool(spark: SparkSession, d: str) -> DataFrame:
    sessions = results(spark, d)
    return signatures.pooled_signatures(sessions, generated.long_events(sessions), KEY)


@query("pooled_signatures")
def pooled_signatures(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_signature_pool(spark, d))


@query("compare_signatures")
def compare_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Distances between two halves of the results in all eight signature classes."""
    pool = _signature_pool(spark, d).withColumn("side", F.when(writer_split.hash_share(0, F.col("result_id")) < 0.5, "a").otherwise("b"))
    return rounded(compare.compare_pools(pool.select("feature", "side", "value")))


@query(
    "generated_p_bursts",
    f"""WITH {GENERATED}, gi AS (SELECT *, press - lag(press) OVER (PARTITION BY result_id ORDER BY seq) AS iki FROM ge),
    isl AS (SELECT result_id, sum(CASE WHEN iki > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY result_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM gi),
    pool AS (SELECT 'p_burst' AS feature, result_id, count(*)::DOUBLE AS value FROM isl GROUP BY result_id, g UNION ALL
             SELECT 'bksp_frac', result_id, count(*) FILTER (type = 'bksp') / count(*) FROM ge GROUP BY result_id),
    lifted AS (SELECT feature, CASE WHEN {share(0, 'result_id')} < 0.5 THEN 'a' ELSE 'b' END AS side, greatest(value, 0.001) AS value FROM pool), {_COMPARE}
    SELECT feature, n_a, n_b, kl, frechet FROM kl JOIN fr USING (feature)""",
)
def generated_p_bursts(spark: SparkSession, d: str) -> DataFrame:
    """The distances again for two classes that SQL can follow."""
    pool = _signature_pool(spark, d).filter(F.col("feature").isin("p_burst", "bksp_frac")).withColumn("side", F.when(writer_split.hash_share(0, F.col("result_id")) < 0.5, "a").otherwise("b"))
    return rounded(compare.compare_pools(pool.select("feature", "side", "value")))


# Knobs: what prompts ask for, at bin centres, against what the sessions show.
def _requested(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("asked")
    return results(spark, d).select(
        "result_id", (a["wpm"] * 5 + 2.5).cast("double").alias("wpm"), (a["ecor"] / 100.0).alias("corrected_error_rate"), (a["eunc"] / 100.0).alias("uncorrected_error_rate"), bins.rev_from_bin(a["rev"]).alias("revision_rate")
    )


_FIDELITY = f"""{_LABELLED}, rq AS (SELECT result_id, regexp_extract(prompt, '<WPM:([0-9]+)>', 1)::INTEGER * 5 + 2.5 AS wpm, regexp_extract(prompt, '<ECOR:([0-9]+)>', 1)::INTEGER / 100.0 AS corrected_error_rate,
    regexp_extract(prompt, '<EUNC:([0-9]+)>', 1)::INTEGER / 100.0 AS uncorrected_error_rate,
    CASE WHEN regexp_extract(prompt, '<REV:([0-9]+)>', 1)::INTEGER <= 0 THEN 0.0 ELSE 0.001 * exp(ln(300.0) / 29 * (least(regexp_extract(prompt, '<REV:([0-9]+)>', 1)::INTEGER, 30) - 1)) END AS revision_rate FROM r),
    pr AS ({' UNION ALL '.join(f"SELECT '{k}' AS knob, rq.{k}::DOUBLE AS a, lab.{k}::DOUBLE AS b FROM rq JOIN lab USING (result_id)" for k in labels.RATES)})"""


@query(
    "knob_fidelity",
    f"""{_FIDELITY} SELECT knob, count(*) AS n, round(CASE WHEN count(*) > 1 AND max(a) > min(a) AND max(b) > min(b) THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 6) AS r, round(avg(abs(a - b)), 6) AS mae
    FROM pr GROUP BY knob""",
)
def knob_fidelity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(knobs.knob_fidelity(_requested(spark, d), labelled(spark, d), "result_id"))


@query(
    "sweep_grid",
    f"""{_FIDELITY} SELECT result_id, w AS wpm, e AS corrected_error_rate, round(uncorrected_error_rate, 6) AS uncorrected_error_rate, round(revision_rate, 6) AS revision_rate
    FROM rq, (VALUES (20.0::DOUBLE), (40.0), (60.0), (80.0)) a(w), (VALUES (0.0::DOUBLE), (0.05), (0.1)) b(e)""",
)
def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(knobs.sweep_grid(_requested(spark, d), [20, 40, 60, 80], [0.0, 0.05, 0.1]))


# Towards the target.
@query("convergence_cost", f"""{_REPLAYED}, p AS (SELECT result_id, target, z.t AS t, z.c AS c, coalesce(list_position(list_transform(range(1, least(length(z.t), length(target)) + 1), lambda j: z.t[j] <> target[j]), true) - 1, least(length(z.t), length(target))) AS p FROM f)
    SELECT result_id, p::INTEGER AS on_path, CASE WHEN t = target THEN 1 WHEN length(t) > p THEN CASE WHEN c <> p THEN 3 + length(p::VARCHAR) ELSE 0 END + 4 + length(p::VARCHAR) + length(length(t)::VARCHAR) + 2 * (length(target) - p) + 1
    ELSE CASE WHEN c <> length(t) THEN 3 + length(length(t)::VARCHAR) ELSE 0 END + 2 * (length(target) - p) + 1 END::INTEGER AS tokens FROM p""")
def convergence_cost(spark: SparkSession, d: str) -> DataFrame:
    from keyloom.operators.replay import replay

    stand = results(spark, d).select("result_id", "target", replay(F.col("events")).alias("z"))
    return stand.select("result_id", convergence.common_prefix(F.col("z.text"), F.col("target")).alias("on_path"), convergence.finish_tokens(F.col("z.text"), F.col("z.cursor"), F.col("target")).cast("int").alias("tokens"))


@query("prefix_depth", f"{_REPLAYED} SELECT result_id, list_min([levenshtein(z.t, left(target, j)) FOR j IN range(0, length(target) + 1)])::INTEGER AS depth FROM f")
def prefix_depth(spark: SparkSession, d: str) -> DataFrame:
    from keyloom.operators.replay import replay

    stand = results(spark, d).select("result_id", "target", replay(F.col("events"))["text"].alias("t"))
    return stand.select("result_id", convergence.prefix_edit_depth("t", "target").alias("depth"))


@query("convergence_audit")
def convergence_audit(spark: SparkSession, d: str) -> DataFrame:
    return convergence.audit(results(spark, d)).select("result_id", "audit.*")


@query(
    "window_progress",
    f"""{_WINDOWED}, p AS (SELECT result_id, window_no::INTEGER AS window_no, coalesce(list_position(list_transform(range(1, least(length(after), length(target)) + 1), lambda j: after[j] <> target[j]), true) - 1, least(length(after), length(target)))::INTEGER AS on_path, mv > 0 AS revised FROM w),
    g AS (SELECT *, on_path - lag(on_path) OVER (PARTITION BY result_id ORDER BY window_no) AS gained FROM p)
    SELECT result_id, window_no, on_path, revised::INTEGER AS revised, gained, coalesce(gained <= 0 AND NOT revised, false)::INTEGER AS stalled FROM g""",
)
def window_progress(spark: SparkSession, d: str) -> DataFrame:
    return convergence.window_progress(windowed(spark, d), KEY).withColumns({"revised": F.col("revised").cast("int"), "stalled": F.col("stalled").cast("int")})


@query(
    "alternation_errors",
    f"""{_EXAMPLES}, t AS (SELECT result_id, window_no, regexp_extract_all(completion, '<[^<>]+:[0-9-]+>') AS t FROM comp)
    SELECT result_id || ':' || window_no AS stream, (len(list_filter(t, lambda x, j: starts_with(x, '<DT:') <> (j % 2 = 0))) + CASE WHEN starts_with(t[-1], '<DT:') THEN 1 ELSE 0 END)::INTEGER AS errors FROM t""",
)
def alternation_errors(spark: SparkSession, d: str) -> DataFrame:
    streams = windowed(spark, d).select(F.concat_ws(":", "result_id", "window_no").alias("stream"), codec.serialize("events", F.col("prev_press")).alias("t"))
    return convergence.alternation_errors(streams, "stream", "t")


# The typed part of each result: keys with one plain character, backspaces and jumps to the start can be applied whatever came before, so long sessions have many windows.
def _typed(sql: str) -> str:
    kept = "(x.type = 'key' AND regexp_full_match(x.ch, '[\\n\\t\\x20-\\x7E]')) OR x.type = 'bksp' OR (x.type = 'cursor' AND x.pos = 0)"
    return sql.replace(" AS z FROM r)", f" AS z FROM (SELECT * REPLACE (list_filter(ev, lambda x: coalesce({kept}, false)) AS ev) FROM r))", 1)


def typed_windows(spark: SparkSession, d: str) -> DataFrame:
    e_kept = lambda e: F.coalesce(((e["type"] == "key") & e["ch"].rlike(r"\A[\n\t\x20-\x7E]\z")) | (e["type"] == "bksp") | ((e["type"] == "cursor") & (e["pos"] == 0)), F.lit(False))
    rows = results(spark, d).select("result_id", "target", F.filter("events", e_kept).alias("events"))
    return labels.windows(labels.session_labels(rows), KEY)


@query("typed_window_labels", _typed(ORACLE["window_labels"]))
def typed_window_labels(spark: SparkSession, d: str) -> DataFrame:
    """All windows of long sessions: what each starts from, and its labels."""
    return rounded(typed_windows(spark, d).select("result_id", "window_no", F.md5(F.col("start_text").cast("binary")).alias("start_text"), "start_cursor", "prev_press", F.size("events").alias("n"), *labels.RATES))


@query("typed_window_schedule", _typed(ORACLE["window_schedule"]))
def typed_window_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The label tokens of long sessions' windows in order."""
    rows = typed_windows(spark, d).select("result_id", F.struct("window_no", labels.label_tokens(F.lit("composition")).alias("t")).alias("w"))
    return rows.groupBy("result_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["t"]), " ").alias("schedule"))


@query("typed_examples", _typed(ORACLE["training_examples"]))
def typed_examples(spark: SparkSession, d: str) -> DataFrame:
    """Training examples of long sessions, later windows with what is written and the caret."""
    return labels.training_examples(typed_windows(spark, d), KEY, "composition").drop("rev")


@query("typed_progress", _typed(ORACLE["window_progress"]))
def typed_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far each window of long sessions gets, and how much that is more than the one before."""
    return convergence.window_progress(typed_windows(spark, d), KEY).withColumns({"revised": F.col("revised").cast("int"), "stalled": F.col("stalled").cast("int")})


@query("typed_alternation", _typed(ORACLE["alternation_errors"]))
def typed_alternation(spark: SparkSession, d: str) -> DataFrame:
    streams = typed_windows(spark, d).select(F.concat_ws(":", "result_id", "window_no").alias("stream"), codec.serialize("events", F.col("prev_press")).alias("t"))
    return convergence.alternation_errors(streams, "stream", "t")


# Editing logs.
@query("composition_sessions")
def composition_sessions(spark: SparkSession, d: str) -> DataFrame:
    parsed = composition.parse_composition(table(spark, d, "composition_log"))
    return parsed.select("writer", F.length("text").alias("chars"), F.size("events").alias("n_events"), "reason")


@query("unescaped_changes", """SELECT log_id, CASE WHEN text_change IS NULL OR text_change = 'NoChange' THEN '' ELSE replace(replace(replace(text_change, '\\n', chr(10)), '\\"', '"'), '\\\\', '\\') END AS change FROM composition_log""")
def unescaped_changes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "composition_log").select("log_id", composition.unescaped_change(F.col("text_change")).alias("change"))


@query("paste_sessions", "SELECT writer, bool_or(coalesce(lower(trim(activity)) = 'paste' AND cursor_position IS NOT NULL, false))::INTEGER AS pasted FROM composition_log WHERE writer IS NOT NULL GROUP BY writer")
def paste_sessions(spark: SparkSession, d: str) -> DataFrame:
    pasted = (F.lower(F.trim("activity")) == "paste") & F.col("cursor_position").isNotNull()
    return table(spark, d, "composition_log").filter("writer is not null").groupBy("writer").agg(F.max(F.coalesce(pasted, F.lit(False)).cast("int")).alias("pasted"))


@query("timing_pools")
def timing_pools_query(spark: SparkSession, d: str) -> DataFrame:
    return timing_pools.complete_pools(timing_pools.harvest_timings(results(spark, d), KEY), KEY)


# Texts.
_PLAIN = """replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '…', '...')"""
# Fixed values, as code points: typographic single quotes, double quotes, dashes and blanks with what they become, then what vanishes.
_WIDE = {39: (8216, 8217, 8218, 8219, 8242), 34: (8220, 8221, 8222, 8223, 8243), 45: (8208, 8209, 8210, 8211, 8212, 8213, 8722), 32: (160, 8239, *range(8192, 8203))}
_GONE = (8203, 8204, 8205, 65279)
_FROM = " || ".join(f"chr({c})" for c in (*(c for wide in _WIDE.values() for c in wide), *_GONE))
_TO = " || ".join(f"chr({k})" for k, wide in _WIDE.items() for _ in wide)


@query("normalize_typable", f"SELECT doc_id, md5(translate({_PLAIN}, {_FROM}, {_TO})) AS plain FROM documents")
def normalize_typable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(codec.normalize_typable(F.col("text")).cast("binary")).alias("plain"))


@query("marker_refusals", "SELECT doc_id, coalesce(contains(text, '<TARGET>') OR contains(text, '<WRITTEN>') OR contains(text, '<PROCESS>'), false)::INTEGER AS refused FROM documents")
def marker_refusals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", codec.has_marker(F.col("text")).cast("int").alias("refused"))


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    """Each draft of a writer beside the next one."""
    texts = table(spark, d, "documents").filter("writer is not null and draft_no is not null and text is not null")
    order = W.partitionBy("writer").orderBy("draft_no", "doc_id")
    return texts.select("writer", "doc_id", "draft_no", F.col("text").alias("before"), F.lead("text").over(order).alias("after")).filter("after is not null")


_DRAFTS = """WITH dr AS (SELECT writer, doc_id, draft_no, text AS before, lead(text) OVER (PARTITION BY writer ORDER BY draft_no, doc_id) AS after FROM documents WHERE writer IS NOT NULL AND draft_no IS NOT NULL AND text IS NOT NULL),
    p AS (SELECT * FROM dr WHERE after IS NOT NULL)"""


@query("revision_chains")
def revision_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of drafts: one draft deeper and starting from the last result."""
    passes = _drafts(spark, d).select(F.col("writer").alias("doc_id"), F.col("draft_no").alias("revision_depth"), F.col("before").alias("before_revision"), F.col("after").alias("after_revision"))
    return revision.revision_chains(passes).groupBy("doc_id", "chain").agg(F.count("*").alias("passes"), F.min("revision_depth").alias("first_depth"))


@query(
    "edit_spans",
    f"""{_DRAFTS}, c AS (SELECT doc_id, before, after, string_split(before, '') AS b, string_split(after, '') AS a, length(before) AS nb, length(after) AS na FROM p),
    h AS (SELECT *, coalesce(list_position(list_transform(range(1, least(nb, na) + 1), lambda j: b[j] <> a[j]), true) - 1, least(nb, na)) AS s FROM c),
    t AS (SELECT *, coalesce(list_position(list_transform(range(0, least(nb, na) - s), lambda j: b[nb - j] <> a[na - j]), true) - 1, least(nb, na) - s) AS tail FROM h)
    SELECT doc_id, s::INTEGER AS start, (nb - tail)::INTEGER AS stop, md5(substr(after, s + 1, na - tail - s)) AS inserted FROM t""",
)
def edit_spans(spark: SparkSession, d: str) -> DataFrame:
    """The span in which each draft differs from the next."""
    return revision.edit_spans(_drafts(spark, d), "before", "after").select("doc_id", "start", "stop", F.md5(F.col("inserted").cast("binary")).alias("inserted"))


@query("sentence_sessions")
def sentence_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each draft typed with drawn timings, then edited into the next."""
    pools = timing_pools.complete_pools(timing_pools.harvest_timings(results(spark, d), KEY), KEY)
    # By document, as one writer's drafts would else be typed in one task.
    pairs = _drafts(spark, d).repartition("doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("nr"), F.col("before").alias("before_sent"), F.col("after").alias("after_sent"))
    return revision.sentence_sessions(pairs, pools, events=False).select("doc_id", F.length("target").alias("chars"), "n_events", "reason")


_AFTER = _PLAIN.replace("text", "after")


@query("revision_documents", f"{_DRAFTS} SELECT doc_id::VARCHAR AS doc_id, md5(translate({_AFTER}, {_FROM}, {_TO})) AS target, NULL::VARCHAR AS reason FROM p")
def revision_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each draft as a revision document: typed, then revised by the action that makes it the next one. Every one must come out letter by letter."""
    pools = timing_pools.complete_pools(timing_pools.harvest_timings(results(spark, d), KEY), KEY)
    spans = revision.edit_spans(_drafts(spark, d), "before", "after")
    action = F.struct(F.substr("before", F.col("start") + 1, F.col("stop") - F.col("start")).alias("before"), F.col("inserted").alias("after"), F.col("start").alias("start_char_pos"), F.col("stop").alias("end_char_pos"))
    passes = spans.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("revision_depth"), F.col("before").alias("before_revision"), F.col("after").alias("after_revision"), F.array(action).alias("edit_actions"))
    return revision.revision_sessions(passes, pools, events=False).select("doc_id", F.md5(F.col("target").cast("binary")).alias("target"), "reason")


@query("mode_filter", "SELECT DISTINCT result_id FROM generation_results WHERE starts_with(prompt, '<MODE:T>')")
def mode_filter(spark: SparkSession, d: str) -> DataFrame:
    return selection.by_mode(table(spark, d, "generation_results"), "transcription").select("result_id").distinct()


@query("encodable_prompts", "SELECT DISTINCT result_id FROM generation_results WHERE regexp_full_match(prompt, '[\\n\\t\\x20-\\x7E]*')")
def encodable_prompts(spark: SparkSession, d: str) -> DataFrame:
    return selection.encodable(table(spark, d, "generation_results")).select("result_id").distinct()


@query(
    "composition_targets",
    "SELECT writer, session_id, left(target, 400) AS target FROM (SELECT writer, session_id, min(target_text) AS target FROM real_sessions WHERE writer IS NOT NULL AND run_mode = 'composition' GROUP BY ALL) WHERE length(target) > 0 QUALIFY row_number() OVER (PARTITION BY writer ORDER BY session_id) = 1",
)
def composition_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "real_sessions").filter("writer is not null and run_mode = 'composition'").groupBy("writer", "session_id").agg(F.min("target_text").alias("target"))
    return selection.composition_targets(rows, ["session_id"])
