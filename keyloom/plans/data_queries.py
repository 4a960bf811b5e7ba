"""Queries of the core's data-preparation operators (problems 1 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.operators.activity_sessions import activity_sessions
from keyloom.operators.row_parser import good_rows, rejected_rows
from keyloom.plans.catalog import query
from keyloom.session import table

_USABLE = """
    SELECT DISTINCT event_id, writer, press_time,
           CASE WHEN lower(trim(event_type)) = 'backspace' THEN 'bksp'
                WHEN lower(trim(event_type)) IN ('key','bksp','cursor','seldel') THEN lower(trim(event_type)) ELSE 'other' END AS kind
    FROM key_events
    WHERE event_id IS NOT NULL AND trim(writer) <> '' AND isfinite(press_time) AND press_time >= 946684800000"""
_MARKED = f"""
    WITH e AS ({_USABLE}),
    o AS (SELECT *, CASE WHEN press_time - lag(press_time) OVER w <= 1800000 THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY writer ORDER BY press_time, event_id)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY writer ORDER BY press_time, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM o)"""


@query(
    "p1_found",
    f"""{_MARKED} SELECT writer, arg_min(event_id, (press_time, event_id)) AS first_event_id, arg_max(event_id, (press_time, event_id)) AS last_event_id
    FROM s GROUP BY writer, session_no""",
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last event of every session."""
    return activity_sessions(table(spark, d, "key_events")).select("writer", "first_event_id", "last_event_id")


@query(
    "p1_sessions",
    f"""{_MARKED} SELECT writer, CAST(session_no AS BIGINT) AS session_no, min(press_time) AS start_ms, max(press_time) AS end_ms,
    max(press_time) - min(press_time) AS duration_ms, arg_min(event_id, (press_time, event_id)) AS first_event_id, arg_max(event_id, (press_time, event_id)) AS last_event_id,
    count(*) AS n_events, count(*) FILTER (kind = 'key') AS n_key, count(*) FILTER (kind = 'bksp') AS n_bksp, count(*) FILTER (kind = 'cursor') AS n_cursor,
    count(*) FILTER (kind = 'seldel') AS n_seldel, count(*) FILTER (kind = 'other') AS n_other
    FROM s GROUP BY writer, session_no""",
)
def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Start, end, duration and counts by type of every session."""
    return activity_sessions(table(spark, d, "key_events"))


_FIELD = r"""("(?:[^"]|"")*"|[^"\t]*)"""
_SPLIT = rf"""
    WITH l AS (SELECT line_id, regexp_replace(coalesce(line, ''), '\r\z', '') AS line FROM raw_log_lines),
    q AS (SELECT line_id, NOT regexp_full_match(line, '(?s){_FIELD}(\t{_FIELD})*') AS broken, regexp_extract_all(chr(9) || line, '(?s)\t{_FIELD}', 1) AS raw FROM l),
    f AS (SELECT line_id, broken, list_transform(raw, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM q),
    r AS (SELECT line_id, f, CASE
        WHEN broken THEN 'quoting' WHEN len(f) <> 9 THEN 'column_count'
        WHEN NOT regexp_full_match(f[1], '0*[1-9][0-9]*') OR len(f[1]) > 18 THEN 'participant_id'
        WHEN NOT regexp_full_match(f[2], '0*[1-9][0-9]*') OR len(f[2]) > 18 THEN 'test_section_id'
        WHEN regexp_full_match(f[3], '[\t \x{{A0}}\x{{202F}}\x{{2007}}]*') OR regexp_matches(f[3], '[\x{{FFFD}}\x7F\x00-\x08\x0A-\x1F]') THEN 'sentence'
        WHEN regexp_full_match(f[4], '[\t \x{{A0}}\x{{202F}}\x{{2007}}]*') OR regexp_matches(f[4], '[\x{{FFFD}}\x7F\x00-\x08\x0A-\x1F]') THEN 'user_input'
        WHEN NOT regexp_full_match(f[5], '0*[1-9][0-9]*') OR len(f[5]) > 18 THEN 'keystroke_id'
        WHEN NOT regexp_full_match(f[6], '1[0-9]{{12}}') THEN 'press_time'
        WHEN NOT regexp_full_match(f[7], '(1[0-9]{{12}})?') THEN 'release_time'
        WHEN NOT regexp_full_match(f[8], 'BKSP|SHIFT|CAPS_LOCK|CTRL|ALT|TAB|[^\x00-\x1F\x7F\x{{FFFD}}]') THEN 'letter'
        WHEN NOT regexp_full_match(f[9], '0*([0-9]{{1,2}}|1[0-9]{{2}}|2[0-4][0-9]|25[0-5])') THEN 'keycode' END AS reason FROM f)"""


@query("p3_found", f"{_SPLIT} SELECT line_id, reason FROM r WHERE reason IS NOT NULL")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that do not parse, with the reason."""
    return rejected_rows(table(spark, d, "raw_log_lines")).select("line_id", "reason")


@query(
    "p3_rows",
    f"""{_SPLIT} SELECT line_id, CAST(f[1] AS BIGINT) AS participant_id, CAST(f[2] AS BIGINT) AS test_section_id, f[3] AS sentence, f[4] AS user_input,
    CAST(f[5] AS BIGINT) AS keystroke_id, CAST(f[6] AS BIGINT) AS press_time, CAST(nullif(f[7], '') AS BIGINT) AS release_time, f[8] AS letter, CAST(f[9] AS INTEGER) AS keycode
    FROM r WHERE reason IS NULL""",
)
def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines that parse, as typed keystroke rows."""
    return good_rows(table(spark, d, "raw_log_lines"))
