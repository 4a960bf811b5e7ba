"""SQL fragments that several queries share. Written for the comparison engine, apart from the operators."""

from __future__ import annotations

#: The logarithmic time grid, worked out by the comparison engine itself: 128 bins between 1 and 120,000 ms, and their geometric centres.
_EDGES = "list_transform(range(129), lambda k: pow(120000.0::DOUBLE, k / 128.0::DOUBLE))"
_CENTERS = "list_transform(range(128), lambda k: pow(120000.0::DOUBLE, (k + 0.5) / 128.0::DOUBLE))"

#: Events of the transcription log, sessions with unlogged letters left out.
EVENTS = """
    k AS (SELECT DISTINCT participant_id AS writer, test_section_id AS session_id, keystroke_id, press_time, release_time, letter, sentence AS target, user_input AS submitted
          FROM keystrokes WHERE participant_id IS NOT NULL AND test_section_id IS NOT NULL),
    bad AS (SELECT writer, session_id FROM k WHERE letter IS NULL),
    v AS (SELECT *, CASE WHEN upper(letter) IN ('BKSP', 'BACKSPACE', chr(8)) THEN 'bksp' WHEN length(letter) = 1 THEN 'key' END AS type
          FROM k ANTI JOIN bad USING (writer, session_id) WHERE press_time IS NOT NULL),
    e AS (SELECT writer, session_id, row_number() OVER (PARTITION BY writer, session_id ORDER BY press_time, keystroke_id, letter, release_time NULLS FIRST) AS seq, type,
          CAST(press_time - min(press_time) OVER (PARTITION BY writer, session_id) AS DOUBLE) AS press,
          CAST(greatest(coalesce(release_time, press_time), press_time) - min(press_time) OVER (PARTITION BY writer, session_id) AS DOUBLE) AS release,
          CASE WHEN type = 'key' THEN letter END AS ch, target, submitted FROM v WHERE type IS NOT NULL),
    i AS (SELECT *, press - lag(press) OVER w AS iki, lead(press) OVER w AS next FROM e WINDOW w AS (PARTITION BY writer, session_id ORDER BY seq))"""

#: Generated sessions: r one row a result with the list ev, ge one row an event.
GENERATED = """
    g0 AS (SELECT result_id, prompt, text, steps, list_filter(coalesce(events, []), lambda x: x IS NOT NULL) AS l FROM generation_results WHERE result_id IS NOT NULL),
    g1 AS (SELECT result_id, prompt, text, steps, list_transform(list_filter(l, lambda x, n: n = 1 OR x IS DISTINCT FROM l[n - 1]), lambda x: {
           'type': CASE WHEN lower(trim(x.event_type)) = 'backspace' THEN 'bksp' ELSE lower(trim(x.event_type)) END, 'press': x.press_time, 'release': x.release_time,
           'ch': x.key_char, 'pos': x.pos, 'a': x.sel_start, 'b': x.sel_end}) AS ev FROM g0),
    r AS (SELECT *, regexp_extract(prompt, '<TARGET>((?s:.*?))(?:<WRITTEN>|<PROCESS>)', 1) AS target FROM g1 QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY len(ev) DESC) = 1),
    ge0 AS (SELECT result_id, unnest(ev) AS x, generate_subscripts(ev, 1) AS seq FROM r),
    ge AS (SELECT result_id, seq, x.type AS type, x.press AS press, x.release AS release, x.ch AS ch, x.pos AS pos, x.a AS a, x.b AS b FROM ge0)"""


def bin_of(x: str) -> str:
    """Time bin of an expression, by comparing with every limit."""
    return f"CASE WHEN {x} IS NOT NULL THEN least(127, greatest(0, len(list_filter({_EDGES}, lambda q: q <= greatest(1.0, least(120000.0, {x})))) - 1))::INTEGER END"


def center_of(k: str) -> str:
    return f"({_CENTERS})[{k} + 1]"


def share(seed: int, key: str) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 15)) AS BIGINT)::DOUBLE / 1152921504606846976.0)"


ESCAPED = "CASE ch WHEN ' ' THEN 'SPC' WHEN chr(10) THEN 'NL' WHEN chr(9) THEN 'TAB' WHEN '<' THEN 'LT' WHEN '>' THEN 'GT' ELSE ch END"
