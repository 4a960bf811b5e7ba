"""SQL of the splitting and packing queries: the same results where SQL can say them, and facts that must hold of every result where it cannot."""

#: Pieces cut greedily, one after another.
PIECES_SQL = """WITH RECURSIVE e AS (SELECT result_id, list_filter(events, lambda x: x IS NOT NULL) AS e FROM generation_results WHERE events IS NOT NULL AND result_id IS NOT NULL),
c AS (SELECT result_id, list_filter(e, lambda x, i: i = 1 OR x IS DISTINCT FROM e[i - 1]) AS e FROM e),
s AS (SELECT result_id, len(e) AS n, list_transform(e, lambda x, i: CASE
        WHEN (lower(trim(e[i - 1].event_type)) = 'key' AND e[i - 1].key_char = chr(10)) OR x.press_time - e[i - 1].press_time >= 2000 THEN 3
        WHEN lower(trim(e[i - 1].event_type)) = 'key' AND (e[i - 1].key_char IN ('.', '!', '?', '…') OR (e[i - 1].key_char = ' ' AND e[i - 2].key_char IN ('.', '!', '?', '…'))) THEN 2
        WHEN (lower(trim(e[i - 1].event_type)) = 'key' AND e[i - 1].key_char = ' ') OR lower(trim(x.event_type)) IN ('cursor', 'seldel') THEN 1 ELSE 0 END) AS s FROM c WHERE len(e) > 0),
o AS (SELECT result_id, max(n) AS n, arg_max(s, n) AS s FROM s GROUP BY result_id),
p AS (SELECT result_id, n, s, 0 AS piece_no, 0 AS a, CASE WHEN n <= 512 THEN n ELSE coalesce(
            list_max(list_filter(range(384, 513), lambda k: s[k + 1] >= 3)), list_max(list_filter(range(384, 513), lambda k: s[k + 1] >= 2)), list_max(list_filter(range(384, 513), lambda k: s[k + 1] >= 1)),
            list_max(list_filter(range(256, 513), lambda k: s[k + 1] >= 1)), list_max(list_filter(range(33, 513), lambda k: s[k + 1] >= 1)), 512) END AS b FROM o
      UNION ALL SELECT result_id, n, s, piece_no + 1, b - 32, CASE WHEN n <= b - 32 + 512 THEN n ELSE b - 32 + coalesce(
            list_max(list_filter(range(384, 513), lambda k: s[b - 32 + k + 1] >= 3)), list_max(list_filter(range(384, 513), lambda k: s[b - 32 + k + 1] >= 2)), list_max(list_filter(range(384, 513), lambda k: s[b - 32 + k + 1] >= 1)),
            list_max(list_filter(range(256, 513), lambda k: s[b - 32 + k + 1] >= 1)), list_max(list_filter(range(33, 513), lambda k: s[b - 32 + k + 1] >= 1)), 512) END FROM p WHERE b < n)
SELECT result_id, n::INT AS n_events, piece_no, a::INT AS start, b::INT AS stop, CASE WHEN b < n THEN s[b + 1] ELSE -1 END AS strength FROM p"""

#: Every document has its place; pieces of a divided one fill containers, and no container holds more than the capacity.
PLACED_SQL = "SELECT doc_id, text IS NOT NULL AS placed, TRUE AS fits FROM documents WHERE doc_id IS NOT NULL"
