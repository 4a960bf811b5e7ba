import random

from keyloom.operators.activity_sessions import GAP_MS, activity_sessions

SCHEMA = "event_id long, writer string, event_type string, press_time double, received_at string"
T0 = 1_700_000_000_000.0


def brute(rows):
    seen, by = {}, {}
    for e, w, _, p, _ in rows:
        if e is None or w is None or not w.strip() or p is None or p != p or p in (float("inf"), float("-inf")) or p < 946684800000:
            continue
        seen.setdefault(e, (w, p))
    for e, (w, p) in seen.items():
        by.setdefault(w, []).append((p, e))
    out = set()
    for w, events in by.items():
        events.sort()
        first = last = events[0]
        n = 1
        for x in events[1:]:
            if x[0] - last[0] > GAP_MS:
                out.add((w, first[1], last[1], n))
                first, n = x, 0
            last, n = x, n + 1
        out.add((w, first[1], last[1], n))
    return out


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = []
    for i in range(3000):
        # A third of all events are one writer's; many gaps are near the limit.
        w = "hot" if r.random() < 0.33 else r.choice(["a", "b", "c", None, "", " "])
        p = T0 + r.choice([0, 1, 2, 5, 50]) * GAP_MS + r.choice([0, 0.25, -0.25, 1, 700_000]) + r.randrange(60) * GAP_MS / 2
        rows.append((i, w, r.choice(["key", "KEY", " bksp", "backspace", None, "odd"]), r.choice([p, p, p, p, None, float("nan"), float("inf"), 1.0]), "d1"))
    rows += [(*x[:4], "d2") for x in r.sample(rows, 500)]
    got = {(x.writer, x.first_event_id, x.last_event_id, x.n_events) for x in activity_sessions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_exact_gap_and_ties(spark):
    rows = [(1, "a", "key", T0, ""), (2, "a", "key", T0 + GAP_MS, ""), (3, "a", "key", T0 + 2 * GAP_MS + 0.25, ""), (9, "b", "cursor", T0, ""), (8, "b", "key", T0, "")]
    got = sorted((x.writer, x.first_event_id, x.last_event_id, x.duration_ms, x.n_key, x.n_cursor) for x in activity_sessions(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("a", 1, 2, GAP_MS, 2, 0), ("a", 3, 3, 0.0, 1, 0), ("b", 8, 9, 0.0, 1, 1)]


def test_empty_and_conflicting_deliveries(spark):
    assert activity_sessions(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "b", "key", T0, ""), (1, "a", "key", T0, ""), (1, None, "key", T0, "")]
    got = activity_sessions(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as chunk", "2 as kind")).collect()
    assert [(x.writer, x.n_events) for x in got] == [("a", 1)]
