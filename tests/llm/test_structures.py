import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import grouped_split, packing, quantile_digest, reading_level, splitting


def slow_cuts(strength, limit, overlap):
    out, s, n = [], 0, len(strength)
    while n:
        if n - s <= limit:
            return [*out, (s, n, -1)]
        for least, share in splitting.PREFERENCE:
            low = s + max(int(limit * share), overlap + 1)
            hits = [e for e in range(low, s + limit + 1) if strength[e] >= least]
            if hits:
                e = hits[-1]
                break
        else:
            e = s + limit
        out.append((s, e, int(strength[e])))
        s = e - overlap
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=120), max_size=5), st.integers(8, 20), st.integers(0, 3))
def test_doubling_equals_greedy(items, limit, overlap):
    arrays = [np.array(x, dtype=np.int8) for x in items]
    assert splitting.greedy_cuts(arrays, limit, overlap) == [slow_cuts(x, limit, overlap) for x in arrays]


def test_pieces(spark):
    event = "struct<event_type:string,press_time:double,release_time:double,key_char:string,pos:int,sel_start:int,sel_end:int>"
    key = lambda i, c="a": ("key", float(i), float(i), c, None, None, None)
    rows = [
        (1, [key(i) for i in range(512)], "x"), (2, [key(i, " " if i % 7 == 0 else "a") for i in range(600)], "x"), (3, [], "x"), (4, None, "x"), (5, [None, *[key(i // 2) for i in range(1100)], None], "x"),
        (2, [key(i, " " if i % 7 == 0 else "a") for i in range(600)], "y"), (6, [key(i) if i % 2 else None for i in range(1030)], "x"), (None, [key(i) for i in range(600)], "x"), (7, [key(1), None, key(1), key(1)], "x"),
        (8, [("key", None, None, None, None, None, None)] * 3 + [key(i) for i in range(512)], "x"),
    ]
    df = spark.createDataFrame(rows, f"result_id long, events array<{event}>, piece_no string")
    got = defaultdict(list)
    for r in splitting.pieces(df).orderBy("result_id", "piece_no").collect():
        got[r.result_id].append((r.n_events, r["start"], r["stop"]))
    assert got[1] == [(512, 0, 512)] and 3 not in got and 4 not in got and None not in got and got[7] == [(1, 0, 1)]
    assert got[5][0][0] == 550 and got[6] == [(515, 0, 512), (515, 480, 515)] and got[8][0][0] == 513
    for pieces in got.values():
        assert all(b - a <= 512 for _, a, b in pieces) and all(x[2] - y[1] == 32 for x, y in zip(pieces, pieces[1:])) and pieces[0][1] == 0 and pieces[-1][2] == pieces[-1][0]
    assert (got[2][0][2] - 1) % 7 == 0  # right after a space
    long = splitting.piece_events(df).filter("result_id = 2 and piece_no = 1").first()
    assert len(long.events) == long["stop"] - long["start"]
    assert splitting.pieces(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.greedy_cuts([], 10, 5)


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(1000, i) for i in range(1001, 1080)]
    cases = [[], [(1, 2)], [(2, 1), (2, 1), (3, 3)], chain, star, chain + star + [(120, 1040)], [(r.randrange(200), r.randrange(200)) for _ in range(120)]]
    for edges in cases:
        df = spark.createDataFrame(edges, "u long, v long")
        got = {x.id: x.component for x in grouped_split.components(df).collect()}
        assert got == union_find([(a, b) for a, b in edges if a != b])


PEOPLE = "participant_id long, native_language string, contact_code string, previous_id long"


def test_links_and_pairs(spark):
    people = spark.createDataFrame(
        [(1, "en", "AB-01", None), (2, "fi", " ab_01", None), (3, "en", "none", None), (4, "en", "NONE", 4), (5, "en", None, 1), (6, "en", "", 999), (7, "en", "??", None), (8, None, "zz-9", None), (9, "en", "ZZ 9", None), (9, "en", "ZZ 9", None), (10, "en", "x", 999)],
        PEOPLE,
    )
    sessions = spark.createDataFrame(
        [(1, "aalto:000003 & 7"), (2, "klicke:4+aalto:5"), (3, "KLICKE: 6; 8"), (4, None), (5, "aalto:4"), (6, "8,aalto: 10"), (7, "99999999999999999999+6"), (6, "8,aalto: 10")], "session_id long, writer string"
    )
    got = {tuple(x) for x in grouped_split.linked_pairs(people, sessions).collect()}
    assert got == {(1, 2), (1, 5), (2, 5), (3, 7), (8, 9), (8, 10), (9, 10)}
    assert grouped_split.linked_pairs(people.limit(0), sessions.limit(0)).count() == 0


def test_splits_keep_groups_together(spark):
    r = random.Random(3)
    people = spark.createDataFrame([(i, r.choice(["en", "FI", None, "xx-odd"]), f"C{i % 150}" if i % 3 else None, None) for i in range(300)], PEOPLE)
    sessions = spark.createDataFrame([(i, f"aalto:{r.randrange(300)}" if i % 5 else r.choice([None, "klicke:1", "aalto:1; 2", ""])) for i in range(400)], "session_id long, writer string")
    keys = spark.createDataFrame([(r.randrange(300) if i % 9 else None, i % 700, "x") for i in range(1500)], "participant_id long, test_section_id long, split string")
    got = grouped_split.person_splits(keys, sessions, people).collect()
    side = {(x.kind, x.record_id): x.split for x in got}
    assert len(side) == len(got) == 300 + 400 + 700 and set(side.values()) <= set(grouped_split.SPLITS)
    group = union_find([(a, b) for a, b in ((x.u, x.v) for x in grouped_split.person_links(people, sessions).collect())])
    by_group = defaultdict(set)
    for (kind, i), s in side.items():
        if kind == "participant":
            by_group[group.get(i, i)].add(s)
    assert all(len(s) == 1 for s in by_group.values())
    for x in sessions.select("session_id", grouped_split.session_writers(F.col("writer")).alias("w")).collect():
        if x.w:
            assert {side["session", x.session_id]} == {side["participant", p] for p in x.w}
    share = Counter(side.values())
    assert abs(share["train"] / len(side) - 0.8) < 0.02 and abs(share["test"] / len(side) - 0.1) < 0.02


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 400), st.integers(1, 60)), min_size=1, max_size=12))
def test_allocation_is_whole_and_close(bundles):
    counts = grouped_split.allocate([(a, n, float(s)) for a, n, s in bundles])
    assert [sum(c) for c in counts] == [n for _, n, _ in bundles] and all(x >= 0 for c in counts for x in c)
    total = sum(n * s for _, n, s in bundles)
    largest = max(s for *_, s in bundles)
    for j, share in enumerate(grouped_split.SHARES):
        assert abs(sum(c[j] * s for c, (_, _, s) in zip(counts, bundles)) - share * total) <= 3 * largest


EVENTS = "event_id long, writer string, event_type string, press_time double, release_time double, key_char string, received_at string"


def timings(rows):
    by = defaultdict(dict)
    for e, w, k, p, r, c, _ in rows:
        if e is not None and w and w.strip() and p is not None and p == p and 946684800000 <= p < float("inf"):
            by[w][e] = (p, e, c if (k or "").strip().lower() == "key" else None, r)
    out = defaultdict(list)
    for w, events in by.items():
        last = None
        for p, e, c, r in sorted(events.values()):
            day = int(p // 86400000)
            if c is not None and r is not None and r == r and p <= r < float("inf"):
                out["hold", w, day, c, None].append(r - p)
            if last and c is not None and last[2] is not None and p - last[0] <= 1_800_000:
                out["gap", w, day, last[2], c].append(p - last[0])
            last = (p, e, c)
    return out


def test_percentiles_of_chunks_and_blocks(spark):
    r = random.Random(5)
    base, rows = 1_700_006_400_000.0 - 500_000, []  # half before, half after midnight
    t = defaultdict(lambda: base)
    for i in range(4000):
        w = "hot" if r.random() < 0.5 else r.choice(["a", "b", None, ""])
        t[w] += r.choice([0, 90.25, 120, 300, 2000, 60_000] if i % 400 else [1_800_000, 1_800_001, 40_000_000])
        rows.append((i, w, r.choice(["key", "KEY ", "key", "bksp", None]), r.choice([t[w]] * 20 + [None, float("nan"), 5.0]), r.choice([t[w] + r.randrange(200), t[w] - 1, None]), r.choice("ab") if i % 50 else None, "x"))
    rows += [(*x[:6], "late") for x in r.sample(rows, 300)]
    truth = timings(rows)
    df = spark.createDataFrame(rows, EVENTS)
    for size, block in ((200, 65_536), (20, 65_536), (200, 30), (20, 7)):
        got = quantile_digest.key_percentiles(df, size=size, block=block).collect()
        assert {(x.measure, x.writer, x.day, x.key_a, x.key_b) for x in got} == set(truth) and len(got) == len(truth)
        for x in got:
            values = np.sort(truth[x.measure, x.writer, x.day, x.key_a, x.key_b])
            assert x.n == len(values) == sum(c.w for c in x.digest)
            if x.n <= size:
                assert x.estimates == pytest.approx(np.quantile(values, quantile_digest.PERCENTILES).tolist())
            worst = max(max(0.0, (values < e).sum() / x.n - p, p - (values <= e).sum() / x.n) for e, p in zip(x.estimates, quantile_digest.PERCENTILES))
            assert x.rank_error == pytest.approx(worst, abs=1e-9) and x.rank_error <= 1 / x.n + 4 / size
        for x in quantile_digest.pair_percentiles(df, size=size, block=block).collect():
            values = np.concatenate([v for (m, _, _, a, b), v in truth.items() if (m, a, b) == (x.measure, x.key_a, x.key_b)] or [[]])
            assert len(values), (x, set(truth))
            assert x.n == len(values) and x.digest[0].lo == values.min() and x.digest[-1].hi == values.max() and x.rank_error <= 1 / x.n + 6 / size
    assert quantile_digest.key_percentiles(df.limit(0)).count() == 0 and quantile_digest.pair_percentiles(df.limit(0)).count() == 0
    # A repeated event_id with another press time is one event, as in the sessions.
    moved = spark.createDataFrame([(1, "w", "key", base, base + 5, "a", "x"), (1, "w", "key", base + 40, base + 45, "a", "y"), (2, "w", "key", base + 100, base + 105, "b", "x")], EVENTS)
    assert {(x.measure, x.estimates[0]) for x in quantile_digest.key_percentiles(moved).collect()} == {("gap", 100.0), ("hold", 5.0)}


def test_digests_as_text(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(k, [float(round(r.expovariate(0.01), 2)) for _ in range(n)]) for k, n in (("a", 0), ("b", 1), ("c", 200), ("d", 1000))] + [("e", None)], "k string, v array<double>")
    made = df.select("k", F.when(F.col("v").isNotNull(), quantile_digest.digest_of_sorted("v", 50)).alias("digest")).withColumn("digest", F.expr("array_sort(digest)"))
    back = made.select("k", "digest", quantile_digest.digest_text(F.col("digest")).alias("t")).withColumn("back", quantile_digest.digest_of_text(F.col("t"))).collect()
    for x in back:
        if x.digest is None:
            assert x.t is None and x.back is None
            continue
        assert [(c.w, c.lo, c.hi) for c in x.back] == [(c.w, c.lo, c.hi) for c in x.digest] and [c.mean for c in x.back] == pytest.approx([c.mean for c in x.digest], abs=6e-4)


def test_merging_digests(spark):
    r = random.Random(1)
    values = [(k, i % 7, r.lognormvariate(5, 1)) for k in "xy" for i in range(3000)] + [("z", 0, 1.0)] * 500
    df = spark.createDataFrame(values, "k string, part int, value double")
    leaf = df.groupBy("k", "part").agg(F.sort_array(F.collect_list("value")).alias("v")).withColumn("digest", quantile_digest.digest_of_sorted("v", 100)).drop("v")
    leaf = leaf.unionByName(leaf.limit(1).select("k", F.lit(99).alias("part"), F.lit(None).cast(leaf.schema["digest"].dataType).alias("digest")))
    merged = quantile_digest.with_estimates(quantile_digest.merge_digests(leaf, ["k"], 100, parts=4, spread=("part",)))
    got = {x.k: x for x in quantile_digest.certify(df.select("k", "value"), merged, ["k"]).collect()}
    assert got["x"].n == 3000 and got["x"].rank_error < 0.02 and got["z"].estimates == [1.0] * 6 and got["z"].rank_error == 0.0
    assert len(got["x"].digest) <= 101


def test_shard_medians(spark):
    schema = "stat_day string, shard int, key_a string, key_b string, n long, geo_mean_ms double, median_ms double"
    rows = [("d", 0, "a", "b", 10, 100.0, 90.0), ("d", 1, "a", "b", 30, 110.0, 0.105), ("d", 1, "a", "b", 30, 110.0, 0.105), ("e", 0, "a", "b", 5, 100.0, None), ("e", 1, "a", "b", 5, 100.0, -120.0), ("e", 2, "q", "r", 2, 50.0, None)]
    df = spark.createDataFrame(rows, schema)
    fixed = sorted((x.stat_day, x.shard, x.median) for x in quantile_digest.repaired_medians(df).filter("key_a = 'a'").collect())
    assert [(a, b, None if m is None else round(m, 6)) for a, b, m in fixed] == [("d", 0, 90.0), ("d", 1, 105.0), ("e", 0, None), ("e", 1, 120.0)]
    got = {x.key_a: x for x in quantile_digest.combined_medians(df).collect()}
    assert (got["a"].n, got["a"].n_unknown, round(got["a"].median), got["a"].lowest, got["a"].highest) == (50, 5, 105, 90.0, 120.0)
    assert got["a"].rank_low == pytest.approx(0.4) and got["a"].rank_high == pytest.approx(1 - 0.35) and got["q"].median is None and got["q"].n_unknown == 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20), st.integers(1, 8))
def test_plans_hold_every_item_once(counts, groups):
    plan = packing.plan_containers(counts, 64, groups)
    room = Counter()
    for length, slots in plan.slots.items():
        seen = []
        for first, n, container in slots:
            seen += range(first, first + n)
            for j in range(n):
                room[container + j] += length
        assert sorted(seen) == list(range(counts[length])) and [s[0] for s in slots] == sorted(s[0] for s in slots)
    assert set(plan.slots) == set(counts) and max(room.values(), default=0) <= 64 and set(room) == set(range(plan.containers))
    # Rounding makes at most one group in ``packing.GROUPS`` much larger than its items.
    volume = sum(x * n for x, n in counts.items())
    assert packing.plan_containers(counts, 64).containers <= 2 * volume / 64 + 1 + sum(counts.values()) / packing.GROUPS


def test_packing_scales_with_lengths_not_items():
    r = random.Random(2)
    counts = Counter(min(2048, max(1, int(r.lognormvariate(5.3, 0.9)))) for _ in range(20_000))
    small, large = packing.plan_containers(dict(counts)), packing.plan_containers({k: v * 10**6 for k, v in counts.items()})
    fill = sum(k * v for k, v in counts.items()) / 2048 / small.containers
    assert fill > 0.99 and sum(map(len, large.slots.values())) < 30 * len(counts)


def test_pack_documents(spark):
    docs = [(i, "word " * n) for i, n in enumerate([3, 700, 1500, 2000, 5000, 0, 10, 10, 10])] + [(100, None), (101, ""), (3, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x"))
    got = packing.pack_documents(df).collect()
    sizes = {(i, t): n for (i, t), n in zip(docs, [x.n_tokens for x in packing.token_counts(df).collect()])}
    assert sizes[100, None] is None and sizes[101, ""] == 0
    room = Counter()
    for x in got:
        if x.container is not None:
            room[x.container] += x.n_tokens
    assert max(room.values()) <= 2048 and sum(room.values()) == sum(n or 0 for n in sizes.values())
    by_doc = defaultdict(list)
    for x in got:
        by_doc[x.doc_id].append(x)
    assert [x.container for x in by_doc[100]] == [None] and [x.container for x in by_doc[101]] == [0]
    assert all(len(v) == 1 for k, v in by_doc.items() if k not in (3, 4)) and len(by_doc[4]) > 1
    pieces = sorted(by_doc[4], key=lambda x: x.piece_no)
    assert all(x.n_tokens == 2048 for x in pieces[:-1]) and [x.token_from for x in pieces] == [2048 * i for i in range(len(pieces))]
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_reading_levels_on_held_out_documents(spark):
    r = random.Random(4)
    by_grade = {g: [f"w{g}x{i}" + "y" * g for i in range(40)] for g in range(1, 7)}

    def text(g):
        return " ".join(r.choice(by_grade[r.choice([h for h in range(1, g + 1)] + [g])]) for _ in range(80))

    docs = [(i, text(1 + i % 6)) for i in range(240)] + [(900, None), (901, ""), (902, "?!"), (903, "unknown words only here")]
    labels = [(i, rater, max(1, min(6, 1 + i % 6 + r.choice([0, 0, 0, 1, -1])))) for i in range(180) for rater in range(3)] + [(5, 9, None), (6, 9, 77), (5000, 1, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("grade", F.lit("x"))
    lab = spark.createDataFrame(labels, "doc_id long, rater_id int, grade int")
    model = reading_level.fit(df, lab)
    got = {x.doc_id: x for x in reading_level.reading_levels(df, model).collect()}
    truth, guess = np.array([1 + i % 6 for i in range(180, 240)]), np.array([got[i].level for i in range(180, 240)])
    assert np.abs(truth - guess).mean() < 0.8 and np.corrcoef(truth, guess)[0, 1] > 0.9
    assert got[900].level is None and got[901].level is None and got[902].level is None and 1 <= got[903].level <= 6 and got[903].known_share == 0.0
    plain = reading_level.fit(df, lab.limit(0))
    assert plain.level("some words")[0] == pytest.approx(3.5) and reading_level.reading_levels(df.limit(0), model).count() == 0


def test_queries_registered(spark):
    from keyloom.llm import catalog

    assert {f"p{n}_found" for n in (2, 4, 5, 6, 9)} <= set(catalog.QUERIES) and set(catalog.ORACLE) <= set(catalog.QUERIES)
