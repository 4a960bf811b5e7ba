import math
import random

import pytest
from builders import SESSION, bksp, cursor, key, long, seldel, sessions, typist
from pyspark.sql import functions as F

from keyloom.functions import bins
from keyloom.operators import codec, compare, composition, controls, convergence, labels, readout, replay, signatures, timing, transcription, writer_split

KEYS = ("writer", "session_id")


def buffer_text(events):
    buf = replay.TextBuffer()
    for i, (kind, _, _, ch, pos, a, b) in enumerate(events):
        if why := buf.apply(kind, ch, pos, a, b):
            return buf.text, buf.cursor, why, i
    return buf.text, buf.cursor, None, -1


def random_session(r, n):
    out, size, t = [], 0, 0.0
    for _ in range(n):
        t += r.choice([0, 40, 120, 1500])
        kind = r.random()
        if kind < 0.7 or not size:
            out.append(key(r.choice("ab .é"), t))
            size += 1
        elif kind < 0.8:
            out.append(bksp(t))
        elif kind < 0.9:
            out.append(cursor(r.randrange(size + 2), t))
        else:
            a = r.randrange(size)
            out.append(seldel(a, a + r.randrange(3), t))
    return out


def test_fold_equals_buffer(spark):
    r = random.Random(3)
    lists = [random_session(r, n) for n in (0, 1, 5, 20, 40, 60) for _ in range(6)] + [[("odd", 1.0, None, None, None, None, None)], [key("ab", 1)]]
    got = sessions(spark, *lists).select("session_id", replay.replay(F.col("events")).alias("z")).orderBy("session_id").collect()
    for row, events in zip(got, lists):
        assert (row.z.text, row.z.cursor, row.z.err, row.z["at"]) == buffer_text(events)
    starts = sessions(spark, *lists).select("session_id", replay.window_starts(F.col("events"), 7).alias("s")).orderBy("session_id").collect()
    for row, events in zip(starts, lists):
        if buffer_text(events)[2] is None:
            assert [(s.text, s.cursor) for s in row.s] == [buffer_text(events[:i])[:2] for i in range(0, len(events), 7)]
        else:
            assert row.s is None


def test_bins(spark):
    edges = bins.EDGES
    values = [0.0, 0.5, 1.0, 1e9, *edges, *(math.nextafter(e, 0) for e in edges), *(math.nextafter(e, 1e9) for e in edges), *map(float, range(0, 3000, 7))]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select("v", bins.to_bin(F.col("v")).alias("k"))
    for row in df.collect():
        if row.v is None:
            assert row.k is None
        else:
            x = min(max(row.v, 1.0), 120000.0)
            assert row.k == min(max(sum(e <= x for e in edges) - 1, 0), 127)
    centers = spark.range(128).select("id", bins.to_bin(bins.from_bin(F.col("id"))).alias("k")).collect()
    assert all(r.id == r.k for r in centers)
    knobs = spark.createDataFrame([(61.4, 0.025, 0.0), (999.0, 0.9, 0.9), (-1.0, 0.0, 0.0039)], "w double, p double, r double")
    got = [tuple(x) for x in knobs.select(bins.wpm_bin(F.col("w")), bins.pct_bin(F.col("p")), bins.rev_bin(F.col("r"))).collect()]
    assert got == [(12, 2, 0), (39, 30, 30), (0, 0, 8)]


def test_timing_vectors(spark):
    lists = [[key("x", t) for t in (0, 100, 220)], [key("x", t) for t in (0, 100, 5100, 5200, 8200)], [key("x", t) for t in (0, 100, 200, 3200, 3300, 3400)], [key("x", t) for t in (0, 1000)]]
    pool = {}
    for r in timing.feature_pool(long(sessions(spark, *lists))).collect():
        pool.setdefault((r.session_id, r.feature), []).append(r.value)
    assert sorted(pool[0, "iki"]) == [100, 120]
    assert sorted(pool[1, "pause"]) == [3000, 5000]
    assert pool[2, "burst"] == [3, 3]
    assert (3, "pause") not in pool  # exactly 1000 is no pause
    gaps = [0, 100, 100, 2500, 100, 100, 100, 2500, 100]
    assert sorted(r.value for r in timing.burst_lengths(long(sessions(spark, typist("a" * 9, gaps))), 2000.0).collect()) == [2, 3, 4]
    assert [r.value for r in timing.burst_lengths(long(sessions(spark, typist("ab", [0, 2000]))), 2000.0).collect()] == [2]


def test_serial_features_of_short_and_even_sessions(spark):
    even = typist("a" * 30)
    rows = {r.session_id: r for r in timing.serial_features(long(sessions(spark, even, [key("a", 0)], typist("ab")))).collect()}
    for i in rows:
        assert (rows[i].lag1, rows[i].von_neumann, rows[i].local_spread) == (0.0, 2.0, 1.0)
    import numpy as np

    r = random.Random(5)
    gaps = [0] + [int(math.exp(r.gauss(4.8, 0.5))) for _ in range(120)]
    text = "".join(r.choice("ab ") for _ in gaps)
    x = np.log1p(np.array(gaps[1:], dtype=float))
    row = timing.serial_features(long(sessions(spark, typist(text, gaps)))).first()
    assert row.lag1 == pytest.approx(np.corrcoef(x[:-1], x[1:])[0, 1], abs=1e-9)
    assert row.von_neumann == pytest.approx(np.mean(np.diff(x) ** 2) / x.var(), abs=1e-9)
    assert row.local_spread == pytest.approx(np.mean([x[i : i + 8].std() for i in range(0, len(x) - 7, 8)]) / x.std(), abs=1e-9)
    assert row.drift == pytest.approx(abs(x[:60].mean() - x[60:].mean()) / x.std(), abs=1e-9)
    space = np.array([c == " " for c in text[:-1]])
    assert row.word_boundary == pytest.approx(x[space].mean() - x[~space].mean(), abs=1e-9)


def test_pause_classes(spark):
    a = typist("ab. cd ef", [0, 100, 100, 100, 900, 100, 100, 300, 100])
    b = [key("a", 0), key(" ", 100), bksp(200), key("b", 500)]
    got = {}
    for r in signatures.pauses_at_boundaries(sessions(spark, a, b), KEYS).collect():
        got.setdefault((r.session_id, r.feature), []).append(r.value)
    assert got[0, "pause_clause_boundary"] == [900] and got[0, "pause_word_boundary"] == [300] and got[0, "pause_within_word"] == [100] * 6
    assert sorted(got[1, "pause_within_word"]) == [100, 300] and (1, "pause_word_boundary") not in got
    texts = spark.createDataFrame([("a. ",), ("a ",), ("a",), ("",), (" ",), ("\n",)], "t string")
    assert [r[0] for r in texts.select(replay.pause_class(F.col("t"))).collect()] == ["clause_boundary", "word_boundary", "within_word", "within_word", "word_boundary", "within_word"]


def test_revision_ops(spark):
    events = [key("a", 0), bksp(1), bksp(2), key("b", 3), cursor(0, 4), key("c", 5), seldel(0, 1, 6), bksp(7)]
    df = long(sessions(spark, events))
    row = signatures.revision_ops(df, KEYS).first()
    assert (row.bksp_frac, row.cursor_count, row.seldel_count) == (3 / 8, 1, 1)
    assert sorted(r.value for r in signatures.revision_episodes(df, KEYS).collect()) == [1, 2]


def test_labels(spark):
    rows = {r.session_id: r for r in labels.session_labels(sessions(spark, typist("a" * 25), typist("hello") + [cursor(0, 900), seldel(0, 2, 1000)], [], [key("a", 0)], target="a" * 25)).collect()}
    assert rows[0].wpm == pytest.approx(125.0) and rows[0].uncorrected_error_rate == 0.0
    assert rows[1].revision_rate == 2 / 7 and rows[1].corrected_error_rate == pytest.approx(2 / 5)
    assert [rows[2][r] for r in labels.RATES] == [0.0] * 4
    assert rows[3].wpm == 0.0
    tokens = spark.createDataFrame([(61.4, 0.031, 0.004, 0.0), (1e6, 1.0, 1.0, 1.0)], "wpm double, corrected_error_rate double, uncorrected_error_rate double, revision_rate double")
    assert [r[0] for r in tokens.select(labels.label_tokens(F.lit("transcription"))).collect()] == ["<MODE:T><WPM:12><ECOR:3><EUNC:0><REV:0>", "<MODE:T><WPM:39><ECOR:30><EUNC:30><REV:30>"]


def test_windows_and_examples(spark):
    events = typist("abcdefgh") + [cursor(2, 900), key("X", 1000), seldel(0, 2, 1100)]
    windows = labels.windows(labels.session_labels(sessions(spark, events, target="Xcdefgh")), KEYS, size=4)
    rows = windows.orderBy("window_no").collect()
    assert [(r.start_text, r.start_cursor, r.prev_press, len(r.events)) for r in rows] == [("", 0, None, 4), ("abcd", 4, 300.0, 4), ("abcdefgh", 8, 700.0, 3)]
    assert [round(r.revision_rate, 6) for r in rows] == [0.0, 0.0, round(2 / 3, 6)]
    examples = labels.training_examples(windows, KEYS, "composition").orderBy("window_no").collect()
    assert examples[0].prompt.endswith("<TARGET>Xcdefgh<PROCESS>") and "<WRITTEN>abcdefgh<CUR:8>" in examples[2].prompt
    assert not examples[0].completion.startswith("<DT") and examples[1].completion.startswith("<DT:")
    assert "<SELDEL:0-2>" in examples[2].completion
    refused = labels.windows(labels.session_labels(sessions(spark, typist("é"), typist("ok"), target="a<TARGET>")), KEYS)
    assert labels.training_examples(refused, KEYS, "composition").count() == 0
    repeated = labels.repeat_revisions(labels.training_examples(windows, KEYS, "composition"), 3, 5)
    assert repeated.count() == 5


def test_codec_round_trip_and_grammar(spark):
    r = random.Random(7)
    t, events = 0, []
    for c in 'ab <>\n\t"é:-9':
        t += r.randrange(1, 3000)
        events.append(key(c, t, t + r.randrange(300)))
    events += [bksp(t + 50), cursor(3, t + 80), seldel(0, 2, t + 95)]
    df = sessions(spark, events)
    stream = df.select("session_id", codec.serialize("events").alias("s"))
    back = codec.parse_tokens(stream, "session_id", "s").orderBy("seq").collect()
    grid = codec.roundtrip(long(df)).orderBy("seq").collect()
    assert [(b.type, b.ch, b.pos, b.sel_start, b.sel_end) for b in back] == [(g.type, g.ch, g.pos, g.sel_start, g.sel_end) for g in grid]
    assert [b.press for b in back] == pytest.approx([g.press for g in grid])
    assert [b.release for b in back if b.release] == pytest.approx([g.release for g in grid if g.release])
    twice = codec.roundtrip(codec.roundtrip(long(df))).orderBy("seq").collect()
    assert [x.press for x in twice] == pytest.approx([g.press for g in grid])
    bad = {
        "<a:1><DT:2><b:3>": None, "": None, "<a:1><b:3>": "missing_gap", "<a:1><DT:1><DT:2><b:3>": "double_gap", "<a:1><DT:2>": "dangling_gap", "x<a:1>": "stray_text", "<DT:1><a:1>": None, "<a:128>": "bin_range",
        "<a:1><DT:200><b:1>": "bin_range", "<CUR:500>": None,
    }
    streams = spark.createDataFrame(list(enumerate(bad)), "id long, s string")
    assert {i.s: i.error for i in streams.join(codec.grammar_errors(streams, "id", "s"), "id").collect()} == bad
    cut = spark.createDataFrame([("<a:1><DT:2><CUR:1",), ("<a:1><DT:2><b:3><DT:1>",), ("junk",)], "s string")
    assert [r[0] for r in cut.select(codec.sound_prefix(F.col("s"))).collect()] == ["<a:1>", "<a:1><DT:2><b:3>", ""]
    assert codec.vocabulary(spark).count() == 12812


def test_normalize_typable(spark):
    df = spark.createDataFrame([("“a”—b…\r\nc\rd​ e",), (None,)], "t string")
    assert [r[0] for r in df.select(codec.normalize_typable(F.col("t"))).collect()] == ['"a"-b...\nc\nd e', None]


def test_transcription(spark):
    schema = "participant_id long, test_section_id long, sentence string, user_input string, keystroke_id long, press_time long, release_time long, letter string, keycode int, loaded_at string"
    rows = [
        (1, 1, "Hi", "Hi", 1, 1000, 1010, "SHIFT", 16, "x"), (1, 1, "Hi", "Hi", 2, 1100, 1050, "H", 72, "x"), (1, 1, "Hi", "Hi", 3, 1200, None, "x", 88, "x"), (1, 1, "Hi", "Hi", 4, 1200, 1290, "bksp", 8, "x"),
        (1, 1, "Hi", "Hi", 5, 1300, 1350, "i", 73, "x"), (1, 1, "Hi", "Hi", 5, 1300, 1350, "i", 73, "y"), (1, 1, "Hi", "Hi", 6, None, None, "q", 1, "x"),
        (1, 2, "ab", "ab", 1, 5, 6, "a", 1, "x"), (1, 2, "ab", "ab", 2, 7, 8, None, 1, "x"),
        (2, 3, "ab", None, 1, 5, 6, "a", 1, "x"), (2, 4, "abc", "zzz", 1, 5, 6, "a", 1, "x"), (None, 5, "a", "a", 1, 5, 6, "a", 1, "x"),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r.writer, r.session_id): r for r in transcription.verified_sessions(df).collect()}
    assert {k: v.reason for k, v in got.items()} == {(1, 1): None, (1, 2): "unlogged_letter", (2, 3): "no_submission", (2, 4): "replay_mismatch"}
    assert got[1, 1].produced == "Hi"
    assert [(e.type, e.press, e.release) for e in got[1, 1].events] == [("key", 0.0, 0.0), ("key", 100.0, 100.0), ("bksp", 100.0, 190.0), ("key", 200.0, 250.0)]
    assert transcription.verified_sessions(df.limit(0)).count() == 0


def test_composition(spark):
    rows = [(0, 100, "Input", "a", 1), (200, 300, "Input", "b", 2), (1000, 1000, "Nonproduction", "", 0), (10000, 10100, "Input", "c", 1)]
    text, events, reason = composition.parse_rows(iter(rows))
    assert (text, reason) == ("cab", None) and [e[:2] for e in events] == [("key", 0.0), ("key", 200.0), ("cursor", 1000.0), ("key", 10000.0)]
    more = [*rows, (11000, 11010, "Remove/Cut", "ca", 0), (12000, 12010, "Replace", "b => xy", 2), (13000, 13001, "Remove/Cut", "y", 1)]
    assert composition.parse_rows(iter(more))[0] == "x"
    assert composition.parse_rows(iter([*rows, (1, 2, "Paste", "x", 3)]))[2] == "unsupported: paste"
    assert composition.parse_rows(iter([*rows, (1, 2, "Paste", "x", None)]))[2] is None
    assert composition.parse_rows(iter([(0, 1, "Input", "a", 9)]))[2] == "cursor outside the text"
    assert composition.parse_rows(iter([(None, 1, "Input", "a", 1)]))[2] == "no time in the first row"
    assert composition.parse_rows(iter([])) == ("", [], None)
    schema = "log_id long, writer string, down_time long, up_time long, activity string, text_change string, cursor_position long"
    log = [(i, "w", d, u, a, t or "NoChange", c) for i, (d, u, a, t, c) in enumerate(rows)] * 2 + [(9, None, 0, 1, "Input", "a", 1), (10, "e", 0, 1, None, None, None)]
    parsed = composition.parse_composition(spark.createDataFrame(log, schema))
    got = {r.writer: r for r in parsed.collect()}
    assert got["w"].text == "cab" and got["e"].text == "" and set(got) == {"w", "e"}
    gold = spark.createDataFrame([("w", "cab\n\n"), ("e", "x")], "writer string, gold string")
    assert [r.writer for r in composition.exact_sessions(parsed, gold).collect()] == ["w"]
    change = spark.createDataFrame([("a\\nb",), ('\\"',), ("\\\\n",), ("NoChange",), (None,)], "c string")
    assert [r[0] for r in change.select(composition.unescaped_change(F.col("c"))).collect()] == ["a\nb", '"', "\\\n", "", ""]


def test_compare(spark):
    import numpy as np

    r = random.Random(2)
    a, b = [r.lognormvariate(4.8, 0.5) for _ in range(400)], [r.lognormvariate(5.0, 0.4) for _ in range(300)]
    pool = spark.createDataFrame([("iki", "a", v) for v in a] + [("iki", "b", v) for v in b] + [("few", "a", 1.0)], "feature string, side string, value double")
    got = {x.feature: x for x in compare.compare_pools(pool).collect()}
    edges = np.geomspace(min(a + b), max(a + b) + 1, 65)
    p, q = (np.histogram(v, edges)[0] / len(v) + 1e-9 for v in (a, b))
    p, q = p / p.sum(), q / q.sum()
    assert got["iki"].kl == pytest.approx(0.5 * float(((p - q) * np.log(p / q)).sum()), rel=1e-6)
    la, lb = np.log1p(a), np.log1p(b)
    assert got["iki"].frechet == pytest.approx((la.mean() - lb.mean()) ** 2 + (la.std() - lb.std()) ** 2)
    assert got["few"].kl is None and got["few"].frechet is None
    with pytest.raises(Exception, match="negative"):
        compare.compare_pools(pool.withColumn("value", -F.col("value"))).collect()


def test_controls(spark):
    df = long(sessions(spark, typist("abcdefgh", [0, 10, 20, 30, 40, 50, 60, 70]), typist("ab")))
    mixed = controls.shuffle_timing(df, KEYS, seed=4).orderBy("session_id", "seq").collect()
    first = [r for r in mixed if r.session_id == 0]
    assert sorted(y.press - x.press for x, y in zip(first, first[1:])) == [10, 20, 30, 40, 50, 60, 70]
    assert [r.ch for r in first] == list("abcdefgh") and all(r.release - r.press == 50 for r in first)
    assert [r.press for r in mixed if r.session_id == 1] == [0, 100]
    typed = controls.heuristic_baseline(sessions(spark, [], target="hello wörld").withColumn("wpm", F.lit(60.0))).orderBy("seq").collect()
    assert "".join(r.ch for r in typed) == "hello wörld" and typed[0].press == 0 and all(y.press > x.press for x, y in zip(typed, typed[1:]))


def test_split_is_stable_under_subsets(spark):
    df = spark.createDataFrame([(f"w{i}",) for i in range(500)] + [(None,)], "writer string")
    for split in (writer_split.split_by_writer, writer_split.split_by_blake2b):
        whole = {r.writer: r.side for r in split(df, test_share=0.2, seed=3).collect()}
        part = {r.writer: r.side for r in split(df.filter("writer < 'w3'"), test_share=0.2, seed=3).collect()}
        assert all(whole[w] == s for w, s in part.items()) and None not in whole
        assert 60 < sum(s == "test" for s in whole.values()) < 140
    with pytest.raises(ValueError):
        writer_split.check_sides(spark.createDataFrame([("a", "train")], "writer string, side string"))


def test_readout(spark):
    df = long(sessions(spark, *(typist("ab cd ef gh ij", [0] + [random.Random(i).randrange(50, 400) for _ in range(13)]) for i in range(12))))
    band = readout.real_band(df)
    rows = readout.serial_readout(codec.roundtrip(df), band).collect()
    assert len(rows) == 12 * 9 and all(r.p10 <= r.p90 for r in rows)


def test_convergence(spark):
    def brute(text, target):
        def lev(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                new = [i]
                for j, y in enumerate(b, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            return row[-1]

        return min(lev(text, target[:k]) for k in range(len(target) + 1))

    r = random.Random(9)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(9))) for _ in range(2))
        assert convergence.prefix_depth(a, b) == brute(a, b)
    for low, high in ((0, 0), (0, 7), (5, 5), (3, 27), (10, 105), (99, 100)):
        reach = {""}
        closed = set()
        frontier = [""]
        while frontier:
            d = frontier.pop()
            digits, done = convergence.number_moves(d, low, high)
            if done:
                closed.add(int(d))
            frontier += [d + x for x in digits]
            reach |= {d + x for x in digits}
        assert closed == set(range(low, high + 1))
    df = spark.createDataFrame([("abc", 3, "abcd"), ("abX", 3, "abcd"), ("abXY", 4, "ab"), ("abcd", 0, "abcd")], "t string, c int, g string")
    got = df.select(convergence.finish_tokens(F.col("t"), F.col("c"), F.col("g")), convergence.finish_tokens(F.col("t"), F.col("c"), F.col("g"), revisions=False), convergence.common_prefix(F.col("t"), F.col("g"))).collect()
    assert [x[2] for x in got] == [3, 2, 2, 4] and got[0][0] == 3 and got[3][0] == 1 and got[1][1] == 2 * 1 + 2 * 2 + 1
    audit = convergence.audit(sessions(spark, typist("abd") + [bksp(400)] + [key("c", 500)], target="abc")).first().audit
    assert (audit.on_path, audit.deepest, audit.stalest) == (3, 1, 1)


def test_validity_and_stats(spark):
    df = sessions(spark, typist("target"), [], typist("zzzz"), [*typist("target"), cursor(0, 900)], target="target")
    got = {r.session_id: (r.valid, r.reason) for r in signatures.validity(df, KEYS).collect()}
    assert got == {0: (True, None), 1: (False, "no events"), 2: (False, "too far from the target"), 3: (False, "off-type events")}
    stats = {r.session_id: r for r in signatures.session_stats(df, KEYS).collect()}
    assert stats[0].exact and stats[0].span_ms == 550.0 and stats[1].span_ms == 0.0
    assert signatures.session_stats(spark.createDataFrame([], SESSION), KEYS).count() == 0
