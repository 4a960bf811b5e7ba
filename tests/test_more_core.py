import json
import math
import random

import numpy as np
import pytest
from builders import cursor, key, long, seldel, sessions, typist
from pyspark.sql import functions as F

from keyloom.operators import annotated, classify, gates, geometry, heldout, knobs, revision, timing_pools
from keyloom.operators.replay import CLAUSE, WITHIN, WORD
from keyloom.sources import readers, writers

KEYS = ("writer", "session_id")


def test_annotated(spark):
    schema = "writer long, session_id long, row_no long, input_time double, key_symbol string, input string, finger string, target string, submitted string"
    rows = [
        (1, 1, 1, 10.0, "Shift_L", "", "L_Little", "t", "s"), (1, 1, 2, 10.1, None, "x", None, "t", "s"), (1, 1, 3, 10.2, "Control_L", "", "L_Little", "t", "s"), (1, 1, 4, 10.3, "h", "h", "R_Index", "t", "s"),
        (1, 1, 5, 10.4, "i", "i", "R_Middle", "t", "s"), (1, 1, 6, 10.5, "Shift_R", "", "R_Little", "t", "s"), (1, 1, 7, 10.6, "BackSpace", "", "R_Little", "t", "s"), (1, 1, 8, 10.7, "space", "x", "L_Thumb", "t", "s"),
        (1, 1, 9, 10.8005, "dead", "´e", None, "t", "s"), (2, 1, 1, None, "a", "a", None, "t", "s"),
    ]
    got = annotated.parse_annotated(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    assert [(r.type, r.ch, r.press, r.finger) for r in got] == [("key", "H", 0.0, "R_Index"), ("key", "i", 100.0, "R_Middle"), ("bksp", None, 300.0, "R_Little"), ("key", " ", 400.0, "L_Thumb"), ("key", "´", 500.0, None), ("key", "e", 500.0, None)]


def test_digraphs(spark):
    events = [*typist("the at", [0, 60, 61, 62, 63, 64]), ("bksp", 400.0, 410.0, None, None, None, None), key("b", 450), key("B", 500), key("a", 500)]
    df = long(sessions(spark, events))
    got = {(r.key_a, r.key_b): r.gap for r in geometry.digraphs(df).collect()}
    assert got == {("t", "h"): 60, ("h", "e"): 61, ("e", " "): 62, (" ", "a"): 63, ("a", "t"): 64}
    many = long(sessions(spark, *(typist("ab", [0, 100 + i]) for i in range(25)), typist("ba")))
    matrix = {(r.key_a, r.key_b): r for r in geometry.digraph_matrix(many).collect()}
    assert matrix["a", "b"].n == 25 and matrix["a", "b"].geo_mean_ms == pytest.approx(math.exp(np.log(np.arange(100, 125)).mean()), abs=1e-5)
    assert matrix["b", "a"].masked_ms is None
    assert {(r.key_a, r.key_b): r.n for r in geometry.text_bigrams(spark.createDataFrame([("the the",), ("A é",), (None,), ("",)], "t string"), "t").collect()} == {("t", "h"): 2, ("h", "e"): 2, ("e", " "): 1, (" ", "t"): 1}
    classes = {(r.key_a, r.key_b): r["class"] for r in geometry.with_classes(spark.createDataFrame([("e", "d"), ("a", "a"), ("a", "s"), ("a", "k"), ("a", " ")], "key_a string, key_b string")).collect()}
    assert classes == {("e", "d"): "same_finger", ("a", "a"): "repeat", ("a", "s"): "same_hand", ("a", "k"): "alternate", ("a", " "): "alternate"}


def test_layout_recovery():
    latency = geometry.synthetic_latencies(0)
    blind, aware = geometry.reconstruct(latency, "blind"), geometry.reconstruct(latency, "finger_aware")
    assert aware["distance_spearman"] > 0.85 and blind["distance_spearman"] > 0.75 and blind["same_finger_auc"] > 0.9
    assert 25 <= blind["detected"].sum() / 2 <= 70 and int(geometry.true_same_finger().sum() / 2) == 41
    truth = np.array([geometry.positions()[k] for k in geometry.KEYS])
    turned = truth @ np.array([[0.0, -3.0], [-3.0, 0.0]]) + 5
    fitted, missed = geometry.fitted_to(turned, truth)
    assert np.allclose(fitted, truth) and missed == pytest.approx(0.0, abs=1e-9)
    assert geometry.permutation_p(turned, truth, n=50) < 0.05
    with pytest.raises(ValueError):
        geometry.reconstruct(latency, "other")


def test_auc_and_law_from_a_matrix(spark):
    latency = geometry.synthetic_latencies(0, noise=0.0)
    rows = [(a, b, 50, float(latency[i, j]), float(latency[i, j])) for i, a in enumerate(geometry.KEYS) for j, b in enumerate(geometry.KEYS)]
    matrix = spark.createDataFrame(rows, "key_a string, key_b string, n long, geo_mean_ms double, masked_ms double")
    auc = geometry.finger_auc(matrix).first()
    assert (auc.positives, auc.negatives) == (41, 310) and 0.5 < auc.auc < 1.0
    assert geometry.layout_reconstruction(matrix).count() == 27
    assert {r["class"] for r in geometry.distance_law(matrix).collect()} == {"same_finger", "same_hand", "alternate"}


def test_revision_sessions(spark):
    pools = spark.createDataFrame([(p, i, 3, 100.0 + i, 50.0) for p in (WITHIN, WORD, CLAUSE, "think", "operation") for i in range(3)], "pool string, nr long, n long, gap double, hold double")
    act = lambda b, a, s, e: (b, a, s, e)
    rows = [
        ("one", 1, "the cat sat", "the dog sat", [act("cat", "dog", 4, 7)]),
        ("one", 2, "the dog sat", "a dog sat down", [act("the", "a", 0, 3), act("", " down", 11, 11)]),
        ("one", 5, "other", "other!", [act("", "!", 5, 5)]),
        ("curly", 1, "“a…b” x", '"a...b" y', [act("x", "y", 6, 7)]),
        ("residue", 1, "aa bb cc", "aa cc", [act("bb", "", 3, 5)]),
        ("far", 1, "a", "b" * 60, []),
        ("wrong", 1, "abc", "abd", [act("x", "d", 2, 3)]),
    ]
    df = spark.createDataFrame(rows, revision.DOCUMENT)
    chains = {(r.doc_id, r.revision_depth): r.chain for r in revision.revision_chains(df).collect()}
    assert (chains["one", 1], chains["one", 2], chains["one", 5]) == (0, 0, 1)
    got = {(r.doc_id, r.chain): r for r in revision.revision_sessions(df, pools).collect()}
    assert {k: v.reason is None for k, v in got.items()} == {("one", 0): True, ("one", 1): True, ("curly", 0): True, ("residue", 0): True, ("far", 0): False, ("wrong", 0): False}
    assert got["one", 0].target == "a dog sat down" and got["curly", 0].target == '"a...b" y'
    from test_sessions_core import buffer_text

    for r in got.values():
        if r.reason is None:
            assert buffer_text([tuple(e) for e in r.events])[:1] == (r.target,)
            assert all(b.press > a.press for a, b in zip(r.events, r.events[1:]))
    pairs = spark.createDataFrame([("d", 0, "a b c", "a x c"), ("d", 1, "same", "same"), ("e", 0, "", "new")], "doc_id string, nr int, before_sent string, after_sent string")
    done = {(r.doc_id, r.chain): r.target for r in revision.sentence_sessions(pairs, pools).collect()}
    assert done == {("d", 0): "a x c", ("e", 0): "new"}
    r = random.Random(1)
    texts = [("".join(r.choice("ab") for _ in range(r.randrange(9))), "".join(r.choice("ab") for _ in range(r.randrange(9)))) for _ in range(60)]
    for x in revision.edit_spans(spark.createDataFrame(texts, "b string, a string"), "b", "a").collect():
        assert x.b[: x.start] + x.inserted + x.b[x.stop :] == x.a and x.start <= x.stop


def test_revision_edits_and_repairs():
    r = random.Random(7)
    for _ in range(200):
        text = "".join(r.choice("ab c…\u200b\r\n“") for _ in range(r.randrange(20)))
        offsets = revision.typable_offsets(text)
        assert len(offsets) == len(text) + 1 and offsets[-1] == len(revision.typable(text))
        for i in range(len(text) + 1):
            if text[i - 1 : i + 1] != "\r\n":
                assert offsets[i] == len(revision.typable(text[:i]))
    play = lambda text, edits: [text := text[: s[1]] + text[s[2] :] if s[0] == "seldel" else text[: edits_[0][1]] + s[1] + text[edits_[0][1] :] for edits_ in edits for s in edits_ if s[0] != "cursor"][-1] if edits else text
    acts = [{"before": "b", "after": "xyz", "start_char_pos": 1, "end_char_pos": 2}, {"before": "", "after": "!", "start_char_pos": 4, "end_char_pos": 4}, {"before": "d", "after": "", "start_char_pos": 3, "end_char_pos": 4}]
    assert play("abcd", revision.pass_edits("abcd", acts)) == "axyzc!" and revision.pass_edits("abcd", []) == []
    for bad in ([{"before": "x", "after": "", "start_char_pos": 0, "end_char_pos": 1}], [{"before": "", "after": "", "start_char_pos": 9, "end_char_pos": 9}], [{"before": "ab", "after": "x", "start_char_pos": 0, "end_char_pos": 2}, {"before": "bc", "after": "y", "start_char_pos": 1, "end_char_pos": 3}]):
        with pytest.raises(revision.Unsound):
            revision.pass_edits("abcd", bad)
    for _ in range(300):
        a = "".join(r.choice("abc") for _ in range(r.randrange(14)))
        b = "".join(r.choice("abc") for _ in range(r.randrange(14)))
        made = revision.reconcile(a, b, 5)
        rows = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            rows, last = [i], rows
            for j, y in enumerate(b, 1):
                rows.append(min(last[j] + 1, rows[-1] + 1, last[j - 1] + (x != y)))
        assert (made is not None) == (rows[-1] <= 5)
        if made is not None:
            assert play(a, made) == b and [e[0][1] for e in made] == sorted((e[0][1] for e in made), reverse=True)


def test_sessions_draw_from_whole_pools(spark):
    gap = F.when(F.col("nr") < 5_000, 100.0).otherwise(900.4)
    names = F.explode(F.array(*(F.lit(p) for p in (WITHIN, WORD, CLAUSE, "think", "operation")))).alias("pool")
    pools = spark.range(20_000).select(names, F.col("id").alias("nr")).select("pool", "nr", F.lit(20_000).alias("n"), gap.alias("gap"), F.lit(0.2).alias("hold"))
    counts = {(r.pool, r.gap, r.hold): r.times for r in revision.pool_counts(pools).collect()}
    assert counts[WITHIN, 100.0, 1.0] == 5_000 and counts[WITHIN, 900.0, 1.0] == 15_000 and len(counts) == 10
    pairs = spark.createDataFrame([("d", 0, "", "ab" * 500)], "doc_id string, nr int, before_sent string, after_sent string")
    passes = spark.createDataFrame([("d", 1, "ab" * 500, "ab" * 500, [])], revision.DOCUMENT)
    for sessions_of, rows in ((revision.sentence_sessions, pairs), (revision.revision_sessions, passes)):
        one, again = (sessions_of(rows, pools.repartition(n)).first().events for n in (1, 3))
        assert one == again
        gaps = [b.press - a.press for a, b in zip(one, one[1:])]
        assert set(gaps) == {100.0, 900.0} and 0.65 < gaps.count(900.0) / len(gaps) < 0.85


def test_pools(spark):
    events = [*typist("ab. cd", [0, 100, 110, 120, 500, 90]), cursor(0, 3000), seldel(0, 1, 3050), key("x", 3100)]
    harvest = timing_pools.harvest_timings(sessions(spark, events), KEYS)
    got = {}
    for r in harvest.collect():
        got.setdefault(r.pool, []).append(r.gap)
    assert got[CLAUSE] == [500] and got["think"] == [3000 - 920] and got["operation"] == [50] and sorted(got[WITHIN]) == [50, 90, 100, 110, 120]
    pools = timing_pools.complete_pools(timing_pools.harvest_timings(sessions(spark, typist("abcd")), KEYS), KEYS)
    sizes = {r.pool: r.n for r in pools.collect()}
    assert sizes == {WITHIN: 3, WORD: 3, CLAUSE: 3, "operation": 3, "think": 3}
    assert timing_pools.complete_pools(harvest.limit(0), KEYS).count() == 0
    wanted = spark.createDataFrame([(WITHIN, i) for i in range(20)], "pool string, i int")
    a, b = (timing_pools.draw(wanted, pools, F.col("i"), seed=2).orderBy("i").collect() for _ in range(2))
    assert [x.gap for x in a] == [x.gap for x in b] and all(x.gap is not None for x in a)


def test_knobs_and_gates(spark):
    rates = "wpm double, corrected_error_rate double, uncorrected_error_rate double, revision_rate double"
    a = spark.createDataFrame([(i, float(i), 0.1, float(i), 0.0) for i in range(5)], f"id long, {rates}")
    b = spark.createDataFrame([(i, 2.0 * i + 1, 0.2, -float(i), 0.0) for i in range(5)], f"id long, {rates}")
    got = {r.knob: r for r in knobs.knob_fidelity(a, b, "id").collect()}
    assert got["wpm"].r == pytest.approx(1.0) and got["uncorrected_error_rate"].r == pytest.approx(-1.0) and got["corrected_error_rate"].r is None and got["corrected_error_rate"].mae == pytest.approx(0.1)
    assert knobs.sweep_grid(a, [1.0, 2.0], [0.1, 0.2, 0.3]).count() == 30
    metrics = spark.createDataFrame([(0.95, 0.8, 0.5, 0.95, 0.5, 9), (0.95, 0.8, float("nan"), 0.95, 0.5, 9), (0.95, 0.8, 0.5, 0.95, 0.5, 4)], "teeth double, shuffle_teeth double, model double, validity double, control double, n long")
    assert [r.passed for r in gates.apply_gates(metrics, gates.TIER1, "n", gates.LEAST_PAIRS).collect()] == [True, False, False]
    assert json.loads(gates.report_json(metrics).collect()[1]["json"])["model"] is None


def test_classifier_keeps_groups_together(spark):
    r = random.Random(4)
    rows = [(f"w{i % 9}", i, i % 2, (i % 2) * 2 + r.gauss(0, 0.3), r.gauss(0, 1), None) for i in range(120)]
    df = spark.createDataFrame(rows, "writer string, session_id long, label int, a double, b double, c double")
    folds = classify.with_folds(df, ["writer"]).select("writer", "fold").distinct()
    assert folds.count() == folds.select("writer").distinct().count()
    got = classify.discriminator_cv(df, ["a", "b", "c"], ["writer"], trees=3).collect()
    assert sum(x.n for x in got) == 120 and min(x.accuracy for x in got) > 0.8
    model = classify.fit_discriminator(df, ["a", "b", "c"], trees=3)
    assert classify.importances(model, ["a", "b", "c"])[0][0] == "a"
    best = classify.best_candidates(df.withColumn("target", F.floor(F.col("session_id") / 2)), ["a", "b", "c"], model, "target")
    assert best.agg(F.avg("label")).first()[0] > 0.9


def test_heldout(spark):
    df = sessions(spark, typist("hello"), typist("world"), typist("hello you"), target="long enough")
    split = spark.createDataFrame([("w0", "train"), ("w1", "test")], "writer string, side string")
    assert [r.writer for r in heldout.heldout(df, split).collect()] == ["w1"]
    assert sorted(r.writer for r in heldout.without(df, split).collect()) == ["w0", "w2"]
    assert heldout.sample_sessions(df, 2).count() == 2
    found = heldout.recover_writers(df.drop("writer"), df).collect()
    assert {r.session_id: r.writer for r in found} == {0: "w0", 1: "w1", 2: "w2"}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    head = "PARTICIPANT_ID\tTEST_SECTION_ID\tSENTENCE\tUSER_INPUT\tKEYSTROKE_ID\tPRESS_TIME\tRELEASE_TIME\tLETTER\tKEYCODE\n"
    (tmp_path / "a" / "b" / "7_keystrokes.txt").write_bytes((head + '7\t1\tsay "hi\tsay "hi\t5\t1700000000000\tbad\t \t32\n7\t1\tx\ty\n').encode() + b"7\t1\t\xff\ty\t6\t1\t2\ta\t65\n")
    rows = readers.read_transcription(spark, str(tmp_path / "a")).orderBy("keystroke_id").collect()
    assert len(rows) == 3 and {r.letter for r in rows} == {" ", None, "a"} and any(r.sentence == 'say "hi' and r.release_time is None for r in rows) and any("�" in r.sentence for r in rows)
    csv = tmp_path / "c" / "csv"
    csv.mkdir(parents=True)
    (csv / "w1.csv").write_text(',DownTime,UpTime,CursorPosition,TextChange,Activity\n1,0,10,1,"a",Input\n2,5,9,,"say ""x""",Paste\n')
    (tmp_path / "c" / "texts").mkdir()
    (tmp_path / "c" / "texts" / "w1.txt").write_text("a\n")
    log = readers.read_composition(spark, str(csv))
    assert [(r.writer, r.log_id, r.cursor_position, r.text_change) for r in log.orderBy("log_id").collect()] == [("w1", 1, 1, "a"), ("w1", 2, None, 'say "x"')]
    logs = log.select("writer", F.regexp_replace("file_path", r"/[^/]*\z", "").alias("folder")).distinct()
    assert [tuple(r) for r in readers.gold_texts(readers.read_texts(spark, str(tmp_path / "c")), logs).collect()] in ([("w1", "a\n")], [("w1", "a")])
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "u_matched.txt").write_text('\tinput_time\tuser_id\tstimulus_id\tinput\tkey_symbol\tcurrent_input\tfinger\tstimulus\n0\t1.5\t3\t4\t""""\tquotedbl\ta\tR_Index\tb\n')
    (tmp_path / "h" / "v_matched.txt").write_text('\tuser_id\tUnnamed: 10\tinput_time\tstimulus_id\tinput\tkey_symbol\n0\t8\t\t2.5\t9\ta\ta\n')
    other = readers.read_annotated(spark, str(tmp_path / "h")).filter("writer = '8'").first()
    assert (other.input_time, other.input, other.finger) == (2.5, "a", None)
    one = readers.read_annotated(spark, str(tmp_path / "h")).filter("writer = '3'").first()
    assert (one.input, one.writer, one.session_id, one.row_no) == ('"', "3", "4", 0)
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "train.json").write_text('{"doc_id": "d", "revision_depth": 1, "before_revision": "a", "after_revision": "b", "edit_actions": [{"before": "a", "after": "b", "start_char_pos": 0, "end_char_pos": 1}]}\n\n')
    assert readers.read_revisions(spark, str(tmp_path / "r")).first().edit_actions[0].after == "b"
    (tmp_path / "log.txt").write_text(" 10%|# | 5/50 [00:01<00:09,  1.0s/it]\n{'loss': '2.5', 'entropy': '1.5', 'mean_token_accuracy': '5e-1', 'epoch': '0.1'}\nnoise\n")
    got = readers.read_training_log(spark, str(tmp_path / "log.txt")).collect()
    assert [(r.step, r.total, r.loss, r.mean_token_accuracy) for r in got] == [(5, 50, None, None), (None, None, 2.5, 0.5)]
    (tmp_path / "dump.jsonl").write_text('{"target": "t", "real": [["key", "a", 1, 2.5]], "generated": []}\n')
    dump = readers.read_generations(spark, str(tmp_path / "dump.jsonl")).first()
    assert (dump.real[0].ch, dump.real[0].press, dump.real[0].release) == ("a", 1.0, 2.5)

    split = spark.createDataFrame([("a", "train"), ("b", "test")], "writer string, side string")
    writers.write_split(split, str(tmp_path / "split"), 3, 0.1)
    assert {tuple(r) for r in readers.read_split(spark, str(tmp_path / "split")).collect()} == {("a", "train"), ("b", "test")}
    assert readers.resolve_split(spark, None, str(tmp_path / "split")).count() == 2 and readers.resolve_split(spark, None, None, allow_none=True) is None
    with pytest.raises(FileNotFoundError):
        readers.resolve_split(spark, str(tmp_path / "no"), None)
    writers.write_split(split.union(spark.createDataFrame([("a", "test")], split.schema)), str(tmp_path / "bad"), 3, 0.1)
    with pytest.raises(ValueError):
        readers.read_split(spark, str(tmp_path / "bad"))
    examples = spark.createDataFrame([("a", i, f"<REV:{i}>", "c") for i in range(4)] + [("b", 9, "<REV:9>", "c")], "writer string, nr long, prompt string, completion string")
    writers.write_examples(examples, split, str(tmp_path / "out"), ["nr"], factor=3, least_bin=2)
    assert [r.prompt for r in readers.read_examples(spark, str(tmp_path / "out" / "train.jsonl")).collect()].count("<REV:3>") == 3
    assert readers.read_examples(spark, str(tmp_path / "out" / "test.jsonl")).count() == 1
    with pytest.raises(ValueError):
        writers.write_examples(examples.filter("writer = 'a'"), split, str(tmp_path / "out2"), ["nr"])


def test_streaming(spark, tmp_path):
    from keyloom.streaming.activity import live_kinds, streaming_intervals, streaming_sessions

    base = 1_700_000_000_000.0
    rows = [(i, "w", "key", base + 1000 * i) for i in range(5)] + [(2, "w", "key", base + 2000)] + [(9, "w", "KEY", base + 9e6), (10, "v", "key", base + 3e7), (11, None, "key", base)]
    schema = "event_id long, writer string, event_type string, press_time double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(99, "z", "key", base + 9e7)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    for name, make, mode in (("sessions", streaming_sessions, "append"), ("intervals", streaming_intervals, "update"), ("kinds", live_kinds, "append")):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        run.awaitTermination()
    got = {(r.writer, r.n_events) for r in spark.table("sessions").collect()}
    assert ("w", 5) in got and ("w", 1) in got
    assert spark.table("intervals").filter("writer = 'w'").agg(F.max("n")).first()[0] == 5
    assert spark.table("kinds").count() >= 1


def test_entry_points(spark):
    import __spark_entry__ as e

    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 60
    assert e.entry(spark).columns[0] == "writer"


def test_queries_train_the_full_classifiers(spark, monkeypatch):
    import inspect

    from keyloom.plans import model_queries

    trees = {}
    one = spark.createDataFrame([(0, 9, 0.5)], "fold int, n long, accuracy double")
    best = spark.createDataFrame([(1, "w", 1, 0.5)], "session_id long, writer string, label int, p_real double")
    answers = {"discriminator_cv": one, "writer_identification": one, "fit_discriminator": None, "importances": [("a", 1.0)], "best_candidates": best}
    for name, answer in answers.items():
        real = inspect.signature(getattr(classify, name))

        def stand_in(*args, _name=name, _real=real, _answer=answer, **kwargs):
            bound = _real.bind(*args, **kwargs)
            bound.apply_defaults()
            if "trees" in bound.arguments:
                trees.setdefault(_name, set()).add(bound.arguments["trees"])
            return _answer

        monkeypatch.setattr(classify, name, stand_in)
    for name in ("typed", "cut_lineage", "_real_and_shuffled"):
        monkeypatch.setattr(model_queries, name, lambda *args: one)
    monkeypatch.setattr(model_queries, "_gate_sides", lambda *args: (one, one, one))
    monkeypatch.setattr(model_queries, "validity", lambda *args: one.select(F.lit(1).alias("valid")))
    monkeypatch.setattr(model_queries, "_features", lambda *args: one.withColumn("label", F.lit(1)))
    monkeypatch.setattr(model_queries.timing, "feature_vector", lambda *args: one)
    monkeypatch.setattr(model_queries.codec, "roundtrip", lambda *args: one)
    monkeypatch.setattr(model_queries.controls, "halves", lambda *args: one)
    for name in ("discriminator_cv", "feature_importances", "best_candidates", "codec_ceiling", "real_vs_real", "tier1_gates", "writer_identification"):
        getattr(model_queries, name)(spark, "")
    assert trees == {"discriminator_cv": {100}, "fit_discriminator": {100}, "writer_identification": {50}}


def test_sessions_leave_the_worker_in_small_batches():
    pools = revision.Pools(np.array([WITHIN, WORD, CLAUSE, "think", "operation"], dtype=object), np.full(5, 9.0), np.array([5.0, 5.0, 5.0, np.nan, np.nan]), np.ones(5, dtype=np.int64))

    def played():
        for i in range(50):
            typist = revision.Typist()
            typist.type("é. x" * 5_000)
            typist.run(revision.edit(0, 2, "ab"))
            yield str(i), 0, "t", typist, "bad" if i == 7 else None

    sizes = {c: [b.num_rows for b in revision._batches(played(), pools, 0, events=c)] for c in (True, False)}
    assert sum(sizes[True]) == 50 and max(sizes[True]) < 12 and sizes[True] == sizes[False]
    rows = next(revision._batches(played(), pools, 0)).to_pylist()
    assert [len(r["events"]) for r in rows[:8]] == [20_004] * 7 + [0]
    start, end = rows[0]["events"][:5], rows[0]["events"][-4:]
    assert [(e["type"], e["press"], e["release"], e["ch"]) for e in start] == [("key", 9.0 * i, 9.0 * i + 5, c) for i, c in enumerate("é. xé")]
    assert [(e["type"], e["ch"], e["pos"], e["sel_start"], e["sel_end"]) for e in end] == [("cursor", None, 0, None, None), ("seldel", None, None, 0, 2), ("key", "a", None, None, None), ("key", "b", None, None, None)]
    assert [e["release"] is None for e in end] == [True, True, False, False] and end[-1]["press"] == 9.0 * 20_003


def test_timings_are_drawn_as_often_as_they_occur():
    times = np.array([1, 7, 2, 90, 4, 4])
    total, own, other = revision.aliases(times)
    shares = np.zeros(6, dtype=np.int64)
    for k in range(6):
        shares[k] += int(own[k])
        shares[int(other[k])] += int(total) - int(own[k])
    assert shares.tolist() == (times * 6).tolist()
    one = revision.Typist()
    one.type("a, b c")
    classes = {"gap": np.array([1.0, 2.0, 3.0]), "hold": np.ones(3), "times": np.ones(3, dtype=np.int64)}
    events = revision.timed([one], [5], revision.Pools(np.array([WITHIN, WORD, CLAUSE], dtype=object), *classes.values())).to_pylist()[0]
    assert [b["press"] - a["press"] for a, b in zip(events, events[1:])] == [1.0, 1.0, 3.0, 1.0, 2.0]


def test_revision_sessions_stream_through_one_exchange(spark):
    pools = spark.createDataFrame([(p, 0, 1, 10.0, 5.0) for p in (WITHIN, WORD, CLAUSE, "think", "operation")], "pool string, nr long, n long, gap double, hold double")
    rows = [(f"d{i % 7}", 1 + i // 7 + (i // 21), "a" * (i // 7), "a" * (i // 7 + 1), [("", "a", 0, 0)]) for i in range(42)]
    made = revision.revision_sessions(spark.createDataFrame(rows, revision.DOCUMENT).repartition(5), pools)
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.chain): (r.target, len(r.events), r.reason) for r in made.collect()}
    assert got == {(f"d{i}", c): ("a" * (3 * c + 3), 3 * c + 6, None) for i in range(7) for c in (0, 1)}
    long = "é" * 20_000
    texts = [(long + "x" + long, long + long), ("ab", None), ("", ""), ("aXa", "aXaXa")]
    spans = {(x.b, x.a): (x.start, x.stop, x.inserted) for x in revision.edit_spans(spark.createDataFrame(texts, "b string, a string"), "b", "a").collect()}
    assert list(spans.values()) == [(20_000, 20_001, ""), (None, None, None), (0, 0, ""), (3, 3, "Xa")]
