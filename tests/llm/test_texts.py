import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import contamination, mojibake, visible_text
from keyloom.llm.visible_text import comparison_form, visible_form

SENTENCES = ["Der Bäcker schloß die große Tür über der Straße.", "L’élève a trouvé la pâte à gâteau.", "Зачем учитель починил первую строку?", "It was 42 °C — far too much…", "¿El niño enseñó el pingüino?", "Pikkuveli löysi märän käsineen.", "Don’t ask “why”, said João.", "plain words only"]


def test_unseen_differences():
    same = [
        ("é", "é"), ("ﬁt", "fit"), ("ａＢ１", "aB1"), ("a b", "a b"), ("a　b", "a b"), ("so­ft", "soft"), ("a​⁠﻿b", "ab"), ("“a”", '"a"'), ("it’s", "it's"), ("a‑b", "a-b"), ("a−b", "a-b"),
        ("𝐡ello", "hello"), ("ɡood", "good"), ("ⅰn", "in"), ("ꓮꓐ", "AB"), ("ᎪᎬ", "AE"), ("…", "..."), ("соре", "cope"), ("ё", "ë"), ("ΟΚ", "OK"), ("K", "K"), ("，", ","), ("ĳ", "ij"), ("＂", '"'), ("a\tb", "a b"),
    ]
    for a, b in same:
        assert visible_form(a) == visible_form(b), (a, b)
    for a, b in [("A", "a"), ("é", "e"), ("ß", "ss"), ("²", "2"), ("a b", "ab"), ("a—b", "a-b"), ("«a»", '"a"'), ("1", "l"), ("a b", "a  b"), ("½", "1/2"), ("a.", "a"), ("'", '"')]:
        assert visible_form(a) != visible_form(b), (a, b)
    for a, b in [("Straße", "STRASSE"), ("²", "2"), ("a  b", "A b"), ("İ", "i̇")]:
        assert comparison_form(a) == comparison_form(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_forms_are_stable(text):
    once = visible_form(text)
    assert visible_form(once) == once
    assert visible_form(unicodedata.normalize("NFD", text)) == visible_form(unicodedata.normalize("NFC", text)) or any(unicodedata.combining(c) for c in text)
    assert comparison_form(comparison_form(text)) == comparison_form(text)


def test_unescape(spark):
    cases = {"a\\nb": "a\nb", '\\"x\\"': '"x"', "\\\\n": "\\n", "\\\\": "\\", "plain": "plain", "": "", "a\\'b": "a'b", None: None, "\\\\\\n": "\\\n", "\ue000\\n": "\ue000\n", "x\\": "x\\", "\\\\\\\\n": "\\\\n"}
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", visible_text.unescape(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got} == cases


def test_match_stimuli(spark):
    sessions = spark.createDataFrame(
        [(1, "Café — now", "x"), (2, "Café — now", "x"), (3, "CAFÉ — NOW", "x"), (4, None, "x"), (5, "", "x"), (1, "Café — now", "late"), (6, "Cafe — now", "x"), (1, "Caf\u200bé — now", "late"), (None, "Ｃafé — now", "x"), (7, "x" * 100_000, "x")],
        "session_id long, target_text string, text string",
    )
    log = spark.createDataFrame([(1, "Paste", 'say \\"hi\\"'), (2, "Input", "Ｃafé — now"), (3, "Paste", "say “hi”"), (4, "Paste", None)], "log_id long, activity string, text_change string")
    stimuli = spark.createDataFrame([(10, "Café — now"), (11, 'say "hi"'), (12, None)], "stimulus_id long, stimulus string")
    texts = visible_text.composed_texts(sessions, log)
    got = {(r.field, r.record_id, r.stimulus_id, r.exact) for r in visible_text.match_stimuli(texts, stimuli).collect()}
    assert got == {("target_text", 1, 10, False), ("target_text", 2, 10, True), ("text_change", 1, 11, True), ("text_change", 3, 11, False)}
    assert visible_text.match_stimuli(texts.limit(0), stimuli).count() == 0 and visible_text.match_stimuli(texts, stimuli.limit(0)).count() == 0


def test_consistent_texts_of_all_activities(spark, tmp_path):
    from keyloom.llm import catalog

    log = [(1, "Paste", 'say \\"hi\\"'), (2, "Input", "Ｃafe\u0301\u00a0now"), (3, "Replace", "a => ﬁt"), (4, "Remove/Cut", "ｂ"), (5, None, "ｃ"), (5, None, "ｃ"), (6, "Input", None)]
    spark.createDataFrame(log, "log_id long, activity string, text_change string").write.parquet(f"{tmp_path}/composition_log.parquet")
    spark.createDataFrame([(1, "ｄ"), (2, None)], "session_id long, target_text string").write.parquet(f"{tmp_path}/real_sessions.parquet")
    got = sorted((r.field, r.record_id, r.visible) for r in catalog.p2_consistent(spark, str(tmp_path)).collect())
    assert got == [("target_text", 1, "d"), ("text_change", 1, 'say "hi"'), ("text_change", 2, "Café now"), ("text_change", 3, "a => fit"), ("text_change", 4, "b"), ("text_change", 5, "c")]


def _corpus(n=400):
    r = random.Random(8)
    words = [w for s in SENTENCES for w in s.split()]
    return [" ".join(r.choice(words) for _ in range(6)) for _ in range(n)] + SENTENCES


def _garble(text, codec):
    out = []
    for byte in text.encode():
        try:
            out.append(bytes([byte]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(byte))
    return "".join(out)


def test_restores_every_codec(spark):
    corpus = _corpus()
    bad = {}
    for codec in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r"):
        for s in SENTENCES[:6]:
            bad[_garble(s, codec)] = s
    bad |= {_garble(_garble(s, "cp1252"), "cp1252"): s for s in SENTENCES[:2]}
    bad[_garble("pâte", "cp1252") + " and café"] = "pâte and café"
    texts = spark.createDataFrame([("f", i, t) for i, t in enumerate([*corpus, *bad, "lost �", None, "", "x" * 200_000 + "é"])], "field string, record_id long, text string")
    got = {r.text: r for r in mojibake.restored_texts(texts).collect()}
    wrong = {t: got[t].restored for t, s in bad.items() if got[t].restored != s}
    assert len(wrong) <= len(bad) * 0.05, wrong
    assert not any(got[t].garbled for t in corpus) and got["lost �"].garbled and not got[None].garbled and not got[""].garbled
    stimuli = spark.createDataFrame([(5, SENTENCES[0]), (6, None)], "stimulus_id long, stimulus string")
    found = {(r.record_id, r.stimulus_id) for r in mojibake.garbled_texts(texts, stimuli).collect()}
    assert len(found) >= len(bad) * 0.95 and sum(s == 5 for _, s in found) >= 7
    assert mojibake.restored_texts(texts.limit(0)).count() == 0


def test_one_byte_encodings_and_blanks(spark):
    corpus = _corpus(1500)
    russian = "Зачем учитель починил первую строку на рынке"
    bad = {russian.encode("cp1251").decode("latin-1"): russian, russian.encode("cp1251").decode("koi8_r"): russian}
    bad |= {_garble(t, "cp1252").replace("\xa0", " "): t for t in ("la pâte à gâteau", "à tarde", "déjà trouvé")}
    sound = ["Ñandú «où» ½-litre £9 €5", "Ελα", "Ça va", "ЗАЧЕМ УЧИТЕЛЬ", "MAÇÃ E PÃO", "В\xad пустом", "fоllowed thе сlаѕѕ оf ехреrtѕ", "принёс зелёный чай"]
    texts = spark.createDataFrame([("f", i, t) for i, t in enumerate([*corpus, *bad, *sound])], "field string, record_id long, text string")
    got = {r.text: r for r in mojibake.restored_texts(texts).collect()}
    assert {t: got[t].restored for t in bad} == bad
    assert [t for t in sound if got[t].garbled] == []


def test_short_texts_in_the_wrong_one_byte_encoding(spark):
    phrase = "Привет как дела"
    whole = [*_corpus(600), *[phrase, "хорошо"] * 200]
    bad = {t.encode("cp1251").decode("cp1252"): t for t in (phrase, "Привет", "как дел", "хорошо")}
    sound = ["é", "Ñu", "ça", "Größe", "£9", "дом"]
    got = {r.text: r for r in mojibake.restored_texts(spark.createDataFrame([("f", i, t) for i, t in enumerate([*whole, *bad, *sound])], "field string, record_id long, text string")).collect()}
    assert {t: got[t].restored for t in bad} == bad and not any(got[t].garbled for t in sound)


def test_runs_are_maximum_scoring_segments():
    import numpy as np

    counts = np.zeros(mojibake.SYMBOLS**2, dtype=np.int64)
    for t in _corpus(100):
        np.add.at(counts, mojibake._flat_pairs([t])[0], 1)
    model = mojibake.PairModel(counts)
    texts = ["ab", "", "a", _garble(SENTENCES[0], "cp1252"), SENTENCES[1], "Ã¤", "xx Ð» yy"]
    for text, spans in zip(texts, model.runs(texts)):
        if len(text) < 2:
            assert spans == []
            continue
        score = -model.pmi[mojibake._flat_pairs([text])[0]].astype(float)
        best, run = 0.0, 0.0
        for s in score:
            run = max(0.0, run + s)
            best = max(best, run)
        assert bool(spans) == (best > 1e-6)
        if best > 1e-6:
            top = max(score[max(a, 0) : max(b - 1, 0)].sum() if False else max((score[i : j + 1].sum() for i in range(a, b - 1) for j in range(i, b - 1)), default=0.0) for a, b in spans)
            assert abs(top - best) < 1e-6


def test_deliveries_and_fields(spark):
    keystrokes = spark.createDataFrame([(1, "cafÃ©"), (1, "cafÃ©"), (2, "café"), (None, "cafÃ©"), (3, None)], "test_section_id long, sentence string")
    log = spark.createDataFrame([(1, "é"), (2, "�"), (3, "a\\nb"), (4, None)], "log_id long, text_change string")
    got = {(r.field, r.record_id, r.text) for r in mojibake.logged_texts(keystrokes, log).collect()}
    assert got == {("sentence", 1, "cafÃ©"), ("sentence", 2, "café"), ("text_change", 2, "�"), ("text_change", 3, "a\nb")}


def _long_text(r, n):
    return [r.choice("alpha beta gamma delta the of and to in was one two three four five".split()) + str(r.randrange(40)) for _ in range(n)]


def test_leaks_equal_brute_force(spark):
    r = random.Random(6)
    items = [(i, " ".join(_long_text(r, r.choice([5, 11, 12, 13, 40]))).capitalize() + ".") for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for d in range(60):
        words = _long_text(r, 60)
        i, t = r.choice(items[:30])
        w = t[:-1].split()
        k = r.choice([11, 12, 15, 40])
        at = r.randrange(max(1, len(w) - k))
        part = w[at : at + k]
        if d % 4 == 1:
            part = [f"*{x}*," if j % 3 else x.upper() for j, x in enumerate(part)]
        if d % 4 == 2:
            part = ["ａ" + x[1:] if x[0] == "a" else x + "​" for x in part]
        if d % 4 == 3:
            part = part[:6] + ["odd"] + part[6:]
        docs.append((d, "\n> ".join([" ".join(words[:30]), *(" ".join(part[j : j + 5]) for j in range(0, len(part), 5)), " ".join(words[30:])])))
    docs += [(900, None), (901, ""), (902, "one two"), (0, docs[0][1])]
    expected = set()
    for d, t in docs:
        have = contamination.words_of(t or "")
        windows = {tuple(have[i : i + 12]) for i in range(len(have) - 11)}
        for i, s in items:
            own = contamination.words_of(s or "")
            if any(tuple(own[j : j + 12]) in windows for j in range(len(own) - 11)):
                expected.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(3))
    index = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = contamination.leaked_items(df, index).filter("longest >= 12").collect()
    assert {(x.doc_id, x.item_id) for x in got} == expected and len(expected) > 10 and len(got) == len(expected)
    assert contamination.leaked_items(df.limit(0), index).count() == 0 and contamination.leaked_items(df, index.limit(0)).count() == 0
    assert all(x.similarity >= 0.8 and (x.longest >= 12 and x.similarity == 1.0 or x.longest == 0 and x.near > 0) for x in contamination.leaked_items(df, index).collect())
    old = contamination.WINDOWS_A_PASS
    try:
        contamination.WINDOWS_A_PASS = 50  # several passes give the same
        assert {(x.doc_id, x.item_id) for x in contamination.leaked_items(df, index).filter("longest >= 12").collect()} == expected
    finally:
        contamination.WINDOWS_A_PASS = old


def test_fingerprints_and_candidates():
    import numpy as np

    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, 40, dtype=np.uint64)
    prints = contamination.fingerprints(h)
    with np.errstate(over="ignore"):
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ ((h[1:] << np.uint64(31)) | (h[1:] >> np.uint64(33)))
        pair ^= pair >> np.uint64(29)
        pair *= np.uint64(0xBF58476D1CE4E5B9)
        pair ^= pair >> np.uint64(32)
    for i, p in enumerate(prints.tolist()):
        for b in range(64):
            votes = sum(int(x) >> b & 1 for x in pair[i : i + 11])
            assert (p >> b & 1) == (votes >= 6)
    # Windows of a text's own: the same by quarters and by running sums, and by counting.
    weight = r.integers(1, 4, 40)
    votes = contamination._votes(h, weight)
    for quarter in contamination.QUARTERS[:4]:
        starts, own = contamination.strided_prints(votes, quarter)
        rolling = dict(zip(*(x.tolist() for x in contamination.rolling_prints(votes, quarter, 1))))
        assert [rolling[a] for a in starts.tolist()] == own.tolist() and set(starts.tolist()) >= set(range(0, 40 - 4 * quarter + 1, quarter))
        for a, p in zip(starts.tolist(), own.tolist()):
            assert all((p >> b & 1) == (sum(int(w) * (1 if int(x) >> b & 1 else -1) for x, w in zip(h[a : a + 4 * quarter], weight[a : a + 4 * quarter])) > 0) for b in range(64))
    # Complete within either radius: every pair that close is found, no other one.
    prints = r.integers(0, 2**63, 50, dtype=np.uint64)
    for radius in (3, 11):
        index = contamination.HammingIndex(prints, radius)
        tried = []
        for _ in range(400):
            p = int(prints[r.integers(50)])
            for b in r.choice(64, r.integers(0, radius + 3), replace=False):
                p ^= 1 << int(b)
            tried.append(p)
        tried = np.array(tried, dtype=np.uint64)
        got = set(zip(*(x.tolist() for x in index.candidates(tried))))
        assert got == {(i, j) for i in range(len(tried)) for j in range(50) if int(tried[i] ^ prints[j]).bit_count() <= radius}
    assert len(contamination.HammingIndex(prints[:0], 3).candidates(prints)[0]) == 0


def _edited(r, words, rate, other):
    out = []
    for w in words:
        kind = r.choice(("replace", "insert", "delete")) if r.random() < rate else None
        out += [r.choice(other)] if kind == "replace" else [w, r.choice(other)] if kind == "insert" else [] if kind == "delete" else [w]
    return out


def _prose(r, n, names):
    """Sentences of a few common words and rarer names, as texts have them."""
    common = "the of and to in was a that it on for with as his they at be this from had not are but have were".split()
    return [r.choice(common) if r.random() < 0.5 else r.choice(names) for _ in range(n)]


def _reachable(index, words, k):
    """Whether any window of the text reaches the similarity with any window of item k, whatever the fingerprints."""
    import numpy as np

    h = contamination._hashes(words)
    n, best = int(index.begin[k + 1] - index.begin[k]), 0.0
    for quarter in contamination.near_quarters(n):
        p, q = (x.ravel() for x in np.meshgrid(np.arange(0, len(words) - 4 * quarter + 1), np.arange(0, n - 4 * quarter + 1)))
        zero = np.zeros(len(p), dtype=np.int64)
        best = max(best, float(index.similarity(h, index.weights(h), zero, zero + len(h), p, zero + k, q, 4 * quarter).max()))
    return best >= contamination.SIMILARITY


def test_recall_of_edited_passages():
    r = random.Random(4)
    names = [f"{a}{b}" for a in "zor pel mik tan rub lod".split() for b in range(300)]
    items = [(i, _prose(r, r.choice([18, 25, 40, 60, 90, 115]), names)) for i in range(150)]
    index = contamination.ItemIndex([(i, contamination._hashes(w)) for i, w in items])
    for rate, least in ((0.05, 0.97), (0.1, 0.95), (0.2, 0.8)):
        texts = [[*_prose(r, r.randrange(60), names), *_edited(r, w, rate, names), *_prose(r, 40, names)] for _, w in items]
        found = {(t, i): (longest, best) for t, i, longest, _, _, best in index.leaks([" ".join(t) for t in texts])}
        assert all(best >= contamination.SIMILARITY for _, best in found.values()) and sum(t != i for t, i in found) <= 2
        alike = [k for k, t in enumerate(texts) if (k, k) in found or _reachable(index, t, k)]
        # Of the passages that reach the similarity at all nine tenths must be found; of all edited ones, as many as stay so like.
        assert sum((k, k) in found for k in alike) >= 0.9 * len(alike), rate
        assert len({t for t, i in found if t == i}) >= least * len(items), rate
        if rate == 0.2:
            assert sum(longest == 0 for longest, _ in found.values()) > 20  # near copies without any whole passage


def _slow_similarity(index, item, text, p, q, size):
    """The same similarity word by word."""
    weight = dict(zip(item[q : q + size], index.weights(contamination._hashes(item[q : q + size])).tolist()))
    weigh = weight.__getitem__
    have = total = 0.0
    for s in range(size - contamination.SHINGLE + 1):
        places = range(s, s + contamination.SHINGLE)
        have += max(sum(weigh(item[q + j]) for j in places if 0 <= p + j + d < len(text) and text[p + j + d] == item[q + j]) for d in range(-contamination.SHIFT, contamination.SHIFT + 1))
        total += sum(weigh(item[q + j]) for j in places)
    return have / total


def test_near_copies_against_all_windows():
    r = random.Random(9)
    names = [f"{a}{b}" for a in "zor pel mik".split() for b in range(60)]
    items = [_prose(r, n, names) for n in (12, 16, 18, 24, 30, 45, 64, 80, 11, 5)]
    index = contamination.ItemIndex([(i, contamination._hashes(w)) for i, w in enumerate(items)])
    assert contamination.near_quarters(11) == [] and contamination.near_quarters(12) == [3] and contamination.near_quarters(118) == [4, 21]
    texts = [[*_prose(r, 20, names), *_edited(r, items[i % len(items)], (0.0, 0.03, 0.06)[i % 3], names), *_prose(r, 9, names)] for i in range(20)]
    found = {(t, i): best for t, i, longest, _, near, best in index.leaks([" ".join(t) for t in texts])}
    reachable = missed = 0
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            best = max((_slow_similarity(index, item, text, p, q, 4 * x) for x in contamination.near_quarters(len(item)) for p in range(0, len(text) - 4 * x + 1, x) for q in range(0, len(item) - 4 * x + 1, max(1, x // 3))), default=0.0)
            if best >= contamination.SIMILARITY:
                reachable += 1
                missed += (t, i) not in found
    assert reachable > 14 and missed <= 0.1 * reachable, (reachable, missed)


def test_no_window_is_passed_over_for_want_of_words():
    r = random.Random(2)
    names = [f"n{b}" for b in range(40)]
    items = [_prose(r, n, names) for n in (30, 60)]
    index = contamination.ItemIndex([(i, contamination._hashes(w)) for i, w in enumerate(items)])
    for quarter, (owner, begins, least, _) in index.near.items():
        for k, q in list(zip(owner.tolist(), begins.tolist()))[::5]:
            window = items[k][q : q + 4 * quarter]
            for _ in range(3):
                kept = set(r.sample(sorted(set(window)), min(least - 1, len(set(window)))))
                text = [w if w in kept else "unknown" for w in window]
                assert _slow_similarity(index, items[k], text, 0, q, 4 * quarter) < contamination.SIMILARITY
