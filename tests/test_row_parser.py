import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.operators.row_parser import good_rows, parse_rows, rejected_rows, tokenize

GOOD = ["1", "2", "s", "u", "3", "1700000000000", "", "a", "65"]


def walk(line):
    """One character after the other."""
    fields, field, state, quoted = [], "", "start", False
    for at, c in enumerate(line):
        if state == "start":
            if c == '"':
                state = "in"
                continue
            state = "plain"
        if state == "plain":
            if c == '"':
                return None, at
            if c == "\t":
                fields.append(field)
                field, state = "", "start"
            else:
                field += c
        elif state == "in":
            if c == '"':
                state = "closed"
            else:
                field += c
        elif state == "closed":
            if c == '"':
                field, state = field + '"', "in"
            elif c == "\t":
                fields.append(field)
                field, state = "", "start"
            else:
                return None, at
    if state == "in":
        return None, len(line)
    return [*fields, field], -1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a"\t é𝕏', max_size=200), max_size=8))
def test_tokenizer_equals_a_walk(lines):
    fields, starts, wrong = tokenize(lines)
    for line, f, s, w in zip(lines, fields, starts, wrong):
        assert (f, w) == walk(line)
        if f is not None:
            assert all(i == 0 or line[i - 1] == "\t" for i in s)


def test_long_records_cross_chunks():
    line = '"' + 'x""\t' * 5000 + '"\tend'
    assert tokenize([line, "", line[:-5]])[0] == [['x"\t' * 5000, "end"], [""], None]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet='ab"\t ', max_size=20), min_size=1, max_size=9))
def test_round_trip(fields):
    out = io.StringIO()
    csv.writer(out, delimiter="\t", lineterminator="").writerow(fields)
    line = out.getvalue()
    assert tokenize([line])[0] == [fields]


def test_reasons(spark):
    def line(i, v):
        f = list(GOOD)
        f[i] = v
        return "\t".join(f)

    cases = {
        "\t".join(GOOD): None, "\t".join(GOOD) + "\r": None, "\t".join(GOOD) + "\r\r": "keycode", "": "column_count", None: "column_count", "a\tb": "column_count", "\t".join([*GOOD, "x"]): "column_count",
        line(2, 'a"b'): "quoting", line(2, '"ab'): "quoting", line(2, '"a"b'): "quoting", line(2, '"a""\tb"'): None, line(7, '""""'): None, line(7, '"\t"'): "letter",
        line(0, "0"): "participant_id", line(0, "١"): "participant_id", line(1, "1" * 19): "test_section_id", line(1, "0" * 17 + "1"): None, line(2, "  "): "sentence", line(2, '"a\tb"'): None, line(3, "a�"): "user_input",
        line(3, "a\x7f"): "user_input", line(4, "-1"): "keystroke_id", line(5, "2700000000000"): "press_time", line(5, "170000000000"): "press_time", line(6, "x"): "release_time", line(6, "1700000000001"): None,
        line(7, "CAPS_LOCK"): None, line(7, "ab"): "letter", line(7, "𝕏"): None, line(7, ""): "letter", line(8, "256"): "keycode", line(8, "0255"): None, line(8, "-1"): "keycode", line(8, ""): "keycode",
        line(0, "x").replace("s\t", "�\t"): "participant_id",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "line_id long, line string")
    got = {x.line: x.reason for x in parse_rows(df).collect()}
    assert got == cases
    assert good_rows(df).count() + rejected_rows(df).count() == len(cases)
    row = good_rows(df).filter("line_id = 0").first()
    assert (row.participant_id, row.press_time, row.release_time, row.letter, row.keycode) == (1, 1700000000000, None, "a", 65)


def test_offsets_and_empty_table(spark):
    bad = "\t".join([*GOOD[:7], "xy", "65"])
    df = spark.createDataFrame([(1, bad), (2, 'a\tb"')], "line_id long, line string")
    assert {x.line_id: x.error_at for x in rejected_rows(df).collect()} == {1: bad.index("xy"), 2: 3}
    assert parse_rows(df.limit(0)).count() == 0
