import pytest
from builders import long, sessions, typist
from pyspark.sql import functions as F

from keyloom.operators import readout, selection


def test_selection(spark):
    examples = spark.createDataFrame([("<MODE:T><WPM:1>a",), ("<MODE:C>é",), ("x<MODE:T>",), (None,)], "prompt string")
    assert selection.by_mode(examples, "transcription").count() == 1 and selection.by_mode(examples, "transcription", "composition").count() == 2
    with pytest.raises(KeyError):
        selection.by_mode(examples, "other")
    assert sorted(r.prompt for r in selection.encodable(examples).collect()) == ["<MODE:T><WPM:1>a", "x<MODE:T>"]
    assert selection.concatenated(examples, examples, examples.limit(0)).count() == 8
    many = spark.range(10_000)
    assert selection.line_sample(many, 20_000, 10_000).count() == 10_000 and 700 < selection.line_sample(many, 1000, 10_000, 3).count() < 1300
    rows = spark.createDataFrame([(f"w{i % 3}", i, "t" * 500 if i % 2 else "") for i in range(20)], "writer string, session_id long, target string")
    split = spark.createDataFrame([("w0", "test"), ("w1", "test"), ("w2", "train")], "writer string, side string")
    assert [r.session_id for r in selection.evaluation_sessions(rows, split, 5, ["session_id"]).collect()] == [0, 1, 3, 4, 6]
    got = {r.writer: (r.session_id, len(r.target)) for r in selection.composition_targets(rows, ["session_id"]).collect()}
    assert got == {"w0": (3, 400), "w1": (1, 400), "w2": (5, 400)}


def test_control_readouts(spark):
    df = long(sessions(spark, *(typist("ab cd ef gh", [0, *range(100 + i, 1100 + i, 100)]) for i in range(4)), target="ab cd"))
    targets = df.select("writer", "session_id").distinct().withColumns({"target": F.lit("ab cd"), "wpm": F.lit(40.0)})
    got = readout.control_readouts(df, targets).groupBy("side").count().collect()
    assert {r["side"]: r["count"] for r in got} == {"sample": 36, "heuristic": 36, "shuffled": 36}
