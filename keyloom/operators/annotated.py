"""Typing logs with finger annotations to canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Key symbols that change no text; the shifts among them capitalise the next producing key.
SHIFTS = ("Shift_L", "Shift_R")
MODIFIERS = (*SHIFTS, "Control_L", "Control_R", "Alt_L", "Alt_R", "Multi_key", "Caps_Lock", "ISO_Level3_Shift")


def parse_annotated(log: DataFrame) -> DataFrame:
    """Long events with ``finger`` of rows (writer, session_id, row_no, input_time, key_symbol, input, finger, target, submitted).

    Times are in seconds and become whole ms, half to even; rows with a null time, symbol or input are skipped and disarm nothing.
    A shift arms capitals for the next row that produces anything (a backspace uses it up). BackSpace deletes, space is a blank,
    an input of several characters is that many keys at one time. There are no releases, so hold times are 0. Times start at 0.

    Whether a shift is armed is whether one lies after the last producing row: two running maxima of one window, no state machine.
    """
    rows = log.filter("input_time is not null and key_symbol is not null and input is not null")
    order = W.partitionBy("writer", "session_id").orderBy("input_time", "row_no")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.withColumns({"_i": F.row_number().over(order), "_shift": F.col("key_symbol").isin(*SHIFTS), "_mod": F.col("key_symbol").isin(*MODIFIERS)})
    armed = F.max(F.when(F.col("_shift"), F.col("_i"))).over(before) > F.coalesce(F.max(F.when(~F.col("_mod"), F.col("_i"))).over(before), F.lit(0))
    made = numbered.withColumn("_armed", F.coalesce(armed, F.lit(False))).filter("not _mod")
    text = F.when(F.col("key_symbol") == "space", " ").otherwise(F.col("input"))
    text = F.when(F.col("_armed"), F.upper(text)).otherwise(text)
    chars = F.when(F.col("key_symbol") == "BackSpace", F.array(F.lit(None).cast("string"))).otherwise(F.filter(F.split(text, ""), lambda c: c != ""))
    press = F.bround(F.col("input_time") * 1000.0).cast("double")
    flat = made.select("writer", "session_id", "_i", press.alias("press"), "finger", "target", "submitted", F.posexplode(chars).alias("_k", "ch"))
    inner = W.partitionBy("writer", "session_id").orderBy("_i", "_k")
    start = F.min("press").over(W.partitionBy("writer", "session_id"))
    null = F.lit(None).cast("int")
    return flat.select(
        "writer", "session_id", F.row_number().over(inner).alias("seq"), F.when(F.col("ch").isNull(), "bksp").otherwise("key").alias("type"), (F.col("press") - start).alias("press"),
        (F.col("press") - start).alias("release"), "ch", null.alias("pos"), null.alias("sel_start"), null.alias("sel_end"), "finger", "target", "submitted",
    )
