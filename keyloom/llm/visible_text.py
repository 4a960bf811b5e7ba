"""Visually identical text with different characters (problem 2)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters of other scripts and the Latin letters they pass for.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԚԜаеорсухѕіјһԛԝӏԁ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυβϲϳͿ" + "օսհՕՍցոզ" + "ɡɑ" + "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ" + "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ",
        "ABESIJKMHOPCTYXYQWaeopcyxsijhqwld" + "ABEZHIKMNOPTYXaivopußcjJ" + "ouhOUgnq" + "ga" + "DRTAJEWMHGZVSLCPKB" + "BPDTGKJCZFMNLSRVHWXYAEIOU",
    )
)
# Typographic forms of the plain quotes, hyphen and ellipsis.
PLAIN_MARKS = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "‐": "-", "‑": "-", "−": "-", "﹣": "-", "…": "..."}
# Ranges of Default_Ignorable_Code_Point.
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
# Compatibility characters that are ligatures, digraphs, Roman numerals or dots set as one character.
JOINED = ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2024, 0x2026), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
#: Decompositions whose difference from the plain character a reader does not see.
UNSEEN_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<font>")


def _within(point: int, ranges: tuple[tuple[int, int], ...]) -> bool:
    return any(a <= point <= b for a, b in ranges)


class _PerCharacter(dict):
    """A translation table that is filled with the characters met; compatibility forms a reader sees (² ½ ™) stay."""

    def __missing__(self, point: int) -> str | int | None:
        char = chr(point)
        kind = unicodedata.decomposition(char).split(" ")[0]
        if _within(point, IGNORABLE):
            out: str | None = None
        elif unicodedata.category(char) == "Zs" or char == "\t":
            out = " "
        elif char in PLAIN_MARKS:
            out = PLAIN_MARKS[char]
        elif kind in UNSEEN_TAGS or _within(point, JOINED):
            out = "".join(PLAIN_MARKS.get(c, c) for c in unicodedata.normalize("NFKC", char))
        else:
            out = char
        self[point] = out
        return out


_SEEN = _PerCharacter()
_LATIN = str.maketrans(LOOK_ALIKES)


def visible_form(text: str) -> str:
    """The text as a reader sees it: equal for two texts exactly if only unseen differences lie between them."""
    if text.isascii():
        return text.replace("\t", " ")
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(_SEEN)).translate(_LATIN))


def comparison_form(text: str) -> str:
    """The loosest form: visible form, compatibility normalised, composed and fully case-folded, blanks as single spaces."""
    plain = unicodedata.normalize("NFKC", visible_form(text))
    return " ".join(unicodedata.normalize("NFKC", plain.casefold()).split())


FORMS = T.StructType([T.StructField("visible", T.StringType()), T.StructField("folded", T.StringType())])


@F.pandas_udf(FORMS)
def text_forms(text: pd.Series) -> pd.DataFrame:
    """Both forms of each value; each distinct value of a batch is worked out once. Null stays null."""
    code, values = pd.factorize(text)
    made = [(visible_form(v), comparison_form(v)) for v in values] + [(None, None)]
    return pd.DataFrame([made[c] for c in code], columns=["visible", "folded"])


def unescape(column: Column) -> Column:
    """Undoes backslash escapes in one pass: ``\\n``, ``\\t`` and ``\\r`` are controls, any other escaped character stands for itself."""
    # Between escaped backslashes every backslash begins another escape, so the parts can be treated apart and joined by single ones.
    parts = F.transform(F.split(column, r"\\\\", -1), lambda p: F.regexp_replace(F.replace(F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\r"), F.lit("\r")), r"(?s)\\(.)", "$1"))
    return F.when(F.instr(column, "\\") > 0, F.array_join(parts, "\\")).otherwise(column)


def composed_texts(real_sessions: DataFrame, composition_log: DataFrame, activities: tuple[str, ...] | None = ("Paste",)) -> DataFrame:
    """(field, record_id, text) of target texts and logged texts, unescaped, one row per distinct delivery.

    ``activities``: those whose text_change counts; None takes every row, whatever its activity or without one.
    """
    target = real_sessions.select(F.lit("target_text").alias("field"), F.col("session_id").alias("record_id"), F.col("target_text").alias("text"))
    rows = composition_log if activities is None else composition_log.filter(F.col("activity").isin(*activities))
    logged = rows.select(F.lit("text_change").alias("field"), F.col("log_id").alias("record_id"), unescape(F.col("text_change")).alias("text"))
    return target.unionByName(logged).filter("text is not null and record_id is not null").distinct()


def consistent_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``visible`` and ``folded``. Null texts get nulls, empty texts empty forms; no shuffle.

    Each distinct value of an Arrow batch is worked out once; making it once in the whole table would shuffle every text twice to save less work than that costs.
    """
    return texts.withColumn("_f", text_forms(F.col(text))).withColumns({"visible": F.col("_f.visible"), "folded": F.col("_f.folded")}).drop("_f")


def match_stimuli(texts: DataFrame, stimuli: DataFrame) -> DataFrame:
    """(field, record_id, stimulus_id, exact): the stimulus each text reads like; ``exact`` if code points are equal too.

    Candidates are equal in the folded form, an equi-join; the visible form then decides, in which letter case,
    accents, digits and punctuation count. Repeated deliveries give one row. Several stimuli that read the same
    would each give a row. Empty tables give no rows.
    """
    left = consistent_texts(texts.select("field", "record_id", "text"))
    right = consistent_texts(stimuli.select("stimulus_id", "stimulus").filter("stimulus is not null"), "stimulus").withColumnRenamed("visible", "stimulus_visible")
    return (
        left.join(right, "folded")
        .filter(F.col("visible") == F.col("stimulus_visible"))
        .select("field", "record_id", "stimulus_id", (F.col("text") == F.col("stimulus")).alias("exact"))
        .distinct()
    )
