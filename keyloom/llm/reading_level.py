"""Reading level of each document (problem 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.contamination import _hashes, words_of

GRADES = (1, 6)
#: Bound of the fit: labelled documents, chosen by a hash of their id. Their words are all counted.
MAX_LABELLED = 20_000
#: Labelled documents a word must occur in to be known, and prior documents by which its distribution is smoothed.
LEAST_DOCS, PRIOR = 3, 1.0
#: A word counts as acquired at the grade by which this share of its use has been met.
ACQUIRED = 0.3
#: Quantiles of a document's word grades that its level is calibrated on.
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.97)
FOLDS = 5
RIDGE = 1.0
#: Words of one length that share a back-off grade; longer ones count as this long.
LONGEST = 24


class Lexicon:
    """Acquisition grades of known words by hash; unknown words get the mean grade of known words of their length."""

    def __init__(self, words: np.ndarray, length: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> None:
        """``counts[w, g]``: labelled documents of grade g that hold word w; ``docs[g]``: labelled documents of grade g."""
        keep = counts.sum(1) >= LEAST_DOCS
        words, length, counts = words[keep], length[keep], counts[keep]
        order = np.argsort(words)
        self.words, length, counts = words[order], length[order], counts[order]
        share = docs / max(docs.sum(), 1.0)
        rate = (counts + PRIOR * share) / (docs + PRIOR)  # use per document of a grade, so a grade with many labels weighs no more
        met = np.cumsum(rate, axis=1) / rate.sum(1, keepdims=True) if len(rate) else np.zeros((0, len(docs)))
        g = (met >= ACQUIRED).argmax(1)
        before = np.where(g > 0, np.take_along_axis(met, np.maximum(g - 1, 0)[:, None], 1)[:, 0], 0.0) if len(g) else np.zeros(0)
        at = np.take_along_axis(met, g[:, None], 1)[:, 0] if len(g) else np.ones(0)
        self.grade = GRADES[0] + g - 1 + (ACQUIRED - before) / np.maximum(at - before, 1e-12)
        by_length = np.full(LONGEST + 1, np.nan)
        for n in range(LONGEST + 1):
            if (length == n).sum() >= 5:
                by_length[n] = self.grade[length == n].mean()
        known = np.flatnonzero(~np.isnan(by_length))
        self.by_length = np.interp(np.arange(LONGEST + 1), known, by_length[known]) if len(known) else np.full(LONGEST + 1, float(np.mean(GRADES)))

    def features(self, words: list[str]) -> tuple[np.ndarray, float] | None:
        """Quantiles of the grades of a text's distinct words, and the share of them that is known; None without words."""
        distinct = sorted(set(words))
        if not distinct:
            return None
        h = _hashes(distinct)
        at = np.searchsorted(self.words, h).clip(max=max(len(self.words) - 1, 0))
        known = self.words[at] == h if len(self.words) else np.zeros(len(h), dtype=bool)
        length = np.minimum([len(w) for w in distinct], LONGEST)
        grade = np.where(known, self.grade[at] if len(self.words) else 0.0, self.by_length[length])
        return np.quantile(grade, QUANTILES), float(known.mean())


class LevelModel:
    """Lexicon and calibration: level = intercept + weights . quantiles, within the grades."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray, intercept: float) -> None:
        self.lexicon, self.weights, self.intercept = lexicon, weights, intercept

    def level(self, text: str | None) -> tuple[float, float] | None:
        """(level, share of known words) of a text, None if it is null or has no words."""
        found = None if text is None else self.lexicon.features(words_of(text))
        if found is None:
            return None
        return float(np.clip(self.intercept + found[0] @ self.weights, *GRADES)), found[1]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("length", T.IntegerType())])))
def _distinct_words(text):  # noqa: ANN001, ANN202
    """Hash and length of each distinct word."""

    def of(t: str | None) -> list[dict[str, int]]:
        words = [] if t is None else sorted(set(words_of(t)))
        return [{"h": h, "length": min(len(w), LONGEST)} for w, h in zip(words, _hashes(words).view(np.int64).tolist())]

    return text.map(of)


def labelled_texts(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, grade, text): labelled documents with the median of their raters' grades; null and impossible grades are left out."""
    grade = labels.filter(F.col("grade").between(*GRADES)).distinct().groupBy("doc_id").agg(F.percentile("grade", 0.5).alias("grade"))
    chosen = grade.orderBy(F.xxhash64("doc_id")).limit(max_labelled)
    # At most ``max_labelled`` numbers are broadcast, so the texts stay where they are.
    return documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> LevelModel:
    """Fits lexicon and calibration.

    Word counts per fold and grade are aggregated in Spark; of words in at least LEAST_DOCS labelled documents a hash and a few numbers come to the driver. The calibration
    sees each labelled document through a lexicon made without its fold, so it learns how far quantiles can be
    trusted on new texts. With fewer than ten labelled documents the level is the mean grade.
    """
    spark = documents.sparkSession
    graded = labelled_texts(documents, labels, max_labelled).select(
        "doc_id", "text", "grade", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold"), F.floor(F.col("grade") + 0.5).cast("int").alias("g")
    ).persist()
    first, last = GRADES
    n = last - first + 1
    docs = np.zeros((FOLDS, n))
    for r in graded.groupBy("fold", "g").agg(F.count("*").alias("n")).collect():
        docs[r["fold"], r["g"] - first] = r["n"]
    exploded = graded.select("fold", "g", F.explode(_distinct_words("text")).alias("w")).select("fold", "g", "w.*")
    by_cell = exploded.groupBy("h", "length", "fold", "g").agg(F.count("*").alias("n"))
    cells = F.map_from_entries(F.collect_list(F.struct((F.col("fold") * n + F.col("g") - first).cast("short").alias("at"), F.col("n").cast("int"))))
    common = by_cell.groupBy("h").agg(F.max("length").alias("length"), F.sum("n").alias("total"), cells.alias("cells")).filter(F.col("total") >= LEAST_DOCS)
    found = common.select("h", "length", F.transform(F.sequence(F.lit(0), F.lit(FOLDS * n - 1)), lambda i: F.coalesce(F.try_element_at("cells", i.cast("short")), F.lit(0))).alias("c")).toArrow()
    words, length = found.column("h").to_numpy().view(np.uint64), found.column("length").to_numpy().astype(int)
    flat = found.column("c").combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(words) else np.zeros(0)
    counts = flat.reshape(len(words), FOLDS, n).transpose(1, 0, 2).astype(float)
    whole = Lexicon(words, length, counts.sum(0), docs.sum(0))
    parts = spark.sparkContext.broadcast([Lexicon(words, length, counts.sum(0) - counts[f], docs.sum(0) - docs[f]) for f in range(FOLDS)])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(f, g, x[0].tolist()) for f, g, t in zip(*(c.to_pylist() for c in batch.columns)) if (x := parts.value[f].features(words_of(t)))]
            yield pa.RecordBatch.from_pydict({"fold": pa.array([o[0] for o in out], pa.int32()), "grade": pa.array([o[1] for o in out], pa.float64()), "x": pa.array([o[2] for o in out], pa.list_(pa.float64()))})

    sample = graded.select("fold", "grade", "text").mapInArrow(seen, "fold int, grade double, x array<double>").toPandas()
    graded.unpersist()
    if len(sample) < 10:
        return LevelModel(whole, np.zeros(len(QUANTILES)), float(sample["grade"].mean()) if len(sample) else float(np.mean(GRADES)))
    x, y = np.array(sample["x"].tolist()), sample["grade"].to_numpy()
    centre = x.mean(0)
    weights = np.linalg.solve((x - centre).T @ (x - centre) + RIDGE * np.eye(x.shape[1]), (x - centre).T @ (y - y.mean()))
    return LevelModel(whole, weights, float(y.mean() - centre @ weights))


def reading_levels(documents: DataFrame, model: LevelModel) -> DataFrame:
    """``documents`` (doc_id) with ``level`` (1 easiest to 6 hardest, a fraction) and ``known_share``; both null for texts without words.

    One pass without a shuffle; the model holds 16 bytes for each word that LEAST_DOCS of the at most MAX_LABELLED labelled documents share.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.level(t.as_py()) or (None, None) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.float64())], ["doc_id", "level", "known_share"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(rate, "doc_id long, level double, known_share double")
