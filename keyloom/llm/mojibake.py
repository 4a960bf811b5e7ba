"""Garbled text from wrong character encoding (problem 4)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.session import cut_lineage, partitions

#: Encodings a UTF-8 text may have been read in, tried in this order (the order breaks ties).
CODECS = ("cp1252", "cp1251", "cp850", "cp437", "mac_roman", "cp1250", "koi8_r", "cp866", "cp852", "iso8859_15", "iso8859_2", "iso8859_5", "mac_cyrillic", "cp1253", "cp1254", "cp1257")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
#: Characters around an improbable run that the inverse mappings may use.
MARGIN = 3
#: Pseudo-count of a pair, and how much better (in nats) a restored text must score.
PSEUDO, GAIN = 0.05, 2.0
_SEQUENCE = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
LOST = "�"


def _tables() -> list[dict[int, str]]:
    """For each codec, its characters above ASCII as the Latin-1 characters of their bytes; bytes without a character pass as C1 controls."""
    out = []
    for codec in CODECS:
        table = {}
        for byte in range(0x80, 0x100):
            try:
                table[ord(bytes([byte]).decode(codec))] = chr(byte)
            except UnicodeDecodeError:
                pass
        for byte in range(0x80, 0xA0):
            table.setdefault(byte, chr(byte))
        if codec == "cp1252":
            for byte in range(0xA0, 0x100):
                table.setdefault(byte, chr(byte))
        out.append(table)
    return out


_BYTES = _tables()
#: Encodings of one byte a character that may have been taken for one another: (what a text was in, what it was read in).
CONFUSED = tuple((a, b) for a in ("cp1251", "koi8_r", "cp866", "iso8859_5", "cp1252") for b in ("cp1252", "cp1251", "koi8_r", "cp866", "cp850", "cp437", "mac_roman") if a != b)
#: Gain, in nats a pair and in all, for which a text is taken to be in another one-byte encoding: the fewer its wide characters, the more each must say.
PAIR_GAIN, WHOLE_GAIN = 2.0, 16.0


def _confusions() -> list[dict[int, str]]:
    byte_of = dict(zip(CODECS, _BYTES))
    out = []
    for true, read in CONFUSED:
        table = {}
        for point, byte in byte_of[read].items():
            try:
                table[point] = byte.encode("latin-1").decode(true)
            except UnicodeDecodeError:
                pass
        out.append(table)
    return out


_SWAPS = _confusions()
#: A lone or word-final Ã before a blank was Ã with a no-break space: somebody made all blanks plain after the wrong decoding.
_BLANKED = re.compile(r"(?<![A-ZÀ-Ý])Ã(?: |\Z)")
#: Symbols of the pair statistics: ASCII, combining marks and every character of the codecs singly, all else by blocks of 128 code points, from
#: U+3400 on of 4096.
_SINGLE = np.array(sorted({*range(0x80), *range(0x300, 0x370), 0xFFFD, *(c for t in _BYTES for c in t)}), dtype=np.int64)
_LETTERS = frozenset(map(chr, _SINGLE.tolist())) - {"\ufffd"}
#: Greek and Cyrillic capitals count as their lower case: in their own encodings capitals also form UTF-8 sequences, and are rarer.
_LOWER = np.array([i if c < 0x370 or len(chr(c).lower()) > 1 or (j := int(np.searchsorted(_SINGLE, ord(chr(c).lower())))) >= len(_SINGLE) or _SINGLE[j] != ord(chr(c).lower()) else j for i, c in enumerate(_SINGLE.tolist())])
_FINE = 0x3400 >> 7
SYMBOLS = len(_SINGLE) + _FINE + (0x110000 >> 12)


def _symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    at = np.searchsorted(_SINGLE, points).clip(max=len(_SINGLE) - 1)
    block = np.where(points < 0x3400, points >> 7, _FINE + (points >> 12))
    return np.where(_SINGLE[at] == points, _LOWER[at], len(_SINGLE) + block)


def _flat_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all adjacent pairs of all texts, and the text each belongs to."""
    symbols = _symbols("".join(texts))
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    same = owner[1:] == owner[:-1]
    return (symbols[:-1] * SYMBOLS + symbols[1:])[same], owner[1:][same]


def _undo(text: str, table: dict[int, str], spans: list[tuple[int, int]] | None = None) -> str:
    """``text`` with the UTF-8 sequences that its bytes form replaced, inside ``spans`` only. One character is one byte, so offsets hold."""
    raw = "".join(table.get(ord(c), "￿") if c > "\x7f" else c for c in text)
    parts, done = [], 0
    for a, b in [(0, len(text))] if spans is None else spans:
        for m in _SEQUENCE.finditer(raw, max(a, done), b):
            try:
                char = m[0].encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            if char == "\xad" and text[m.start()] not in "ÂÃ":
                continue  # a letter before a soft hyphen; only Latin-1 shows a garbled one like this
            parts += [text[done : m.start()], char]
            done = m.end()
    return "".join(parts) + text[done:] if parts else text


def _suspect(text: str, table: dict[int, str], cyrillic: bool) -> bool:
    raw = "".join(table.get(ord(c), "\uffff") if c > "\x7f" else c for c in text)
    found = [m.span() for m in _SEQUENCE.finditer(raw)]
    for a, b in found:
        # Words of Cyrillic letters often form such sequences in their own encodings, with a symbol among them or a Latin letter beside them never.
        plain = cyrillic and text[a:b].isalpha() and not any(c.isascii() and c.isalpha() for c in text[max(a - 1, 0) : a] + text[b : b + 1])
        if not plain and raw[a:b].encode("latin-1").decode("utf-8", "replace") in _LETTERS:
            return True
    return len(found) > 2 and sum(b - a for a, b in found) > 0.9 * sum(c > "\x7f" for c in text)


def decodes(text: str) -> bool:
    """Whether some codec turns parts of the text into UTF-8 of a known letter, or nearly all of it into any UTF-8.

    Such texts, and those with lost characters, stay out of the corpus statistics: a corpus with many garbled
    texts would otherwise vouch for its own errors. Sound texts among them cost a little support and no more.
    """
    return not text.isascii() and (LOST in text or any(_suspect(text, t, c in CYRILLIC) for c, t in zip(CODECS, _BYTES)))


def _wide(text: str) -> str:
    return "".join(c for c in text if c > "\x7f")


class PairModel:
    """Pointwise mutual information of adjacent characters over the corpus, discounted where support is small."""

    def __init__(self, counts: np.ndarray) -> None:
        n = counts.reshape(SYMBOLS, SYMBOLS).astype(np.float64)
        expected = np.outer(n.sum(1), n.sum(0)) / max(n.sum(), 1.0)
        self.log = np.log(n + PSEUDO).astype(np.float32).ravel()
        self.most = float(self.log.max())
        self.seen = n.sum(0) + n.sum(1) > 0
        self.pmi = np.log((n + PSEUDO) / (np.maximum(expected, 1.0) + PSEUDO)).astype(np.float32).ravel()

    def runs(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text, its improbable runs: the maximum-scoring segments of the negated pair scores, as character spans.

        With C the running sum and M its running minimum, C - M falls to zero where no segment is worth
        keeping; each excursion above zero, from its start to its peak, is one segment. All texts are scanned at
        once; a drop below any score separates them.
        """
        pairs, owner = _flat_pairs(texts)
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(pairs):
            return found
        score = -self.pmi[pairs].astype(np.float64)
        fresh = np.concatenate(([True], owner[1:] != owner[:-1]))
        total = np.cumsum(score)
        low = np.concatenate(([0.0], total[:-1]))
        # A text's minimum must not see sums of the texts before it: shift every text below all earlier ones.
        base = np.maximum.accumulate(np.where(fresh, np.arange(len(pairs)), 0))
        shift = -(np.cumsum(fresh) * (2 * np.abs(score).sum() + 1.0))
        local = total - low[base]
        excess = local - (np.minimum.accumulate(np.minimum(np.where(fresh, 0.0, np.concatenate(([0.0], local[:-1]))), local) + shift) - shift)
        up = excess > 1e-6
        start = np.flatnonzero(up & (fresh | np.concatenate(([True], ~up[:-1]))))
        if not len(start):
            return found
        stop = np.append(start[1:], len(pairs))
        for a, b in zip(start.tolist(), stop.tolist()):
            piece = excess[a:b]
            dead = np.flatnonzero((piece <= 1e-6) | (owner[a:b] != owner[a]))
            piece = piece[: dead[0]] if len(dead) else piece
            text = int(owner[a])
            first = a - int(base[a])
            found[text].append((max(0, first - MARGIN), min(len(texts[text]), first + int(piece.argmax()) + 2 + MARGIN)))
        return found

    def cost(self, text: str) -> float:
        """Improbability of the pairs of a text that are not wholly ASCII."""
        if len(text) < 2:
            return 0.0
        s = _symbols(text)
        wide = (s[1:] >= 128) | (s[:-1] >= 128)
        return float(np.minimum(self.pmi[(s[:-1] * SYMBOLS + s[1:])[wide]], 0.0).sum() * -1.0)

    def sound(self, before: str, after: str) -> bool:
        """Whether every character that came in is one the corpus has; text in letters new to it counts only if nearly all was garbled."""
        came = "".join(set(after) - set(before))
        wide = [sum(c > "\x7f" for c in t) for t in (before, after)]
        return not came or bool(self.seen[_symbols(came)].all()) or (wide[1] > 2 and wide[0] > 1.9 * wide[1])

    def familiarity(self, text: str) -> float:
        """Mean logarithm of the corpus counts of the pairs of a text that are not wholly ASCII."""
        s = _symbols(text)
        wide = (s[1:] >= 128) | (s[:-1] >= 128)
        return float(self.log[(s[:-1] * SYMBOLS + s[1:])[wide]].mean()) if wide.any() else 0.0

    def swapped(self, text: str) -> str | None:
        """The text in the one-byte encoding that makes it far more familiar, if there is one that all its wide characters allow."""
        wide = _wide(text)
        if not wide:
            return None
        points = set(map(ord, wide))
        best, most = None, self.familiarity(text) + max(PAIR_GAIN, WHOLE_GAIN / len(wide))
        if most >= self.most:
            return None  # nothing could be that familiar
        for table in _SWAPS:
            if all(p in table for p in points):
                tried = text.translate(table)
                if (f := self.familiarity(tried)) > most:
                    best, most = tried, f
        return best

    def restore(self, texts: list[str]) -> list[str]:
        """Each text with its garbled parts undone as far as any codec explains them; sound texts come back as they are."""
        out = list(texts)
        begun = [_BLANKED.sub("Ã\xa0", t) for t in texts]
        beams = {i: [(self.cost(t), t)] for i, t in enumerate(begun) if len(t) > 1 and not t.isascii()}
        best = {i: b[0] for i, b in beams.items()}
        met = {(i, text) for i, beam in beams.items() for _, text in beam}
        done = 0.0
        # Layer by layer, all distinct partial readings; undoing makes a text shorter, so this ends.
        while beams:
            at = [(i, cost, text) for i, beam in beams.items() for cost, text in beam]
            beams = {}
            for (i, _cost, now), span in zip(at, self.runs([t for *_, t in at])):
                for table in _BYTES if span else ():
                    tried = _undo(now, table, span)
                    if tried != now and (i, tried) not in met:
                        met.add((i, tried))
                        beams.setdefault(i, []).append((self.cost(tried), tried))
            for i, found in beams.items():
                found.sort(key=lambda x: x[0])  # stable: equal costs stay in the order of CODECS
                for cost, text in found:
                    # Within the first layer the cheapest reading wins; each further one must be worth it.
                    if cost < best[i][0] - GAIN * done and self.sound(begun[i], text):
                        best[i] = (cost, text)
            done = 1.0
        for i, (cost, text) in best.items():
            if text != begun[i] and cost < self.cost(begun[i]) - GAIN:
                out[i] = text
        # One-byte text in the wrong table: where most wide characters are improbable, and that explains more than multi-byte readings.
        many = list(best)
        for i, spans in zip(many, self.runs([texts[i] for i in many])):
            inside = sum(len(_wide(texts[i][a:b])) for a, b in spans)
            if inside * 2 >= len(_wide(texts[i])) and (found := self.swapped(texts[i])) is not None and self.cost(found) < self.cost(out[i]) - GAIN:
                out[i] = found
        return out


def _counted(texts: DataFrame, wanted) -> np.ndarray:  # noqa: ANN001
    """Pair counts over the texts for which ``wanted`` (made once a task) holds, as a flat SYMBOLS x SYMBOLS array.

    Each Arrow batch is counted where it lies; the shuffle and the driver see at most SYMBOLS squared sums, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, kept = wanted(), {}
        for batch in batches:
            column = [t for t in batch.column(0).to_pylist() if t and keep(t)]
            if column:
                pair, n = np.unique(_flat_pairs(column)[0], return_counts=True)
                for p, k in zip(pair.tolist(), n.tolist()):
                    kept[p] = kept.get(p, 0) + k
        yield pa.RecordBatch.from_pydict({"pair": pa.array(list(kept), pa.int32()), "n": pa.array(list(kept.values()), pa.int64())})

    rows = texts.select("text").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
    counts[rows["pair"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def _packed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


def _model(packed: tuple[np.ndarray, np.ndarray]) -> PairModel:
    counts = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
    counts[packed[0]] = packed[1]
    return PairModel(counts)


def pair_counts(texts: DataFrame) -> np.ndarray:
    """Counts of adjacent characters over column ``text``, without texts that look garbled.

    A first pass leaves out texts that hold UTF-8 in another encoding; its counts tell which of the rest would be far more familiar in
    another one-byte encoding, and a second pass leaves those out too.
    """
    first = texts.sparkSession.sparkContext.broadcast(_packed(_counted(texts, lambda: lambda t: not decodes(t))))

    def sound():  # noqa: ANN202
        model = _model(first.value)
        return lambda t: not decodes(t) and model.swapped(t) is None

    return _counted(texts, sound)


RESTORED = T.StringType()


def restored_texts(texts: DataFrame) -> DataFrame:
    """``texts`` (field, record_id, text) with ``restored`` and ``garbled``.

    A text is garbled if an improbable run of it turns out to be UTF-8 read in another encoding, if most of its wide characters lie in such runs and
    are far more familiar in another one-byte encoding, or if it holds U+FFFD
    (then what can be restored is, the rest stays lost). Null and empty texts are sound. ``text`` is read twice:
    once for the pair statistics, once to restore; nothing is shuffled between.
    """
    counts = pair_counts(texts)
    shared = texts.sparkSession.sparkContext.broadcast(_packed(counts))
    model: list[PairModel] = []

    @F.pandas_udf(RESTORED)
    def restore(text: pd.Series) -> pd.Series:
        if not model:
            model.append(_model(shared.value))
        code, values = pd.factorize(text)
        made = [*model[0].restore(list(values)), None]
        return pd.Series([made[c] for c in code], dtype=object)

    wide = F.col("text").rlike(r"[^\x00-\x7F]")
    out = texts.filter(wide).withColumn("restored", restore(F.col("text"))).unionByName(texts.filter(~wide | F.col("text").isNull()).withColumn("restored", F.col("text")))
    return out.withColumn("garbled", F.coalesce((F.col("restored") != F.col("text")) | F.contains(F.col("text"), F.lit(LOST)), F.lit(False)))


def logged_texts(keystrokes: DataFrame, composition_log: DataFrame) -> DataFrame:
    """(field, record_id, text): each section's sentence and each unescaped text_change, once. Written to the shared folder, as it is read twice."""
    from keyloom.llm.visible_text import unescape

    sentence = keystrokes.select(F.lit("sentence").alias("field"), F.col("test_section_id").alias("record_id"), F.col("sentence").alias("text"))
    change = composition_log.select(F.lit("text_change").alias("field"), F.col("log_id").alias("record_id"), unescape(F.col("text_change")).alias("text"))
    # A single character forms no pair; only a lost one matters.
    some = (F.length("text") > 1) | F.contains(F.col("text"), F.lit(LOST))
    once = sentence.unionByName(change).filter(some & F.col("record_id").isNotNull()).distinct()
    # Few bytes but much work a text: spread them as wide as the session shuffles, not by size.
    return cut_lineage(once.repartition(partitions(keystrokes.sparkSession), "field", "record_id"))


def garbled_texts(texts: DataFrame, stimuli: DataFrame) -> DataFrame:
    """(field, record_id, stimulus_id) of garbled texts: the stimulus the restored text equals, 0 if none or if characters are lost."""
    bad = restored_texts(texts).filter("garbled")
    known = stimuli.filter("stimulus is not null").groupBy(F.col("stimulus").alias("restored")).agg(F.min("stimulus_id").alias("stimulus_id"))
    joined = bad.join(known, "restored", "left")
    lost = F.contains(F.col("text"), F.lit(LOST))
    return joined.select("field", "record_id", F.when(lost, F.lit(0)).otherwise(F.coalesce("stimulus_id", F.lit(0))).cast("long").alias("stimulus_id")).distinct()
