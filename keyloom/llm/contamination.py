"""Evaluation texts leaking into training text (problem 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.visible_text import visible_form

#: Words of a passage; a document leaks an item if it holds so many of its words in a row.
PASSAGE = 12
#: Bits by which fingerprints of passages and of near copies may differ. A fingerprint has BLOCKS blocks, of which one differs in at most
#: radius // BLOCKS bits; all such neighbours of an item's block are in the index, so the search is complete.
RADIUS, NEAR_RADIUS, BLOCKS = 3, 11, 4
#: Words of a shingle, and the share of an item window's shingle weight a near copy must have in common.
SHINGLE, SIMILARITY = 5, 0.8
#: Quarters, in words, of the windows near copies are sought by. A text is cut into windows at every quarter.
QUARTERS = (3, 4, 6, 9, 14, 21)
#: Quarter of the window for parts of items, beside the largest that an item can hold.
PART = 4
#: Words by which a near copy may be shifted against the item within a shingle (words put in or left out).
SHIFT = 2
#: Near-copy windows of items that are searched at a time (about 150 MB a worker); more items are searched in several passes.
WINDOWS_A_PASS = 64_000
#: Characters of texts that are searched at a time, and candidates that are compared at a time.
TEXT_CHARS, CANDIDATES = 2_000_000, 20_000
_WORD = re.compile(r"[^\W_]+")
_EMPHASIS = str.maketrans("", "", "*_~`'")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Words as a reader compares them: visible form, case folded; apostrophes and emphasis marks vanish, all else that is no letter or digit parts words."""
    return _WORD.findall(visible_form(text).translate(_EMPHASIS).casefold())


class _Hashes(dict):
    """64-bit hashes of words, emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def fingerprints(h: np.ndarray, passage: int = PASSAGE) -> np.ndarray:
    """64-bit SimHash of every window of ``passage`` word hashes: the majority, bit by bit, of its word pairs.

    The votes are counted for 64 bits at once in vertical counters, one word of bits per binary digit of the count.
    """
    n = len(h) - passage + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        pair = (h[:-1] * _ODD) ^ ((h[1:] << np.uint64(31)) | (h[1:] >> np.uint64(33)))
        pair ^= pair >> np.uint64(29)
        pair *= np.uint64(0xBF58476D1CE4E5B9)
        pair ^= pair >> np.uint64(32)
    votes = passage - 1
    digits = [np.zeros(n, dtype=np.uint64) for _ in range(votes.bit_length())]
    for j in range(votes):
        carry = pair[j : j + n]
        for d in digits:
            d ^= carry
            carry = ~d & carry
    # Majority: the count is at least votes // 2 + 1, compared from the highest digit down.
    least, above, equal = votes // 2 + 1, np.zeros(n, dtype=np.uint64), np.full(n, ~np.uint64(0))
    for i in reversed(range(len(digits))):
        if least >> i & 1:
            equal = equal & digits[i]
        else:
            above |= equal & digits[i]
            equal = equal & ~digits[i]
    return above | equal


def _votes(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The votes of each word on each of 64 bits: its weight, for or against."""
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.view(np.int8) * np.int8(2) - np.int8(1)) * weight.astype(np.int8)[:, None]


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").reshape(-1).view(np.uint64)


def strided_prints(votes: np.ndarray, quarter: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, SimHash) of the windows of four quarters that start at every half of a quarter, rounded down."""
    starts, prints = [], []
    for offset in (0, quarter // 2):
        n = (len(votes) - offset) // quarter
        if n < 4:
            continue
        stop = offset + n * quarter
        blocks = votes[offset:stop:quarter].copy()
        for j in range(1, quarter):
            blocks += votes[offset + j : stop : quarter]
        starts.append(np.arange(n - 3) * quarter + offset)
        halves = blocks[:-1].astype(np.int16) + blocks[1:]  # a quarter's sum is at most 63
        prints.append(_packed(halves[:-2] + halves[2:]))
    return (np.concatenate(starts), np.concatenate(prints)) if starts else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64))


def rolling_prints(votes: np.ndarray, quarter: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, SimHash) of windows of four quarters at every ``step`` words and at the very end."""
    size = 4 * quarter
    starts = np.unique(np.append(np.arange(0, len(votes) - size + 1, step), len(votes) - size))
    total = np.concatenate((np.zeros((1, 64), dtype=np.int32), np.cumsum(votes, axis=0, dtype=np.int32)))
    return starts, _packed(total[starts + size] - total[starts])


class HammingIndex:
    """Fingerprints by the values of their blocks, and by all values at most radius // BLOCKS bits away: complete within ``radius``."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        bits = 64 // BLOCKS
        flips = [sum(1 << b for b in c) for k in range(radius // BLOCKS + 1) for c in combinations(range(bits), k)]
        self.blocks = []
        for b in range(BLOCKS):
            own = ((prints >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1)).astype(np.uint16)
            key = (own[None, :] ^ np.array(flips, dtype=np.uint16)[:, None]).ravel()
            order = np.argsort(key, kind="stable")
            start = np.concatenate(([0], np.cumsum(np.bincount(key, minlength=1 << bits))))
            self.blocks.append((np.uint64(b * bits), (order % max(len(prints), 1)).astype(np.int32), start))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (number of a given fingerprint, number of one in the index) that differ in at most ``radius`` bits."""
        found = [np.empty(0, dtype=np.int64)]
        for shift, order, start in self.blocks if len(self.prints) else ():
            key = ((prints >> shift) & np.uint64(len(start) - 2)).astype(np.int64)
            n = start[key + 1] - start[key]
            # A portion of keys at a time, so hits of common blocks never pile up.
            for rows in np.array_split(np.flatnonzero(n), int(n.sum()) // 4_000_000 + 1):
                many = n[rows]
                at = np.repeat(rows, many)
                inner = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                windows = order[np.repeat(start[key[rows]], many) + inner]
                near = np.bitwise_count(prints[at] ^ self.prints[windows]) <= self.radius
                found.append(at[near] * len(self.prints) + windows[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(len(self.prints), 1), pairs % max(len(self.prints), 1)


class ItemIndex:
    """Fingerprints of the items' passages (windows of ``passage`` words) and of windows of their own size and of sentence size."""

    def __init__(self, items: list[tuple[int, np.ndarray]], passage: int = PASSAGE, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS) -> None:
        """``items``: (item_id, word hashes)."""
        self.least = similarity
        self.passage = passage
        self.ids = [i for i, _ in items]
        self.hashes = [h for _, h in items]
        prints = [fingerprints(h, passage) for h in self.hashes]
        self.item = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
        self.at = np.concatenate([np.arange(len(p)) for p in prints]) if prints else np.empty(0, dtype=np.int64)
        self.exact = HammingIndex(np.concatenate(prints) if prints else np.empty(0, dtype=np.uint64), RADIUS)
        # Weight of a word: rarer among the items, heavier; words no item has weigh as much as the rarest.
        self.vocabulary, df = np.unique(np.concatenate([np.unique(h) for h in self.hashes]) if items else np.empty(0, dtype=np.uint64), return_counts=True)
        self.idf = np.log1p(len(items) / df)
        self.rare = float(np.log1p(max(len(items), 1)))
        self.flat = np.concatenate(self.hashes) if items else np.empty(0, dtype=np.uint64)
        self.begin = np.cumsum([0, *(len(h) for h in self.hashes)])
        self.flat_weight = self.weights(self.flat)
        self.near: dict[int, tuple[np.ndarray, np.ndarray, int, HammingIndex]] = {}
        made: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for k, h in enumerate(self.hashes):
            votes = _votes(h, self._steps(self.flat_weight[self.begin[k] : self.begin[k + 1]])) if len(h) >= 4 * QUARTERS[0] else None
            for quarter in near_quarters(len(h)):
                made.setdefault(quarter, []).append((k, *rolling_prints(votes, quarter, max(1, quarter // 3))))
        for quarter, parts in made.items():
            owner = np.repeat([k for k, *_ in parts], [len(s) for _, s, _ in parts])
            at = np.concatenate([s for _, s, _ in parts])
            self.near[quarter] = (owner, at, self._least_words(owner, at, 4 * quarter, similarity), HammingIndex(np.concatenate([p for *_, p in parts]), radius))

    def weights(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(h), self.rare)
        at = np.searchsorted(self.vocabulary, h).clip(max=len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, self.idf[at], self.rare)

    def _least_words(self, k: np.ndarray, q: np.ndarray, size: int, similarity: float) -> int:
        """Distinct words without which no text can reach ``similarity`` with any of these item windows: the heaviest of each, until they suffice."""
        own = (self.begin[k] + q)[:, None] + np.arange(size)
        share = self.flat_weight[own] * np.minimum(np.minimum(np.arange(size) + 1, size - np.arange(size)), SHINGLE)  # a word counts in up to five shingles
        order = np.argsort(self.flat[own], axis=1)
        word, share = np.take_along_axis(self.flat[own], order, 1), np.cumsum(np.take_along_axis(share, order, 1), axis=1)
        last = np.concatenate((word[:, 1:] != word[:, :-1], np.ones((len(own), 1), dtype=bool)), axis=1)
        each = np.where(last, share, 0.0)
        each = np.where(last, each - np.concatenate((np.zeros((len(own), 1)), np.maximum.accumulate(each, axis=1)[:, :-1]), axis=1), 0.0)
        reached = np.cumsum(-np.sort(-each, axis=1), axis=1) >= similarity * share[:, -1:] - 1e-9
        return int(reached.argmax(1).min()) + 1

    def _steps(self, weight: np.ndarray) -> np.ndarray:
        """Weights in a fingerprint's votes: 1 to 3."""
        return np.ceil(3.0 * weight / self.rare).clip(1, 3)

    def similarity(self, h: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, p: np.ndarray, k: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        """Weighted five-word-shingle similarity of item windows (item k, from word q) with the text from word p of ``h`` on.

        A shingle counts by the share of its weight that the text has in the same places, at the best of the shifts by up to SHIFT words;
        where words differ, the heavier one's weight is missed. ``low`` and ``high`` bound the text that p lies in.
        """
        j = np.arange(size)
        own = (self.begin[k] + q)[:, None] + j
        item, wi = self.flat[own], self.flat_weight[own]
        sums = lambda x: (c := np.concatenate((np.zeros((len(x), 1)), np.cumsum(x, axis=1)), axis=1))[:, SHINGLE:] - c[:, :-SHINGLE]
        best = np.zeros((len(p), size - SHINGLE + 1))
        for shift in range(-SHIFT, SHIFT + 1):
            at = p[:, None] + j + shift
            inside = (at >= low[:, None]) & (at < high[:, None])
            at = at.clip(0, len(h) - 1)
            same = inside & (h[at] == item)
            best = np.maximum(best, sums(wi * same))
        return best.sum(1) / sums(wi).sum(1)

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int, int, int, float]]:
        """(number of the text, item, longest, windows, near, best) for each item a text holds something of: words of the longest stretch both have
        word by word (at least a passage, else 0), windows of a passage's size that are an item's word by word, windows that are near copies, and the
        best similarity. Fingerprints of all texts propose at once, the words decide."""
        words = [_hashes(words_of(t)) for t in texts]
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(size)
        start = end - size
        h = np.concatenate(words) if words else np.empty(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(words)), size)
        found: dict[tuple[int, int], list] = {}
        if not len(h):
            return []
        self._passages(h, owner, end, found)
        self._near_copies(h, owner, start, end, found)
        return [(t, self.ids[k], *x) for (t, k), x in found.items()]

    def _passages(self, h: np.ndarray, owner: np.ndarray, end: np.ndarray, found: dict) -> None:
        n = self.passage
        # Windows that would reach into the next text are none.
        first = np.flatnonzero(np.arange(len(h)) + n <= end[owner])
        rows, windows = self.exact.candidates(fingerprints(h, n)[first])
        r, k, at = first[rows], self.item[windows], self.at[windows]
        same = np.ones(len(r), dtype=bool)
        for j in range(n):
            same &= h[r + j] == self.flat[self.begin[k] + at + j]
        streak: dict[tuple[int, int, int], tuple[int, int]] = {}
        counted: dict[tuple[int, int], set[int]] = {}
        for t, i, x, y in zip(owner[r[same]].tolist(), k[same].tolist(), r[same].tolist(), at[same].tolist()):
            last, length = streak.get((t, i, x - y), (-2, 0))
            streak[t, i, x - y] = (x, length := length + 1 if last == x - 1 else n)
            row = found.setdefault((t, i), [0, 0, 0, 1.0])
            counted.setdefault((t, i), set()).add(x)
            row[0], row[1] = max(row[0], length), len(counted[t, i])

    def _near_copies(self, h: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray, found: dict) -> None:
        weight = self.weights(h)
        votes = _votes(h, self._steps(weight))
        known = np.concatenate(([0], np.cumsum(self.vocabulary[np.searchsorted(self.vocabulary, h).clip(max=max(len(self.vocabulary) - 1, 0))] == h))) if len(self.vocabulary) else np.zeros(len(h) + 1)
        for quarter, (item, begins, least, index) in self.near.items():
            p, prints = strided_prints(votes, quarter)
            size = 4 * quarter
            # Windows that would reach into the next text are none; those with too few words of any item cannot be copies.
            whole = (p + size <= end[owner[p]]) & (known[np.minimum(p + size + SHIFT, len(h))] - known[np.maximum(p - SHIFT, 0)] >= least)
            p, prints = p[whole], prints[whole]
            rows, windows = index.candidates(prints)
            hits: dict[tuple[int, int], set[int]] = {}
            for a in range(0, len(rows), CANDIDATES):
                r, k, q = p[rows[a : a + CANDIDATES]], item[windows[a : a + CANDIDATES]], begins[windows[a : a + CANDIDATES]]
                t = owner[r]
                s = self.similarity(h, weight, start[t], end[t], r, k, q, size)
                good = s >= self.least
                for text, i, x, score in zip(t[good].tolist(), k[good].tolist(), r[good].tolist(), s[good].tolist()):
                    row = found.setdefault((text, i), [0, 0, 0, 0.0])
                    row[3] = max(row[3], score)
                    hits.setdefault((text, i), set()).add(x)
            for pair, places in hits.items():
                found[pair][2] += len(places)


def near_quarters(n: int) -> list[int]:
    """Quarters of the windows by which near copies of an item of n words are sought: the largest that lies within it wherever a text's windows fall
    (the smallest for short items), and that for parts. Items of fewer words than a passage have none."""
    fit = [x for x in QUARTERS if 5 * x - 1 <= n] or [x for x in QUARTERS[:1] if 4 * x <= n]
    return sorted({fit[-1], min(fit[-1], PART)}) if fit else []


def _portions(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about TEXT_CHARS characters, with the number of the first."""
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= TEXT_CHARS or i + 1 == len(texts):
            yield begin, texts[begin : i + 1]
            begin, chars = i + 1, 0


def _hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [_hashes(words_of(t)).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"])


def leaked_items(documents: DataFrame, eval_items: DataFrame, passage: int = PASSAGE, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS) -> DataFrame:
    """(doc_id, item_id, longest, windows, near, similarity): documents holding passages of evaluation items or near copies of them, with the items.

    ``longest`` counts the words of the longest stretch that is word for word an item's, 0 if there is no passage of at least ``passage`` words;
    ``windows`` such passages. ``near`` counts windows, of the item's size or of a sentence's, that reach ``similarity`` with the item;
    ``similarity`` is the best of all, 1 for a passage. Items or documents of fewer words than a passage have no rows; null texts have none.
    A doc_id or item_id that occurs twice keeps the larger figures.

    Documents are read once where they lie and nothing of them is shuffled but their hits. The evaluation items are the stated query set:
    hashes of their words (8 bytes each) go to all tasks, in passes of at most WINDOWS_A_PASS windows each; only more items than that read the documents again.
    """
    hashed = eval_items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null").mapInArrow(_hashed_words, "item_id long, words array<long>")
    passes: list[list[tuple[int, np.ndarray]]] = [[]]
    room = WINDOWS_A_PASS
    for row in hashed.toLocalIterator():
        h = np.array(row["words"], dtype=np.int64).view(np.uint64)
        size = sum((len(h) - 4 * x) // max(1, x // 3) + 1 for x in near_quarters(len(h)))
        if size > room and passes[-1]:
            passes.append([])
            room = WINDOWS_A_PASS
        passes[-1].append((row["item_id"], h))
        room -= size
    schema = "doc_id long, item_id long, longest int, windows int, near int, similarity double"
    texts = documents.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    found = None
    for items in passes:
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index = ItemIndex(shared.value, passage, similarity, radius)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [(ids[begin + t], *x) for begin, texts in _portions(batch.column(1).to_pylist()) for t, *x in index.leaks(texts)]
                columns = list(zip(*out)) if out else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "longest", "windows", "near", "similarity"])

        hits = texts.mapInArrow(search, schema)
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("longest", "windows", "near", "similarity")))
