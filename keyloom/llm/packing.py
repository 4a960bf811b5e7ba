"""Filling fixed-capacity containers with items (problem 8)."""

from __future__ import annotations

import base64
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.ranks import hashed_rank
from keyloom.session import cut_lineage

CAPACITY = 2048
#: Rank file of the public tokenizer that sizes are counted in.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before that tokenizer's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items above this share of the capacity are large; they are rounded up within this many groups of equal cardinality.
LARGE_SHARE, GROUPS = 0.125, 32
_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):  # noqa: ANN202
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null texts have null tokens, empty ones 0."""

    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        encode = _encoding(tokenizer).encode_ordinary
        return pd.Series([None if t is None else len(encode(t.encode("utf-8", "replace").decode("utf-8"))) for t in text], dtype="Int64")

    return documents.select("doc_id", count("text").alias("n_tokens"))


class Plan:
    """Where the items of each length go: the r-th item of a length lies in ``container + (r - first)`` of its slot."""

    def __init__(self) -> None:
        self.slots: dict[int, list[tuple[int, int, int]]] = {}
        self.containers = 0
        self._used: dict[int, int] = {}

    def take(self, length: int, n: int, container: int) -> None:
        first = self._used.get(length, 0)
        self.slots.setdefault(length, []).append((first, n, container))
        self._used[length] = first + n

    def open(self, n: int) -> int:
        self.containers += n
        return self.containers - n


def _groups(lengths: list[int], counts: dict[int, int], k: int) -> list[list[tuple[int, int]]]:
    """Large items, longest first, in at most k groups of (nearly) equal cardinality, each a list of (length, count)."""
    total = sum(counts[x] for x in lengths)
    edges = sorted({total * g // k for g in range(k + 1)})
    out: list[list[tuple[int, int]]] = [[] for _ in edges[1:]]
    group, at = 0, 0
    for x in sorted(lengths, reverse=True):
        n = counts[x]
        while n:
            part = min(n, edges[group + 1] - at)
            out[group].append((x, part))
            n, at = n - part, at + part
            group += at == edges[group + 1]
    return out


def _best_configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Multiplicities of the fullest container that what is left allows (bounded knapsack), longer items preferred."""
    reach = np.full(capacity + 1, -1, dtype=np.int64)  # the size by which a fill was reached first
    reach[0] = len(sizes)
    many = np.zeros(capacity + 1, dtype=np.int64)
    for i, (size, n) in enumerate(zip(sizes, left)):
        if not n or size > capacity:
            continue
        many[:] = 0
        top = min(n, capacity // size)
        for fill in range(size, capacity + 1):
            if reach[fill] < 0 and reach[fill - size] >= 0 and many[fill - size] < top:
                reach[fill], many[fill] = i, many[fill - size] + 1
    fill = int(np.flatnonzero(reach >= 0)[-1])
    out = [0] * len(sizes)
    while fill:
        out[reach[fill]] += 1
        fill -= sizes[reach[fill]]
    return out


def plan_containers(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_share: float = LARGE_SHARE) -> Plan:
    """A plan for ``counts`` items of each length (1 to capacity); its work and size depend on the lengths, not on the items.

    Large lengths are rounded up within groups of equal cardinality. Configurations of the few rounded sizes are
    used fullest first, each as often as what is left allows. Slots are then given to the actual items of the group,
    in runs of equal length, which frees what the rounding had added; small items go, longest first, where they fit
    best, and open containers of their own when none fits.
    """
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    plan = Plan()
    least = capacity * large_share
    queues = _groups([x for x, n in counts.items() if n and x > least], counts, groups)
    sizes, left = [q[0][0] for q in queues], [sum(n for _, n in q) for q in queues]
    runs: list[tuple[int, int, int]] = []  # (free room, first container, containers)
    while any(left):
        config = _best_configuration(sizes, left, capacity)
        times = min(have // need for have, need in zip(left, config) if need)
        first = plan.open(times)
        cuts, filled = {0, times}, []
        for g, need in enumerate(config):
            left[g] -= need * times
            for _ in range(need):
                at = 0
                while at < times:
                    length, n = queues[g][0]
                    part = min(n, times - at)
                    plan.take(length, part, first + at)
                    filled.append((at, part, length))
                    cuts.add(at + part)
                    at += part
                    queues[g][0] = (length, n - part)
                    if part == n:
                        queues[g].pop(0)
        edges = sorted(cuts)
        room = dict.fromkeys(edges[:-1], capacity)
        for at, part, length in filled:
            for e in edges[bisect_left(edges, at) : bisect_left(edges, at + part)]:
                room[e] -= length
        runs += [(room[a], first + a, b - a) for a, b in zip(edges, edges[1:])]
    _best_fit(plan, {x: n for x, n in counts.items() if n and x <= least}, runs, capacity)
    return plan


def _best_fit(plan: Plan, small: dict[int, int], runs: list[tuple[int, int, int]], capacity: int) -> None:
    by_room: dict[int, list[tuple[int, int]]] = {}
    for room, first, n in runs:
        by_room.setdefault(room, []).append((first, n))
    rooms = sorted(r for r in by_room if r)

    def put(room: int, first: int, n: int) -> None:
        if room not in by_room or not by_room[room]:
            at = bisect_left(rooms, room)
            if at == len(rooms) or rooms[at] != room:
                rooms.insert(at, room)
        by_room.setdefault(room, []).append((first, n))

    for length in sorted(small, reverse=True):
        n = small[length]
        while n:
            at = bisect_left(rooms, length)
            while at < len(rooms) and not by_room[rooms[at]]:
                rooms.pop(at)
            if at == len(rooms):
                each = capacity // length
                new = -(-n // each)
                put(capacity, plan.open(new), new)
                continue
            room = rooms[at]
            first, have = by_room[room].pop()
            part = min(n, have)
            plan.take(length, part, first)
            n -= part
            if part < have:
                by_room[room].append((first + part, have - part))
            if room > length:
                put(room - length, first, part)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece_no, token_from, n_tokens, container): every document's container.

    Documents within the capacity are one piece. A longer one is cut into full pieces and a rest, and only such a one.
    An empty text takes no room and lies in container 0; a null text has no tokens and no container. Repeated
    doc_ids with the same size count once each, as they are different rows of the input.

    The driver sees one count per length, at most ``capacity`` of them, and plans by runs; documents find their
    container by their rank among those of equal length, numbered in hash buckets, so no length is one task.
    """
    sized = token_counts(documents, tokenizer).withColumn("pieces", F.when(F.col("n_tokens").isNull(), 1).otherwise(F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1))))
    row = sized.withColumn("row", F.monotonically_increasing_id())
    spread = row.select("doc_id", "row", "n_tokens", F.explode(F.sequence(F.lit(0), (F.col("pieces") - 1).cast("int"))).alias("piece_no"))
    start = F.col("piece_no").cast("bigint") * capacity
    items = cut_lineage(spread.select("doc_id", "row", "piece_no", start.alias("token_from"), F.when(F.col("n_tokens").isNotNull(), F.least(F.col("n_tokens") - start, F.lit(capacity))).alias("n_tokens")))
    counts = {r["n_tokens"]: r["n"] for r in items.filter("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    plan = plan_containers(counts, capacity)
    slots = {x: (np.array([s[0] for s in v]), np.array([s[2] for s in v])) for x, v in plan.slots.items()}
    shared = documents.sparkSession.sparkContext.broadcast(slots)

    @F.pandas_udf(T.LongType())
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(length), dtype=np.int64)
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(order)]):
            rows = order[a:b]
            first, place = shared.value[int(sizes[rows[0]])]
            slot = np.searchsorted(first, ranks[rows], side="right") - 1
            out[rows] = place[slot] + ranks[rows] - first[slot]
        return pd.Series(out)

    placed = hashed_rank(items.filter("n_tokens > 0"), ["n_tokens"], ["doc_id", "row", "piece_no"], "rank")
    columns = ["doc_id", "piece_no", "token_from", "n_tokens"]
    rest = items.filter("n_tokens is null or n_tokens = 0").select(*columns, F.when(F.col("n_tokens") == 0, F.lit(0)).cast("bigint").alias("container"))
    return placed.select(*columns, container("n_tokens", "rank").alias("container")).unionByName(rest)
