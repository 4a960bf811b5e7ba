"""Splits that keep related records together (problem 6)."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.session import cut_lineage

SPLITS = ("train", "validation", "test")
SHARES = (0.8, 0.1, 0.1)
#: Sizes up to EXACT are their own class; larger ones fall in classes STEP apart, which bounds the bundles.
EXACT, STEP = 32, 1.15
#: Hash buckets by which the members of a bundle are put in order without one task seeing them all.
BUCKETS = 1024


def session_writers(writer: Column) -> Column:
    """Participant ids a session names: every number but those with the prefix ``klicke``; numbers beyond 64 bits are none."""
    own = F.regexp_replace(F.lower(writer), r"klicke[^0-9]*[0-9]+", " ")
    numbers = F.transform(F.regexp_extract_all(own, F.lit(r"([0-9]+)"), F.lit(1)), lambda x: x.try_cast("long"))
    return F.array_distinct(F.filter(numbers, lambda x: x.isNotNull()))


def person_links(participants: DataFrame, real_sessions: DataFrame) -> DataFrame:
    """(u, v) of ids that must share a split. Groups are linked to their smallest id, never pair by pair.

    previous_id counts if it is another participant's id. Contact codes are compared by letters and digits, whatever
    the case; a code without a digit identifies nobody.
    """
    ids = participants.filter("participant_id is not null")
    known = ids.select(F.col("participant_id").alias("v")).distinct()
    earlier = ids.filter("previous_id <> participant_id").select(F.col("participant_id").alias("u"), F.col("previous_id").alias("v")).join(known, "v", "left_semi")
    code = F.lower(F.regexp_replace("contact_code", r"[^\p{L}\p{N}]", ""))
    coded = ids.select(F.col("participant_id").alias("u"), code.alias("code")).filter(F.col("code").rlike(r"\p{N}")).distinct()
    same = coded.join(coded.groupBy("code").agg(F.min("u").alias("v")), "code").select("u", "v")
    named = real_sessions.select(session_writers(F.col("writer")).alias("w")).filter("size(w) > 1").distinct()
    together = named.select(F.explode(F.slice("w", 2, F.lit(2**30))).alias("u"), F.col("w")[0].alias("v"))
    return earlier.select("u", "v").unionByName(same).unionByName(together).filter("u <> v")


def components(links: DataFrame) -> DataFrame:
    """(id, component): each linked id with the smallest id it is connected to.

    Alternates large-star and small-star: first every node's larger neighbours, then its smaller ones, are linked to
    the smallest in its neighbourhood. Minima are aggregated map-side and joined back, so a hub is never gathered in
    one task; each round is checkpointed, and rounds grow with the logarithm of the chain length.
    """
    edges = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Nodes without larger neighbours keep their smallest one.
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def linked_pairs(participants: DataFrame, real_sessions: DataFrame) -> DataFrame:
    """(participant_a, participant_b): all pairs of participants in one component, as the listed result demands them."""
    own = participants.select(F.col("participant_id").alias("id")).distinct()
    member = components(person_links(participants, real_sessions)).join(own, "id", "left_semi")
    a, b = member.select("component", F.col("id").alias("participant_a")), member.select("component", F.col("id").alias("participant_b"))
    return a.join(b, "component").filter("participant_a < participant_b").select("participant_a", "participant_b")


class _Flow:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []
        self.cost: list[float] = []

    def add(self, a: int, b: int, room: float, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        n = len(self.out)
        height = [0.0] * n
        while True:
            far, via = [math.inf] * n, [-1] * n
            far[source] = 0.0
            heap = [(0.0, source)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x] + 1e-9:
                    continue
                for e in self.out[x]:
                    if self.room[e] > 1e-6 and (t := d + self.cost[e] + height[x] - height[self.to[e]]) < far[self.to[e]] - 1e-9:
                        far[self.to[e]], via[self.to[e]] = t, e
                        heapq.heappush(heap, (t, self.to[e]))
            if via[sink] < 0:
                return
            height = [h + (f if f < math.inf else 0.0) for h, f in zip(height, far)]
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push


def allocate(bundles: list[tuple[str, int, float]], shares: tuple[float, ...] = SHARES) -> list[list[int]]:
    """For each bundle (label, number of components, mean size), how many components go to each split.

    Records flow from bundles through (label, split) cells to splits. Flow within the quota of a bundle, cell or split
    is free; each record beyond a bundle's quota costs 0.1, beyond a cell's 1, beyond a split's 10. The flow is then rounded to whole components,
    largest first: each remaining component goes where its split (then its label's cell) is furthest below quota.
    """
    k = len(shares)
    labels = sorted({b[0] for b in bundles})
    weight = dict.fromkeys(labels, 0.0)
    for label, n, size in bundles:
        weight[label] += n * size
    total = sum(weight.values())
    cells = {x: 2 + len(bundles) + i * k for i, x in enumerate(labels)}
    splits = 2 + len(bundles) + len(labels) * k
    net = _Flow(splits + k)
    arcs = []
    for i, (label, n, size) in enumerate(bundles):
        net.add(0, 2 + i, n * size, 0.0)
        arcs.append([(net.add(2 + i, cells[label] + j, shares[j] * n * size, 0.0), net.add(2 + i, cells[label] + j, n * size, 0.1)) for j in range(k)])
    for label in labels:
        for j in range(k):
            net.add(cells[label] + j, splits + j, shares[j] * weight[label], 0.0)
            net.add(cells[label] + j, splits + j, weight[label], 1.0)
    for j in range(k):
        net.add(splits + j, 1, shares[j] * total, 0.0)
        net.add(splits + j, 1, total, 10.0)
    net.run(0, 1)
    flows = [[net.room[a + 1] + net.room[b + 1] for a, b in arc] for arc in arcs]
    counts = [[0] * k for _ in bundles]
    lack = np.array(shares) * total
    lack_cell = {x: np.array(shares) * weight[x] for x in labels}
    rest = []
    for i, (label, n, size) in enumerate(bundles):
        counts[i] = [min(n, int(f / size + 1e-6)) for f in flows[i]]
        while sum(counts[i]) > n:
            counts[i][int(np.argmax(counts[i]))] -= 1
        lack -= np.array(counts[i]) * size
        lack_cell[label] -= np.array(counts[i]) * size
        rest.append((size, i, n - sum(counts[i])))
    for size, i, left in sorted(rest, reverse=True):
        label = bundles[i][0]
        for _ in range(left):
            fits = [(max(0.0, size - lack[j]) * 10 + max(0.0, size - lack_cell[label][j]), -lack[j], j) for j in range(k)]
            j = min(fits)[2]
            counts[i][j] += 1
            lack[j] -= size
            lack_cell[label][j] -= size
    return counts


def _size_class(size: Column) -> Column:
    above = F.floor(F.log(size / F.lit(float(EXACT))) / math.log(STEP)) + EXACT + 1
    return F.when(size <= EXACT, size).otherwise(above).cast("long")


def assign_splits(members: DataFrame, shares: tuple[float, ...] = SHARES, seed: int = 17) -> DataFrame:
    """(component, split) for ``members`` (component, label), one row per record.

    Components are bundled by size and label profile (the label most of their records carry, the first in order on
    ties). Sizes above 32 share classes 15 % apart, so there are at most about 160 bundles a label, of which only
    counts and weights reach the driver. Labels should be few; anything but two letters counts as ``other``.
    Within a bundle, components are taken in the order of a seeded hash: stable for the same data, unrelated to ids.
    """
    label = F.lower(F.trim("label"))
    label = F.when(label.rlike(r"\A[a-z]{2}\z"), label).otherwise(F.lit("other"))
    by_label = members.groupBy("component", label.alias("label")).agg(F.count("*").alias("n"))
    size = by_label.groupBy("component").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label"))
    rank = F.xxhash64(F.col("component"), F.lit(seed))
    sized = cut_lineage(size.select("component", "label", "size", _size_class(F.col("size")).alias("class"), rank.alias("h"), F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket")))
    bundles = sized.groupBy("label", "class").agg(F.count("*").alias("n"), F.sum("size").alias("w")).orderBy("label", "class").collect()
    counts = allocate([(b["label"], b["n"], b["w"] / b["n"]) for b in bundles], shares) if bundles else []
    names = SPLITS if len(shares) == 3 else tuple(f"part_{i}" for i in range(len(shares)))
    plan = [(b["label"], b["class"], [int(x) for x in np.cumsum(c)]) for b, c in zip(bundles, counts)]
    plan_df = sized.sparkSession.createDataFrame(plan, "label string, class long, upto array<long>")
    per_bucket = sized.groupBy("label", "class", "bucket").agg(F.count("*").alias("c"))
    before = per_bucket.withColumn("before", F.sum("c").over(W.partitionBy("label", "class").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    ranked = sized.withColumn("r", F.row_number().over(W.partitionBy("label", "class", "bucket").orderBy("h", "component")))
    placed = ranked.join(before.select("label", "class", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["label", "class", "bucket"]).join(F.broadcast(plan_df), ["label", "class"])
    position = F.col("r") + F.col("before")
    split = F.coalesce(*(F.when(position <= F.col("upto")[i], name) for i, name in enumerate(names)))
    return placed.select("component", split.alias("split"))


def person_splits(keystrokes: DataFrame, real_sessions: DataFrame, participants: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(kind, record_id, split) of every participant, real session and keystrokes section, each once.

    A session belongs to the people it names; one that names no participant goes by its writer's text, one without a
    writer stands alone. A section whose participant is missing stands alone too. A section delivered under several
    participants follows the smallest of them.
    """
    person = participants.filter("participant_id is not null").groupBy("participant_id").agg(F.min(F.lower(F.trim("native_language"))).alias("label"))
    section = keystrokes.filter("test_section_id is not null").groupBy("test_section_id").agg(F.min("participant_id").alias("p"))
    session = real_sessions.filter("session_id is not null").groupBy("session_id").agg(F.min("writer").alias("writer"))
    writers = session_writers(F.col("writer"))
    other = F.when(F.trim("writer") != "", F.concat(F.lit("w:"), F.lower(F.regexp_replace("writer", r"\s", "")))).otherwise(F.concat(F.lit("s:"), F.col("session_id")))
    records = (
        person.select(F.lit("participant").alias("kind"), F.col("participant_id").alias("record_id"), F.col("participant_id").alias("id"), F.lit(None).cast("string").alias("alone"))
        .unionByName(session.select(F.lit("session").alias("kind"), F.col("session_id").alias("record_id"), F.get(writers, F.lit(0)).alias("id"), other.alias("alone")))
        .unionByName(section.select(F.lit("section").alias("kind"), F.col("test_section_id").alias("record_id"), F.col("p").alias("id"), F.concat(F.lit("k:"), F.col("test_section_id")).alias("alone")))
    )
    group = components(person_links(participants, real_sessions))
    joined = records.join(group, "id", "left").join(person.select(F.col("participant_id").alias("id"), "label"), "id", "left")
    component = F.coalesce(F.concat(F.lit("p:"), F.coalesce("component", "id")), F.col("alone"))
    members = cut_lineage(joined.select("kind", "record_id", "label", component.alias("component")))
    return members.join(assign_splits(members, shares), "component").select("kind", "record_id", "split")
