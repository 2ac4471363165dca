"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them).  A small flow network routes each pattern's words to the quotas of its
sources; a pattern may be passed over up to ``max_repeats`` times, each pass
dearer than the one before, so nothing repeats while fresh words are left.
Seeded documents then fill each pattern's share.

Only one row per pattern reaches the driver (``MAX_PATTERNS`` is checked);
documents never do.  A hot pattern is never sorted in one task: documents fall
into 4096 buckets by seeded hash, bucket sums find the one bucket in which the
share ends, and only that bucket is put in order.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hold, table, word_count

#: Patterns that the driver routes, at about 1 KB each; more of them are refused, never dropped.
MAX_PATTERNS = 1_000_000
BUCKET_BITS = 12


def water_fill(sizes: dict, weights: dict, total: float, cap: float) -> dict:
    """Shares ``total`` by weight; none above ``cap`` times its size, the
    excess shared anew by weight among the rest."""
    left, open_, out = float(total), set(sizes), {}
    while open_:
        w = sum(weights[s] for s in open_)
        want = {s: left * weights[s] / w for s in open_}
        over = [s for s in open_ if want[s] > cap * sizes[s]]
        if not over:
            return out | want
        for s in sorted(over, key=lambda s: (s is None, s or "")):
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


class _Network:
    """Largest flow from node 0 to node 1 by levels and blocking flows."""

    def __init__(self, nodes: int):
        self.head: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, c in ((a, b, room), (b, a, 0)):
            self.head[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)
        return len(self.to) - 2

    def _levels(self) -> list[int]:
        level, queue = [-1] * len(self.head), deque([0])
        level[0] = 0
        while queue:
            x = queue.popleft()
            for e in self.head[x]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def fill(self) -> None:
        while (level := self._levels())[1] >= 0:
            at, path, x = [0] * len(self.head), [], 0
            while True:
                if x == 1:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    path = path[: next(i for i, e in enumerate(path) if not self.room[e])]
                    x = self.to[path[-1]] if path else 0
                elif at[x] < len(self.head[x]):
                    e = self.head[x][at[x]]
                    if self.room[e] and level[self.to[e]] == level[x] + 1:
                        path.append(e)
                        x = self.to[e]
                    else:
                        at[x] += 1
                elif path:
                    x = self.to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break


def route(patterns: dict[str, int], members: dict[str, list], quota: dict, max_repeats: int) -> dict[str, int]:
    """Min-cost flow.  Patterns feed the quotas of their sources; pass r over a
    pattern costs r (convex).  As only passes cost, the cheapest flow fills all
    it can with first passes, then with second ones, and so on: a largest flow
    after each pass is opened.  Returns the words taken from each pattern."""
    place = {s: 2 + i for i, s in enumerate(quota)}
    net = _Network(2 + len(place) + len(patterns))
    feed = {}
    for i, (p, size) in enumerate(patterns.items(), 2 + len(place)):
        feed[p] = net.arc(0, i, 0)
        for s in members[p]:
            net.arc(i, place[s], max_repeats * size)
    for s, q in quota.items():
        net.arc(place[s], 1, q)
    for _ in range(max_repeats):
        for p, size in patterns.items():
            net.room[feed[p]] += size
        net.fill()
    return {p: net.room[e + 1] for p, e in feed.items()}


def mix_sources(
    docs: DataFrame,
    sources: Column,
    size: Column,
    key: Column,
    cycle: tuple[float, ...] = (5, 2, 1),
    share: float = 1.0,
    max_repeats: int = 3,
    seed: int = 17,
    cut: bool = True,
) -> tuple[DataFrame, dict]:
    """Adds ``mix_size``, ``mix_pattern`` and ``mix_taken`` to every document.

    sources: array of the sources that hold the document (nulls are a source
    of their own; an empty or null array takes part in no quota).  Sources in
    code-point order, null last, weigh ``cycle``, repeating.  cut: the last
    document of a share is cut to fill it to the word; otherwise documents are
    taken whole and the share is met to within half a document.

    Empty texts have size 0 and take 0; a text of any length is one number here; rows that repeat an id share its place
    in the order; columns of the input are kept (names beginning with ``mix_``
    are replaced).  An empty table gives an empty result.

    The second result has the plan: sources' sizes, weights, targets, and
    words by pattern.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1)
    docs = docs.select(
        "*",
        size.alias("mix_size"),
        F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))).alias("mix_pattern"),
        order.alias("mix_order"),
    ).withColumn("mix_bucket", F.shiftright("mix_order", 63 - BUCKET_BITS))
    sums = hold(docs.groupBy("mix_pattern", "mix_bucket").agg(F.sum("mix_size").alias("words")), StorageLevel.MEMORY_AND_DISK)
    rows = sums.groupBy("mix_pattern").agg(F.sum("words").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    rows = sorted((r[0], int(r[1] or 0)) for r in rows)
    patterns = dict(rows)
    members = {p: json.loads(p) for p in patterns}
    sizes: dict = {}
    for p, n in rows:
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + n
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: cycle[i % len(cycle)] for i, s in enumerate(ranked)}
    targets = water_fill(sizes, weights, share * sum(patterns.values()), max_repeats)
    taken = route(patterns, members, {s: round(targets[s]) for s in ranked}, max_repeats)
    plan = {"sizes": sizes, "weights": weights, "targets": targets, "taken": taken, "members": members}

    part = [(p, *divmod(taken[p], n)) if n else (p, 0, 0) for p, n in rows]
    want = spark.createDataFrame(part, "mix_pattern string, mix_base long, mix_rest long")
    w = Window.partitionBy("mix_pattern").orderBy("mix_bucket")
    ends = (
        sums.withColumn("before", F.sum("words").over(w) - F.col("words"))
        .join(F.broadcast(want), "mix_pattern")
        .filter((F.col("before") < F.col("mix_rest")) & (F.col("mix_rest") <= F.col("before") + F.col("words")))
        .select("mix_pattern", F.col("mix_bucket").alias("mix_end"), (F.col("mix_rest") - F.col("before")).alias("mix_left"))
    )
    # One row per pattern, and their number was checked above.
    known = docs.join(F.broadcast(want), "mix_pattern").join(F.broadcast(ends), "mix_pattern", "left")
    end = F.coalesce("mix_end", F.lit(-1))
    inside = known.filter(F.col("mix_bucket") != end).withColumn("mix_more", F.when(F.col("mix_bucket") < end, F.col("mix_size")).otherwise(F.lit(0)))
    w = Window.partitionBy("mix_pattern").orderBy("mix_order", key, "mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = known.filter(F.col("mix_bucket") == end).withColumn("mix_before", F.sum("mix_size").over(w) - F.col("mix_size"))
    room = F.col("mix_left") - F.col("mix_before")
    more = F.greatest(F.lit(0), F.least(room, F.col("mix_size"))) if cut else F.when(F.col("mix_size") <= 2 * room, F.col("mix_size")).otherwise(F.lit(0))
    edge = edge.withColumn("mix_more", more).drop("mix_before")
    out = inside.unionByName(edge).withColumn("mix_taken", (F.col("mix_base") * F.col("mix_size") + F.col("mix_more")).cast("long"))
    return out.drop("mix_base", "mix_rest", "mix_end", "mix_left", "mix_more", "mix_order", "mix_bucket"), plan


def take_mix(docs: DataFrame) -> DataFrame:
    """The documents that a mix takes, whole, as often as it takes them; the
    columns of the input.  A null source is a source of its own; null and empty
    texts are never taken, as they have no words; rows that repeat an id stand at
    one place of the order, ties by size; a very long text is taken only where
    at least half of it fits its source's share; an empty table gives no rows."""
    cols = docs.columns
    mixed, _ = mix_sources(docs, F.array("source"), word_count(F.col("text")), F.col("doc_id"), cut=False)
    copies = F.when(F.col("mix_size") > 0, (F.col("mix_taken") / F.col("mix_size")).cast("int")).otherwise(F.lit(0))
    return mixed.withColumn("mix_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).select(*cols)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    docs = hold(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), StorageLevel.MEMORY_AND_DISK)
    mixed, plan = mix_sources(docs, F.array("source"), F.col("size"), F.col("doc_id"))
    rows = [(p, int(plan["sizes"][m[0]]), float(plan["targets"][m[0]])) for p, m in plan["members"].items()]
    known = spark.createDataFrame(rows, "mix_pattern string, source_size long, target double")
    return mixed.join(F.broadcast(known), "mix_pattern", "left").select("doc_id", "source", "size", "source_size", "target", F.col("mix_taken").alias("taken"))
