"""Connected components of links that stay distributed.

Alternating stars: every node's larger neighbours are hung on its smallest
neighbour, then every node and its smaller neighbours on the smallest of them,
until nothing changes (a few rounds for groups found by hubs).  Only sums over
groups and joins are used, so a hub with any number of links is pre-aggregated
or split, never gathered.  Each round is cut off by checkpoint().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_root


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link (a, b); component is the
    smallest node that links reach."""
    shared_root(links.sparkSession)
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    mark = None
    for _ in range(rounds):
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = rest.union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


class Forest:
    """Union-find over 0..n-1 for one task."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if np.array_equal(nxt, self.up):
                return self.up
            self.up = nxt

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, a: int, b: int) -> bool:
        """True if a and b were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
