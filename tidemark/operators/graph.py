"""Connected components of links between names, distributed.

Stars alternate: each name's larger neighbours are hung on its smallest, then
each name with its smaller neighbours on the smallest of those.  A chain of n
links settles in about log n rounds; groups are only ever summed or joined,
and every round is cut off by checkpoint().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoints


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of a link (a, b); component is the
    smallest node that links reach.  Links may repeat and loop."""
    ensure_checkpoints(links.sparkSession)
    e = links.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct().checkpoint()
    alone = e.filter("big = small").select(F.col("big").alias("node"), F.col("small").alias("component"))
    e, seen = e.filter("big <> small"), None
    while True:
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("big", "small"))).first()
        if state == seen:
            break
        seen = state
        ends = e.union(e.select("small", "big"))
        least = ends.groupBy(F.col("big").alias("at")).agg(F.min("small").alias("m")).select("at", F.least("at", "m").alias("m"))
        hung = ends.filter("small > big").join(least, F.col("big") == F.col("at")).select(F.col("small").alias("big"), F.col("m").alias("small")).distinct()
        tops = hung.groupBy(F.col("big").alias("at")).agg(F.min("small").alias("m"))
        moved = hung.join(tops, F.col("big") == F.col("at")).filter("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small"))
        e = moved.union(tops.select("at", "m")).distinct().checkpoint()
    linked = e.select(F.col("big").alias("node"), F.col("small").alias("component"))
    return linked.union(e.select(F.col("small").alias("node"), F.col("small").alias("component"))).union(alone).groupBy("node").agg(F.min("component").alias("component"))
