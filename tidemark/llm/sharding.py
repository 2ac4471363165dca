"""Shards of near equal bytes, by sampled splitters.

Records are ordered by the digest of their text, then by id, so equal texts are
neighbours.  A sample of keys is drawn, a record the likelier the larger it is, and
its quantiles cut the order into ranges; ranges that come out overfull are sampled
again by themselves and subdivided, until each has at most twice its share or holds
one key only.  The ranges' exact sums then give every record its place: shards are
stretches of the order, cut where the sums say.

A range is sized by bytes and rows together, so very many tiny records are spread
as well as a few large ones.  All this is done on narrow rows (key, digest, size);
texts are shuffled once, to their range.  The driver holds the sample, a few sums a
range and the groups of equal texts that are larger than the 32nd part of a shard, of
which there are at most 32 a shard.  Those groups may be cut; all others stay together.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, shared_root, table, work_dir

#: Sampled keys a range.
OVERSAMPLE = 40
#: A range has about so many bytes at most, however large the input.
RANGE_BYTES = 32 << 20
#: A group of equal texts is cut only where it is larger than this part of a shard.
GROUP_PART = 32

Splitters = tuple[np.ndarray, np.ndarray]  # digests, ids; ascending
_LOWEST = np.iinfo(np.int64).min


def digest(text: Column) -> Column:
    """The first 60 bits of the SHA-256 of a text."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 15), 16, 10).cast("long")


def _range_of(splitters: Splitters, h: np.ndarray, i: np.ndarray) -> np.ndarray:
    """How many splitters are not above each key (h, i)."""
    sh, si = splitters
    at = np.searchsorted(sh, h, "right")
    low = np.searchsorted(sh, h, "left")
    for key in np.unique(h[low < at]):  # as many as there are different splitters at most
        mine = h == key
        a, b = np.searchsorted(sh, key, "left"), np.searchsorted(sh, key, "right")
        at[mine] = a + np.searchsorted(si[a:b], i[mine], "right")
    return at


def _ranged(keys: DataFrame, splitters: Splitters) -> DataFrame:
    """Adds ``part``, the range of each key."""
    known = keys.sparkSession.sparkContext.broadcast(splitters)  # as many as ranges; a parameter bounds them

    @F.pandas_udf("long")
    def part(cols: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, i in cols:
            yield pd.Series(_range_of(known.value, h.to_numpy(), i.to_numpy()))

    return keys.withColumn("part", part("h", "i"))


def _sample(keys: DataFrame, weight: Column, wanted: Column, seed: int) -> np.ndarray:
    """(part, h, i, weight) of keys drawn with odds wanted * weight, at most 1; a row
    that is drawn for certain stands for its whole weight, another for 1 / wanted."""
    odds = wanted * weight
    luck = F.shiftrightunsigned(F.xxhash64("h", "i", F.lit(seed)), 11).cast("double") / float(1 << 53)
    rows = keys.filter(luck < odds).select("part", "h", "i", F.greatest(weight, 1 / wanted).alias("w")).toArrow()
    return np.rec.fromarrays([rows.column(k).to_numpy() for k in range(4)], names="part,h,i,w")


def _quantiles(drawn: np.ndarray, pieces: int) -> list[tuple[int, int]]:
    """Keys that cut the sample into so many pieces of equal weight, at most."""
    drawn = drawn[np.lexsort((drawn.i, drawn.h))]
    upto = np.cumsum(drawn.w)
    cut = np.searchsorted(upto, upto[-1] * np.arange(1, pieces) / pieces)
    return [(int(drawn.h[k]), int(drawn.i[k])) for k in np.unique(cut)]


def split_points(keys: DataFrame, ranges: int, large: set[int], rounds: int = 12) -> tuple[Splitters, list]:
    """Splitters for about ``ranges`` ranges and the sums (part, n, size) of what
    lies between them.  Only groups in ``large`` are cut inside."""
    rows, size = keys.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("copies") * F.col("size")), F.lit(0))).first()
    if not rows:
        return (np.empty(0, np.int64), np.empty(0, np.int64)), []
    # A row's weight: its share of all bytes and its share of all rows; all weigh 2.
    weight = F.col("copies") * F.col("size") / float(size) + F.col("copies") / float(rows)
    points: set[tuple[int, int]] = set()
    parts = keys.withColumn("part", F.lit(0).cast("long"))
    over = {0: ranges}
    for turn in range(rounds):
        # Each overfull range gets as many pieces as it has shares.
        todo = parts.filter(F.col("part").isin(list(over)))
        drawn = _sample(todo, weight, F.lit(OVERSAMPLE * ranges / 2.0), turn)
        for p, pieces in over.items():
            mine = drawn[drawn.part == p]
            if len(mine):
                points |= {(h, i if h in large else _LOWEST) for h, i in _quantiles(mine, 2 * pieces if turn else pieces)}
        both = np.array(sorted(points), np.int64).reshape(-1, 2)
        splitters = both[:, 0].copy(), both[:, 1].copy()
        parts = _ranged(keys, splitters)
        same = F.when(F.col("h").isin(list(large)), F.col("i")).otherwise(F.lit(0))
        sums = parts.groupBy("part").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("size"), F.sum(weight).alias("w"), F.min(F.struct("h", same.alias("i"))).alias("low"), F.max(F.struct("h", same.alias("i"))).alias("high")).collect()  # one row a range
        share = 2.0 / ranges
        over = {r.part: int(np.ceil(r.w / share)) for r in sums if r.w > 2 * share and r.low != r.high}
        if not over:
            break
    return splitters, [(r.part, r.n, r.size) for r in sums]


def plan_shards(docs: DataFrame, shards: int, text: str, key: str, ranges: int | None) -> tuple[Splitters, list[tuple[int, int, list[tuple[int, int]]]]]:
    """The splitters (for ``ranges`` ranges, or as many as the bytes ask for), and for each range that has records its number, the records
    before it and the (first record, shard) of every shard in it."""
    spark = docs.sparkSession
    shared_root(spark)
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(key).cast("long").alias("key"), digest(t).alias("h"), (F.octet_length(t) + 1).cast("long").alias("size"))
    keys = d.groupBy("key", "h", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("i", F.coalesce("key", F.lit(_LOWEST))).checkpoint()
    much = F.col("copies") * F.col("size")
    total = keys.agg(F.coalesce(F.sum(much), F.lit(0))).first()[0]
    ranges = ranges or max(8 * shards, partitions(spark), total // RANGE_BYTES)
    # Groups above a part of all bytes: shards * GROUP_PART rows at most.
    large = {r[0] for r in keys.groupBy("h").agg(F.sum(much).alias("s")).filter(F.col("s") * shards * GROUP_PART > total).select("h").collect()}
    splitters, sums = split_points(keys, ranges, large)
    before, n, size = [], 0, 0
    for p, rows, b in sorted(sums):
        before.append((p, n, size))
        n, size = n + rows, size + b
    known = spark.createDataFrame(before or [(-1, 0, 0)], "part long, rows_before long, bytes_before long")  # one row a range
    earlier = Window.partitionBy("part").orderBy("h", "i", F.col("key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("part", "h")  # a group that is not cut lies in one range
    placed = _ranged(keys, splitters).join(F.broadcast(known), "part")
    placed = placed.withColumns({"at": F.col("bytes_before") + F.coalesce(F.sum(much).over(earlier), F.lit(0)), "nth": F.col("rows_before") + F.coalesce(F.sum("copies").over(earlier), F.lit(0))})
    placed = placed.withColumns({"start": F.min("at").over(group), "all": F.sum(much).over(group)})
    whole = ~F.col("h").isin(list(large))
    # Twice the middle of the record, or of its group, in bytes; the k-th part of all bytes begins at k / shards of them.
    low = F.when(whole, 2 * F.col("start") + F.col("all")).otherwise(2 * F.col("at") + F.col("size"))
    high = F.when(whole, low).otherwise(low + 2 * (F.col("copies") - 1) * F.col("size"))
    shard = lambda x: F.least(F.lit(shards - 1), F.call_function("div", x * shards, F.lit(2 * max(total, 1)))).cast("long")
    placed = placed.select("nth", "size", low.alias("low"), shard(low).alias("one"), F.explode(F.sequence(shard(low), shard(high))).alias("shard"))
    need = F.col("shard") * F.lit(2 * max(total, 1)) - F.col("low") * shards
    copy = F.when(F.col("shard") == F.col("one"), 0).otherwise(F.call_function("div", need + 2 * F.col("size") * shards - 1, 2 * F.col("size") * shards))
    firsts = sorted((r.first, r.shard) for r in placed.groupBy("shard").agg(F.min(F.col("nth") + copy).alias("first")).collect())  # one row a shard
    starts = [f for f, _ in firsts]
    found = []
    ends = [x[1] for x in before[1:]] + [n] * bool(before)
    for (p, n, _), after in zip(before, ends, strict=True):
        found.append((p, n, [(int(f), int(k)) for f, k in firsts[bisect_right(starts, n) - 1 : bisect_left(starts, after)]]))
    return splitters, found


def assign_shards(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """Adds sh_shard (0 to shards - 1) and sh_slot (gapless from 0) to every row;
    rows come in ranges, in their order.

    A size is the text's UTF-8 bytes plus 1; a null text has no bytes.  Shard k takes
    what has its middle in the k-th part of all bytes: a group of equal texts that is
    at most the 32nd part of a shard as a whole, records of larger groups one by one.
    So shards differ from equal sizes by a 32nd part or by the largest record at most,
    and a record larger than a shard may leave others empty.  The sample decides only
    how the work is dealt out, not the result: reruns agree.  Null keys come first in
    their group.  Rows that repeat key and text are records of their own; they are
    counted together but written by one task, row by row.  Texts of any length are
    digested whole.  Columns that begin with ``sh_`` are replaced, all others kept; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    cols = [c for c in docs.columns if not c.startswith("sh_")]
    splitters, found = plan_shards(docs, shards, text, key, ranges)
    known = spark.createDataFrame(found or [(-1, 0, [])], "part long, rows_before long, cuts array<struct<first: long, shard: int>>")  # one row a range
    rows = docs.select(F.struct(*cols).alias("row"), digest(F.col(text)).alias("h"), F.col(key).cast("long").alias("key")).withColumn("i", F.coalesce("key", F.lit(_LOWEST)))
    rows = _ranged(rows, splitters).repartition(max(len(found), partitions(spark)), "part")
    order = Window.partitionBy("part").orderBy("h", "i", F.col("key").asc_nulls_first())
    rows = rows.withColumn("n", F.row_number().over(order)).join(F.broadcast(known), "part").withColumn("nth", F.col("rows_before") + F.col("n") - 1)
    cut = F.element_at(F.filter("cuts", lambda c: c["first"] <= F.col("nth")), -1)
    rows = rows.select("row", cut.alias("cut"), "nth")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in cols], F.col("cut.shard").alias("sh_shard"), (F.col("nth") - F.col("cut.first")).alias("sh_slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, text: str = "text", key: str = "doc_id") -> None:
    """Writes the rows, with sh_slot, to folders sh_shard=k."""
    assign_shards(docs, shards, text, key).write.partitionBy("sh_shard").parquet(path)


def op13_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in eight shards of near equal bytes, as the shards that
    were written say."""
    path = work_dir(spark, "shards")
    write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    d = spark.read.schema("doc_id long, text string, sh_slot long, sh_shard int").parquet(path)
    t = F.coalesce(F.col("text"), F.lit(""))
    return d.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), F.col("sh_shard").alias("shard"), F.col("sh_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: crc32 goes byte by byte through the polynomial's table.
OP13_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) AS c FROM (SELECT unnest(range(256)) AS b))),
d AS (SELECT doc_id, coalesce(text, '') AS t, ('0x' || substr(sha256(coalesce(text, '')), 1, 15)) AS h, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size FROM documents),
crc AS (SELECT t, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: (16 * (instr('0123456789ABCDEF', x[1]) - 1) + instr('0123456789ABCDEF', x[2]) - 1)::BIGINT), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS crc
        FROM (SELECT DISTINCT t FROM d) CROSS JOIN tab),
a AS (SELECT *, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY h) AS much, coalesce(sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM d),
s AS (SELECT *, least(7, ((CASE WHEN much * 256 > total THEN 2 * upto + size ELSE 2 * min(upto) OVER (PARTITION BY h) + much END) * 8 // (2 * total)))::INT AS shard FROM a)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM s JOIN crc USING (t)
"""
