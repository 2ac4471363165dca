"""Near-duplicates by ProbMinHash.

Every shingle of five words, weighted by its count, sends a Poisson stream of
arrivals at registers; a register keeps the shingle that arrives first.  A
shingle stops once its next arrival is later than every register's (early
termination).  Two texts agree in a register with their probability Jaccard
similarity.  Bands of registers give candidates, which are verified by the
exact probability Jaccard similarity of the whole texts.

Exact copies (equal word sequences) are collapsed first.  A bucket is worked
on where its texts are, with a local union-find: texts that are joined already
are not compared again, so a large group of copies costs about one comparison
each, and a task emits a spanning forest of its links, never its pairs.  Large
buckets are cut into blocks, and pairs of blocks are tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hold, partitions, slices, table
from tidemark.llm.groups import Forest, components
from tidemark.llm.textops import mix, shingles, word_hashes

_U = np.uint64
_C = _U(0x9E3779B97F4A7C15)
WORDS = 5
BANDS, ROWS = 32, 6
SIMILARITY = 0.8
#: Texts with more copies than one row in so many are handed their class by broadcast.
HOT_GROUPS = 2000
#: A task compares blocks of at most about this many texts and shingles.
BLOCK_TEXTS, BLOCK_SHINGLES = 1000, 500_000


def weighted_shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, row) of all texts, sorted by row and shingle; then two
    64-bit digests of each text's words.  A text of one to four words is one
    shingle; a text without words has none."""
    _, _, _, row, h = word_hashes(col)
    n = len(col)
    s, first = shingles(h, row, WORDS)
    owner = row[first]
    count = np.bincount(row, minlength=n)
    lead = np.concatenate([[0], np.cumsum(count)])[:-1]
    rank = (np.arange(len(h)) - lead[row]).astype(_U)
    digest = [np.zeros(n, _U), np.zeros(n, _U)]
    if len(h):
        some = np.flatnonzero(count)
        for k in (0, 1):
            digest[k][some] = np.add.reduceat(mix(h * _U(2 * k + 1) + mix(rank + _U(k) * _C)), lead[some])
        short = np.flatnonzero((count > 0) & (count < WORDS))
        s, owner = np.concatenate([s, mix(digest[0][short])]), np.concatenate([owner, short])
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])])) if len(s) else np.empty(0, np.int64)
    weight = np.diff(np.append(new, len(s)))
    return s[new], weight.astype(np.float64), owner[new], digest[0], digest[1]


def registers(s: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """The shingle each of m registers of each of n texts holds (0: none)."""
    q, z = np.full(n * m, np.inf), np.zeros(n * m, _U)
    t, r, last = np.zeros(len(s)), 0, np.full(n, np.inf)
    while len(s):
        r += 1
        u = mix(s ^ mix(np.array([r], _U) * _C))
        t = t - np.log1p(-(u >> _U(11)).astype(np.float64) * 2.0**-53) / weight
        live = t < last[owner]
        s, weight, owner, t, u = s[live], weight[live], owner[live], t[live], u[live]
        cell = owner * m + (mix(u ^ _C) % _U(m)).astype(np.int64)
        np.minimum.at(q, cell, t)
        win = q[cell] == t
        z[cell[win]] = s[win]
        texts = np.unique(owner)
        last[texts] = q.reshape(n, m)[texts].max(1)
        live = t < last[owner]
        s, weight, owner, t = s[live], weight[live], owner[live], t[live]
    return z.reshape(n, m)


def band_hashes(z: np.ndarray) -> np.ndarray:
    acc = np.tile(mix(np.arange(1, BANDS + 1).astype(_U)), (len(z), 1))
    z = z.reshape(len(z), BANDS, ROWS)
    for k in range(ROWS):
        acc = mix(acc * _C + z[:, :, k])
    return acc.view(np.int64)


def probability_jaccard(x: np.ndarray, y: np.ndarray, x_all: float, y_all: float) -> float:
    """Exact, from the weights of the common shingles and the total weights."""
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    cx = np.cumsum(x)
    cy = np.cumsum(y)
    return float((1 / ((x_all - cx[-1] + cx) / x + (y_all - cy[-1] + cy[-1] - cy) / y)).sum()) if len(x) else 0.0


def link_block(ids: np.ndarray, col: pa.Array, side: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the links among the texts; where side has both 0
    and 1, only pairs across sides are compared."""
    s, w, owner, _, _ = weighted_shingles(col)
    n = len(ids)
    cut = np.searchsorted(owner, np.arange(n + 1))
    total = np.bincount(owner, w, n)
    forest, out = Forest(n), []
    both = side.min() != side.max()
    for i in range(n):
        a, b = cut[i], cut[i + 1]
        roots = forest.roots()
        open_ = (roots != roots[i]) & (ids != ids[i])
        open_[: i + 1] = False
        if both:
            open_ &= side != side[i]
        if a == b or not open_.any():
            continue
        lo = cut[i + 1]
        at = np.minimum(np.searchsorted(s[a:b], s[lo:]), b - a - 1) + a
        hit = (s[at] == s[lo:]) & open_[owner[lo:]]
        own, wx, wy = owner[lo:][hit], w[at[hit]], w[lo:][hit]
        bound = np.bincount(own, np.minimum(wx / total[i], wy / total[own]), n)
        for j in np.flatnonzero(bound >= similarity - 1e-9):
            if forest.find(j) == forest.find(i):
                continue
            p, q = np.searchsorted(own, [j, j + 1])
            if probability_jaccard(wx[p:q], wy[p:q], total[i], total[j]) >= similarity - 1e-12:
                forest.join(i, j)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, col in slices(batch):
            s, w, owner, d0, d1 = weighted_shingles(col)
            n = len(col)
            size = np.bincount(owner, minlength=n)
            bands = band_hashes(registers(s, w, owner, n, BANDS * ROWS))
            some = size > 0
            at = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(d0.view(np.int64)), pa.array(d1.view(np.int64)), pa.array(size), pa.ListArray.from_arrays(pa.array(at), pa.array(bands[some].ravel()))],
                ["doc_id", "d0", "d1", "size", "bands"],
            )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task; a task's rows may lie in several batches."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = rows["rep"].to_numpy()
        if len(ids) > 1:
            links = link_block(ids, rows["text"].combine_chunks().cast(pa.large_string()) if rows["text"].num_chunks != 1 else rows["text"].chunk(0).cast(pa.large_string()), rows["side"].to_numpy())
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2)]
        new = np.flatnonzero(np.concatenate([[False], np.any([k[1:] != k[:-1] for k in key], axis=0)]))
        for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
            now = tuple(int(k[a]) for k in key)
            if held and now != last:
                yield from flush()
                held.clear()
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield from flush()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_shingles, kept): class_id is the smallest id that
    links reach; kept marks it.

    Null texts count as empty; texts without words link with nothing, so each
    is a class of its own.  Every shingle of a long text counts.  A similarity
    that equals the limit links.  Rows that repeat an id are one document.  A null id
    has a null class and is kept.  Columns besides key and text are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    n_parts = partitions(spark)
    d = docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text")
    sketch = hold(d.mapInArrow(_sketch, "doc_id long, d0 long, d1 long, size long, bands array<long>"))
    some = sketch.filter("size > 0 and doc_id is not null")
    reps = some.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    one = some.join(reps.select(F.col("rep").alias("doc_id"), "d0", "d1"), ["doc_id", "d0", "d1"]).dropDuplicates(["doc_id", "d0", "d1"])
    banded = one.select(F.col("doc_id").alias("rep"), "size", F.explode("bands").alias("h"))
    shared = banded.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    member = hold(banded.join(shared, "h"))
    sums = member.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y"))
    buckets = sums.groupBy("c", "total", "x", "y").agg(F.min("h").alias("h"))  # buckets of the same texts once
    blocks = F.greatest(F.lit(1), F.ceil(F.col("c") / BLOCK_TEXTS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("nb").cast("long")).cast("int")
    tasks = member.join(buckets.select("h", blocks.alias("nb")), "h").select("h", "rep", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    tasks = tasks.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(F.lit(None).cast("int")).alias("side"), "rep")
    # A block against itself (i = j) has no sides; otherwise the lower block is side 0.
    tasks = tasks.withColumn("side", F.coalesce("side", F.lit(0)))
    texts = d.join(tasks, d["doc_id"] == tasks["rep"]).select("h", "i", "j", "rep", "side", "text")
    links = texts.repartition(n_parts, "h", "i", "j").sortWithinPartitions("h", "i", "j", "rep").mapInArrow(_verify, "a long, b long")
    found = components(links)
    # A text with very many copies hands its class to them by broadcast: at most HOT_GROUPS rows.
    per = hold(reps.join(found, reps["rep"] == found["node"], "left").select("d0", "d1", "n", F.coalesce("component", "rep").alias("class")), StorageLevel.MEMORY_AND_DISK)
    many = F.col("n") > max(1000, sketch.count() // HOT_GROUPS)
    each = sketch.select("doc_id", "d0", "d1", "size").join(F.broadcast(per.filter(many).select("d0", "d1", F.col("class").alias("hot"))), ["d0", "d1"], "left")
    rest = each.filter("hot is null").join(per.filter(~many).select("d0", "d1", "class"), ["d0", "d1"], "left")
    out = each.filter("hot is not null").withColumn("class", F.col("hot")).unionByName(rest)
    class_id = F.when(F.col("size") > 0, F.coalesce("class", "doc_id")).otherwise(F.col("doc_id"))
    class_id = F.when(F.col("doc_id").isNotNull(), class_id)
    out = out.select("doc_id", class_id.alias("class_id"), F.col("size").alias("n_shingles"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class; the columns of the input.  Rows that repeat
    an id are one document, so one of them stays."""
    found = hold(near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id"))
    ids = found.distinct()
    out = docs.join(ids, "doc_id", "left_semi")
    if found.count() > ids.count():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def op8_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
