"""Similarity join of embeddings by subspace pigeonhole.

Unit vectors with cosine of at least c lie within squared distance 2 - 2c.
After a seeded rotation they are split into blocks; each block gets the share
of the squared distance that its dimensions have of all, so a linked pair is
within the budget of at least one block.  Each block is range-joined on its
first coordinate (a window as wide as the budget's radius), then its block
distance is checked, and the candidates are verified exactly in double
precision.  A pair counts in the first block whose budget it meets, so nothing
has to be made distinct.

Equal vectors are collapsed first, with their number.  The classes are written
once, in files of bounded size in the shared folder, and files are dealt into a
few groups; a task takes two groups and reads them chunk by chunk, so what is
written and shuffled grows with the vectors while only reading and comparing
are quadratic.  Tasks emit sums of links and spanning forests, never pairs: a
vector at most once for every group.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hold, open_fs, table, work_dir
from tidemark.llm.groups import components

BLOCKS = 4
#: Vectors in a chunk, and numbers in it; a task holds two chunks.
CHUNK, CHUNK_NUMBERS = 8192, 1 << 22


@lru_cache(maxsize=16)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[slice]:
    cut = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    return [slice(int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def budgets(dim: int, cosine: float) -> list[float]:
    total = 2 - 2 * cosine + 1e-9
    return [total * (b.stop - b.start) / dim for b in blocks_of(dim)]


def rows_in(dim: int, chunk: int) -> int:
    return min(chunk, max(64, CHUNK_NUMBERS // dim))


def _write(base: str, kind: str, chunk: int):
    """Writes a task's classes to files of a chunk at most; gives where each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        fs, root = open_fs(base)

        def flush(dim: int) -> Iterator[pa.RecordBatch]:
            rep, n, m1, m2, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            most = rows_in(dim, chunk)
            fs.create_dir(root, recursive=True)
            for a in range(0, len(rep), most):
                part = slice(a, a + most)
                f = uuid.uuid4().int >> 65
                with fs.open_output_stream(f"{root}/{f}") as out:
                    out.write(n[part].astype("<i8").tobytes() + x[part].astype(kind).tobytes())
                k = len(rep[part])
                cols = (np.full(k, dim, np.int32), np.full(k, f), np.arange(k), rep[part], n[part], m1[part], m2[part])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["dim", "f", "pos", "rep", "n", "m1", "m2"])

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            v = batch.column(4)
            size = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, off = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                most = rows_in(dim, chunk)
                for a in range(0, len(at), most):
                    k = at[a : a + most]
                    held.setdefault(dim, []).append([*(c[k] for c in cols), flat[off[k][:, None] + np.arange(dim)]])
                    if sum(len(h[0]) for h in held[dim]) >= most:
                        yield from flush(dim)
            if sum(len(h[0]) * d for d, hs in held.items() for h in hs) > 2 * CHUNK_NUMBERS:  # many dimensions at once
                for dim in list(held):
                    yield from flush(dim)
        for dim in list(held):
            yield from flush(dim)

    return run


class Chunk:
    """Vectors ready to be joined: of each block the coordinates in the order of the first."""

    def __init__(self, x: np.ndarray, n: np.ndarray):
        # Scaled by the largest part first, so that no square over- or underflows.
        x = x.astype(np.float64)
        self.x, self.n = x / np.abs(x).max(1, keepdims=True), n
        self.length = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        self.y = (self.x / self.length[:, None]) @ rotation(x.shape[1])
        self.order, self.first, self.left, self.right = [], [], [], []
        for part in blocks_of(x.shape[1]):
            p = self.y[:, part].astype(np.float32)
            order = np.argsort(p[:, 0], kind="stable")
            p = p[order]
            sq, one = np.einsum("ij,ij->i", p, p)[:, None], np.ones((len(p), 1), np.float32)
            self.order.append(order)
            self.first.append(p[:, 0].copy())
            # Their product is the squared distance.
            self.left.append(np.hstack([-2 * p, sq, one]))
            self.right.append(np.ascontiguousarray(np.hstack([p, one, sq]).T))


def candidates(a: Chunk, b: Chunk, block: int, budget: float, rows: int = 256, wide: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a and b within a block's budget, or a little over; of one chunk each pair once."""
    radius, most = np.sqrt(budget + 1e-4), np.float32(budget + 1e-4)
    first, other = a.first[block], b.first[block]
    for i in range(0, len(first), rows):
        part = first[i : i + rows]
        low, high = np.searchsorted(other, part[0] - radius, "left"), np.searchsorted(other, part[-1] + radius, "right")
        for j in range(max(int(low), i) if a is b else int(low), int(high), wide):
            d = a.left[block][i : i + rows] @ b.right[block][:, j : min(j + wide, int(high))]
            at = np.flatnonzero((d <= most).ravel())
            if len(at):
                s, t = np.divmod(at, d.shape[1])
                s, t = s + i, t + j
                if a is b:
                    s, t = s[s < t], t[s < t]
                yield a.order[block][s], b.order[block][t]


def link_chunks(a: Chunk, b: Chunk, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each vector, smallest vector its links reach), those of a before those of b.

    Only pairs whose first met budget is the block's count."""
    dim, same = a.x.shape[1], a is b
    parts, most = blocks_of(dim), budgets(dim, cosine)
    size = len(a.n) if same else len(a.n) + len(b.n)
    links, root, shift = np.zeros(size, np.int64), np.arange(size), 0 if same else len(a.n)
    for block in range(len(parts)):
        for u, w in candidates(a, b, block, most[block]):
            for k in range(0, len(u), 65536):
                s, t = u[k : k + 65536], w[k : k + 65536]
                good = np.einsum("ij,ij->i", a.x[s], b.x[t]) / (a.length[s] * b.length[t]) >= cosine
                s, t = s[good], t[good]
                gap = (a.y[s] - b.y[t]) ** 2
                met = np.stack([gap[:, q].sum(1) <= m for q, m in zip(parts, most, strict=True)], 1)
                mine = (met.argmax(1) == block) & met.any(1)
                s, t = s[mine], t[mine]
                if len(s):
                    np.add.at(links, s, b.n[t])
                    np.add.at(links, t + shift, a.n[s])
                    while _hook(root, s, t + shift):
                        pass
    return links, root


def _hook(root: np.ndarray, s: np.ndarray, t: np.ndarray) -> bool:
    """One step of min-label hooking with pointer jumping; False when settled."""
    was = root.copy()
    low = np.minimum(root[s], root[t])
    np.minimum.at(root, root[s], low)
    np.minimum.at(root, root[t], low)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root[:] = up
    return not np.array_equal(was, root)


def _groups(files: list[tuple[int, int, int]], chunk: int, most: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(dimension, number of the first vector, (file, rows)s) of groups of about equal
    size, at most ``most`` a dimension; vectors are numbered file by file."""
    out, at = [], 0
    for dim in sorted({d for d, _, _ in files}):
        mine = [(f, n) for d, f, n in files if d == dim]
        rows = sum(n for _, n in mine)
        target = -(-rows // min(most, -(-rows // rows_in(dim, chunk))))
        begin = at
        for f, n in mine:
            if at == begin or at + n - out[-1][1] > target:
                out.append((dim, at, []))
            out[-1][2].append((f, n))
            at += n
    return out


def _join(base: str, kind: str, cosine: float, chunk: int, groups: list, pairs: list[tuple[int, int]]):
    """Joins the groups whose pairs are numbered by the rows."""

    def load(group: int) -> Iterator[tuple[int, Chunk]]:
        dim, _, files = groups[group]
        fs, root = open_fs(base)
        held, size, at = [], 0, 0

        def made() -> tuple[int, Chunk]:
            return at, Chunk(np.concatenate([x for _, x in held]), np.concatenate([n for n, _ in held]))

        for f, rows in files:
            if held and size + rows > rows_in(dim, chunk):
                yield made()
                held, size, at = [], 0, at + size
            with fs.open_input_stream(f"{root}/{f}") as src:
                raw = src.read()
            held.append((np.frombuffer(raw, "<i8", rows), np.frombuffer(raw, kind, rows * dim, 8 * rows).reshape(rows, dim)))
            size += rows
        yield made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, h in (pairs[i] for i in batch.column(0).to_pylist()):
                sizes = [sum(n for _, n in groups[k][2]) for k in ((g,) if g == h else (g, h))]
                links, root = np.zeros(sum(sizes), np.int64), np.arange(sum(sizes))
                names = np.concatenate([groups[k][1] + np.arange(n) for k, n in zip((g, h), sizes, strict=False)])
                for at, a in load(g):
                    for to, b in load(h):
                        if g == h and to < at:
                            continue
                        one = g == h and to == at
                        n, r = link_chunks(a, a if one else b, cosine)
                        where = at + np.arange(len(a.n))
                        if not one:
                            where = np.concatenate([where, to + np.arange(len(b.n)) + (0 if g == h else sizes[0])])
                        links[where] += n
                        some = np.flatnonzero(r != np.arange(len(r)))
                        while len(some) and _hook(root, where[some], where[r[some]]):
                            pass
                some = np.flatnonzero(links)
                for k in range(0, len(some), 65536):
                    part = some[k : k + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (names[part], names[root[part]], links[part])], ["a", "b", "n"])

    return run


def similarity_join(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, chunk: int = CHUNK) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    n_links counts the other rows linked directly; component_id is the smallest
    key that links reach, itself included; kept marks it.  Vectors that are
    null, zero, or hold null or non-finite components link with nothing;
    vectors link only with those of their dimension.  Rows with equal vectors
    link with each other, repeated keys included; rows that repeat a key with
    other vectors are rows of their own, each with its own links.  A null key
    links with nothing and has a null component and is kept.  A cosine that
    equals the limit links.  Other columns are ignored; an empty table gives no
    rows.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    fine = F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # A class is known by two hashes of its vector, so the vectors themselves are shuffled once.
    m1, m2 = (F.xxhash64(F.lit(seed), "v") for seed in (1, 2))
    classes = v.filter("fine").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).select("rep", "n", m1.alias("m1"), m2.alias("m2"), "v")
    base, kind = work_dir(spark, "vectors"), "<f4" if single else "<f8"
    # Checkpointed: a task that is run again writes files of other names.
    written = classes.mapInArrow(_write(base, kind, chunk), "dim int, f long, pos long, rep long, n long, m1 long, m2 long").checkpoint()
    files = sorted(tuple(r) for r in written.groupBy("dim", "f").agg(F.count(F.lit(1)).alias("rows")).collect())  # one row a file
    groups = _groups(files, chunk, math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)))
    pairs = [(g, h) for g in range(len(groups)) for h in range(g, len(groups)) if groups[g][0] == groups[h][0]]
    starts, at = [], 0
    for _, f, n in files:
        starts.append((f, at))
        at += n
    starts = spark.createDataFrame(starts or [(0, 0)], "f long, start long")
    nodes = written.join(F.broadcast(starts), "f").select((F.col("start") + F.col("pos")).alias("node"), "rep", "n", "m1", "m2")
    found = hold(spark.range(0, len(pairs), 1, max(1, len(pairs))).mapInArrow(_join(base, kind, cosine, chunk, groups, pairs), "a long, b long, n long"))
    linked = components(found.select("a", "b"))
    least = linked.join(nodes, "node").groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select("node", "least")
    sums = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    per = nodes.join(sums, "node", "left").join(linked, "node", "left").select("m1", "m2", "rep", "n", "links", "least")
    v = v.select("id", F.when(F.col("fine"), m1).alias("m1"), F.when(F.col("fine"), m2).alias("m2"))
    out = v.join(per, ["m1", "m2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "rep", "id"))
    out = out.select(F.col("id").alias(key), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op7_embedding_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return similarity_join(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.a, r.c FROM p JOIN r ON p.b = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.c AS component_id, m.c = v.vec_id AS kept
FROM v JOIN m ON v.vec_id = m.a LEFT JOIN k ON v.vec_id = k.a
"""
