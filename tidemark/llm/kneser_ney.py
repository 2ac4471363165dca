"""Toxicity by class-conditional Kneser-Ney models.

Words are spelled as runs of bytes between boundary marks.  Each class has its
own counts of the runs of six bytes; both back off to the same Kneser-Ney
continuation counts of five bytes and fewer, so a spelling that a class has
never seen costs it no more than the other.  The log-likelihood ratio of a
document's words, normalised by length over the whole text and over windows
of 8 and 16 words, goes through a logistic curve fitted on labelled documents
that the counts leave out.

Counting covers every labelled document and is distributed (words, then runs,
then continuations).  The model is a table of every run of six bytes that occurs,
whatever its count; it is collected and sent to the tasks, and grows with the
number of different runs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table
from tidemark.llm.labelled import held_out, with_labels
from tidemark.llm.textops import hash_spans, raw, words

N = 6
DISCOUNT = 0.75
WINDOWS = (8, 16)


def _fold_table() -> np.ndarray:
    """Lower-case ASCII letters; other ASCII marks become spaces."""
    t = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        t[b] = ord(c.lower()) if c.isalnum() or c == "'" else 32
    return t


_FOLD = _fold_table()


def fold_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, off = raw(col)
    data = _FOLD[data]
    return data, *words(data, off)


def spell(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run of N bytes as an integer, word) for every place of every word."""
    size = end - start
    n = size + 1
    word = np.repeat(np.arange(len(start)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    padded = np.append(data, np.uint8(0))
    run = np.zeros(len(at), np.int64)
    for k in range(N):
        pos = at - (N - 1) + k
        byte = padded[np.minimum(np.maximum(pos, 0) + start[word], len(data))].astype(np.int64)
        byte[pos < 0] = 2
        byte[pos == size[word]] = 3
        run = (run << 8) | byte
    return run, word


class Model:
    """Log-likelihood ratios from counts.  runs: sorted runs of N bytes with
    their counts by class; all: (sums, kinds) by class and context of all runs."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray, context: np.ndarray, sums: np.ndarray, kinds: np.ndarray, lower: list[tuple[np.ndarray, np.ndarray]]):
        self.runs, self.context, self.lower = runs, context, []
        for key, n in lower:  # from N - 1 bytes down to 1
            ctx, at = np.unique(key >> 8, return_inverse=True)
            self.lower.append((key, n, ctx, np.bincount(at, n), np.bincount(at)))
        self.counts, self.sums, self.kinds = counts, sums, kinds
        self.known = self._ratio(runs) if len(runs) else np.zeros(0)

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return at, keys[at] == x

    def shared(self, x: np.ndarray) -> np.ndarray:
        """Continuation probability of the last byte after the N - 2 before it."""
        p = np.full(len(x), 1 / 256)
        for level in range(len(self.lower) - 1, -1, -1):
            key, n, ctx, total, kinds = self.lower[level]
            part = x & ((1 << 8 * (N - 1 - level)) - 1)
            i, ok = self._find(ctx, part >> 8)
            j, hit = self._find(key, part)
            if not len(ctx):
                continue
            q = (np.where(hit, np.maximum(n[j] - DISCOUNT, 0), 0) + DISCOUNT * kinds[i] * p) / total[i]
            p = np.where(ok, q, p)
        return p

    def _ratio(self, x: np.ndarray) -> np.ndarray:
        back = self.shared(x & ((1 << 8 * (N - 1)) - 1))
        i, ok = self._find(self.context, x >> 8)
        j, hit = self._find(self.runs, x)
        out = []
        for c in (0, 1):
            if not len(self.context):
                return np.zeros(len(x))
            total = self.sums[c][i]
            n = np.where(hit, self.counts[c][j], 0) if len(self.runs) else 0
            p = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * self.kinds[c][i] * back) / np.maximum(total, 1)
            out.append(np.log(np.where(ok & (total > 0), np.maximum(p, 1e-12), back)))
        return out[1] - out[0]

    def ratios(self, x: np.ndarray) -> np.ndarray:
        j, hit = self._find(self.runs, x)
        out = np.empty(len(x))
        out[hit] = self.known[j[hit]]
        out[~hit] = self._ratio(x[~hit])
        return out

    def features(self, col: pa.Array) -> np.ndarray:
        """Per text: mean ratio of its words, and the largest mean of a window
        (windows at the end count as full)."""
        data, start, end, row = fold_words(col)
        out = np.zeros((len(col), 1 + len(WINDOWS)))
        if not len(start):
            return out
        _, one, which = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
        run, word = spell(data, start[one], end[one])
        v = np.bincount(word, self.ratios(run), len(one))[which]
        have, first = np.unique(row, return_index=True)
        n = np.diff(np.append(first, len(v)))
        out[have, 0] = np.add.reduceat(v, first) / n
        upto = np.concatenate([[0], np.cumsum(v)])
        last = np.repeat(first + n, n)
        for k, w in enumerate(WINDOWS):
            s = (upto[np.minimum(np.arange(len(v)) + w, last)] - upto[:-1]) / w
            out[have, 1 + k] = np.maximum.reduceat(s, first)
        return out


def count_words(rows: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word, n0, n1): counts by class, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(held[0] | held[1])
            r = pa.RecordBatch.from_pydict({"word": pa.array(keys, pa.binary()), "n0": pa.array([held[0][k] for k in keys], pa.int64()), "n1": pa.array([held[1][k] for k in keys], pa.int64())})
            held[0].clear()
            held[1].clear()
            return r

        lower = bytes(_FOLD)
        for batch in batches:
            for piece, col in slices(batch):
                for t, y in zip(col, piece.column(1).to_pylist(), strict=True):
                    held[y].update(t.as_py().encode().translate(lower).split())
                if len(held[0]) + len(held[1]) > flush:
                    yield out()
        if held[0] or held[1]:
            yield out()

    counted = rows.select("text", F.when(F.col("label") > 0, 1).otherwise(0).alias("label")).mapInArrow(run, "word binary, n0 long, n1 long")
    return counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def count_runs(counted: DataFrame) -> DataFrame:
    """(run, n0, n1) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0).cast(pa.large_binary())
            data, off = raw(col)
            r, word = spell(data, off[:-1], off[1:])
            keys, at = np.unique(r, return_inverse=True)
            n = [np.bincount(at, batch.column(i).to_numpy()[word], len(keys)).astype(np.int64) for i in (1, 2)]
            yield pa.RecordBatch.from_pydict({"run": pa.array(keys), "n0": pa.array(n[0]), "n1": pa.array(n[1])})

    return counted.mapInArrow(run, "run long, n0 long, n1 long").groupBy("run").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def train(rows: DataFrame) -> Model:
    """The model of (text, label) rows: every run, context and continuation."""
    runs = count_runs(count_words(rows)).persist(StorageLevel.MEMORY_AND_DISK)
    top = runs.orderBy("run").toArrow()
    ctx = runs.groupBy(F.shiftright("run", 8).alias("c")).agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"), F.count_if(F.col("n0") > 0).alias("k0"), F.count_if(F.col("n1") > 0).alias("k1"))
    ctx = ctx.orderBy("c").toArrow()
    num = lambda t, c: t[c].to_numpy().astype(np.int64)
    # All shorter levels at once: a run of k bytes counts the different runs of k + 1 that end in it.
    end = lambda k: F.col("run").bitwiseAND(F.lit((1 << 8 * k) - 1)) if k < N else F.col("run")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), end(k + 1).alias("long"), end(k).alias("short")) for k in range(1, N)]))
    ends = runs.select(each.alias("e")).select("e.*").distinct().groupBy("k", "short").agg(F.count(F.lit(1)).alias("n")).orderBy("k", "short").toArrow()
    k, short, n = (num(ends, c) for c in ("k", "short", "n"))
    cut = np.searchsorted(k, np.arange(1, N + 1))
    lower = [(short[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]]) for i in range(N - 2, -1, -1)]
    runs.unpersist()
    return Model(num(top, "run"), np.stack([num(top, "n0"), num(top, "n1")]), num(ctx, "c"), np.stack([num(ctx, "s0"), num(ctx, "s1")]), np.stack([num(ctx, "k0"), num(ctx, "k1")]), lower)


def _features(docs: DataFrame, model, extra: str, kind: str) -> DataFrame:
    """(extra column, f0, f1, f2) of every row of (extra, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for piece, col in slices(batch):
                f = m.features(col)
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(f[:, i]) for i in range(f.shape[1]))], ["key", "f0", "f1", "f2"])

    return docs.select(F.col(extra).alias("key"), "text").mapInArrow(run, f"key {kind}, f0 double, f1 double, f2 double")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with intercept last) by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    pen = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pen, z.T @ (p - y) + pen @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, rest: int = 0, calibration: int = 20_000, key: str = "doc_id") -> DataFrame:
    """(key, score, llr, llr_w8, llr_w16) of every whole text.

    A fifth of the rows that may be learned (at most about ``calibration``)
    fit the curve; the counts leave that fifth out.  Null and empty texts have
    ratio 0 and are scored so; every word of a long text counts; a score at the
    limit of a verdict is above it.  Without labels of both classes every score is
    0.  Repeated rows score alike; null keys are kept; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = with_labels(docs, labels, label, folds, rest, key)
    apart = F.pmod(F.xxhash64(F.lit("curve"), key), F.lit(5)) == 0
    model = spark.sparkContext.broadcast(train(rows.filter(~apart)))
    n = labels.count()
    part = F.pmod(F.xxhash64(F.lit("part"), key), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 5 * calibration / max(n, 1)))
    fitted = _features(rows.filter(apart & part).select("label", "text"), model, "label", "int").toPandas().sort_values(["key", "f0", "f1", "f2"])
    y = (fitted["key"].to_numpy() > 0).astype(float)
    if len(y) and 0 < y.mean() < 1:
        mean, scale, w = _logistic(fitted[["f0", "f1", "f2"]].to_numpy(), y)
    else:
        mean, scale, w = np.zeros(3), np.ones(3), np.array([0, 0, 0, -1e3])
    kind = docs.schema[key].dataType.simpleString()
    f = _features(docs, model, key, kind)
    logit = F.lit(float(w[3]))
    for i in range(3):
        logit = logit + F.lit(float(w[i])) * (F.col(f"f{i}") - F.lit(float(mean[i]))) / F.lit(float(scale[i]))
    return f.select(F.col("key").alias(key), (1 / (1 + F.exp(-logit))).alias("score"), F.col("f0").alias("llr"), F.col("f1").alias("llr_w8"), F.col("f2").alias("llr_w16"))


def op3_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; rows of the held-out fold teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "llr")
