"""Quality by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded (shares of
character kinds, repetition, word shape, and hashed words), a learned layer
maps it to a hidden vector, gated attention weighs the passages of a document,
and the weighted representation is classified.  Only document labels are used.

The network is fitted on the driver on a bounded sample of labelled documents
(``sample`` and ``passages`` are the bounds, drawn by hash); scoring reads every passage of every
text in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table, word_count
from tidemark.llm.labelled import held_out, with_labels
from tidemark.llm.textops import mix, word_hashes

PASSAGE = 64
HASHED = 32
_U = np.uint64


def _kinds() -> np.ndarray:
    """Bytes by kind: upper, lower, digit, space, newline, full stop or comma,
    other sentence marks, each further ASCII mark by one of eight groups, and
    bytes of other scripts."""
    kind = np.full(256, 15, np.int64)
    for b in range(128):
        c = chr(b)
        if c.isupper():
            kind[b] = 0
        elif c.islower():
            kind[b] = 1
        elif c.isdigit():
            kind[b] = 2
        elif c == "\n":
            kind[b] = 4
        elif c.isspace() or b < 32 or b == 127:
            kind[b] = 3
        elif c in ".,":
            kind[b] = 5
        elif c in "!?;:'\"()-":
            kind[b] = 6
        else:
            kind[b] = 7 + b % 8
    return kind


_KIND = _kinds()
N_KINDS = 16
N_FEATURES = N_KINDS + 8 + HASHED


def encode_passages(col: pa.Array, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features, row) of every passage of every text; a text without words has
    one passage of zeros."""
    data, start, end, row, h = word_hashes(col)
    n_rows = len(col)
    n_words = np.bincount(row, minlength=n_rows)
    n_pass = np.maximum(1, -(-n_words // passage))
    first = np.concatenate([[0], np.cumsum(n_pass)])
    owner = np.repeat(np.arange(n_rows), n_pass)
    x = np.zeros((first[-1], N_FEATURES), np.float32)
    if not len(start):
        return x, owner
    rank = np.arange(len(start)) - np.searchsorted(row, row)
    p = first[row] + rank // passage
    count = np.bincount(p, minlength=len(x)).astype(np.float32)
    safe = np.maximum(count, 1)
    # Bytes belong to the passage of the last word that began at or before them.
    lead = np.flatnonzero(np.diff(p, prepend=-1))
    byte_p = np.repeat(p[lead], np.diff(np.append(start[lead], end[-1])))
    cells = np.bincount(byte_p * N_KINDS + _KIND[data[start[0] : end[-1]]], minlength=len(x) * N_KINDS).reshape(-1, N_KINDS)
    x[:, :N_KINDS] = cells / np.maximum(cells.sum(1, keepdims=True), 1)
    size = (end - start).astype(np.float32)
    k = N_KINDS
    x[:, k] = np.bincount(p, size, len(x)) / safe / 8
    x[:, k + 1] = np.sqrt(np.bincount(p, size * size, len(x)) / safe) / 16
    x[:, k + 2] = np.log1p(count) / 5
    order = np.lexsort((h, p))
    same = (h[order][1:] == h[order][:-1]) & (p[order][1:] == p[order][:-1])
    x[:, k + 3] = np.bincount(p[order][1:][same], minlength=len(x)) / safe
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    x[:, k + 4] = np.bincount(p[1:][again], minlength=len(x)) / safe
    order = np.lexsort((np.arange(len(h)), h, row))
    seen = np.zeros(len(h), bool)
    seen[order[1:]] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    x[:, k + 5] = np.bincount(p[seen], minlength=len(x)) / safe
    x[:, k + 6] = np.bincount(p[size <= 1], minlength=len(x)) / safe
    x[:, k + 7] = np.bincount(p[size >= 12], minlength=len(x)) / safe
    bucket = (mix(h) >> _U(40)) % _U(HASHED)
    words = np.bincount(p * HASHED + bucket.astype(np.int64), minlength=len(x) * HASHED).reshape(-1, HASHED)
    x[:, k + 8 :] = words / safe[:, None]
    return x, owner


def _forward(w: dict, x: np.ndarray, owner: np.ndarray, n: int) -> dict:
    hid = np.tanh(((x - w["mean"]) / w["std"]) @ w["W"] + w["b"])
    v, u = np.tanh(hid @ w["V"]), 1 / (1 + np.exp(-(hid @ w["U"])))
    e = (v * u) @ w["a"]
    first = np.searchsorted(owner, np.arange(n))
    e = np.exp(e - np.maximum.reduceat(e, first)[owner])
    att = e / np.add.reduceat(e, first)[owner]
    z = np.add.reduceat(att[:, None] * hid, first, axis=0)
    return {"hid": hid, "v": v, "u": u, "att": att, "z": z, "first": first, "logit": z @ w["c"] + w["d"]}


def fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 60, seed: int = 5, decay: float = 1e-4) -> dict:
    """Gradient descent (Adam) on the mean cross entropy of whole bags.

    ``owner`` gives each passage's bag, ascending; every bag has a passage."""
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    middle, spread = (x.mean(0), x.std(0)) if len(x) else (np.zeros(f), np.ones(f))
    w = {"mean": middle, "std": spread + 1e-3, "W": rng.normal(0, f**-0.5, (f, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "a": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.array(0.0)}
    rate = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
    w["d"] = np.array(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        w["c"] *= 0
        return w
    keys = ("W", "b", "V", "U", "a", "c", "d")
    m, s, t = {k: 0.0 for k in keys}, {k: 0.0 for k in keys}, 0
    first = np.searchsorted(owner, np.arange(len(y) + 1))
    for epoch in range(epochs):
        for bags in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            pick = np.concatenate([np.arange(first[b], first[b + 1]) for b in bags])
            own = np.repeat(np.arange(len(bags)), first[bags + 1] - first[bags])
            r = _forward(w, x[pick], own, len(bags))
            dl = (1 / (1 + np.exp(-r["logit"])) - y[bags]) / len(bags)
            dz = dl[:, None] * w["c"]
            da = (dz[own] * r["hid"]).sum(1)
            de = r["att"] * (da - np.add.reduceat(r["att"] * da, r["first"])[own])
            dvu = de[:, None] * w["a"]
            dv, du = dvu * r["u"] * (1 - r["v"] ** 2), dvu * r["v"] * r["u"] * (1 - r["u"])
            dh = (r["att"][:, None] * dz[own] + dv @ w["V"].T + du @ w["U"].T) * (1 - r["hid"] ** 2)
            grad = {"W": ((x[pick] - w["mean"]) / w["std"]).T @ dh + decay * w["W"], "b": dh.sum(0), "V": r["hid"].T @ dv, "U": r["hid"].T @ du, "a": (r["v"] * r["u"]).T @ de, "c": r["z"].T @ dl + decay * w["c"], "d": dl.sum()}
            t += 1
            lr = 0.01 * (1 - epoch / epochs) + 1e-4
            for k in keys:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                s[k] = 0.999 * s[k] + 0.001 * grad[k] ** 2
                w[k] = w[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, rest: int = 2, sample: int = 8000, passages: int = 200_000, key: str = "doc_id") -> dict:
    """Weights learned from at most about ``sample`` labelled documents with at
    most about ``passages`` passages, drawn by hashes of their keys; whole texts,
    at 0.5 KB a passage.  Without labels every score is 0.5."""
    n = labels.count()
    part = labels if n <= sample else labels.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    rows = with_labels(docs, part, label, folds, rest, key)
    total = rows.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(word_count(F.col("text")) / PASSAGE))), F.lit(0))).first()[0]
    if total > passages:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("passages"), key), F.lit(1 << 20)) < int((1 << 20) * passages / total))
    rows = rows.select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, col in slices(batch):
                x, owner = encode_passages(col)
                cut = np.searchsorted(owner, np.arange(len(col) + 1))
                yield pa.RecordBatch.from_pydict({"x": pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), "label": pc.cast(piece.column(1), pa.int32())})

    found = rows.mapInArrow(run, "x binary, label int").collect()
    found.sort(key=lambda r: (r.label, bytes(r.x)))  # tasks may end in any order
    if not found:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0, int), np.zeros(0))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in found]
    return fit(np.concatenate(bags).astype(np.float64), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([r.label for r in found], float))


def score(docs: DataFrame, weights: dict, key: str = "doc_id") -> DataFrame:
    """(key, score, n_passages, top_passage, top_weight) of every whole text.

    Null and empty texts are scored as one passage of zeros; every passage of a
    long text counts; of equally heavy passages the first is the top.  Repeated rows
    are scored alike; the key may be null; columns besides key and text are
    ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, col in slices(batch):
                x, owner = encode_passages(col)
                r = _forward(weights, x, owner, len(col))
                best = np.maximum.reduceat(r["att"], r["first"])
                at = np.flatnonzero(r["att"] == best[owner])
                _, lead = np.unique(owner[at], return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(1 / (1 + np.exp(-r["logit"]))), pa.array(np.bincount(owner, minlength=len(col))), pa.array(at[lead] - r["first"]), pa.array(best)],
                    ["key", "score", "n_passages", "top_passage", "top_weight"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, score double, n_passages long, top_passage long, top_weight double").withColumnRenamed("key", key)


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text; rows of the held-out fold teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, weights)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_passages")
