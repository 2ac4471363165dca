"""Lexical retrieval packing.

BM25 over token ids, with document frequencies and the mean length of all
documents.  A document's full windows stand alone; what is left of it (less
than a window) is packed with lexical neighbours, in rounds over all that is
still unused:

* every text draws terms in proportion to their idf (consistent sampling: texts
  draw the same term as often as their idf-weighted Jaccard similarity says),
  and the drawn terms are its key; all unused texts are range-partitioned by key
  and cut into shards of ``shard_tokens`` ids, so likely neighbours share one;
* a shard builds an inverted index; a seed's BM25 scores for every unused text
  of the shard give the neighbours that fill its window, best first; the one
  that no longer fits is cut and its rest is the next seed;
* when ``share`` of a shard's ids are packed, so that the last seeds still have
  a choice, the rest goes on to the next round, which draws anew.

What fits one shard in the end is packed there completely, and only the last
window of all is not full: it is cut into sequences of powers of two, which need
no padding.  Rounds shrink geometrically, so the work is linear in the input;
each is written to the shared folder.  No text is held that is longer than a
window except by the encoder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, slices, table, work_dir
from tidemark.llm.textops import mix
from tidemark.llm.tokens import CHUNK, encoder, with_end

_U = np.uint64
K1, B = 1.2, 0.75
#: Shards that one task works on, at most about.
SHARDS_A_TASK = 32
DRAWS = 3
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "uid", "draw", "df")
_TYPES = (*[pa.int64()] * 7, pa.binary(), pa.int64(), pa.int64(), pa.binary())
#: A row is a piece (sequence_id), a text that waits (uid), or a task's counts (df).
_ROW = _PIECE + ", ids binary, uid long, draw long, df binary"


class Stats:
    """Of all documents: their number, mean length and the idf of each term."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean = n, max(mean, 1.0)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def weights(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))

    def ranks(self, turn: int) -> list[np.ndarray]:
        """For each draw the place of every term in an exponential race at the
        rate of its idf: the term of a text that comes first is drawn."""
        term = np.arange(len(self.idf)).astype(_U)
        out = []
        for k in range(DRAWS):
            u = (mix(term ^ mix(np.array([turn * DRAWS + k + 1], _U))) >> _U(11)).astype(np.float64) * 2.0**-53
            rank = np.empty(len(term), np.int64)
            rank[np.argsort(-np.log1p(-u) / np.maximum(self.idf, 1e-9), kind="stable")] = np.arange(len(term))
            out.append(rank.astype(np.uint16 if len(term) <= 1 << 16 else np.uint32))
        return out


def draw(ids: np.ndarray, off: np.ndarray, uid: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Each text's drawn terms, then bits of its number, in one sortable key;
    equal texts in any number are so spread over neighbouring shards."""
    key = np.zeros(len(uid), _U)
    for rank in ranks:
        key = key << _U(16) | (np.minimum.reduceat(rank[ids], off[:-1]).astype(_U) & _U(0xFFFF))
    key = key << _U(16) | mix(uid.astype(_U)) >> _U(48)
    return (key ^ _U(1 << 63)).view(np.int64)


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of every run of n."""
    upto = np.cumsum(n)
    return np.repeat(first - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)


class Index:
    """Inverted BM25 index of a shard."""

    def __init__(self, ids: np.ndarray, off: np.ndarray, stats: Stats):
        size = np.diff(off)
        self.n, self.terms = len(size), len(stats.idf)
        owner = np.repeat(np.arange(self.n, dtype=np.uint16 if self.n <= 1 << 16 else np.uint32), size)
        order = np.argsort(ids, kind="stable")
        t, d = ids[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])]))
        self.term, self.doc = t[new], d[new]
        tf = np.diff(np.append(new, len(t)))
        self.weight = stats.weights(self.term, tf, size[self.doc]).astype(np.float32)
        self._first()

    def _first(self) -> None:
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=self.terms))])

    def drop(self, unused: np.ndarray) -> None:
        """Forgets the postings of used texts."""
        stay = unused[self.doc]
        self.term, self.doc, self.weight = self.term[stay], self.doc[stay], self.weight[stay]
        self._first()

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Of every text of the shard for a query's different terms."""
        term = np.unique(query)
        runs = [slice(a, b) for a, b in zip(self.first[term].tolist(), self.first[term + 1].tolist(), strict=True) if a < b]
        if not runs:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[r] for r in runs]), np.concatenate([self.weight[r] for r in runs]), self.n)


def pack_shard(ids: np.ndarray, off: np.ndarray, stats: Stats, window: int = 4096, share: float = 1.0) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """(full sequences of (text, start, length), what is left as (text, start)).

    No text may be longer than the window.  Seeds come in the order of the
    shard; ties of scores too.  Stops when ``share`` of the ids are packed or
    the rest fills no window."""
    size = np.diff(off)
    index, unused, out = Index(ids, off, stats), np.ones(len(size), bool), []
    left, goal, open_, seed, start, first = int(size.sum()), (1 - share) * size.sum(), len(size), None, 0, 0
    held = open_
    while left >= window and left > goal:
        if seed is None:
            first += int(np.argmax(unused[first:]))
            seed, start = first, 0
            unused[seed] = False
            open_ -= 1
        n = int(size[seed]) - start
        row, room = [(seed, start, n)], window - n
        score = np.where(unused, index.scores(ids[off[seed] + start : off[seed + 1]]), -1.0) if room else None
        seed, k = None, 32
        while room:
            k = min(k, open_)
            best = np.argpartition(-score, k - 1)[:k] if k < len(score) else np.arange(len(score))
            best = best[np.lexsort((best, -score[best]))]
            for d in best[unused[best]].tolist():
                take = min(room, int(size[d]))
                row.append((d, 0, take))
                unused[d] = False
                open_ -= 1
                room -= take
                if not room:
                    if take < size[d]:
                        seed, start = d, take
                    break
            score[~unused] = -1.0
            k *= 4
        out.append(row)
        left -= window
        if 5 * open_ < 4 * held:
            index.drop(unused)
            held = open_
    rest = [(int(d), 0) for d in np.flatnonzero(unused)]
    return out, ([(seed, start)] if seed is not None else []) + rest


def powers(pieces: list[tuple]) -> list[list[tuple]]:
    """(text, start, length) pieces cut into sequences of powers of two."""
    out, row, pieces = [], [], list(pieces)
    left = sum(p[2] for p in pieces)
    room = 1 << (left.bit_length() - 1) if left else 0
    while pieces:
        d, s, n = pieces.pop(0)
        row.append((d, s, min(n, room)))
        if n > room:
            pieces.insert(0, (d, s + room, n - room))
        room -= row[-1][2]
        left -= row[-1][2]
        if not room:
            out.append(row)
            row, room = [], 1 << (left.bit_length() - 1) if left else 0
    return out


def _ragged(cols: list[pa.Array], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, offsets) of binary columns, one after the other."""
    parts, sizes = [], [np.zeros(1, np.int64)]
    for col in cols:
        col = col.cast(pa.large_binary())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        width = np.dtype(dtype).itemsize
        if off[-1] > off[0]:
            parts.append(np.frombuffer(col.buffers()[2], dtype, (off[-1] - off[0]) // width, off[0]))
        sizes.append(np.diff(off) // width)
    return np.concatenate(parts) if parts else np.empty(0, dtype), np.cumsum(np.concatenate(sizes))


def _batch(cols: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([cols[c].cast(t) if c in cols else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)], list(_NAMES))


class _Pieces:
    """Rows of pieces, with sequence numbers of one task."""

    def __init__(self, turn: int, with_ids: bool):
        self.number, self.with_ids, self.rows = turn << 56 | TaskContext.get().partitionId() << 32, with_ids, []

    def add(self, pieces: list[tuple[int | None, int, np.ndarray, int]]) -> None:
        """One sequence of (doc_id, start, ids, tokens of the document)."""
        at = 0
        for key, start, ids, n in pieces:
            x = ids.astype("<u4").tobytes()
            self.rows.append((key, start, len(ids), zlib.crc32(x), n, self.number, at, x if self.with_ids else None))
            at += len(ids)
        self.number += 1

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield _batch({c: pa.array(x, t) for c, t, x in zip(_NAMES, _TYPES, zip(*self.rows, strict=True), strict=False)})
            self.rows = []


def _binary(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    return pa.array([ids[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())


def _start(tokenizer: str, end_id: int, kind: str, terms: int, window: int, with_ids: bool):
    """Encodes; gives full windows of single documents, rests, and the counts of
    all documents of the task: number, ids, and documents with each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid, out = encoder(tokenizer), TaskContext.get().partitionId() << 40, _Pieces(0, with_ids)
        count = np.zeros(terms + 2, np.int64)
        for batch in batches:
            for rows, col in slices(batch, limit=CHUNK):
                ids, n = with_end(*enc.encode(col), end_id)
                ids, m = ids.astype(kind), len(n)
                off = np.concatenate([[0], np.cumsum(n)])
                order = np.argsort(ids, kind="stable")
                t, d = ids[order], np.repeat(np.arange(m, dtype=np.int32), n)[order]
                new = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])
                count += np.concatenate([[m, len(ids)], np.bincount(t[new], minlength=terms)])
                keys, full = rows.column(0), n // window
                for i in np.flatnonzero(full):
                    for s in range(0, int(full[i]) * window, window):
                        out.add([(keys[int(i)].as_py(), s, ids[off[i] + s : off[i] + s + window], int(n[i]))])
                yield from out.batch()
                rest = np.flatnonzero(n % window)
                yield _batch({"doc_id": keys.take(pa.array(rest)), "start": pa.array(full[rest] * window), "doc_tokens": pa.array(n[rest]), "ids": _binary(ids, off[rest] + full[rest] * window, off[rest + 1]), "uid": pa.array(uid + rest)})
                uid += m
        yield _batch({"df": pa.array([count.astype("<i8").tobytes()], pa.binary())})

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total = total + np.frombuffer(x, "<i8")
    yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(len(total))), "n": pa.array(total)})


def statistics(rows: DataFrame, terms: int) -> Stats:
    """Sums the counts of all tasks; one row a term reaches the driver."""
    n = rows.filter("df is not null").select("df").mapInArrow(_sum, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).orderBy("term").toPandas()["n"].to_numpy()
    count = np.zeros(terms + 2, np.int64)
    count[: len(n)] = n
    return Stats(int(count[0]), count[1] / max(count[0], 1), count[2:])


def _draw(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value.ranks(1)
        for batch in batches:
            if len(batch):
                uid = batch.column(4).to_numpy()
                key = draw(*_ragged([batch.column(3)], kind), uid, ranks)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], [*batch.schema.names, "draw"])

    return run


def _round(shared, kind: str, turn: int, window: int, shard_tokens: int, share: float, with_ids: bool):
    """Packs the shards of one task; rows come in the order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, out = shared.value, _Pieces(turn, with_ids)
        ranks = stats.ranks(turn + 1)

        def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, off = _ragged([b.column(3) for b in held], kind)
            key, at, total, uid = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1, 2, 4))
            starts, totals, keys = at.to_numpy(), total.to_numpy(), key.to_pylist()
            full, rest = pack_shard(ids, off, stats, window, share)
            piece = lambda d, s, n: (keys[d], int(starts[d]) + s, ids[off[d] + s : off[d] + s + n], int(totals[d]))
            for row in full:
                out.add([piece(*p) for p in row])
            if share >= 1:
                for row in powers([(d, s, int(off[d + 1] - off[d]) - s) for d, s in rest]):
                    out.add([piece(*p) for p in row])
            yield from out.batch()
            if share < 1 and rest:
                d, s = np.array(rest, np.int64).T
                a, b = off[d] + s, off[d + 1]
                again = uid.to_numpy()[d]
                left = np.concatenate([[0], np.cumsum(b - a)])
                yield _batch({"doc_id": key.take(pa.array(d)), "start": pa.array(starts[d] + s), "doc_tokens": pa.array(totals[d]), "ids": _binary(ids, a, b), "uid": pa.array(again), "draw": pa.array(draw(ids[_runs(a, b - a)], left, again, ranks))})

        held, size = [], 0
        width = np.dtype(kind).itemsize
        for batch in batches:
            n = np.cumsum(np.diff(_ragged([batch.column(3)], "u1")[1]) // width)
            at = 0
            while at < len(batch):
                base = int(n[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(n, base + shard_tokens - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(n[min(to, len(n)) - 1]) - base
                at = to
                if size >= shard_tokens - window:
                    yield from pack(held)
                    held, size = [], 0
        if held:
            yield from pack(held)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, shard_tokens: int = 1 << 21, share: float = 0.9, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset; with_ids adds the ids (little-endian uint32).

    Every id of every document lies in exactly one piece.  window must be a
    power of two.  Null texts are empty and have the end id alone; null and
    repeated keys are packed like others, each row a document of its own; very
    long texts fill windows of their own; ties of scores go to the text that
    stands first in its shard; columns besides key and text are ignored; an
    empty table gives no pieces.
    """
    from tokenizers import Tokenizer

    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    root, width = work_dir(spark, "packing"), partitions(spark)
    terms = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = "<u2" if terms <= 1 << 16 else "<u4"
    rows = docs.selectExpr(f"cast(`{key}` as long) as key", f"`{text}` as text")
    rows.mapInArrow(_start(tokenizer, end_id, kind, terms, window, with_ids), _ROW).write.parquet(f"{root}/0", compression="zstd")
    done = [f"{root}/0"]
    now = spark.read.schema(_ROW).parquet(done[0])
    shared = spark.sparkContext.broadcast(statistics(now, terms))
    waits = ["doc_id", "start", "doc_tokens", "ids", "uid"]
    rest = now.filter("uid is not null").select(*waits).mapInArrow(_draw(shared, kind), "doc_id long, start long, doc_tokens long, ids binary, uid long, draw long")
    size = F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)) / np.dtype(kind).itemsize
    left, before, turn = now.filter("uid is not null").agg(size).first()[0], 0, 0
    while left:
        turn += 1
        shards = max(1, int(left // shard_tokens))
        last = shards == 1 or left == before
        before = left
        tasks = 1 if last else max(min(width, shards), -(-shards // SHARDS_A_TASK))
        dealt = rest.coalesce(1) if last else rest.repartitionByRange(tasks, "draw")
        dealt.sortWithinPartitions("draw", "uid", "start").select(*waits).mapInArrow(_round(shared, kind, turn, window, 2 * shard_tokens if last else shard_tokens, 1.0 if last else share, with_ids), _ROW).write.parquet(f"{root}/{turn}", compression="zstd")
        done.append(f"{root}/{turn}")
        rest = spark.read.schema(_ROW).parquet(done[-1]).filter("uid is not null").select(*waits, "draw")
        left = 0 if last else rest.agg(size).first()[0]
    pieces = spark.read.schema(_ROW).parquet(*done).filter("sequence_id is not null")
    return pieces.select(*[c.split()[0] for c in _PIECE.split(", ")], *["ids"] * with_ids)


def op5_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in windows of 4096."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
