"""Token-id shard files with keyed access.

A shard is ``<name>.ids``, the raw little-endian ids of its documents in
ascending key order (16 bits where the vocabulary fits, else 32), and
``<name>.idx``, whose minimal perfect hash sends a key to a slot in constant
time; the slot holds a 32-bit fingerprint, which rejects foreign keys, and the
document's row, whose offset and length address the ids.  Keys themselves are
not stored.

The hash is built in levels: keys alone in their place of a level's bit map
settle there, the others go on to the next level; the rank of the set bit is
the slot.  About three bits a key.

Documents are range-partitioned by key and the beginning of their text, so
shards are written in parallel, their order is the order of keys, and one key
with a great many rows is shared among tasks.  A task begins a new shard after
``SHARD_BYTES`` of ids or ``SHARD_DOCS`` documents, so a shard, its index and
what a task holds stay the same size as the table grows; a very long text is
held once, with its ids.  Files carry the attempt's own name and only the
manifest of finished tasks is read, so a lost executor's leftovers are never
seen.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import open_fs, partitions, slices, table, work_dir
from tidemark.llm.textops import mix
from tidemark.llm.tokens import CHUNK, encoder, with_end

_U = np.uint64
SHARD_BYTES, SHARD_DOCS = 64 << 20, 1 << 20


class PerfectHash:
    """Minimal perfect hash of different 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ mix(np.array([level + 1], _U))) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, maps, left, level = [], [], keys, 0
        while len(left):
            size = -(-max(64, 2 * len(left)) // 64) * 64
            at = cls._place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            maps.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
            level += 1
        return cls(np.array(sizes, np.int64), np.concatenate(maps) if maps else np.empty(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has it (never a built key)."""
        out, live = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.first[level] + self._place(keys[live], level, int(size))
            word = self.bits[at >> 6]
            shift = (at & 63).astype(_U)
            hit = (word >> shift) & _U(1) == 1
            inside = np.bitwise_count(word & ((_U(1) << shift) - _U(1)))
            out[live[hit]] = (self.rank[at >> 6] + inside)[hit]
            live = live[~hit]
            if not len(live):
                break
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _U(0xA5A5A5A5DEADBEEF)) >> _U(32)).astype(np.uint32)


def _index_bytes(keys: np.ndarray, nulls: int, counts: np.ndarray, width: int) -> bytes:
    """keys: ascending, of the documents after the first ``nulls``."""
    different, first, runs = np.unique(keys, return_index=True, return_counts=True)
    hash_ = PerfectHash.build(different.view(_U))
    slot = hash_.slots(different.view(_U))
    row, run, mark = (np.empty(len(different), t) for t in (np.int64, np.int64, np.uint32))
    row[slot], run[slot], mark[slot] = nulls + first, runs, _fingerprint(different.view(_U))
    out = io.BytesIO()
    np.savez(out, nulls=nulls, width=width, offsets=np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), sizes=hash_.sizes, bits=hash_.bits, row=row, run=run, mark=mark)
    return out.getvalue()


class Shard:
    """Keyed access to one shard."""

    def __init__(self, path: str):
        fs, p = open_fs(path)
        with fs.open_input_file(p + ".idx") as f:
            z = np.load(io.BytesIO(f.read()))
            self.nulls, self.width = int(z["nulls"]), int(z["width"])
            self.offsets, self.row, self.run, self.mark = z["offsets"], z["row"], z["run"], z["mark"]
            self.hash = PerfectHash(z["sizes"], z["bits"])
        self.file = fs.open_input_file(p + ".ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, number of rows) of each key; -1 and 0 for foreign keys."""
        k = keys.astype(np.int64).view(_U)
        slot = self.hash.slots(k)
        known = slot >= 0
        known[known] = self.mark[slot[known]] == _fingerprint(k[known])
        row, run = np.full(len(k), -1, np.int64), np.zeros(len(k), np.int64)
        row[known], run[known] = self.row[slot[known]], self.run[slot[known]]
        return row, run

    def read(self, row: int, rows: int = 1) -> np.ndarray:
        a, b = int(self.offsets[row]) * self.width, int(self.offsets[row + rows]) * self.width
        self.file.seek(a)
        return np.frombuffer(self.file.read(b - a), f"<u{self.width}")

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document with this key (none if there is none)."""
        row, run = (0, self.nulls) if key is None else (int(x[0]) for x in self.find(np.array([key], np.int64)))
        return [self.read(row + i) for i in range(run)]


class _Writer:
    """One shard at a time of one task."""

    def __init__(self, path: str, width: int):
        self.fs, self.base = open_fs(path)
        self.width, self.out = width, None

    def add(self, keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        if self.out is None:
            self.fs.create_dir(self.base, recursive=True)
            self.name, self.keys, self.counts, self.nulls, self.total, self.docs = uuid.uuid4().hex, [], [], 0, 0, 0
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}.ids")
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(keys.drop_null().to_numpy(zero_copy_only=False))
        self.nulls += keys.null_count
        self.counts.append(counts)
        self.total += len(ids)
        self.docs += len(counts)

    def full(self, shard_bytes: int, shard_docs: int) -> bool:
        return self.out is not None and (self.total * self.width >= shard_bytes or self.docs >= shard_docs)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.out, keys = None, np.concatenate(self.keys)
        with self.fs.open_output_stream(f"{self.base}/{self.name}.idx") as f:
            f.write(_index_bytes(keys, self.nulls, np.concatenate(self.counts), self.width))
        low, high = (keys[0], keys[-1]) if len(keys) else (None, None)
        return pa.RecordBatch.from_pydict({"name": [self.name], "nulls": pa.array([self.nulls], pa.int64()), "low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64()), "docs": pa.array([self.docs], pa.int64()), "ids": pa.array([self.total], pa.int64())})


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", shards: int | None = None, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> list[dict]:
    """Encodes whole texts and writes shard files under ``path``.

    Returns the manifest in key order: path, nulls, low, high (least and
    largest key), docs, ids and before (ids of all shards before it).  Only
    this short row a shard reaches the driver.  Null texts are empty and have
    the end id alone; null keys come first; rows that repeat a key stand in the
    order of their texts; other columns are ignored; an empty table gives an
    empty manifest.
    """
    n = shards or partitions(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        w = _Writer(path, 2 if max(enc.vocab_size, end_id + 1) <= 1 << 16 else 4)
        for batch in batches:
            for rows, col in slices(batch, limit=min(CHUNK, shard_bytes)):
                w.add(rows.column(0), *with_end(*enc.encode(col), end_id))
                if w.full(shard_bytes, shard_docs):
                    yield w.close()
        if w.out is not None:
            yield w.close()

    rows = docs.selectExpr(f"cast(`{key}` as long) as key", f"`{text}` as text").repartitionByRange(n, "key", F.substring("text", 1, 64)).sortWithinPartitions("key", "text")
    found = rows.mapInArrow(write, "name string, nulls long, low long, high long, docs long, ids long")
    # Partitions are in the order of keys, and so are a task's shards.
    out, before = [], 0
    for r in found.select("*", F.monotonically_increasing_id().alias("rank")).collect():
        out.append(r.asDict() | {"path": f"{path}/{r.name}"})
    for r in sorted(out, key=lambda r: r["rank"]):
        r["before"] = before
        before += r["ids"]
    return sorted(out, key=lambda r: r["rank"])


def read_keys(keys: DataFrame, manifest: list[dict], with_ids: bool = False, block: int = 1 << 22) -> DataFrame:
    """The documents of the keys asked for (first column of ``keys``), each found
    through the index of the shards whose range holds its key: doc_id, start
    (ids of all documents before it), n_tokens, ids_crc32 of its ids as
    little-endian 32-bit integers, and the ids if wanted.

    A key asked for more than once is answered once; one that no shard has is
    not answered; a null key finds the documents without one.  The manifest goes
    to every task: one row for ``SHARD_BYTES`` of ids.
    """
    spark = keys.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    files = [(r["path"], r["before"]) for r in manifest]
    null = np.array([i for i, r in enumerate(manifest) if r["nulls"]], np.int64)
    some = np.array([i for i, r in enumerate(manifest) if r["low"] is not None], np.int64)
    low, high = (np.array([manifest[i][c] for i in some], np.int64) for c in ("low", "high"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            k = col.drop_null().to_numpy(zero_copy_only=False)
            a, b = np.searchsorted(high, k, "left"), np.searchsorted(low, k, "right")
            n = np.maximum(b - a, 0)
            at = some[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(some) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.repeat(k, n) if len(some) else at)], ["shard", "key"])
            if col.null_count:
                yield pa.RecordBatch.from_arrays([pa.array(null), pa.array([None] * len(null), pa.int64())], ["shard", "key"])

    def answer(number: int, asked: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        path, before = files[number]
        shard, col = Shard(path), pa.concat_arrays(asked)
        different = col.drop_null().to_numpy(zero_copy_only=False)
        row, run = shard.find(different)
        row, keys = np.repeat(row - (np.cumsum(run) - run), run) + np.arange(run.sum()), np.repeat(different, run)
        nulls = shard.nulls if col.null_count else 0
        row = np.concatenate([np.arange(nulls), row]).astype(np.int64)
        keys = pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(keys, pa.int64())])
        n = shard.offsets[row + 1] - shard.offsets[row]
        # Rows that follow each other are read at once, about ``block`` ids at a time.
        ends = np.cumsum(n)
        cut = np.flatnonzero((np.diff(row, prepend=-2) != 1) | (np.diff((ends - n) // block, prepend=-1) != 0))
        for a, b in zip(cut, np.append(cut[1:], len(row)), strict=True):
            data = shard.read(int(row[a]), int(b - a)).astype("<u4")
            at = np.concatenate([[0], np.cumsum(n[a:b])])
            each = [data[at[i] : at[i + 1]] for i in range(b - a)]
            cols = {"doc_id": keys[int(a) : int(b)], "start": pa.array(before + shard.offsets[row[a:b]]), "n_tokens": pa.array(n[a:b]), "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64())}
            if with_ids:
                cols["ids"] = pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(cols)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            number = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(number, prepend=-1))
            for a, b in zip(cut, np.append(cut[1:], len(number)), strict=True):
                if held and number[a] != now:
                    yield from answer(now, held)
                    held = []
                now = int(number[a])
                held.append(batch.column(1).slice(int(a), int(b - a)))
        if held:
            yield from answer(now, held)

    asked = keys.select(F.col(keys.columns[0]).cast("long").alias("key")).distinct().mapInArrow(place, "shard long, key long").distinct()
    return asked.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "key").mapInArrow(read, schema)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, read back from the files by its key."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    manifest = write_shards(docs, work_dir(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_keys(docs.select("doc_id"), manifest)
