"""Exact substring dedup with FM-indexes by shard.

A window is 20 consecutive words.  Every window goes to the shard of its
minimiser (the smallest hash of its runs of six words), so equal windows meet
in one shard and each stretch of text is streamed against one index only.
A minimiser with one place in the corpus cannot repeat, and its stretch stays
where it is.  Of the rest, equal stretches are collapsed to the earliest
(summed map-side, so a passage in a third of all documents is one row a task);
every shard builds a compressed FM-index over its stretches and streams them
through it by backward search; the interval of a window that occurs twice
gives its earliest occurrence.

A minimiser with more than ``HOT`` occurrences is split by the windows
themselves, so no shard grows with one passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, slices, table
from tidemark.llm.fm_index import FMIndex
from tidemark.llm.textops import mix, raw, word_hashes, words

WINDOW = 20
RUN = 6
HOT = 5000
#: Windows in a stretch and words in an index, at most about.
STRETCH, SHARD_WORDS = 512, 400_000
_U = np.uint64
_C = _U(0x9E3779B97F4A7C15)


def stretches(col: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, row, first window, windows, places of the minimiser) of all
    texts, in order."""
    _, _, _, row, h = word_hashes(col)
    none = np.empty(0, np.int64)
    if len(h) < window:
        return none, none, none, none, none
    k = min(RUN, window)
    acc = np.zeros(len(h) - k + 1, _U)
    for j in range(k):
        acc = acc * _C + h[j : len(h) - k + 1 + j]
        acc ^= acc >> _U(29)
    each = mix(acc)
    low, width, want = each, 1, window - k + 1
    while 2 * width <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < want:
        low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
    at = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
    low, row = low[at], row[at]
    lead = np.searchsorted(row, row)
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (row[1:] != row[:-1])])
    run = np.flatnonzero(new)
    inside = np.arange(len(low)) - np.repeat(run, np.diff(np.append(run, len(low))))
    run = np.flatnonzero(inside % STRETCH == 0)
    first = np.arange(len(low)) - lead  # windows of a row are consecutive
    n = np.diff(np.append(run, len(low)))
    span = n + want - 1
    stretch = np.repeat(np.arange(len(run)), span)
    place = np.repeat(at[run] - (np.cumsum(span) - span), span) + np.arange(span.sum())
    hits = np.bincount(stretch[each[place] == low[run][stretch]], minlength=len(run))
    return low[run].view(np.int64), row[run], first[run], n, hits


def shard_windows(texts: pa.Array, order: np.ndarray, first: np.ndarray, windows: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each stretch of a shard, which of its windows occur earlier in the
    shard.  order: rank of the stretch's document; first: its first word."""
    _, _, _, row, h = word_hashes(texts)
    words, symbol = np.unique(h, return_inverse=True)
    n = len(row) + len(texts)
    text = np.zeros(n, np.int64)
    place = np.arange(len(row)) + row
    text[place] = symbol + 1
    index = FMIndex(text, len(words) + 1, window)
    head = np.searchsorted(row, np.arange(len(texts))) + np.arange(len(texts))
    start = np.repeat(head, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    length, lo, hi = index.matching(text, start + window - 1, window)
    found = np.flatnonzero(length == window)
    out = np.zeros(len(start), bool)
    if len(found):
        doc = np.full(n, np.iinfo(np.int64).max)
        doc[place] = order[row]
        word = np.zeros(n, np.int64)
        word[place] = first[row] + np.arange(len(row)) - np.searchsorted(row, row)
        by = np.lexsort((word, doc))
        new = np.concatenate([[0], ((doc[by][1:] != doc[by][:-1]) | (word[by][1:] != word[by][:-1])).astype(np.int64)])
        when = np.empty(n, np.int64)
        when[by] = np.cumsum(new)
        lo_, which = np.unique(lo[found], return_inverse=True)
        hi_ = np.empty(len(lo_), np.int64)
        hi_[which] = hi[found]
        cuts = np.stack([lo_, hi_], 1).ravel()  # intervals of one depth never overlap
        earliest = np.minimum.reduceat(np.append(when[index.places], np.iinfo(np.int64).max), cuts)[::2]
        out[found] = earliest[which] < when[start[found]]
    return np.split(out, np.cumsum(windows)[:-1])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, col in slices(batch):
            low, row, first, n, hits = stretches(col)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(low), piece.column(0).take(take), piece.column(1).take(take), pa.array(first << 16 | n), pa.array(hits)], ["low", "ord", "th", "at", "hits"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ord, th, text, parts): the words of each part.  Windows of hot
    minimisers are collapsed here to the earliest, before they are shuffled."""
    names = ["key", "seg", "ord", "th", "at"]
    hot: dict[bytes, tuple[int, int, int]] = {}

    def out(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

    def flush() -> Iterator[pa.RecordBatch]:
        segs = list(hot)
        for i in range(0, len(segs), 20_000):
            part = segs[i : i + 20_000]
            keys = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in part]
            yield out([keys, [x.decode() for x in part], *map(list, zip(*[hot[x] for x in part], strict=True))])
        hot.clear()

    for batch in batches:
        cols: list[list] = [[] for _ in names]
        size = 0
        for o, th, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            w = text.as_py().encode().split()
            for p in parts:
                first, n = p["at"] >> 16, p["at"] & 0xFFFF
                if p["hot"]:
                    for i in range(first, first + n):
                        seg, now = b" ".join(w[i : i + WINDOW]), (o, th, i << 16 | 1)
                        was = hot.get(seg)
                        if was is None or now < was:
                            hot[seg] = now
                    continue
                seg = b" ".join(w[first : first + n + WINDOW - 1])
                for c, v in zip(cols, (p["low"], seg.decode(), o, th, p["at"]), strict=True):
                    c.append(v)
                size += len(seg)
            if size > 4 << 20:
                yield out(cols)
                cols, size = [[] for _ in names], 0
            if len(hot) > 100_000:
                yield from flush()
        if cols[0]:
            yield out(cols)
    if hot:
        yield from flush()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, seg, ord, th, at) in this order: equal stretches collapse to
    their first row; an index for every few hundred thousand words of different
    stretches, never cutting a key."""
    held: list[pa.RecordBatch] = []
    seen = ""

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids = np.stack([t[c].to_numpy() for c in ("ord", "th")])
        order = np.unique(ids, axis=1, return_inverse=True)[1].ravel()
        at = t["at"].to_numpy()
        seg = pa.concat_arrays(t["seg"].chunks).cast(pa.large_string())
        flags = shard_windows(seg, order, at >> 16, at & 0xFFFF)
        packed = [np.packbits(f, bitorder="little").tobytes() for f in flags]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(t[c].chunks) for c in ("ord", "th", "at")] + [pa.array(packed, pa.binary())], ["ord", "th", "at", "flags"])

    words, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        before = pa.concat_arrays([pa.array([seen], pa.string()), batch.column(1).slice(0, batch.num_rows - 1).cast(pa.string())])
        seen = batch.column(1)[batch.num_rows - 1].as_py()
        new = pc.not_equal(batch.column(1).cast(pa.string()), before).to_numpy(zero_copy_only=False)
        key = batch.column(0).to_numpy()
        new[0] |= key[0] != last
        new[1:] |= key[1:] != key[:-1]
        batch = batch.filter(pa.array(new))
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        size = np.cumsum((batch.column(4).to_numpy() & 0xFFFF) + WINDOW)
        at = 0
        for b in np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, batch.num_rows):
            start = int(size[at - 1]) if at else 0
            if held and words + int(size[b - 1]) - start > SHARD_WORDS and key[at] != last:
                yield flush()
                held.clear()
                words = 0
            held.append(batch.slice(at, int(b) - at))
            words += int(size[b - 1]) - start
            last, at = key[b - 1], int(b)
    if held:
        yield flush()


def cut_ranges(text: np.ndarray, start: np.ndarray, end: np.ndarray, edges: np.ndarray) -> bytes:
    """A text (bytes; its words lie at start..end) without the words of the
    ranges [a, b), each with the white space that follows it, or at the end of
    the text that before it; all other white space stays."""
    keep = np.ones(len(text), bool)
    for a, b in edges.tolist():
        if b < len(start):
            keep[start[a] : start[b]] = False
        else:
            keep[end[a - 1] if a else 0 :] = False
    return text[keep].tobytes()


def _apply(spaces: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for piece, col in slices(batch):
                kept, total, gone, spans = [], [], [], []
                data, off = raw(col)
                start, end, row = words(data, off)
                first = np.searchsorted(row, np.arange(len(col) + 1))
                for i, (parts, found) in enumerate(zip(piece.column(3), piece.column(4), strict=True)):
                    n = int(first[i + 1] - first[i])
                    text = data[off[i] : off[i + 1]]
                    total.append(n)
                    edge = np.empty((0, 2), np.int64)
                    if parts.is_valid and len(parts):
                        again = np.zeros(n + 1, bool)
                        for p in parts.values.to_numpy().tolist():
                            again[p >> 16 : (p >> 16) + (p & 0xFFFF)] = True
                        for p in found.as_py() or ():
                            at, m = p["at"] >> 16, p["at"] & 0xFFFF
                            again[at : at + m] = np.unpackbits(np.frombuffer(p["flags"], np.uint8), count=m, bitorder="little")
                        step = np.zeros(n + 1, np.int32)
                        at = np.flatnonzero(again)
                        step[at] += 1
                        np.subtract.at(step, np.minimum(at + WINDOW, n), 1)
                        cover = np.cumsum(step)[:-1] > 0
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))).reshape(-1, 2)
                    gone.append(int((edge[:, 1] - edge[:, 0]).sum()))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edge])
                    if spaces:
                        a, b = first[i], first[i + 1]
                        kept.append(cut_ranges(text, start[a:b] - off[i], end[a:b] - off[i], edge) if len(edge) else text.tobytes())
                    elif not len(edge):
                        kept.append(b" ".join(text.tobytes().split()))
                    else:
                        w, at = text.tobytes().split(), np.concatenate([[0], edge.ravel(), [n]]).reshape(-1, 2)
                        kept.append(b" ".join([x for a, b in at.tolist() for x in w[a:b]]))
                rest = [piece.column(i) for i in range(5, piece.num_columns)]
                names = [piece.schema.field(i).name for i in range(5, piece.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kind)], [*names, "sd_words", "sd_removed", "sd_text", "sd_spans"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", spaces: bool = False) -> DataFrame:
    """Adds sd_words, sd_removed, sd_text (the kept words joined by a space; with
    ``spaces`` the text as it was, less the removed ranges) and sd_spans (removed word ranges) to every row.

    Every word is removed that a window covers whose words also start earlier:
    in a smaller key, or in the same document at an earlier word; windows are
    judged on the input.  Null texts have no words.  A null key counts as the
    largest long; rows that repeat key and text are judged alike, and rows that
    repeat a key with other text stand in the order of a hash of their texts.
    Columns that begin with ``sd_`` are replaced, all others kept.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    cols = [c for c in docs.columns if not c.startswith("sd_")]
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("ord"), F.xxhash64(t).alias("th"), t.alias("text"), *[F.col(c).alias(f"sd_{c}") for c in cols if c != text])
    rest = [c for c in d.columns if c not in ("ord", "th", "text")]
    marks = d.select("ord", "th", "text").mapInArrow(_mark, "low long, ord long, th long, at long, hits long")
    shared = marks.groupBy("low").agg(F.sum("hits").alias("c")).filter("c > 1").select("low", (F.col("c") > HOT).alias("hot"))
    parts = marks.join(shared, "low").groupBy("ord", "th").agg(F.collect_set(F.struct("low", "at", "hot")).alias("parts"))
    # Both joins below read the same columns, so the texts are shuffled once and the exchange is reused.
    known = d.join(parts, ["ord", "th"]).select("ord", "th", "text", "parts", *rest)
    segs = known.mapInArrow(_cut, "key long, seg string, ord long, th long, at long")
    flags = segs.repartition(n, "key").sortWithinPartitions("key", "seg", "ord", "th", "at").mapInArrow(_search, "ord long, th long, at long, flags binary")
    found = flags.groupBy("ord", "th").agg(F.collect_set(F.struct("at", "flags")).alias("found"))
    all_ = d.join(parts, ["ord", "th"], "left").join(found, ["ord", "th"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + ["sd_words long, sd_removed long, sd_text string, sd_spans array<struct<start:bigint,end:bigint>>"])
    out = all_.select("ord", "th", "text", F.transform("parts", lambda p: p["at"]).alias("parts"), "found", *rest).mapInArrow(_apply(spaces), schema)
    return out.select(*[F.col(f"sd_{c}").alias(c) for c in cols if c != text], "sd_words", "sd_removed", "sd_text", "sd_spans")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Documents without their repeated words, the columns of documents; line
    breaks and other white space around what stays are kept.  Null texts become
    empty; documents that lose all their words stay, with what white space they
    had; repeated rows, ties and empty tables as in remove_repeats."""
    d = remove_repeats(docs, spaces=True)
    new = {"text": F.col("sd_text"), "n_chars": F.length("sd_text").cast("long")}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without words that windows of 20 repeat."""
    d = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("sd_words").alias("n_words"), F.col("sd_removed").alias("n_removed"), F.sha2(F.col("sd_text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT rid, doc_id, i, list_slice(ws, i, i + 19) AS gram FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
f AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 20)) AS p FROM f)),
w AS (SELECT d.rid, p, ws[p] AS word FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS p FROM d) d),
k AS (SELECT w.rid, string_agg(word, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM w ANTI JOIN c ON w.rid = c.rid AND w.p = c.p GROUP BY w.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid
"""
