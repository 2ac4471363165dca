"""Periodic runs of words in a document, and texts without their repetitions.

Each document is gone through alone: its words become ranks in their order, and
the runs come from the Lyndon array (``lyndon``).  Words that come less than four
times in a stretch cannot lie in a run of four periods, so the text is cut at
them first; what is left is gone through whole.  Time is linear in the text and
memory about a hundred bytes a word of the longest text; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table
from tidemark.llm.lyndon import Run, runs, stretches

#: A run has at least this many times its smallest period, and this many words.
EXPONENT, LEAST = 4, 6

_RUN = "struct<start: long, length: long, period: long>"


def words_of(text: str) -> list[bytes]:
    """The words of a text, in UTF-8; bytes split at ASCII white space, and nothing else."""
    return text.encode().split()


def runs_of(words: list[bytes]) -> list[Run]:
    """(start, length, period) of the runs of a document's words, by start, then period."""
    times = Counter(words)
    if len(words) < LEAST or max(times.values()) < EXPONENT:
        return []
    rank = {w: r for r, w in enumerate(sorted(times))}
    codes = np.fromiter((rank[w] for w in words), np.int32, len(words))
    found = []
    for start, end in stretches(codes, EXPONENT):
        if end - start >= LEAST:
            found += [(start + a, n, p) for a, n, p in runs(codes[start:end].tolist(), EXPONENT, LEAST)]
    return found


def collapse(words: list[bytes], found: Iterable[Run]) -> list[bytes]:
    """The words that no run has after its first period."""
    step = np.zeros(len(words) + 1, np.int32)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    gone = np.cumsum(step[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words


def make_periodic(words: list[bytes], key: int | None) -> list[bytes]:
    """The words as the audit asks for them: in every tenth document, by the crc32
    of its id, the words from one on repeat with a period.  A null id leaves the
    words as they are."""
    if key is None or not words:
        return words
    g, tenth = divmod(zlib.crc32(str(key).encode()), 10)
    if tenth:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(len(words) - a)]


def periodic_runs(docs: DataFrame, text: str = "text", audit: str | None = None) -> DataFrame:
    """Adds to every row pr_runs (its runs by start, then period), pr_words, pr_text
    (the kept words joined by one space), pr_runs_sha256 and pr_sha256 (of pr_text).

    audit names the id by which some texts are made periodic before.  A null text
    has no words, like an empty one: no runs, an empty pr_text.  Repeated rows are
    treated row by row, ties of length are the caller's to break; texts of any
    length are read whole.  Other columns are kept, those that begin with ``pr_``
    replaced; an empty table gives no rows.
    """
    cols = [c for c in docs.columns if not c.startswith("pr_")]
    extra = {"pr_text_in": F.coalesce(F.col(text), F.lit(""))} | ({"pr_key": F.col(audit).cast("long")} if audit else {})
    kept = docs.select(F.struct(*cols).alias("pr_row"), *[e.alias(n) for n, e in extra.items()])
    schema = f"pr_row {kept.schema['pr_row'].dataType.simpleString()}, pr_runs array<{_RUN}>, pr_words long, pr_text string, pr_runs_sha256 string, pr_sha256 string"
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "pr_text_in"):
                keys = part.column("pr_key").to_pylist() if audit else [None] * part.num_rows
                out: list[list] = [[], [], [], [], []]
                for t, key in zip(texts, keys, strict=True):
                    words = make_periodic(words_of(t.as_py()), key)
                    found = runs_of(words)
                    joined = b" ".join(collapse(words, found))
                    said = "".join(f"{a},{n},{p}\n" for a, n, p in found).encode()
                    row = ([{"start": a, "length": n, "period": p} for a, n, p in found], len(words), joined.decode(), hashlib.sha256(said).hexdigest(), hashlib.sha256(joined).hexdigest())
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                arrays = [pa.array(v, k) for v, k in zip(out, (pa.list_(struct), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("pr_row"), *arrays], names=["pr_row", "pr_runs", "pr_words", "pr_text", "pr_runs_sha256", "pr_sha256"])

    return kept.mapInArrow(read, schema).select(*[F.col("pr_row").getField(c).alias(c) for c in cols], "pr_runs", "pr_words", "pr_text", "pr_runs_sha256", "pr_sha256")


def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every whole text, the longest of them, and digests of all runs
    and of the text without repetitions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = periodic_runs(docs.select("doc_id", F.col("text").alias("pr_in"), F.col("doc_id").alias("pr_id")), "pr_in", "pr_id")
    best = F.array_max(F.transform("pr_runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    d = d.select("doc_id", F.size("pr_runs").cast("long").alias("n_runs"), (-best["before"]).alias("start"), best["length"].alias("length"), (-best["short"]).alias("period"), "pr_runs_sha256", "pr_sha256")
    return d.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), F.col("pr_runs_sha256").alias("runs_sha256"), F.col("pr_sha256").alias("collapsed_sha256"))
