"""Which labelled rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label tables up to this many rows (16 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def held_out(key: str, folds: int, rest: int) -> Column:
    return F.coalesce(fold(key, folds) == rest, F.lit(False))


def with_labels(docs: DataFrame, labels: DataFrame, label: str, folds: int, rest: int, key: str = "doc_id") -> DataFrame:
    """(key, text, label) of the documents whose label may be learned.

    Null keys and null labels teach nothing; a key that is labelled more than
    once takes its highest label."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key, folds, rest)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    n = labels.count()
    return docs.select(key, "text").join(F.broadcast(known) if n <= BROADCAST_ROWS else known, key)
