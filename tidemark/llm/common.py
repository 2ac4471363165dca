"""Shared plumbing: the shared work folder, table access and small helpers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import on_one_machine

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests, one machine) a
    temporary folder is made and set as the checkpoint folder of the session; a
    cluster would lose what one of its machines holds.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        if not root:
            if not on_one_machine(spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


_HELD: list[DataFrame] = []


def hold(df: DataFrame, level: StorageLevel = StorageLevel.DISK_ONLY) -> DataFrame:
    """Persists a frame that a lazy result reads, until ``release``."""
    _HELD.append(df.persist(level))
    return df


def release() -> None:
    """Gives up what was held for results that have been written by now."""
    while _HELD:
        df = _HELD.pop()
        if df.sparkSession.sparkContext._jsc is not None:  # its session has not ended
            df.unpersist()


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str):
    """(file system, path) for a URI, as executors see it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 2 << 20):
    """Cuts a batch into runs of rows of about ``limit`` bytes of text, so
    that temporaries stay bounded whatever the batch size; nulls become ''."""
    col = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
    sizes = pc.binary_length(col).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at), col.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < len(sizes):
        yield batch.slice(at), col.slice(at)
