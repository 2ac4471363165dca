"""Frames of a checked size, and running sums without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoints


def small(df: DataFrame, most: int, what: str) -> DataFrame:
    """The frame, to be broadcast; raises if it has more than ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(df)


def before(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows that come earlier in ``order``
    (which must tell rows apart).  Rows are range-partitioned and summed by
    partition; only the partitions' sums reach the driver."""
    ensure_checkpoints(df.sparkSession)
    d = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sums, at = [], 0
    for part, n in sorted(d.groupBy("_part").agg(F.coalesce(F.sum(value), F.lit(0)).cast("long")).collect()):
        sums.append((part, at))
        at += n
    known = df.sparkSession.createDataFrame(sums or [(-1, 0)], "_part int, _base long")  # one row a partition
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return d.join(F.broadcast(known), "_part").withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")).drop("_part", "_base")


def numbered(df: DataFrame, order: list[str], name: str, only: Column | None = None, ranged: bool = False) -> DataFrame:
    """Adds the place of each row in ``order`` (which must tell rows apart), from 0; with
    ``only``, of the rows where it is true, and null to the others.  Rows are sorted once
    by range (with ``ranged``, their partitions are ranges already), and only the
    partitions' counts reach the driver."""
    ensure_checkpoints(df.sparkSession)
    d = df.withColumn("_only", F.lit(True) if only is None else only)
    d = d if ranged else d.repartitionByRange(*order)
    d = d.sortWithinPartitions(*([] if only is None else [F.desc("_only")]), *order)
    d = d.withColumn("_at", F.monotonically_increasing_id()).checkpoint()  # the partition in the upper bits, the row in the lower 33
    counts, at = [], 0
    for part, n in sorted(d.filter("_only").groupBy(F.shiftright("_at", 33)).count().collect()):
        counts.append((part, at))
        at += n
    known = df.sparkSession.createDataFrame(counts or [(-1, 0)], "_part long, _base long")  # one row a partition
    place = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return d.join(F.broadcast(known), F.shiftright("_at", 33) == F.col("_part"), "left").withColumn(name, F.when(F.col("_only"), place)).drop("_only", "_at", "_part", "_base")
