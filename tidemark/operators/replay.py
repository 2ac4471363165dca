"""Upserts one sighting at a time, as a sequential store does them.

Each sighting looks for its row by fingerprint, then by source and canonical URL, and
inserts a row where neither is known.  So, unlike in ``merge.upsert``, an ad that changes
its URL while its id is away becomes two rows.  A sighting that would give two rows of a
source the same id is not taken; it is returned as a conflict.

Rows can only meet within a component of ids and URLs.  Where all sightings of a
component have one fingerprint, and the stored row too, every lookup finds the same row
and an aggregation gives what the sequence would.  Only the others are replayed: their
sightings are hashed by component, sorted, and read as a stream that says which row each
goes into, so a task holds the names of one component's rows, not its sightings; the rows
are then made by the same aggregation.  A component is replayed by one task, as its order
is the meaning of it.

Null and empty ids and URLs name nothing.  A row that was made without a URL takes the
first that comes.  Sightings of equal ``seq`` are taken in an order that their columns fix.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import fingerprint
from tidemark.operators.bounded import numbered
from tidemark.operators.merge import LAST, STICKY, entities, fold, stored_form, touched
from tidemark.session import ensure_checkpoints

ROW = ("source", *LAST, *STICKY, "description", "url_canonical", "fingerprint")
_KEPT = (*ROW, "first_seen_at", "last_seen_at", "_old", "_from", "touched")


class Shelf:
    """The names of one component's rows, found as a store finds them."""

    def __init__(self) -> None:
        self.rows: list[list] = []  # source, fingerprint, canonical URL, listing id
        self.by: dict[tuple, int] = {}

    def _name(self, at: int) -> int:
        source, *names = self.rows[at]
        for kind, name in enumerate(names):
            if name:
                self.by[kind, source, name] = at
        return at

    def add(self, *names: str | None) -> int:
        self.rows.append([*names])
        return self._name(len(self.rows) - 1)

    def take(self, source: str, mark: str, url: str | None, ident: str | None) -> int | None:
        """The row that a sighting makes or refreshes; None, and no change, on a conflict."""
        find = lambda kind, name: self.by.get((kind, source, name)) if name else None
        at, holder = find(0, mark), find(2, ident)
        if at is None:
            at = find(1, url)
        if holder is not None and holder != at:
            return None
        if at is None:
            return self.add(source, mark, url, ident)
        row = self.rows[at]
        self.by.pop((0, source, row[1]), None)
        self.by.pop((2, source, row[3]), None)
        row[1], row[2] = mark, row[2] or url
        if ident or row[3] is None:
            row[3] = ident
        return self._name(at)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds _row, the row of its component that each sighting goes into (null: a conflict),
    and _k, its place; components come one after the other, each in order."""
    entity, shelf, k = None, Shelf(), 0
    for batch in batches:
        rows, places = [], []
        for now, old, *names in zip(*(batch.column(c).to_pylist() for c in ("entity", "_old", "source", "fingerprint", "url_canonical", "source_listing_id")), strict=True):
            if now != entity:
                entity, shelf, k = now, Shelf(), 0
            rows.append(shelf.take(*names) if old is None else shelf.add(*names))
            places.append(k)
            k += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int32()), pa.array(places, pa.int64())], [*batch.schema.names, "_row", "_k"])


def replay(existing: DataFrame | None, sightings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the new snapshot, conflicts), from columns as ``merge.upsert`` takes them.

    The snapshot has ``action`` (inserted, updated or kept) and ``touched`` (sightings
    that went into the row).  New ids follow the largest stored one in the order of the
    rows' first sightings.  Conflicts have the sighting's columns and ``seen_at``."""
    ensure_checkpoints(sightings.sparkSession)
    s = stored_form(sightings).withColumn("fingerprint", fingerprint(*[F.col(c) for c in ("source", "source_listing_id", "url", "city", "category", "title", "price_raw")]))
    s = s.withColumns({"_old": F.lit(None).cast("long"), "_first": F.col("seen_at"), "_from": F.col("seq").cast("long"), "touched": F.lit(1).cast("long")}).persist()
    made_once = s
    rest, last_id = None, 0
    if existing is not None:
        old, rest = touched(existing, s)
        old = old.withColumns({"seq": F.lit(None).cast("long"), "seen_at": F.col("last_seen_at"), "_old": F.col("id"), "_first": F.col("first_seen_at"), "_from": F.lit(None).cast("long"), "touched": F.lit(0).cast("long")})
        s = s.unionByName(old.select(*[(F.col(c) if c in old.columns else F.lit(None)).cast(s.schema[c].dataType).alias(c) for c in s.columns]).checkpoint())
        last_id = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    s = entities(s).withColumns({"first_seen_at": F.col("seen_at"), "last_seen_at": F.col("seen_at")}).checkpoint()
    made_once.unpersist()
    one = s.select("entity", "fingerprint", "_old").groupBy("entity", "fingerprint").agg(F.count("_old").alias("k")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    torn = one.filter("n > 1 or k > 1").select("entity", F.lit(True).alias("_torn"))
    split = s.join(torn, "entity", "left").persist()
    wide = split.filter("_torn").drop("_torn")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema) + ", _row int, _k long"
    # Stored rows first (nulls do), then by seq; the other columns only settle ties.
    order = ["entity", "seq", "_old", "seen_at", *ROW]
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slow = wide.repartition(parts, "entity").sortWithinPartitions(*order).mapInArrow(_in_order, schema).persist()
    bad = slow.filter("_row is null").select(*ROW, "seen_at").checkpoint()
    plain = split.filter("_torn is null").drop("_torn").withColumns({"_row": F.lit(0), "_k": F.coalesce("seq", F.lit(-(1 << 62)))})
    more = (F.min("_old").alias("_old"), F.min_by("_first", "_k").alias("_first"), F.min("_from").alias("_from"), F.sum("touched").alias("touched"), F.max_by("fingerprint", "_k").alias("fingerprint"))
    made = fold(plain.unionByName(slow.filter("_row is not null")), "_k", key=("entity", "_row"), more=more)
    made = made.withColumn("first_seen_at", F.col("_first")).select(*_KEPT, "scraped_at", "entity").persist()
    out = numbered(made, ["_from", "entity", "fingerprint"], "_n", F.col("_old").isNull())
    slow.unpersist()
    made.unpersist()
    split.unpersist()
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("touched") > 0, "updated").otherwise("kept")
    out = out.withColumns({"id": F.coalesce("_old", F.lit(last_id) + F.col("_n") + 1), "action": action}).drop("_old", "_from", "_n", "entity")
    if rest is not None:
        rest = rest.withColumns({"action": F.lit("kept"), "touched": F.lit(0).cast("long")})
        out = out.unionByName(rest.select(*[(F.col(c) if c in rest.columns else F.lit(None)).cast(out.schema[c].dataType).alias(c) for c in out.columns]))
    return out, bad
