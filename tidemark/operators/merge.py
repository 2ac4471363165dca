"""Upsert merge: a thinner sighting never erases what a richer one said.

All sightings of an entity in order fold into one row by a single aggregation:
the last wins for identity-like columns, the longest for the description, the
last non-empty for the columns that a page may leave out, the first for when
it was first seen and its canonical URL.  A stored row is a sighting of its
own, before the others.

Entities are connected components over a source's listing ids and canonical
URLs, so an ad that changes its URL, or is seen without its id, stays one row
(a lookup one sighting at a time would split it).  A sighting without a URL is
known by its id alone, one without either by the hash of its content.  The
fingerprint is made anew from the merged id.

Only stored rows that share an id or a URL with a sighting take part; the
others are neither linked nor folded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip
from tidemark.functions.urls import canonical_url, fingerprint
from tidemark.operators.bounded import numbered
from tidemark.operators.graph import components
from tidemark.session import ensure_checkpoints

LAST = ("city", "category", "title", "price_currency", "price_raw", "url")
#: Names that are looked up by a broadcast.
KNOWN = 200_000
#: Sightings of one entity that a single task sorts; where there may be more, they are first folded where they lie.
MOST_SEEN = 1_000_000
STICKY = ("price", "phone", "seller_name", "ad_date", "source_listing_id", "area")


def sticky(c: str, seq: Column, text: bool) -> Column:
    """The last that is neither null nor empty; '' if only that was said."""
    if not text:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), seq))
    return F.coalesce(F.max_by(F.col(c), F.when(F.col(c) != "", seq)), F.when(F.bool_or(F.col(c) == ""), F.lit("")))


def longest(c: str, seq: Column) -> Column:
    return F.max_by(F.col(c), F.struct(F.length(F.coalesce(F.col(c), F.lit(""))), seq))


def _ends(c: Column) -> Column:
    """``strip``, where an end is white."""
    return F.when(strip(F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))) != F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1)), strip(c)).otherwise(c)


def to_row(s: DataFrame) -> DataFrame:
    """Sightings as they are stored: white space off the ends of city, area,
    title, description and seller; a missing area or description is '', an
    empty seller is null."""
    new = {c: _ends(F.col(c)) for c in ("city", "title")} | {c: _ends(F.coalesce(F.col(c), F.lit(""))) for c in ("area", "description")}
    new["seller_name"] = F.nullif(_ends(F.col("seller_name")), F.lit(""))
    return s.withColumns({c: x for c, x in new.items() if c in s.columns})


def _names(s: DataFrame) -> DataFrame:
    """Adds _u, _i and _h: the names that rows of one entity share."""
    name = lambda kind, c: F.concat_ws("\x1f", "source", F.lit(kind), c)
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    mark = fingerprint(F.col("source"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("city"), F.col("category"), F.col("title"), F.col("price_raw"))
    return s.withColumns({"_u": F.when(some("url") & some("url_canonical"), name("u", F.col("url_canonical"))), "_i": F.when(some("source_listing_id"), name("i", F.col("source_listing_id")))}).withColumn("_h", F.when(F.col("_u").isNull() & F.col("_i").isNull(), name("h", mark)))


def _linked(s: DataFrame) -> tuple[bool, int]:
    """(whether an id has two URLs or a URL two ids, rows of the name that most have).

    Names are counted by their hashes, which are all that is shuffled: names that share
    one are looked at in vain."""
    told = F.col("_i").isNotNull()
    marks = s.select(F.xxhash64("entity").alias("g"), F.when(told, F.xxhash64("_i")).alias("a"), F.when(told, F.hash("_i")).alias("b"))
    by = marks.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.max("a").alias("a2"), F.min("b").alias("b"), F.max("b").alias("b2"))
    by = by.groupBy("a").agg(F.count("a").alias("k"), F.max("n").alias("n"), F.bool_or((F.col("a") != F.col("a2")) | (F.col("b") != F.col("b2"))).alias("shared"))
    r = by.agg(F.coalesce(F.max("k"), F.lit(0)) > 1, F.coalesce(F.bool_or("shared"), F.lit(False)), F.coalesce(F.max("n"), F.lit(0))).first()
    return r[0] or r[1], r[2]


def _entities(s: DataFrame) -> tuple[DataFrame, int]:
    """(``entities``, a bound on the rows of one)."""
    s = _names(s).withColumn("entity", F.coalesce("_u", "_i", "_h")).drop("_u", "_h")
    linked, most = _linked(s)
    if not linked:
        return s.drop("_i"), most
    pairs = s.filter("_i is not null").select("entity", "_i").distinct().checkpoint()
    shared = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("entity").checkpoint()
    roaming = pairs.groupBy("_i").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("_i")
    # All links of whatever has more than one.
    links = pairs.join(roaming, "_i", "left_semi").union(pairs.join(shared, "entity", "left_semi").select("_i", "entity")).distinct().checkpoint()
    known = links.select(F.col("entity").alias("node"), F.col("_i").alias("component")) if shared.isEmpty() else components(links.select(F.col("entity").alias("a"), F.col("_i").alias("b")))
    known = known.checkpoint()
    few, wide = known.groupBy("component").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(1))).first()
    known = F.broadcast(known) if few <= KNOWN else known
    s = s.join(known, F.col("entity") == F.col("node"), "left").withColumn("entity", F.coalesce("component", "entity"))
    return s.drop("_i", "node", "component"), most * wide


def entities(s: DataFrame) -> DataFrame:
    """Adds ``entity``: the same for rows of a source that share a listing id
    or a canonical URL, directly or through others.

    Nearly every URL has one id and every id one URL: such rows are known by the URL, or
    by the id where there is none, and nothing is joined.  Only the links of ids with
    several URLs and of URLs with several ids are looked up; where no URL has two ids, an
    id with its URLs is an entity as it is, otherwise ``components`` settles them."""
    return _entities(s)[0]


def all_names(s: DataFrame, *cols: str) -> DataFrame:
    """(name, cols) for every name of every row: what rows of one entity share."""
    return _names(s).select(*cols, F.explode(F.array_compact(F.array("_u", "_i", "_h"))).alias("name"))


def touched(existing: DataFrame, sightings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored rows that share an id, URL or content hash with a sighting, all others)."""
    hit = all_names(existing, "id").join(all_names(sightings).distinct(), "name", "left_semi").select("id").distinct().checkpoint()
    return existing.join(hit, "id", "left_semi"), existing.join(hit, "id", "left_anti")


def fold(s: DataFrame, seq: str = "seq", seen: str = "seen_at", key: str | tuple[str, ...] = "entity", more: tuple[Column, ...] = ()) -> DataFrame:
    """One row an entity from its sightings in the order of ``seq``; ``more`` are
    further aggregates."""
    o, kinds = F.col(seq), {f.name: f.dataType.simpleString() for f in s.schema}
    told = [c for c in LAST if c in kinds]
    # What the newest says is one aggregate.
    cols = [F.max_by(F.struct(*told, F.col(seen).alias("_seen")), o).alias("_newest")]
    cols += [sticky(c, o, kinds[c] == "string").alias(c) for c in STICKY if c in kinds]
    cols += [longest("description", o).alias("description"), F.min_by("url_canonical", F.when(F.col("url_canonical").isNotNull(), o)).alias("url_canonical"), F.min_by(seen, o).alias("first_seen_at"), F.count(F.lit(1)).alias("sightings")]
    keys = [*([key] if isinstance(key, str) else key), "source"]
    out = s.groupBy(*keys).agg(*cols, *more)
    rest = [c for c in out.columns if c not in (*keys, "_newest")]
    return out.select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in told], *rest, *[F.col("_newest._seen").alias(c) for c in ("last_seen_at", "scraped_at")])


def stored_form(sightings: DataFrame) -> DataFrame:
    """Sightings as they are stored, with their canonical URL."""
    return to_row(sightings).withColumn("url_canonical", canonical_url(F.col("url")))


def upsert(existing: DataFrame | None, sightings: DataFrame, rest: bool = True, last_id: int | None = None) -> DataFrame:
    """The new snapshot, with ``action`` (inserted, updated or kept) and
    ``touched`` (sightings folded in).  Sightings have the columns of a record,
    ``seq`` and ``seen_at``, in any form or in that of ``stored_form``; ids continue after ``last_id``, by default the largest
    stored one.  Without ``rest``, stored rows that no sighting touches are left
    out, and ``replaces`` lists the ids of the stored rows that went into each."""
    ensure_checkpoints(sightings.sparkSession)
    # Read by several steps: made once.
    s = sightings if "url_canonical" in sightings.columns else stored_form(sightings).checkpoint()
    s = s.withColumn("_old", F.lit(None).cast("long")).withColumn("_first", F.col("seen_at"))
    kept = None
    if existing is not None:
        old, kept = touched(existing, s)
        old = old.withColumns({"seq": F.lit(-1).cast("long"), "seen_at": F.col("last_seen_at"), "_old": F.col("id"), "_first": F.col("first_seen_at")})
        s = s.unionByName(old.select(*[F.col(c) if c in old.columns else F.lit(None).alias(c) for c in s.columns]).checkpoint())
    more = (F.min("_old").alias("_old"), F.max("_old").alias("_old2"), F.count("_old").alias("_olds"), F.min_by("_first", "seq").alias("_first"), F.count_if(F.col("_old").isNull()).alias("touched"))
    s, most = _entities(s)
    # Ranges of entities are folded as they are and stay in order, so ids need no other sort.
    ranged = most <= MOST_SEEN
    m = fold(s.repartitionByRange("entity") if ranged else s, more=more)
    m = m.withColumn("first_seen_at", F.col("_first")).withColumn("fingerprint", fingerprint(F.col("source"), F.col("source_listing_id"), F.col("url"), F.col("city"), F.col("category"), F.col("title"), F.col("price_raw")))
    m = m.withColumn("action", F.when(F.col("_old").isNull(), "inserted").otherwise("updated"))
    if last_id is None:
        last_id = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if existing is not None else 0
    # New ids in the order of entities.
    out = numbered(m if ranged else m.checkpoint(), ["entity"], "_n", None if existing is None else F.col("_old").isNull(), ranged)
    if not rest:
        few = F.array_distinct(F.array_compact(F.array("_old", "_old2")))
        if existing is not None and not out.filter("_olds > 2").isEmpty():
            many = s.filter("_old is not null").groupBy(F.col("entity").alias("_e")).agg(F.collect_set("_old").alias("_gone")).filter(F.size("_gone") > 2)
            out = out.join(many, F.col("entity") == F.col("_e"), "left").withColumn("replaces", F.coalesce("_gone", few)).drop("_e", "_gone")
        else:
            out = out.withColumn("replaces", few)
    out = out.withColumn("id", F.coalesce("_old", F.lit(last_id) + F.col("_n") + 1)).drop("_old", "_old2", "_olds", "_first", "_n", "entity", "sightings")
    if not rest or kept is None:
        return out
    more = {"action": F.lit("kept"), "touched": F.lit(0).cast("long")}
    return out.unionByName(kept.select(*[more[c].alias(c) if c in more else F.col(c).cast(out.schema[c].dataType).alias(c) if c in kept.columns else F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns]))


def batch_counts(actions: DataFrame) -> DataFrame:
    """Inserted and updated, counting every sighting: the first of a new entity
    inserts, all others update."""
    new = (F.col("action") == "inserted").cast("long")
    return actions.agg(F.coalesce(F.sum(new), F.lit(0)).alias("inserted"), F.coalesce(F.sum(F.col("touched") - new), F.lit(0)).alias("updated"))


def check_unique(df: DataFrame) -> None:
    """Raises if a key of the table is not unique."""
    keys = [["fingerprint"], ["source", "url_canonical"], ["source", "source_listing_id"]]
    # Where no two hashes are equal, no two keys are.
    marks = [F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in k]), F.xxhash64(F.lit(n), *k)) for n, k in enumerate(keys)]
    if df.select(F.explode(F.array_compact(F.array(*marks))).alias("k")).groupBy("k").count().filter("count > 1").isEmpty():
        return
    for k in keys:
        d = reduce(lambda d, c: d.filter(F.col(c).isNotNull()), k, df)
        if d.groupBy(*k).count().filter("count > 1").limit(1).count():
            raise ValueError(f"not unique: {', '.join(k)}")
