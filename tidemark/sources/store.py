"""Tables as lists of folders under numbered pointers.

A writer fills new folders and then creates the next pointer, which lists the
folders that make up the table; the highest complete pointer counts, so readers
see the old table or the new one, never a mixture, and a crash leaves the old
one.  Two writers cannot take the same number: the second one fails.

Listings lie in cells (``layout``): a search by source and city opens only the
folders whose first and last city admit it.  Beside them lies an index of keys: the
hash of every name (listing id, canonical URL or content) with the id and the cell
of its row, in buckets by hash and sorted within.  A batch opens the buckets of its
own names, and then the cells where these say that a row may be; of the rest of the
table nothing is read.  It rewrites the cells of the rows that it changes and adds
new rows beside the others.  Entries of the index are only added: one that has become
false names a cell in vain, as do two names with one hash; names are compared
themselves before rows are merged.

Rejects, runs and outcomes are only ever appended to.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import schema as S
from tidemark.functions.text import clean_text
from tidemark.operators import listings as L
from tidemark.operators.merge import all_names, check_unique, stored_form, upsert
from tidemark.operators.validate import judged
from tidemark.session import ensure_checkpoints
from tidemark.sources.layout import CELL_ROWS, Cell, Part, cells_for, lines, placed, plan_cells, towns

TABLES = {"listings": S.LISTINGS, "runs": S.RUNS, "rejects": S.REJECTS, "outcomes": S.OUTCOMES}
#: Buckets of the index of keys.
KEY_BUCKETS = 64
#: Folders of one slice of a cell before ``compact`` makes them one.
MOST_PARTS = 8

#: Tasks that list folders.
LISTERS = 64

_KEYS = "k long, id long, cell int, slice int"


@dataclass(frozen=True)
class Keys:
    """A folder of one bucket of the index."""

    bucket: int
    at: str


@dataclass
class State:
    """What a pointer of the listings says."""

    cells: list[Cell] = field(default_factory=list)
    parts: list[Part] = field(default_factory=list)
    keys: list[Keys] = field(default_factory=list)
    last_id: int = 0

    def lines(self) -> list[dict]:
        return [{"kind": "last", "id": self.last_id}, *lines(self.cells, self.parts), *({"kind": "keys"} | asdict(k) for k in self.keys)]

    @classmethod
    def of(cls, said: list[dict]) -> State:
        out = cls()
        kinds = {"cell": (out.cells, Cell), "part": (out.parts, Part), "keys": (out.keys, Keys)}
        for x in said:
            kind = x.pop("kind")
            if kind == "last":
                out.last_id = x["id"]
            else:
                to, make = kinds[kind]
                to.append(make(**x))
        return out


def _key(name: Column) -> Column:
    return F.xxhash64(name)


def _bucket(k: Column) -> Column:
    return F.pmod(k, F.lit(KEY_BUCKETS)).cast("int")


class Store:
    """The tables under one root, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, cell_rows: int = CELL_ROWS):
        self.spark, self.root, self.cell_rows = spark, root.rstrip("/"), cell_rows
        # Folders of many slices are listed some at a time, not by a task each.
        spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", min(LISTERS, int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism"))))

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}/_pointers")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []

    def _current(self, name: str) -> list[dict] | None:
        """What the highest complete pointer says, None if there is none."""
        for n in reversed(self._pointers(name)):
            said = [r[0] for r in self.spark.read.text(f"{self.root}/{name}/_pointers/{n:012d}").collect()]
            if said and said[-1] == "end":
                return [json.loads(x) for x in said[:-1]]
        return None

    def _publish(self, name: str, said: list[dict]) -> None:
        number = max(self._pointers(name), default=0) + 1
        fs, p = self._fs(f"{self.root}/{name}/_pointers/{number:012d}")
        out = fs.create(p, False)  # fails where another writer has taken the number
        out.write(bytearray("".join(json.dumps(x) + "\n" for x in said).encode() + b"end\n"))
        out.close()

    def _open(self, name: str, folders: list[str]) -> DataFrame:
        # Listings are always written in the columns' types, so no file is opened to learn them.
        reader = self.spark.read.schema(S.LISTINGS) if name == "listings" else self.spark.read.option("mergeSchema", True)
        d = self.spark.createDataFrame([], TABLES[name]) if not folders else reader.parquet(*[f"{self.root}/{name}/{at}" for at in folders])
        for f in StructType.fromDDL(TABLES[name]).fields:
            if f.name not in d.columns:
                d = d.withColumn(f.name, F.lit(None).cast(f.dataType))
        return d

    def _folders(self, name: str, at: str, column: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{name}/{at}")
        return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith(f"{column}="))

    def tables(self) -> list[str]:
        return [n for n in TABLES if self._current(n) is not None]

    def init(self) -> list[str]:
        """Creates the tables that are not there yet; gives their names."""
        new = [n for n in TABLES if self._current(n) is None]
        for n in new:
            self._publish(n, [])
        return new

    def read(self, name: str, source: str = "", city: str = "") -> DataFrame:
        """The current table; columns that it lacks are null.  Of listings, source
        and city pass over the folders that cannot hold them."""
        if name != "listings":
            return self._open(name, [x["at"] for x in self._current(name) or []])
        state = self.state()
        cell = {c.number: c for c in state.cells}
        return self._open(name, [p.at for p in state.parts if p.may_hold(cell[p.cell], source, city)])

    def search(self, *, city: str = "", source: str = "", **filters) -> DataFrame:
        """``listings.search`` over the folders that may hold what it asks for."""
        return L.search(self.read("listings", source, city), city=city, source=source, **filters)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Stored rows that share a listing id, a canonical URL or their content with a
        record, from the cells that the index names."""
        state, wanted = self.state(), stored_form(wanted)
        hits = self._hits(state, wanted)
        found = {tuple(r) for r in hits.select("cell", "slice").distinct().collect()}  # a cell's slices at most
        old = self._open("listings", [p.at for p in state.parts if (p.cell, p.slice) in found])
        return old.join(all_names(old, "id").join(all_names(wanted).distinct(), "name", "left_semi").select("id").distinct(), "id", "left_semi")

    def write(self, name: str, df: DataFrame) -> None:
        """The table anew; listings with new cells and a new index."""
        if name != "listings":
            self._publish(name, [self._fill(name, df)])
            return
        df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(S.LISTINGS).fields])
        found = towns(df)
        cells = plan_cells(found, self.cell_rows)
        parts, keys = self._fill_cells(df, df, cells, found)
        self._publish(name, State(cells, parts, keys, df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]).lines())

    def append(self, name: str, df: DataFrame) -> None:
        cols = [f.name for f in StructType.fromDDL(TABLES[name]).fields if f.name in df.columns]
        self._publish(name, [*(self._current(name) or []), self._fill(name, df.select(*cols))])

    def _fill(self, name: str, df: DataFrame) -> dict:
        at = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{at}")
        return {"at": at}

    # ----------------------------------------------------------------- listings

    def state(self) -> State:
        return State.of(self._current("listings") or [])

    def _fill_cells(self, df: DataFrame, indexed: DataFrame | None, cells: list[Cell], found: list) -> tuple[list[Part], list[Keys]]:
        """Writes rows to new folders, and the keys of those that are to be indexed."""
        at = f"v-{uuid.uuid4().hex}"
        order = ("_cell", "_slice", "city", "id")
        placed(df, cells, found).repartition("_cell", "_slice").sortWithinPartitions(*order).write.partitionBy("_cell", "_slice").parquet(f"{self.root}/listings/{at}")
        parts = []
        if self._folders("listings", at, "_cell"):
            name = F.coalesce("city", F.lit(""))
            d = self.spark.read.parquet(f"{self.root}/listings/{at}")
            for r in d.groupBy("_cell", "_slice").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).collect():  # one row a folder
                parts.append(Part(r._cell, r._slice, f"{at}/_cell={r._cell}/_slice={r._slice}", r.n, r.low, r.high))
        if indexed is None:
            return parts, []
        k = all_names(placed(indexed, cells, found), "id", "_cell", "_slice").select(_key(F.col("name")).alias("k"), "id", F.col("_cell").alias("cell"), F.col("_slice").alias("slice"))
        k.withColumn("_kb", _bucket(F.col("k"))).repartition("_kb").sortWithinPartitions("_kb", "k").write.partitionBy("_kb").parquet(f"{self.root}/listings/{at}-keys")
        return parts, [Keys(int(f[4:]), f"{at}-keys/{f}") for f in self._folders("listings", f"{at}-keys", "_kb")]

    def _hits(self, state: State, records: DataFrame) -> DataFrame:
        """(id, cell, slice) of the entries of the index that have the hash of a
        name of the records."""
        ensure_checkpoints(self.spark)
        if not state.keys:
            return self.spark.createDataFrame([], "id long, cell int, slice int")
        wanted = all_names(records).select(_key(F.col("name")).alias("k")).distinct().checkpoint()
        buckets = {r[0] for r in wanted.select(_bucket(F.col("k"))).distinct().collect()}  # KEY_BUCKETS at most
        at = [f"{self.root}/listings/{k.at}" for k in state.keys if k.bucket in buckets]
        if not at:
            return self.spark.createDataFrame([], "id long, cell int, slice int")
        return self.spark.read.schema(_KEYS).parquet(*at).join(wanted, "k", "left_semi").select("id", "cell", "slice").distinct()

    def ingest(self, sightings: DataFrame, today) -> dict[str, int]:
        """Validates, merges and stores sightings; rejects go to their table."""
        ensure_checkpoints(self.spark)
        # Read and judged once, valid or not.
        made = stored_form(judged(sightings, today)).checkpoint()
        bad = made.filter("_reasons is not null").select("source", "url", F.col("_reasons").alias("reasons"), F.col("_payload").alias("payload"), F.current_timestamp().alias("rejected_at"))
        if not bad.isEmpty():
            self.append("rejects", bad)
        state, good = self.state(), made.filter("_reasons is null").drop("_reasons", "_payload")
        hits, near = None, set()
        if state.keys:
            hits = self._hits(state, good).persist(StorageLevel.MEMORY_AND_DISK)
            near = {(r.cell, r.slice) for r in hits.select("cell", "slice").distinct().collect()}  # a cell's slices at most
        old = self._open("listings", [p.at for p in state.parts if (p.cell, p.slice) in near]) if near else None
        merged = upsert(old, good, rest=False, last_id=state.last_id)
        new = (F.col("action") == "inserted").cast("long")
        row = merged.agg(F.coalesce(F.sum(new), F.lit(0)), F.coalesce(F.sum(F.col("touched") - new), F.lit(0)), F.max("id")).first()
        types = {f.name: f.dataType for f in StructType.fromDDL(S.LISTINGS).fields}
        rows = table = merged.select(*[F.col(c).cast(t).alias(c) if c in merged.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()])
        check_unique(table)
        stale = set()
        if near:
            gone = merged.select(F.explode("replaces").alias("id"))
            stale = {(r.cell, r.slice) for r in hits.join(gone, "id", "left_semi").select("cell", "slice").distinct().collect()}
            rows = table.unionByName(self._open("listings", [p.at for p in state.parts if (p.cell, p.slice) in stale]).join(gone, "id", "left_anti").select(*types))
        found = towns(rows)
        cells = cells_for(state.cells, found, self.cell_rows)
        parts, keys = self._fill_cells(rows, table, cells, found)
        kept = [p for p in state.parts if (p.cell, p.slice) not in stale]
        self._publish("listings", State(cells, kept + parts, state.keys + keys, max(state.last_id, row[2] or 0)).lines())
        if hits is not None:
            hits.unpersist()
        return {"inserted": row[0], "updated": row[1]}

    def compact(self, name: str, most: int = MOST_PARTS) -> int:
        """Makes one folder of slices that have more than ``most``, and splits cells
        that have outgrown twice their size; how many cells were written anew.  Other
        tables are written as one folder."""
        if name != "listings":
            self.write(name, self.read(name))
            return 1
        state = self.state()
        folders = Counter((p.cell, p.slice) for p in state.parts)
        rows: Counter = Counter()
        for p in state.parts:
            rows[p.cell] += p.rows
        size = {c.number: c.slices * self.cell_rows for c in state.cells}
        grown = {c for c, n in rows.items() if n > 2 * size[c]}
        picked = grown | {c for (c, _), n in folders.items() if n > most}
        if not picked:
            return 0
        d = self._open("listings", [p.at for p in state.parts if p.cell in picked])
        found = towns(d)
        cells = list(state.cells)
        for c in [c for c in state.cells if c.number in grown]:
            after = min((x.start for x in state.cells if x.source == c.source and x.start > c.start), default=None)
            mine = [t for t in found if t[0] == c.source and t[1] >= c.start and (after is None or t[1] < after)]
            cells.remove(c)
            cells += plan_cells(mine, self.cell_rows, 1 + max(x.number for x in [*cells, c]), c.start)
        parts, keys = self._fill_cells(d, d if grown else None, cells, found)
        self._publish(name, State(cells, [p for p in state.parts if p.cell not in picked] + parts, state.keys + keys, state.last_id).lines())
        return len(picked)

    def clean_texts(self) -> int:
        """Rewrites titles and descriptions that still hold markup, in the cells where
        there are any; how many rows changed."""
        state = self.state()
        d = self.read("listings")
        dirty = lambda c: F.col(c).like("%<%") | F.col(c).like("%&%;%")
        new = {c: F.when(dirty(c), clean_text(F.col(c))).otherwise(F.col(c)) for c in ("title", "description")}
        changed = d.filter(~(F.col("title").eqNullSafe(new["title"]) & F.col("description").eqNullSafe(new["description"])))
        found = towns(changed)
        n = sum(t[2] for t in found)
        if n:
            marks = placed(changed.select("id", "source", "city"), state.cells, found).select("_cell", "_slice").distinct()
            stale = {tuple(r) for r in marks.collect()}  # a cell's slices at most
            rows = self._open("listings", [p.at for p in state.parts if (p.cell, p.slice) in stale]).withColumns(new)
            # A row without id and URL is known by its content, which changes here.
            parts, keys = self._fill_cells(rows, rows, state.cells, towns(rows))
            self._publish("listings", State(state.cells, [p for p in state.parts if (p.cell, p.slice) not in stale] + parts, state.keys + keys, state.last_id).lines())
        return n

    # ---------------------------------------------------------------- run audit

    def start_run(self, sources: list[str], cities: list[str], now: datetime) -> int:
        """Notes that a run began; its id."""
        number = (self.read("runs").agg(F.max("id")).first()[0] or 0) + 1
        self._note(number, now, None, sources, cities, {}, None)
        return number

    def finish_run(self, number: int, stats: dict[str, int], notes: str, now: datetime) -> None:
        began = self.runs().filter(F.col("id") == number).first()
        self._note(number, began.started_at, now, began.sources.split(","), began.cities.split(","), stats, notes)

    def _note(self, number: int, began: datetime, ended: datetime | None, sources: list[str], cities: list[str], stats: dict[str, int], notes: str | None) -> None:
        row = (number, began, ended, ",".join(sources), ",".join(cities), *(stats.get(c, 0) for c in ("inserted", "updated", "skipped", "errors")), notes)
        self.append("runs", self.spark.createDataFrame([row], S.RUNS))

    def runs(self) -> DataFrame:
        """One row a run: its last note."""
        d = self.read("runs")
        whole = F.struct(*[c for c in d.columns if c != "id"])
        return d.groupBy("id").agg(F.max_by(whole, F.struct(F.col("finished_at").isNotNull(), "finished_at")).alias("r")).select("id", "r.*")

