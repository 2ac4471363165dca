"""Where stored listings lie: by source, then in cells of neighbouring cities.

A cell is a range of city names of one source that has about ``CELL_ROWS`` rows; a
city with more has a cell of its own, cut into slices by id.  Cells are numbered
once and stay, so whatever says where a row lies holds until a cell is split.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bounded import small

CELL_ROWS = 1_000_000
#: Different (source, city) pairs that the driver handles.
TOWNS = 1_000_000


@dataclass(frozen=True)
class Cell:
    number: int
    source: str
    start: str  # the first city name that it may hold
    slices: int


@dataclass(frozen=True)
class Part:
    """A folder of rows of one slice of a cell, with what lets it be passed over."""

    cell: int
    slice: int
    at: str
    rows: int
    low: str
    high: str

    def may_hold(self, cell: Cell, source: str, city: str) -> bool:
        return (not source or cell.source == source) and (not city or self.low <= city <= self.high)


def towns(df: DataFrame) -> list[tuple[str, str, int]]:
    """(source, city, rows), one a city of a source; nulls are ''."""
    name = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = df.groupBy(name("source"), name("city")).agg(F.count(F.lit(1)).alias("n")).limit(TOWNS + 1).collect()
    if len(rows) > TOWNS:
        raise ValueError(f"more than {TOWNS} cities")
    return sorted((r.source, r.city, r.n) for r in rows)


def plan_cells(found: Iterable[tuple[str, str, int]], target: int, first: int = 0, start: str = "") -> list[Cell]:
    """Cells for (source, city, rows) in order; a source's first one begins at ``start``."""
    out: list[Cell] = []
    source, size = None, 0
    for s, city, n in found:
        if s != source or size + n > target:
            out.append(Cell(first + len(out), s, start if s != source else city, -(-n // target) or 1))
            source, size = s, 0
        size += n
    return out


def cells_for(cells: list[Cell], found: list[tuple[str, str, int]], target: int) -> list[Cell]:
    """The cells, and new ones for sources that have none."""
    known = {c.source for c in cells}
    return cells + plan_cells([t for t in found if t[0] not in known], target, 1 + max((c.number for c in cells), default=-1))


def placed(df: DataFrame, cells: list[Cell], found: list[tuple[str, str, int]]) -> DataFrame:
    """Adds _cell and _slice; found has every town of the rows."""
    by: dict[str, list[Cell]] = {}
    for c in sorted(cells, key=lambda c: (c.source, c.start)):
        by.setdefault(c.source, []).append(c)
    rows = []
    for source, city, _ in found:
        mine = by[source]
        c = mine[max(0, bisect_right([x.start for x in mine], city) - 1)]
        rows.append((source, city, c.number, c.slices))
    spark = df.sparkSession
    where = small(spark.createDataFrame(rows or [("", "", 0, 1)], "_s string, _t string, _cell int, _slices int"), TOWNS, "cities")
    same = (F.coalesce("source", F.lit("")) == F.col("_s")) & (F.coalesce("city", F.lit("")) == F.col("_t"))
    return df.join(where, same).withColumn("_slice", F.pmod("id", F.col("_slices")).cast("int")).drop("_s", "_t", "_slices")


def lines(cells: list[Cell], parts: list[Part]) -> list[dict]:
    return [{"kind": "cell"} | asdict(c) for c in cells] + [{"kind": "part"} | asdict(p) for p in parts]
