"""Workbooks: one sheet of all listings, one a city, and a summary.

A workbook is one file of bounded size (a sheet holds 1,048,576 rows), so rows
come to the driver one partition at a time; larger exports belong in Parquet.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable
from itertools import chain, groupby, islice
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import preview, safe_cell, sheet_name
from tidemark.operators.listings import all_listings, summary_by_city

MOST_ROWS = 1_048_575
# Columns of the export, in order.
COLUMNS = (
    "city", "area", "source", "category", "title", "description_preview", "price", "price_currency", "price_raw", "phone", "seller_name",
    "ad_date", "url", "description", "source_listing_id", "first_seen_at", "last_seen_at", "scraped_at", "id",
)
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _row(n: int, values: Iterable) -> str:
    cells = []
    for i, v in enumerate(values):
        if v is None:
            continue
        at = f"{_letters(i)}{n}"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            cells.append(f'<c r="{at}"><v>{v}</v></c>')
        else:
            cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
    return f'<row r="{n}">{"".join(cells)}</row>'


def write_workbook(path: str, sheets: list[tuple[str, list[str], Iterable]]) -> None:
    """Sheets of (name, header, rows) as an OOXML file."""
    names, used = [], set()
    for name, _, _ in sheets:
        n, k = sheet_name(name), 2
        while n.lower() in used:
            n, k = f"{sheet_name(name)[:28]} {k}", k + 1
        used.add(n.lower())
        names.append(n)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook {_NS} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        for i, (_, header, rows) in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet {_NS}><sheetData>{_row(1, header)}'.encode())
                for n, r in enumerate(rows, 2):
                    f.write(_row(n, r).encode())
                f.write(b"</sheetData></worksheet>")


def safe_rows(df: DataFrame) -> DataFrame:
    d = df.withColumn("description_preview", preview(F.col("description")))
    kinds = dict(d.dtypes)
    number = ("int", "bigint", "double", "float")
    return d.select(*[F.col(c) if kinds[c] in number else safe_cell(F.col(c).cast("string")).alias(c) for c in COLUMNS if c in kinds])


def export_workbook(listings: DataFrame, path: str, city: str = "", since=None, seen_since=None) -> int:
    """Writes the workbook; the number of listings.  Sorted once, and split by
    city as the rows stream by."""
    d = all_listings(listings, city, since, seen_since).persist()
    n = d.count()
    if n > MOST_ROWS:
        raise ValueError(f"{n} listings do not fit a sheet")
    rows = safe_rows(d)
    at = rows.columns.index("city")
    cities = [r[0] for r in rows.select("city").distinct().orderBy("city").collect()]
    stream = groupby(map(tuple, rows.withColumn("_place", F.monotonically_increasing_id()).orderBy("city", "_place").drop("_place").toLocalIterator()), lambda r: r[at])
    each = [(c, rows.columns, chain.from_iterable(g for _, g in islice(stream, 1))) for c in cities]
    s = summary_by_city(d)
    total = [("Total listings", n), ()]
    summary = [*total, tuple(s.columns), *[tuple(r) for r in s.collect()]]
    write_workbook(path, [("All Listings", rows.columns, map(tuple, rows.toLocalIterator())), *each, ("Summary", ["Listings summary"], summary)])
    d.unpersist()
    return n
