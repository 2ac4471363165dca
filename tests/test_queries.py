"""Every registered query beside its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(cols, data):
    at = [cols.index(c) for c in sorted(cols)]
    return sorted((tuple(None if r[i] is None else repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in at) for r in data), key=str)


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    d = catalog.queries()[name](spark, str(SF))
    r = con.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    want = rows(cols, r.fetchall())
    assert sorted(d.columns) == sorted(cols)
    got = rows(d.columns, d.collect())
    assert got == want and want


def test_excel_safe_whole_is_of_whole_texts(spark, tmp_path):
    import hashlib
    import re

    texts = [None, "", "=1+1", "\x01@x", "a" * 60 + "\x00\x0b\x1f end", "é" * 30_000, "é" * 30_001, "-" + "b\x02" * 29_999, "+" + "c" * 40_000, "a\n\t=b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def cell(t):
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", t)
        t = t[:29_997] + "..." if len(t) > 30_000 else t
        return hashlib.md5((("'" if t.startswith(("=", "+", "-", "@")) else "") + t).encode()).hexdigest()

    want = [(i, None if t is None else cell(t)) for i, t in enumerate(texts)]
    assert sorted(tuple(r) for r in catalog.queries()["excel_safe_whole"](spark, str(tmp_path)).collect()) == want
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.execute(catalog.oracle_sql()["excel_safe_whole"]).fetchall()) == want


@pytest.mark.skipif(not SF.exists(), reason="no tables")
def test_stored_lookup_all_asks_for_every_listing(spark, con):
    got = catalog.queries()["stored_lookup_all"](spark, str(SF)).collect()
    assert sorted(r.asked for r in got) == sorted(r[0] for r in con.execute("SELECT o_orderkey FROM orders").fetchall())
