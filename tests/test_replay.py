"""Upserts one at a time against a sequential store, and what belongs to it."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from test_operators import NOW, frame, record
from tidemark.operators.replay import _in_order, replay


class Plain:
    """A store with three unique names, in the plainest way: a list of rows, searched."""

    def __init__(self):
        self.rows, self.clashes = [], 0

    def take(self, r):
        r = r | {"canon": r["url"], "fp": f"olx:id:{r['source_listing_id']}" if r["source_listing_id"] else f"olx:url:{r['url']}"}
        hit = next((x for x in self.rows if x["fp"] == r["fp"]), None) or next((x for x in self.rows if x["canon"] == r["canon"]), None)
        if any(x is not hit and r["source_listing_id"] and x["source_listing_id"] == r["source_listing_id"] for x in self.rows):
            self.clashes += 1
            return
        if hit is None:
            self.rows.append(r | {"id": len(self.rows) + 1, "first": r["seen_at"], "last": r["seen_at"], "n": 1})
            return
        new = dict(r)
        if len(new["description"]) < len(hit["description"]):
            new["description"] = hit["description"]
        for c in ("price", "phone", "seller_name", "ad_date", "source_listing_id", "area"):
            if new[c] in (None, "") and hit[c] is not None:
                new[c] = hit[c]
        hit.update({k: v for k, v in new.items() if k != "canon"}, last=r["seen_at"], n=hit["n"] + 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_a_sequential_store(spark, seed):
    rng, plain, old, clashes = random.Random(seed), Plain(), None, 0
    for batch in range(3):
        rows = []
        for i in range(150):
            n = rng.randrange(40)
            ident = rng.choice([str(n), str(n), None])
            far = rng.random() < (0.5 if n < 12 else 0.0)
            rows.append(record(n, seq=batch * 1000 + i, source_listing_id=ident, url=f"https://s.example/{rng.randrange(40) if far else n}", title=f"T{batch}-{i}", description=rng.choice(["", "x", "long text", "other txt"]), phone=rng.choice([None, "+92"]), seller_name=rng.choice([None, "Ali"]), area=rng.choice(["", "A", "B"]), price=rng.choice([None, 5, 7]), seen_at=datetime(2026, 9, 1 + batch, i // 60, i % 60)))
        for n in plain.rows:
            n["n"] = 0
        for r in rows:
            plain.take(r)
        out, bad = replay(old, frame(spark, rows))
        out = out.checkpoint()
        clashes += bad.count()
        columns = ("title", "description", "phone", "seller_name", "area", "price", "source_listing_id", "url")
        got = sorted((r.id, r.fingerprint, r.url_canonical, *(r[c] for c in columns), r.first_seen_at, r.last_seen_at, r.touched) for r in out.collect())
        assert got == sorted((r["id"], r["fp"], r["canon"], *(r[c] for c in columns), r["first"], r["last"], r["n"]) for r in plain.rows)
        assert {r.action for r in out.filter("touched = 0").collect()} <= {"kept"}
        old = out.drop("action", "touched")
    assert clashes == plain.clashes > 0


def test_replay_of_nothing_ties_and_missing_names(spark):
    none, bad = replay(None, frame(spark, []))
    assert none.count() == bad.count() == 0
    rows = [record(1, url=None), record(1, url="", seq=0), record(2, url=None, source_listing_id=None), record(2, url=None, source_listing_id=None, seq=1), record(3, description=None, area=None, seq=2), record(3, url=None, seq=3)]
    out, bad = replay(None, frame(spark, rows))
    assert sorted((r.title, r.touched) for r in out.collect()) == [("Car 1", 2), ("Car 2", 2), ("Car 3", 2)] and bad.count() == 0
    again, _ = replay(out.drop("action", "touched"), frame(spark, [record(9, seq=9)]))
    assert sorted((r.title, r.action) for r in again.collect()) == [("Car 1", "kept"), ("Car 2", "kept"), ("Car 3", "kept"), ("Car 9", "inserted")]
    assert again.agg(F.max("id")).first()[0] == 4 and NOW in {r.last_seen_at for r in again.collect()}


def test_tasks_say_only_where_sightings_go():
    """What reads the sightings one by one passes their columns on as they are."""
    import pyarrow as pa

    names = ["entity", "_old", "source", "fingerprint", "url_canonical", "source_listing_id", "other"]
    rows = [("e", None, "s", "s:id:1", "u", "1", {"x": 1}), ("e", None, "s", "s:url:v", "v", None, {"x": 2}), ("e", None, "s", "s:id:1", "v", "1", {"x": 3}), ("e", None, "s", "s:id:1", "u", "2", {"x": 4}), ("f", 7, "s", "s:id:1", "u", "1", {"x": 5})]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
    (out,) = _in_order(iter([batch]))
    assert out.column("_row").to_pylist() == [0, 1, 0, 0, 0] and out.column("_k").to_pylist() == [0, 1, 2, 3, 0]
    assert out.column("other").equals(batch.column("other"))
