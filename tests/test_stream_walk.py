"""Units walked as a stream: any split of their pages gives what all at once give."""

from __future__ import annotations

import json
import random
from datetime import datetime

import pandas as pd
import pytest
from test_run import page
from test_walk import loop, units

from tidemark.functions.text import city_keys
from tidemark.operators import planning
from tidemark.sources.store import Store
from tidemark.streaming import collect

NOW = datetime(2026, 9, 19, 12)


@pytest.mark.parametrize("stale,barren,most,files", [(2, 2, 4, 5), (1, 0, None, 3)])
def test_any_split_equals_a_loop(spark, tmp_path, stale, barren, most, files):
    rng = random.Random(files)
    all_units = units(rng, 60)
    rows = [{"unit": u, "page": p, "ads": json.dumps([{k: str(v) if k == "key" else v for k, v in a.items() if k in ("rn", "key", "own", "inw")} for a in ads])} for u, ps in all_units.items() for p, ads in ps]
    rows += rng.sample(rows, 20)  # read twice
    rng.shuffle(rows)
    (tmp_path / "in").mkdir()
    for f in range(files):
        (tmp_path / "in" / f"{f}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[f::files]))
    pages = spark.readStream.schema(collect.PAGE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = collect.walk_stream(pages, stale, barren, most).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got: dict = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r.unit, []).append(r.rn)
    for u, ps in all_units.items():
        assert sorted(got.get(u, [])) == loop(ps, stale, barren, most)[0], u


class _Held:
    """A state of one unit that counts the calls to it."""

    def __init__(self, calls):
        self.calls, self.held = calls, []

    def get(self):
        self.calls.append("get")
        return (self.held[0] if self.held else None) if self.one else iter(list(self.held))

    def update(self, value):
        self.calls.append("update")
        self.held = [value]

    def put(self, values):
        self.calls.append("put")
        self.held = list(values)

    def appendValue(self, value):  # noqa: N802 (Spark's names)
        self.appendList([value])

    def appendList(self, values):  # noqa: N802
        self.calls.append("append")
        self.held += values

    def clear(self):
        self.calls.append("clear")
        self.held = []


def test_state_is_asked_for_once_a_batch_not_once_an_ad():
    """However many ads a batch has, in order or early, the calls to the state stay few."""
    calls = []

    class Handle:
        def _of(self, one):
            h = _Held(calls)
            h.one = one
            return h

        def getValueState(self, *a):  # noqa: N802
            return self._of(True)

        def getListState(self, *a):  # noqa: N802
            return self._of(False)

    w = collect.UnitWalk()
    w.init(Handle())
    one = lambda p: json.dumps([{"rn": p * 50 + n, "key": f"{p}-{n}", "own": True, "inw": True} for n in range(50)])
    got = []
    for batch in (range(1, 20, 2), range(2, 21, 2), range(1, 4), range(21, 30)):
        calls.clear()
        for d in w.handleInputRows((7,), iter([pd.DataFrame({"page": list(batch), "ads": [one(p) for p in batch]})]), None):
            got += d["rn"].tolist()
        assert len(calls) <= 6, calls
    assert got == [p * 50 + n for p in range(1, 30) for n in range(50)]


def test_captures_are_collected_in_parts(spark, tmp_path):
    """Page 2 before page 1, an ad seen twice, two stale pages, an empty page, a foreign ad."""
    cities = spark.createDataFrame([("Lahore", ["LHR"], 0, True), ("Multan", [], 1, True)], "name string, aliases array<string>, pos int, enabled boolean").withColumn("keys", city_keys("name", "aliases"))
    categories = spark.createDataFrame([("olx", "cars", "Cars", 0, True)], "source string, key string, label string, pos int, enabled boolean")
    plan = planning.plan_units(cities, categories).checkpoint()
    parts = [
        [("Lahore", 2, page((2, "Lahore"), (1, "Lahore")), 200), ("Multan", 1, page((9, "Multan"), (8, "Lahore")), 200)],
        [("Lahore", 1, page((1, "Lahore")), 200), ("Lahore", 4, page((1, "Lahore")), 200), ("Multan", 2, page(), 200)],
        [("Lahore", 3, page((2, "Lahore")), 200), ("Lahore", 5, page((5, "Lahore")), 200), ("Multan", 3, page((7, "Multan")), 200)],
    ]
    store = Store(spark, str(tmp_path / "s"))
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(parts):
        said = [{"city": c, "source": "olx", "category": "cars", "page": p, "url": f"https://s.example/{c}?page={p}", "text": t, "base_url": "https://s.example", "status": s, "allowed": True} for c, p, t, s in rows]
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps(x) + "\n" for x in said))
        if n != 1:  # the second part waits for the third
            collect.collect_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "work"), plan, cities, NOW)
    assert sorted((r.city, r.source_listing_id) for r in store.read("listings").collect()) == [("Lahore", "1"), ("Lahore", "2"), ("Multan", "9")]
