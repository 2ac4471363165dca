"""Units read page by page: windows and state against a plain loop."""

from __future__ import annotations

import random

import pytest

from tidemark.operators import crawlcut


def loop(unit_pages, stale, barren, most):
    """One unit, page after page: [(ads that come out)], pages read, foreign ads, ..."""
    seen, out, places = set(), [], []
    run = idle = read = foreign = outside = last = 0
    made = 0
    for page, ads in unit_pages:
        if most and made >= most:
            break
        if not ads:
            break
        last = page
        own = [a for a in ads if a["own"]]
        foreign += len(ads) - len(own)
        for a in ads:
            if not a["own"] and a["place"] not in places and len(places) < 5:
                places.append(a["place"])
        if not any(a["key"] not in seen for a in own):
            run += 1
            if run >= stale:
                break
            continue
        run, read = 0, page
        inside = sum(a["inw"] for a in own)
        for a in own:
            if most and made >= most:
                break
            if a["key"] in seen:
                continue
            seen.add(a["key"])
            out.append(a["rn"])
            made += a["inw"]
            outside += not a["inw"]
        if barren:
            idle = 0 if inside else idle + 1
            if idle >= barren:
                break
    return sorted(out), (read, foreign, made, outside, last, tuple(places), bool(most) and made >= most)


def units(rng, n):
    out = {}
    for u in range(n):
        pages, rn = [], 0
        for p in range(1, rng.randrange(2, 14)):
            ads = []
            for _ in range(0 if rng.random() < 0.06 else rng.randrange(1, 4)):
                rn += 1
                own = rng.random() < 0.6
                ads.append({"unit": u, "page": p, "rn": rn, "key": rng.randrange(12) + 100 * (not own), "own": own, "inw": rng.random() < 0.4, "place": None if own else f"p{rng.randrange(7)}"})
            pages.append((p, ads))
        out[u] = pages
    return out


@pytest.mark.parametrize("stale,barren,most", [(2, 0, None), (1, 2, None), (2, 2, 4), (3, 0, 1)])
def test_walk_equals_a_loop(spark, stale, barren, most):
    all_units = units(random.Random(stale * 7 + barren), 120)
    ads = spark.createDataFrame([a for pages in all_units.values() for _, x in pages for a in x], "unit int, page int, rn int, key int, own boolean, inw boolean, place string")
    pages = spark.createDataFrame([(u, p, len(x)) for u, ps in all_units.items() for p, x in ps], "unit int, page int, n int")
    got, seen = crawlcut.walk(pages, ads, stale=stale, barren=barren, most=most)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.unit, []).append(r.rn)
    facts = {r.unit: (r.pages_read, r.foreign_ads, r.produced, r.out_of_window, r.last_page, tuple(r.foreign_places), r.budget_spent) for r in seen.collect()}
    for u, ps in all_units.items():
        assert (sorted(rows.get(u, [])), facts[u]) == loop(ps, stale, barren, most), u
    assert {r.unit for r in seen.filter("no_ads").collect()} == {u for u, ps in all_units.items() if not ps[0][1]}
