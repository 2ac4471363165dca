"""Configuration files, archives and towns of one name."""

from __future__ import annotations

import zipfile

import pytest

from tidemark.operators import places
from tidemark.sources import dims


def line(name, ascii_name="", code="PPLA", population="9"):
    return "\t".join(["1", name, ascii_name, "", "31.55555", "74.3", "P", code, "PK", "", "04", "", "", "", population, "", "", "", ""])


def test_archives_give_what_unpacked_files_give(spark, tmp_path):
    text = "\n".join([line("Lāhore", "Lahore"), "", line('Say "x"', "", "PPL", ""), line("Multan", "Multan", "PPL", "70000")] + [line(f"Ü{i}", f"U{i}") for i in range(25_000)]) + "\r\n"
    (tmp_path / "plain").mkdir()
    (tmp_path / "packed").mkdir()
    for n in (1, 2):
        (tmp_path / "plain" / f"{n}.txt").write_text(text, encoding="utf-8")
        with zipfile.ZipFile(tmp_path / "packed" / f"{n}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("other.txt", "no")
            z.writestr("cities.txt", text)
    want = dims.gazetteer(spark, str(tmp_path / "plain"))
    got = dims.gazetteer(spark, str(tmp_path / "packed"), "cities.txt")
    assert got.schema == want.schema and got.count() == 2 * 25_003 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert {r.name for r in got.filter("population = 70000 or name like 'L%' or name like 'Say%'").collect()} == {"Lahore", "Multan", 'Say "x"'} and got.first().lat == 31.5556
    with pytest.raises(Exception, match="no item named"):
        dims.gazetteer(spark, str(tmp_path / "packed"), "none.txt").count()


def test_configuration_files(spark, tmp_path):
    at = str(tmp_path)
    with pytest.raises(FileNotFoundError, match="cities.yml"):
        dims.configuration(spark, at)
    (tmp_path / "cities.yml").write_text("# none\n")
    with pytest.raises(FileNotFoundError, match="settings.yml"):
        dims.configuration(spark, at)
    (tmp_path / "settings.yml").write_text("sources:\n  olx:\n    categories: [{key: cars, label: Cars}]\n")
    with pytest.raises(ValueError, match="no cities"):
        dims.configuration(spark, at)
    (tmp_path / "cities.json").write_text('{"cities":[{"name":"Lahore","province":"Punjab","aliases":["LHR"],"lat":1.5},{"name":"Multan","province":"Punjab"}]}')
    (tmp_path / "cities.yml").write_text("cities:\n  - {name: lhr, olx_location_id: 4060673, aliases: [Data Nagar]}\n  - {name: Multan, enabled: false, province: South}\n  - name: Newtown\n")
    cities, categories, config = dims.configuration(spark, at)
    got = {r.name: r for r in cities.collect()}
    assert [r.name for r in cities.orderBy("pos").collect()] == ["Lahore", "Multan", "Newtown"]
    assert (got["Lahore"].enabled, got["Lahore"].aliases, got["Lahore"].pins, got["Lahore"].lat) == (True, ["LHR", "Data Nagar"], {"olx": "4060673"}, 1.5)
    assert (got["Multan"].enabled, got["Multan"].province, got["Newtown"].enabled) == (False, "South", True)
    assert categories.first().label == "Cars" and config["sources"]["olx"]
    found = spark.createDataFrame([("olx", "Lahore", "lahore_g1", None, "city", 0), ("olx", "Multan", "multan_g2", None, "city", 1)], "source string, name string, identifier string, province string, level string, pos long")
    assert {r.city: (r.identifier, r.status) for r in places.resolve(cities, found).collect()} == {"Lahore": ("4060673", "resolved"), "Multan": ("multan_g2", "resolved"), "Newtown": (None, "unsupported")}
    (tmp_path / "cities.yml").write_text("cities:\n  - enabled: false\n")
    with pytest.raises(ValueError, match="'name'"):
        dims.configuration(spark, at)


def test_towns_of_one_name(spark):
    rows = [("gazetteer", "Kotli", "Azad", 1.0, 1.0, 90, 0), ("site_a", "Kotli", "Azad", None, None, None, 0), ("site_a", "Kotli", "Punjab", None, None, None, 1), ("site_b", "Kotli", "Azad", None, None, None, 0), ("site_b", "Kotli!", None, None, None, None, 1), ("site_a", "Swat", "KPK", None, None, None, 2), ("site_b", "Swat", "Sindh", None, None, None, 2), ("gazetteer", "Swat", "Sindh", 5.0, 5.0, 50, 1)]
    p = spark.createDataFrame(rows, "source string, name string, province string, lat double, lon double, population long, pos long")
    none = spark.createDataFrame([], "name string, variants array<string>")
    got = {r.name: r for r in places.build_cities(p, none, none).collect()}
    # Swat: sites that disagree name one town, where the first site has it, and the gazetteer's is another.
    assert {n: (r.province, r.population) for n, r in got.items()} == {"Kotli! (Azad)": ("Azad", 90), "Kotli (Punjab)": ("Punjab", 0), "Swat": ("KPK", 0)}
    shown = spark.createDataFrame([("Kotli", "Punjab", "Kotli Loharan"), ("Kotli", "Azad", "Kotli")], "name string, province string, shown string")
    assert {r.name for r in places.build_cities(p, none, none, shown).collect()} == {"Kotli", "Kotli Loharan", "Swat"}
