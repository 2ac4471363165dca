"""Configuration and dimension files."""

from __future__ import annotations

import io
import itertools
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators import places

CITY = "name string, province string, aliases array<string>, lat double, lon double, population long, coverage map<string,boolean>"
CATEGORY = "key string, label string, path string, category_id string, `group` string, level int, priority int"
#: ``ascii`` is the plain name, ``name`` the name as it is written there.
GAZETTEER = "_0 string, name string, ascii string, _3 string, lat double, lon double, _6 string, code string, country string, _9 string, admin string, _11 string, _12 string, _13 string, population long, _15 string, _16 string, _17 string, _18 string"


def _list(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The array under a key of a JSON file; missing or broken files are empty."""
    try:
        d = spark.read.schema(f"`{key}` array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
        return d.selectExpr(f"posexplode(`{key}`) as (pos, r)").select("r.*", "pos")
    except AnalysisException:
        return spark.createDataFrame([], schema + ", pos int")


def cities(spark: SparkSession, path: str) -> DataFrame:
    return _list(spark, path, "cities", CITY)


def categories(spark: SparkSession, path: str) -> DataFrame:
    return _list(spark, path, "categories", CATEGORY)


def unzipped_lines(archives: DataFrame, member: str, batch: int = 10_000) -> DataFrame:
    """``value``: the lines of one member of every archive (``content``, bytes), as UTF-8.

    An archive is a value of at most 2 GB; what is in it is unpacked as it is read,
    ``batch`` lines at a time.  An archive without the member is an error; a null is none."""

    def unpack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column("content"):
                if not content.is_valid:
                    continue
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z, z.open(member) as raw:
                    text = io.TextIOWrapper(raw, "utf-8", newline="\n")
                    while lines := [x.rstrip("\r\n") for x in itertools.islice(text, batch)]:
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    return archives.select("content").mapInArrow(unpack, "value string")


def places_in(lines: DataFrame) -> DataFrame:
    """Tab-separated places under their plain names, where they have one."""
    d = lines.filter("value <> ''").select(F.from_csv("value", GAZETTEER, {"sep": "\t", "quote": ""}).alias("r")).select("r.*")
    return d.select(F.coalesce("ascii", "name").alias("name"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "code", "country", "admin", "population")


def gazetteer(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """Places of unpacked files or, by name, of a member of every archive under the path."""
    if member is None:
        return places_in(spark.read.text(path))
    return places_in(unzipped_lines(spark.read.format("binaryFile").load(path), member))


def settings(path: str) -> dict:
    """A YAML file as a dictionary; an empty file is an empty one."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


#: What an override may say of a city, beside its name.
OVERRIDE = "name string, aliases array<string>, pos int, enabled boolean, province string, pins map<string,string>"
# The keys under which an override pins a source's identifier.
PINS = {"olx_location_id": "olx", "zameen_slug": "zameen", "pakwheels_slug": "pakwheels"}


def overrides(spark: SparkSession, config: dict) -> DataFrame:
    """The entries of an overrides file in its order; an entry without a name is an error."""
    rows = []
    for i, e in enumerate(config.get("cities") or []):
        if "name" not in e:
            raise ValueError(f"missing required key 'name' in entry {i + 1} of the cities' overrides")
        pins = {source: str(e[k]) for k, source in PINS.items() if e.get(k) is not None}
        rows.append((str(e["name"]), [str(a) for a in e.get("aliases") or []], i, e.get("enabled"), e.get("province"), pins or None))
    return spark.createDataFrame(rows, OVERRIDE)


def _yaml(spark: SparkSession, path: str) -> dict:
    """A YAML file that Spark can reach; a missing one is an error."""
    import yaml

    try:
        found = [r[0] for r in spark.read.text(path, wholetext=True).collect()]  # configuration: one file
    except AnalysisException as e:
        raise FileNotFoundError(f"config file not found: {path}") from e
    return yaml.safe_load("\n".join(found)) or {}


def configuration(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """(cities, categories, settings) of a folder with cities.json (the master list; may
    be missing), cities.yml (overrides) and settings.yml.

    Cities keep the master list's order; an override is matched by name or alias, and one
    that fits no city is a city of its own behind them.  No cities at all is an error."""
    said, config = _yaml(spark, f"{folder}/cities.yml"), _yaml(spark, f"{folder}/settings.yml")
    found = places.merge_overrides(cities(spark, f"{folder}/cities.json"), overrides(spark, said))
    if found.isEmpty():
        raise ValueError("no cities: the master list is missing and there are no overrides")
    return found, source_categories(spark, config), config


def source_categories(spark: SparkSession, config: dict) -> DataFrame:
    """(source, key, label, path, enabled, pos) of the sources in the settings."""
    rows = []
    for s, body in (config.get("sources") or {}).items():
        for i, c in enumerate(body.get("categories") or []):
            rows.append((s, str(c["key"]), str(c.get("label", c["key"])), str(c.get("path", "")), bool(body.get("enabled", True)), i))
    return spark.createDataFrame(rows, "source string, key string, label string, path string, enabled boolean, pos int")


def picker(cities_df: DataFrame, categories_df: DataFrame, defaults: dict) -> dict:
    """What a page needs to offer choices: bounded configuration."""
    cats: dict[str, list] = {}
    for r in categories_df.orderBy("source", "pos").collect():
        cats.setdefault(r.source, []).append({"key": r.key, "label": r.label})
    return {"cities": [r.name for r in cities_df.orderBy("pos").select("name").collect()], "sources": cats, "defaults": json.loads(json.dumps(defaults))}
