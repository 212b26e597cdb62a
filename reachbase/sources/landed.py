"""Landed JSON: rows by line and documents with nested arrays, in fixed schemas; what is missing falls back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachbase.sources.files import read_or_empty

# The shapes that collectors land, one JSON row a line.
ROWS = {
    "region_routes": "city string, id string, no string, type string, `from` string, `to` string",
    "region_details": "id string, city string, no string, type string, first string, last string, headwayWeekday int, headwaySat int, headwaySun int",
    "region_stops": "id string, city string, stops array<struct<stop: string, name: string, ord: int, lat: double, lon: double, up: string>>",
    "city_routes": "id string, no string, type string, `from` string, `to` string, corp string, lengthM double, first string, last string, headway int",
    "city_stops": "id string, stops array<struct<stop: string, ars: string, name: string, ord: int, lat: double, lon: double, dir: string, distM: double>>",
    "fleet": "id string, no string, type string, n int",
    "contracts": "seq string, name string, sgg string, umd string, area double, amt int, mon int, kind string, ym int",
}
# Documents of one JSON object.
DOCUMENTS = {
    "calibration": "dwellSec int, detour double, detourGyeonggi double, longSegmentMeters double, longSegmentSpeedFactor double",
    "headways": "byType map<string, array<double>>, buckets array<string>",
    "dongs": "months array<int>, dongs array<struct<name: string, gu: string, lon: double, lat: double, deals: int, climb: double>>",
    "ods": "slot string, budget int, ods array<struct<origin: string, band: string, dong: string, ours: int, kakao: int, frozen: boolean>>",
}
# What holds where a calibration lacks a value.
CALIBRATION = {"dwellSec": 58, "detour": 1.07, "detourGyeonggi": 1.10, "longSegmentMeters": 1500.0, "longSegmentSpeedFactor": 1.25}


def read_rows(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """Rows of a landed table; none where it never landed. Lines that aren't JSON are null in every column and go."""
    return read_or_empty(spark, path, ROWS[shape]).na.drop("all")


def read_document(spark: SparkSession, path: str, shape: str, each: str | None = None) -> DataFrame:
    """A document's fields, or with ``each`` a row for each element of that array."""
    found = read_or_empty(spark, path, DOCUMENTS[shape], multiLine=True)
    return found if each is None else found.select(F.inline(each))


def with_defaults(found: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """One row of the defaults' columns: what found, of one row or none, has, else the default."""
    known = found.limit(1).agg(*[F.first(c, ignorenulls=True).alias(c) for c in defaults])
    return known.select(*[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def complexes_json(buildings: DataFrame) -> DataFrame:
    """One JSON document of buildings (seq, name, lat, lon and prices) by seq, coordinates to five places."""
    rest = [c for c in buildings.columns if c not in ("seq", "lat", "lon")]
    one = F.struct("seq", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), *rest)
    return buildings.agg(F.array_sort(F.collect_list(one)).alias("complexes")).select(F.to_json(F.struct("complexes")).alias("value"))
