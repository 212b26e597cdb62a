"""Text, JSON, GTFS and GML files as tables, and the same tables as files."""

from __future__ import annotations

import csv
import io
import itertools
import math
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from reachbase.functions.exprs import unescape_xml


GTFS_SCHEMAS = {
    "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, location_type int, parent_station string",
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_type int",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "trips": "route_id string, service_id string, trip_id string, direction_id int",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int",
    "frequencies": "trip_id string, start_time string, end_time string, headway_secs int, exact_times int",
    "transfers": "from_stop_id string, to_stop_id string, transfer_type int, min_transfer_time int",
}
#: A fixed time for archive members, so that equal tables give equal bytes.
_ARCHIVE_TIME = (1980, 1, 1, 0, 0, 0)


def read_or_empty(spark: SparkSession, path: str, schema: str, kind: str = "json", **options) -> DataFrame:
    """A file's rows, or none where there is no such file."""
    try:
        return spark.read.schema(schema).options(**options).format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_gtfs(spark: SparkSession, path: str, table: str, tag: str | None = None) -> DataFrame:
    """One table of GTFS archives (a path or pattern of zip files), columns by their header names.

    Each archive member is parsed in one task as a stream of rows; missing columns are null,
    blank lines go, a byte order mark too. With a tag, ids are namespaced ``tag:id``.
    """
    schema = GTFS_SCHEMAS[table]
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = dict(c.strip().split() for c in schema.split(","))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if f"{table}.txt" not in z.namelist():
                        continue
                    with z.open(f"{table}.txt") as member:
                        for part in pd.read_csv(member, dtype=object, chunksize=50_000, encoding="utf-8-sig", keep_default_na=False, skip_blank_lines=True):
                            part = part.rename(columns=str.strip).reindex(columns=names)
                            for c, kind in kinds.items():
                                if kind == "string":
                                    part[c] = pd.Series([v or None if isinstance(v, str) else None for v in part[c]], index=part.index, dtype=object)
                                else:
                                    part[c] = pd.to_numeric(part[c], errors="coerce").astype("Float64" if kind == "double" else "Int32")
                            yield part

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)
    if tag:
        out = out.withColumns({c: F.concat(F.lit(f"{tag}:"), c) for c in names if c.endswith("_id") and kinds[c] == "string" and c != "agency_id"})
    return out


def pack_gtfs(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Tables with the columns that order them, as a GTFS archive whose bytes depend on the rows alone.

    Rows stream to the driver partition by partition: an archive is one file by its format.
    """
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(tables):
            df, order = tables[name]
            with z.open(zipfile.ZipInfo(f"{name}.txt", _ARCHIVE_TIME), "w") as member, io.TextIOWrapper(member, "utf-8", newline="") as text:
                writer = csv.writer(text, lineterminator="\n")
                writer.writerow(df.columns)
                for row in df.orderBy(*order).toLocalIterator():
                    writer.writerow("" if v is None else v for v in row)


def content_hash(df: DataFrame, keys: list[str] | None = None) -> str:
    """A hash of a table's rows in any order: what tells whether anything changed."""
    row = F.sha2(F.to_json(F.struct(*(keys or df.columns))), 256)
    parts = [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20, 0)") for i in range(4)]
    got = df.select(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).agg(*[F.sum(f"p{i}") for i in range(4)], F.count("*")).first()
    return "-".join(str(v or 0) for v in got)


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, line_no, station_name, lat, lon) and edges (source, target, line_no) of GML files.

    A node's first pos is its longitude, its second the latitude; numeric entities are decoded.
    """
    text = spark.read.text(path, wholetext=True)

    def blocks(kind: str) -> DataFrame:
        return text.select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)\b{kind}\s*\[(.*?)\n\s*\]"), 1)).alias("b"))

    def quoted(name: str):
        return decode_entities(F.regexp_extract("b", rf'\b{name}\s+"([^"]*)"', 1))

    def number(name: str):
        return F.regexp_extract("b", rf"\b{name}\s+(-?[\d.eE+-]+)", 1)

    pos = F.transform(F.regexp_extract_all("b", F.lit(r"\bpos\s+(-?[\d.eE+-]+)"), 1), lambda v: v.cast("double"))
    nodes = blocks("node").select(number("id").cast("int").alias("id"), quoted("label").alias("label"), quoted("line_no").alias("line_no"), quoted("station_name").alias("station_name"), F.try_element_at(pos, F.lit(2)).alias("lat"), F.try_element_at(pos, F.lit(1)).alias("lon"))
    edges = blocks("edge").select(number("source").cast("int").alias("source"), number("target").cast("int").alias("target"), quoted("line_no").alias("line_no"))
    return nodes, edges


def decode_entities(text):
    """``&#NNNN;`` as characters: the text is cut at the entities and put together again."""
    parts = F.split(text, r"(?=&#\d{1,7};)")
    code = lambda p: F.regexp_extract(p, r"^&#(\d{1,7});", 1)
    utf16 = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")
    return F.array_join(F.transform(parts, lambda p: F.when(F.coalesce(code(p).try_cast("int") < 0xD800, F.lit(False)), F.concat(utf16(code(p).cast("int")), F.regexp_replace(p, r"^&#\d{1,7};", ""))).otherwise(p)), "")


def read_legacy_csv(spark: SparkSession, path: str, schema: str, encoding: str = "cp949") -> DataFrame:
    """CSV files in an encoding that Spark's reader doesn't take, each decoded whole in its task.

    Quoted cells may hold line ends. Empty cells, missing ones and those of another type are null;
    rows whose first cell is the first column's name are headers and go.
    """

    kinds = [c.strip().split(None, 1) for c in schema.split(",")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                reader = csv.reader(io.StringIO(content.decode(encoding, "replace"), newline=""))
                while part := list(itertools.islice(reader, 10_000)):
                    yield pd.DataFrame({"cells": [[x or None for x in row] for row in part if row]})

    cells = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "cells array<string>")
    parsed = cells.where(F.coalesce(F.trim(F.get("cells", F.lit(0))), F.lit("")) != kinds[0][0])
    return parsed.select(*[F.get("cells", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(kinds)])


def xml_items(raw: DataFrame, column: str, item: str, tags: list[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row for each ``<item>`` of landed XML bodies: the columns to keep, and a string column for each tag, empty where missing."""
    each = raw.select(*keep, F.explode(F.regexp_extract_all(column, F.lit(rf"(?s)<{item}>(.*?)</{item}>"), 1)).alias("_x"))
    return each.select(*keep, *[unescape_xml(F.trim(F.regexp_extract("_x", rf"(?s)<{t}>(.*?)</{t}>", 1))).alias(t) for t in tags])


def request_plan(*dimensions: DataFrame) -> DataFrame:
    """Every combination of short lists (regions, months, endpoints), one request each."""
    plan = dimensions[0].distinct()
    for d in dimensions[1:]:
        plan = plan.crossJoin(F.broadcast(d.distinct()))
    return plan


def missing_requests(plan: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """The requests of a plan that haven't landed completely yet; landed holds one row for each complete key."""
    return plan.join(landed.select(*keys).distinct(), keys, "left_anti")


def tiles(spark: SparkSession, south: float, west: float, north: float, east: float, step: float) -> DataFrame:
    """A box cut into tiles, by whole-number rows and columns so that no rounding adds up."""
    rows, cols = (max(1, math.ceil((b - a) / step - 1e-9)) for a, b in ((south, north), (west, east)))
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return grid.select("row", "col", (south + F.col("row") * step).alias("south"), (west + F.col("col") * step).alias("west"), F.least(F.lit(north), south + (F.col("row") + 1) * step).alias("north"), F.least(F.lit(east), west + (F.col("col") + 1) * step).alias("east"))
