"""The reach matrix as one small binary file for each origin, beside the Parquet table."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachbase.functions.exprs import drawn_colour, mercator_y

# Fixed values of the format: magic, version, flag of the walk plane, and what stands for out of reach.
MAGIC, VERSION, HAS_WALK, UNREACHABLE = b"TRMX", 1, 1, 255


def encode(minutes: np.ndarray, walk: np.ndarray | None) -> bytes:
    """Header (magic, version, flags, slots, columns) and one or two planes of bytes."""
    slots, columns = minutes.shape
    planes = [minutes] if walk is None else [minutes, walk]
    return MAGIC + struct.pack("<BBHH", VERSION, HAS_WALK if walk is not None else 0, slots, columns) + b"".join(p.astype(np.uint8).tobytes() for p in planes)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    if data[:4] != MAGIC or data[4] != VERSION:
        raise ValueError("not a matrix of this version")
    flags, slots, columns = struct.unpack("<BHH", data[5:10])
    planes = 2 if flags & HAS_WALK else 1
    if len(data) != 10 + planes * slots * columns:
        raise ValueError("the matrix has another size than its header says")
    got = np.frombuffer(data, np.uint8, offset=10).reshape(planes, slots, columns)
    return got[0], got[1] if planes == 2 else None


def matrix_files(reach: DataFrame, slots: int, columns: int, walk: bool = True) -> DataFrame:
    """origin, content of reach (origin, slot, dong_idx, minutes, walk); what isn't there is out of reach.

    An origin's group is its dense matrix, slots x columns bytes, whatever the rows.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        minutes = np.full((slots, columns), UNREACHABLE, np.uint8)
        steps = np.zeros((slots, columns), np.uint8)
        known = rows[rows.minutes.notna()]
        minutes[known.slot, known.dong_idx] = known.minutes
        steps[known.slot, known.dong_idx] = known.walk.fillna(0)
        return pd.DataFrame({"origin": [rows.origin.iloc[0]], "content": [encode(minutes, steps if walk else None)]})

    return reach.select("origin", "slot", "dong_idx", "minutes", "walk").groupBy("origin").applyInPandas(build, f"origin {dict(reach.dtypes)['origin']}, content binary")


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """name, slot, dong_idx, minutes, walk of all cells in reach."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                minutes, walk = decode(content)
                slot, dong = np.nonzero(minutes != UNREACHABLE)
                yield pd.DataFrame({"name": name.rsplit("/", 1)[-1], "slot": slot.astype(np.int32), "dong_idx": dong.astype(np.int32), "minutes": minutes[slot, dong].astype(np.int32), "walk": None if walk is None else walk[slot, dong].astype(np.int32)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "name string, slot int, dong_idx int, minutes int, walk int")


def manifest(slots: DataFrame, stations: DataFrame, dongs: DataFrame, cap_minutes: int) -> DataFrame:
    """One JSON document; written last, it says that the matrices are complete."""

    def listed(df: DataFrame, order: str, name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c != order]))).alias(name))

    one = listed(slots, "slot", "slots").join(listed(stations, "station_idx", "stations"), F.lit(True)).join(listed(dongs, "dong_idx", "dongs"), F.lit(True))
    return one.select(F.to_json(F.struct(F.lit(2).alias("version"), F.lit(cap_minutes).alias("capMinutes"), "slots", "stations", "dongs")).alias("value"))


def features(rows: DataFrame, properties: list[str]) -> DataFrame:
    """GeoJSON features of points (lat, lon), one a row, coordinates to five places."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 5), F.round("lat", 5)).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def band_features(cells: DataFrame, cell: float) -> DataFrame:
    """GeoJSON features of cells (lat, lon of the lower corner, band): a square each, cell degrees wide; contours aren't traced."""
    corner = lambda i, j: F.array(F.round(F.col("lon") + j * cell, 5), F.round(F.col("lat") + i * cell, 5))
    ring = F.array(*[corner(i, j) for i, j in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))])
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return cells.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(F.col("band").alias("minutes")).alias("properties"))).alias("value"))


def svg_dots(rows: DataFrame, box: tuple[float, float, float, float], width: int) -> DataFrame:
    """A circle element for each point (lat, lon, minutes) in the box (south, west, north, east), in the colour of its minutes."""
    south, west, north, east = box
    scale = width / (east - west)
    top = mercator_y(F.lit(north))
    x, y = (F.col("lon") - west) * scale, (top - mercator_y("lat")) * scale
    colour = drawn_colour("minutes")
    return rows.where((F.col("lat").between(south, north)) & (F.col("lon").between(west, east))).select(F.format_string('<circle cx="%.1f" cy="%.1f" r="3" fill="%s"/>', x, y, colour).alias("value"))
