"""OpenStreetMap extracts (PBF) as a Python data source: a partition for each run of blobs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reachbase.sources.remote import opened

SCHEMA = "kind string, id long, lat double, lon double, tags map<string, string>, refs array<long>, members array<struct<kind: string, id: long, role: string>>"
_KINDS = ("node", "way", "relation")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _packed(data: bytes) -> np.ndarray:
    """All variable-length numbers of a packed field."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    bits = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(bits, starts)


def _signed(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def _one(value: int) -> int:
    return value >> 1 ^ -(value & 1)


class Blobs(InputPartition):
    def __init__(self, path: str, places: list[tuple[int, int]]):
        self.path, self.places = path, places


class ExtractReader(DataSourceReader):
    def __init__(self, path: str, kinds: set[str], per_partition: int):
        self.path, self.kinds, self.per_partition = path, kinds, per_partition

    def partitions(self) -> list[Blobs]:
        """Reads the blobs' headers alone."""
        places = []
        with opened(self.path) as f:
            while head := f.read(4):
                header = dict(_fields(f.read(struct.unpack(">I", head)[0])))
                if header[1] == b"OSMData":
                    places.append((f.tell(), header[3]))
                f.seek(header[3], 1)
        n = self.per_partition
        return [Blobs(self.path, places[i : i + n]) for i in range(0, len(places), n)] or [Blobs(self.path, [])]

    def read(self, partition: Blobs) -> Iterator[tuple]:
        with opened(partition.path) as f:
            for at, size in partition.places:
                f.seek(at)
                blob = dict(_fields(f.read(size)))
                yield from self._block(zlib.decompress(blob[3]) if 3 in blob else blob[1])

    def _block(self, data: bytes) -> Iterator[tuple]:
        strings: list[str] = []
        groups, granularity, lat0, lon0 = [], 100, 0, 0
        for number, value in _fields(data):
            if number == 1:
                strings = [v.decode(errors="replace") for _, v in _fields(value)]
            elif number == 2:
                groups.append(value)
            elif number == 17:
                granularity = value
            elif number == 19:
                lat0 = value - (1 << 64) if value >> 63 else value
            elif number == 20:
                lon0 = value - (1 << 64) if value >> 63 else value
        degrees = lambda v, zero: 1e-9 * (zero + granularity * v)
        for group in groups:
            for number, value in _fields(group):
                if number == 1 and "node" in self.kinds:
                    own = dict(_fields(value))
                    yield "node", _one(own[1]), degrees(_one(own[8]), lat0), degrees(_one(own[9]), lon0), self._tags(own, strings), None, None
                elif number == 2 and "node" in self.kinds:
                    own = dict(_fields(value))
                    ids, lats, lons = (np.cumsum(_signed(_packed(own[k]))) for k in (1, 8, 9))
                    marks = iter(_packed(own.get(10, b"")).tolist())
                    for i, y, x in zip(ids.tolist(), lats.tolist(), lons.tolist(), strict=True):
                        tags = {}
                        for k in marks:
                            if k == 0:
                                break
                            tags[strings[k]] = strings[next(marks)]
                        yield "node", i, degrees(y, lat0), degrees(x, lon0), tags, None, None
                elif number == 3 and "way" in self.kinds:
                    own = dict(_fields(value))
                    yield "way", own[1], None, None, self._tags(own, strings), np.cumsum(_signed(_packed(own.get(8, b"")))).tolist(), None
                elif number == 4 and "relation" in self.kinds:
                    own = dict(_fields(value))
                    ids, roles, kinds = np.cumsum(_signed(_packed(own.get(9, b"")))).tolist(), _packed(own.get(8, b"")).tolist(), _packed(own.get(10, b"")).tolist()
                    yield "relation", own[1], None, None, self._tags(own, strings), None, [(_KINDS[k], i, strings[r]) for k, i, r in zip(kinds, ids, roles, strict=True)]

    @staticmethod
    def _tags(own: dict, strings: list[str]) -> dict[str, str]:
        return {strings[k]: strings[v] for k, v in zip(_packed(own.get(2, b"")).tolist(), _packed(own.get(3, b"")).tolist(), strict=True)}


class Extract(DataSource):
    """``spark.read.format("osm_extract").option("kinds", "way,relation").load(path)``; fewer kinds read less."""

    @classmethod
    def name(cls) -> str:
        return "osm_extract"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExtractReader:
        return ExtractReader(self.options["path"], set(self.options.get("kinds", "node,way,relation").split(",")), int(self.options.get("blobsPerPartition", "16")))
