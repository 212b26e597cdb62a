"""Workbooks as a Python data source: rows of all sheets in their order, cells as strings."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reachbase.sources.remote import opened

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


class Sheets(InputPartition):
    def __init__(self, path: str, members: list[tuple[int, str]]):
        self.path, self.members = path, members


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, per_partition: int):
        self.path, self.per_partition = path, per_partition

    def partitions(self) -> list[Sheets]:
        """Runs of sheets in numeric order: a long table is split over sheets by its writer. Shared strings are read once for each run."""
        with opened(self.path) as f, zipfile.ZipFile(f) as z:
            found = sorted((int(m[1]), m[0]) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        return [Sheets(self.path, found[i : i + self.per_partition]) for i in range(0, len(found), self.per_partition)] or [Sheets(self.path, [])]

    def read(self, partition: Sheets) -> Iterator[tuple]:
        with opened(partition.path) as whole, zipfile.ZipFile(whole) as z:
            shared = self._shared(z) if partition.members else []
            for number, member in partition.members:
                for at, cells in enumerate(self._rows(z, member, shared)):
                    yield number, at, cells

    @staticmethod
    def _shared(z: zipfile.ZipFile) -> list[str]:
        out: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{_NS}si":
                        out.append("".join(t.text or "" for t in node.iter(f"{_NS}t")))
                        node.clear()
        return out

    @staticmethod
    def _rows(z: zipfile.ZipFile, member: str, shared: list[str]) -> Iterator[list[str]]:
        with z.open(member) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                cells: dict[int, str] = {}
                for cell in row.iter(f"{_NS}c"):
                    value = cell.find(f"{_NS}v")
                    text = "".join(t.text or "" for t in cell.iter(f"{_NS}t")) if cell.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                    cells[_column(cell.get("r"))] = shared[int(text)] if cell.get("t") == "s" and text else text
                yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
                row.clear()


class Workbook(DataSource):
    """``spark.dataSource.register(Workbook)``, then ``spark.read.format("workbook").option("sheetsPerPartition", "8").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet int, row int, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"], int(self.options.get("sheetsPerPartition", "8")))
