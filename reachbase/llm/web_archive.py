"""Web archives: legacy ARC files, their conversion to WARC, and reading WARC files back.

An ARC file starts with a version block, whose first line names the file and whose lines give the
version and the fields of a record's header line: five in version 1, ten in version 2. Every
header ends with the length of what follows it. The converter parses headers by version and
bodies by length, and makes WARC records that say the same: a ``warcinfo`` record of the version
block, ``response`` records of HTTP answers, ``resource`` records of the rest. Record ids follow
from the file's name and the record's place in it, dates from the header's date, digests from
the bytes. Of equal payloads the first stays whole and the others become ``revisit`` records.

Files are written and read by Spark, one for each task, gzipped; a file is read in one task.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachbase.llm import key_filter
from reachbase.llm.cluster import BATCH_BYTES, by_small_batches, durable, folder, removed

#: Payloads with fewer bytes are stored each time.
MIN_SHARED_BYTES = 100
#: What the formats prescribe.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http; msgtype=response"
#: Date of records whose source has none, and the address of an unknown server.
NO_DATE, NO_ADDRESS, NO_URL = "19700101000000", "0.0.0.0", "about:blank"
PAGE_HEADER = "X-Page-Id"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


class ArcRecord(NamedTuple):
    """A record as it stands in an ARC file; the version block is one too."""

    offset: int
    url: str
    ip: str
    date: str
    mime: str
    status: str | None
    content: bytes
    truncated: bool


def opened(content: bytes) -> BinaryIO:
    """The bytes of a file, unpacked while they are read if they are gzipped (in one member or a member for each record)."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw


def _fields(line: bytes, version: int, name: str, offset: int) -> list[str]:
    """The fields of a header line; a URL may hold spaces."""
    fields = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(ARC_FIELDS[version].split()) - 1)
    if len(fields) != len(ARC_FIELDS[version].split()) or not fields[-1].isdigit():
        raise ValueError(f"{name}: no header line of version {version} at {offset}: {line[:200]!r}")
    return fields


def arc_records(stream: BinaryIO, name: str) -> Iterator[ArcRecord]:
    """All records of an ARC file, the version block first. Blank lines between records are skipped.

    A record that ends before its declared length is marked as truncated. A line that isn't a
    header of the file's version is an error that names the file and the place.
    """
    version, end = None, 0
    while True:
        offset = end
        line = stream.readline()
        end += len(line)
        if not line:
            return
        if not line.strip(b"\r\n"):
            continue
        if version is None:
            length = line.split()[-1]
            if not line.startswith(b"filedesc:") or not length.isdigit():
                raise ValueError(f"{name}: an ARC file starts with its version block, not with {line[:200]!r}")
            content = stream.read(int(length))
            number = content.split(b" ", 1)[0]
            version = int(number) if number.isdigit() else 0
            if version not in ARC_FIELDS:
                raise ValueError(f"{name}: unknown ARC version {number[:20]!r}")
        else:
            length = _fields(line, version, name, offset)[-1]
            content = stream.read(int(length))
        end += len(content)
        fields = _fields(line, version, name, offset)
        yield ArcRecord(offset, *fields[:4], fields[4] if version == 2 else None, content, len(content) < int(length))


def iso_date(date: str) -> str:
    """14 digits, or fewer of them from the left, as a WARC date; what isn't a date counts as NO_DATE."""
    digits = date if re.fullmatch(r"\d{4,14}", date) else NO_DATE
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str, offset: int) -> str:
    """The same for each reading of a record, another for each record of a file with a name of its own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}>"


@dataclass(frozen=True)
class Converted:
    """What a WARC record says of an ARC record. payload is what follows the HTTP head, or all."""

    record_id: str
    kind: str
    url: str
    date: str
    ip: str
    mime: str
    head: bytes
    payload: bytes
    truncated: bool

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.payload).hexdigest()

    @property
    def page_id(self) -> int | None:
        return _page_id(self.head)


def _header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?mi)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def _page_id(head: bytes) -> int | None:
    value = _header(head, PAGE_HEADER)
    return int(value) if value and re.fullmatch(r"-?\d{1,19}", value) else None


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """The head with its blank line, and the payload; an answer without a blank line is all head."""
    end = _HEAD_END.search(content)
    return (content[: end.end()], content[end.end() :]) if end else (content, b"")


def converted(record: ArcRecord, name: str) -> Converted:
    """The WARC side of an ARC record of the file of that name."""
    answer = re.match(r"(?i)https?://|about:blank$", record.url) and record.content.startswith(b"HTTP/")
    kind = "warcinfo" if record.url.startswith("filedesc:") else "response" if answer else "resource"
    head, payload = split_http(record.content) if kind == "response" else (b"", record.content)
    mime = {"warcinfo": "text/plain", "response": HTTP_RESPONSE}.get(kind, record.mime)
    return Converted(record_id(name, record.offset), kind, record.url, iso_date(record.date), record.ip, mime, head, payload, record.truncated)


def warc_record(fields: Iterable[tuple[str, str | None]], block: bytes) -> bytes:
    """A record up to the end of its block; the two line ends behind it are the sink's."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def response_record(c: Converted) -> bytes:
    """The whole record of what was converted."""
    block = c.head + c.payload
    known = [("WARC-Type", c.kind), ("WARC-Record-ID", c.record_id), ("WARC-Date", c.date)]
    if c.kind == "warcinfo":
        return warc_record([*known, ("WARC-Filename", c.url.removeprefix("filedesc://")), ("Content-Type", c.mime)], block)
    address = None if c.ip in (NO_ADDRESS, "-") else c.ip
    digests = [("WARC-Payload-Digest", f"sha256:{c.digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    return warc_record([*known, ("WARC-Target-URI", c.url), ("WARC-IP-Address", address), *digests, ("WARC-Truncated", "unspecified" if c.truncated else None), ("Content-Type", c.mime)], block)


def revisit_record(row: dict) -> bytes:
    """The record of an answer whose payload stands in another record."""
    known = [("WARC-Type", "revisit"), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["url"]), ("WARC-IP-Address", None if row["ip"] in (NO_ADDRESS, "-") else row["ip"])]
    first = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", row["first_id"]), ("WARC-Refers-To-Target-URI", row["first_url"]), ("WARC-Refers-To-Date", row["first_date"])]
    return warc_record([*known, *first, ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", HTTP_RESPONSE)], row["head"])


def warc_records(stream: BinaryIO, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC file, by declared lengths."""
    while True:
        offset = stream.tell()
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record at {offset}: {line[:200]!r}")
        fields: dict[str, str] = {}
        last = ""
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and last:
                fields[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            key, _, value = line.decode("utf-8", "replace").partition(":")
            last = key.strip().lower()
            fields[last] = value.strip()
        block = stream.read(int(fields.get("content-length", "0")))
        yield fields, block


# Spark's side


def _batched(rows: Iterable[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches; size: the number of the column whose bytes fill one."""
    held: list[tuple] = []
    filled = 0
    for row in rows:
        held.append(row)
        filled += len(row[size] or b"") + 200
        if filled >= BATCH_BYTES:
            yield _batch(held, schema)
            held, filled = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_VALUE = pa.schema([("value", pa.binary())])


def _sink(records: DataFrame, path: str, between: str) -> None:
    """Writes the column value, whatever bytes it holds, with ``between`` behind each; a file for each task, packed fast."""
    records.select(F.col("value").cast("string")).write.option("lineSep", between).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return by_small_batches(spark.read.format("binaryFile").load(path)).select("path", "content")


def _arc_batches(versions: tuple[int, ...], date: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes]]:
        number = TaskContext.get().partitionId()
        version = versions[number % len(versions)]
        name = f"pages-{number:06d}.arc"
        block = f"{version} 0 reachbase\n{ARC_FIELDS[version]}\n".encode()
        more = f"200 - - 0 {name} " if version == 2 else ""
        first = f"filedesc://{name} {NO_ADDRESS} {date} text/plain {more}{len(block)}\n".encode() + block
        yield (first,)
        offset = len(first) + 1
        for batch in batches:
            urls = batch.column("url").to_pylist()
            for page_id, url, html in zip(batch.column("page_id").to_pylist(), urls, batch.column("html").cast(pa.binary()).to_pylist(), strict=True):
                payload = html or b""
                own = f"{PAGE_HEADER}: {page_id}\r\n" if page_id is not None else ""
                content = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload
                safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or NO_URL
                if not re.match(r"(?i)https?://", safe):
                    safe = NO_URL
                more = f"200 - - {offset} {name} " if version == 2 else ""
                record = f"{safe} {NO_ADDRESS} {date} text/html {more}{len(content)}\n".encode() + content
                offset += len(record) + 1
                yield (record,)

    return lambda batches: _batched(rows(batches), _VALUE, 0)


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2), date: str = NO_DATE) -> None:
    """Writes pages (page_id, url, html) as ARC files, one for each task; tasks take turns in the versions.

    A null html is an empty payload; a null page_id has no header of its own; a url that isn't
    one of http is written as NO_URL, and spaces and control characters in it as percent signs
    and digits. Equal rows are records of their own; further columns are ignored.
    """
    _sink(by_small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_arc_batches(versions, date), "value binary"), path, "\n")


def _converted_files(batches: Iterator[pa.RecordBatch]) -> Iterator[Converted]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            name = path.rsplit("/", 1)[-1]
            for record in arc_records(opened(content.as_py()), name):
                yield converted(record, name)


_HEADS = pa.schema([("record_id", pa.string()), ("key", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("head", pa.binary())])
_HEADS_SQL = "record_id string, key long, url string, date string, ip string, digest string, page_id long, head binary"


def _key(record_id: str) -> int:
    """64 random bits of an id, as a signed number."""
    digits = record_id.removeprefix("<urn:uuid:").rstrip(">")
    key = int(digits[:8] + digits[-8:], 16)
    return key - (1 << 64) if key >> 63 else key


def _may_repeat(c: Converted) -> bool:
    return c.kind == "response" and len(c.payload) >= MIN_SHARED_BYTES


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of answers that may repeat others all but their payloads."""
    rows = ((c.record_id, _key(c.record_id), c.url, c.date, c.ip, c.digest, c.page_id, c.head) for c in _converted_files(batches) if _may_repeat(c))
    return _batched(rows, _HEADS, 7)


def _passing(known: Broadcast):
    """For mapInArrow over key: those that the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.value.has(batch.column("key").to_numpy().view(np.uint64))))

    return run


_DOUBTED = pa.schema([("record_id", pa.string()), ("value", pa.binary())])


def _parted(repeats: Broadcast, doubted: Broadcast, surely: bool):
    """The whole records of those that are surely no revisits, or those that may be either (record_id, value).

    repeats has the keys of all revisits and, by its nature, of some others, which doubted has.
    """

    def may_be_revisit(c: Converted) -> bool:
        return _may_repeat(c) and bool(repeats.value.has(_as_key(c))[0])

    def _as_key(c: Converted) -> np.ndarray:
        return np.array([_key(c.record_id)]).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if surely:
            return _batched(((response_record(c),) for c in _converted_files(batches) if not may_be_revisit(c)), _VALUE, 0)
        found = (c for c in _converted_files(batches) if may_be_revisit(c) and doubted.value.has(_as_key(c))[0])
        return _batched(((c.record_id, response_record(c)) for c in found), _DOUBTED, 1)

    return run


def _as_revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _batched(((revisit_record(row),) for row in batch.to_pylist()), _VALUE, 0)


def _filter(keys: DataFrame) -> Broadcast:
    return keys.sparkSession.sparkContext.broadcast(key_filter.of_keys(keys, "key", key_filter.bits_for(keys.count())))


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Writes the records of all ARC files of a folder as WARC files.

    Answers with equal payloads of MIN_SHARED_BYTES and more: the one with the smallest page id
    (those without an id last, then by date and record id) is whole, the others are revisits of it.
    Truncated records stay and say so. Without files no records are written.

    Rows without payloads move to find and to write the revisits. Tasks know the revisits' ids by a
    bitset of bounded size, and those ids that it wrongly has by another. Only records that both
    have, about one in a hundred of those with repeated payloads, move whole to be told apart.
    """
    files = _files(spark, arc_path)
    heads = durable(files.mapInArrow(_heads, _HEADS_SQL))
    order = F.struct(F.col("page_id").isNull(), "page_id", "date", "record_id", "url")
    groups = heads.groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    first = groups.select("digest", F.col("first.record_id").alias("first_id"), F.col("first.date").alias("first_date"), F.col("first.url").alias("first_url"))
    again = durable(heads.join(first, "digest").where("record_id <> first_id"))
    repeats = _filter(again)
    passing = heads.select("key").mapInArrow(_passing(repeats), "key long")
    doubted = _filter(durable(passing.join(again.select("key"), "key", "left_anti")))
    either = files.mapInArrow(_parted(repeats, doubted, False), "record_id string, value binary")
    whole = files.mapInArrow(_parted(repeats, doubted, True), "value binary")
    told = either.join(again.select("record_id"), "record_id", "left_anti").select("value")
    _sink(whole.unionAll(again.mapInArrow(_as_revisits, "value binary")).unionAll(told), warc_path, "\r\n\r\n")


_READ = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("sound", pa.bool_())])
_READ_SQL = "record_id string, record_type string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, sound boolean"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for fields, block in warc_records(opened(content.as_py()), path):
                    kind = fields.get("warc-type")
                    head, payload = split_http(block) if fields.get("content-type", "").startswith("application/http") else (b"", block)
                    declared = (fields.get("warc-payload-digest") or "").removeprefix("sha256:")
                    digest = hashlib.sha256(payload).hexdigest()
                    whole = len(block) == int(fields.get("content-length", "0"))
                    if kind == "revisit":
                        size, digest, sound = None, declared, whole
                    else:
                        size, sound = len(payload), whole and declared in ("", digest)
                    yield fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), _page_id(head), size, digest, fields.get("warc-refers-to"), sound

    return _batched(rows(), _READ, 2)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of all WARC files of a folder, gzipped or not.

    record_id, record_type, url, date, page_id (of the head, if there is one), payload_bytes,
    payload_digest (counted, but declared for revisits, which have no payload; their size is
    null), refers_to_id, and sound: whether the block is complete and its digest is as declared.
    """
    return _files(spark, path).mapInArrow(_read_batches, _READ_SQL)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes pages as ARC files, converts these to WARC files, reads the WARC files back and removes both.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url and date of
    each page, as the archives have them. Revisits take their payload's size from the record that
    they refer to, found by its id, and refers_to is that one's page_id. Nulls, odd urls and equal
    rows are as in write_arc(); very long pages are written and read whole; without pages there
    are no rows. Raises ValueError if a record is broken or refers to nothing.
    """
    spark = pages.sparkSession
    arc, warc = folder(spark, "arc"), folder(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    found = durable(read_warc(spark, warc).where("record_type <> 'warcinfo'"))
    removed(spark, arc)
    removed(spark, warc)
    whole = found.where("record_type <> 'revisit'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date"]
    first = whole.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("of"))
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes").join(first, "refers_to_id", "left").withColumn("payload_bytes", F.col("size"))
    broken = F.raise_error(F.concat(F.lit("broken record "), F.coalesce("record_id", F.lit(""))))
    checked = F.when(F.coalesce(F.col("sound") & (F.col("payload_digest") == F.col("of")), F.lit(False)), F.col("payload_digest")).otherwise(broken)
    intact = F.when(F.coalesce("sound", F.lit(False)), F.col("payload_digest")).otherwise(broken)
    return whole.withColumn("payload_digest", intact).withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionAll(revisits.withColumn("payload_digest", checked).select(*columns))
