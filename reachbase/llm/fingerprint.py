"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct hashes of a document's shingles, and the number of distinct
shingles that it stands for where there are fewer. Sketches of parts merge into the sketch of
the whole; two of them estimate resemblance and containment, one the distinct shingle count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachbase.llm.cluster import by_small_batches, partitions
from reachbase.llm.textblock import TextBlock, blocks

#: Hashes that a sketch keeps, and words of a shingle.
K, WORDS = 128, 5
_END = 2.0**64


def sketches(block: TextBlock, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """Each document's k smallest distinct shingle hashes, in order; empty for a text without words."""
    hashes, bounds = block.shingles(words)
    out = []
    for i in range(len(block)):
        own = hashes[bounds[i] : bounds[i + 1]]
        least = own
        if len(own) > 8 * k:  # sorting all of a long text isn't needed unless few hashes are distinct
            least = np.unique(np.partition(own, 4 * k)[: 4 * k])
            if len(least) < k:
                least = own
        out.append(np.unique(least)[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) / _END)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all of both; two empty sketches are alike (1)."""
    if len(a) == 0 and len(b) == 0:
        return 1.0
    least = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(least, both, assume_unique=True).sum()) / len(least)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    if len(a) == 0:
        return 1.0
    j, n, m = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return min(1.0, j * (n + m) / (1 + j) / n)


def encode(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (hex of the sorted hashes) and n_distinct of every document.

    A null text counts as empty; very long ones count whole; repeated rows get a row each; extra
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch.column("text")):
                made = sketches(block, k, words)
                ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array([encode(s) for s in made], pa.string()), pa.array([distinct_count(s, k) for s in made], pa.float64())], ["doc_id", "fingerprint", "n_distinct"])

    return by_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string, n_distinct double")


def merged_fingerprints(parts: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint of documents that come in parts (doc_id, text), from the parts' sketches.

    Each part's k smallest hashes go on, and of a document's the k smallest distinct ones stay,
    which Spark finds with k rows of each task. Parts that overlap by words - 1 words give the
    sketch of the whole text. Null texts count as empty; a document without words has an empty
    fingerprint; null doc_ids are one document; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch.column("text")):
                made = sketches(block, k, words)
                owner = np.repeat(np.arange(part.start, part.stop), [len(s) for s in made])
                hashes = np.concatenate([np.zeros(0, np.uint64), *made]) ^ np.uint64(1 << 63)  # signed numbers in the same order
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), pa.array(hashes.view(np.int64))], ["doc_id", "hash"])

    kind = dict(parts.dtypes)["doc_id"]
    each = by_small_batches(parts).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, hash long").distinct()
    least = each.withColumn("_place", F.row_number().over(Window.partitionBy("doc_id").orderBy("hash"))).where(F.col("_place") <= k)
    unsigned = F.lower(F.lpad(F.hex(F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    joined = least.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", unsigned.alias("h")))), lambda x: x["h"]), "").alias("fingerprint"))
    found = joined.withColumnRenamed("doc_id", "_id")
    return parts.select("doc_id").distinct().join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


#: The order of documents: null doc_ids first, then by doc_id, of equal ones by their texts' CRC, of equal ones by their place in docs.
_ORDER = ("_some", "_id", "_crc", "_place")
_ORDER_TYPE = np.dtype([("some", "i1"), ("id", "i8"), ("crc", "i8"), ("place", "i8")])


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text and the columns of the order. No two rows are equal in it, so no number of equal ids or texts ends in one range."""
    number = F.col("doc_id").cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.select("doc_id", "text", number.isNotNull().cast("tinyint").alias("_some"), F.coalesce(number, F.lit(0)).alias("_id"), crc.alias("_crc"), F.monotonically_increasing_id().alias("_place"))


def _runs(rows: DataFrame) -> np.ndarray:
    """The first rows, in the order, of ranges of about equal numbers of rows, one for each partition.

    What comes to the driver are these bounds, as many as partitions, whatever the number of rows.
    """
    ranges = rows.select(*_ORDER).repartitionByRange(partitions(rows.sparkSession), *_ORDER)
    lows = ranges.groupBy(F.spark_partition_id().alias("_p")).agg(F.min(F.struct(*_ORDER)).alias("low")).collect()
    return np.array(sorted(tuple(r["low"]) for r in lows), _ORDER_TYPE)


def _dealt_in_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text, _run and _next, each run in one partition, in the order.

    After its own rows, a run has the next run's first row (_next is true), the last run the
    first of all: so each row's successor stands behind it, and every text moves once but for
    one row of each run. docs must have its rows in the same partitions whenever it is read, as files do.
    """
    rows = _ordered(docs)
    bounds = _runs(rows)
    runs = max(1, len(bounds))

    @F.pandas_udf("int")
    def place_of(some: pd.Series, number: pd.Series, crc: pd.Series, place: pd.Series) -> pd.Series:
        keys = np.empty(len(some), _ORDER_TYPE)
        keys["some"], keys["id"], keys["crc"], keys["place"] = some, number, crc, place
        at = np.maximum(np.searchsorted(bounds, keys, side="right") - 1, 0)
        return pd.Series((2 * at + (keys == bounds[at])).astype(np.int32))

    own = rows.withColumn("_at", place_of(*_ORDER)).withColumn("_run", F.shiftright("_at", 1))
    here = F.struct(F.col("_run").alias("run"), F.lit(False).alias("next"))
    back = F.struct(F.pmod(F.col("_run") - 1, F.lit(runs)).alias("run"), F.lit(True).alias("next"))
    twice = own.withColumn("_to", F.explode(F.when(F.col("_at") % 2 == 1, F.array(here, back)).otherwise(F.array(here))))
    dealt = twice.select("doc_id", "text", *_ORDER, F.col("_to.run").alias("_run"), F.col("_to.next").alias("_next"))
    return dealt.repartitionById(runs, F.col("_run")).sortWithinPartitions("_run", "_next", *_ORDER).drop(*_ORDER)


def edit_with_following(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints every text, its edited text, and compares them and the next document's.

    In the edited text the last floor(n / 4) of n code points give way to the first as many (or
    all) of the next document by ascending doc_id (after the last: the first). Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_distinct and
    in_edited (the share of its shingles that the edited text has).

    docs: doc_id (a whole number) and text are used. Null texts count as empty; texts without
    words are alike (1). Null doc_ids come first; rows with equal doc_ids follow each other by
    their texts' CRC; a single row follows itself; an empty table gives an empty result. docs must
    have its rows in the same partitions whenever it is read, as files do; if not, it is an error.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, in_edited double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Held] = []
        for batch in batches:
            ids, runs, nexts = batch.column("doc_id"), batch.column("_run").to_numpy(zero_copy_only=False), batch.column("_next").to_numpy(zero_copy_only=False)
            for part, block in blocks(batch.column("text")):
                n = part.stop - part.start
                rows = [_Held(ids[part.start + i].as_py(), int(runs[part.start + i]), bool(nexts[part.start + i]), block.data[block.doc_start[i] : block.doc_end[i]], s) for i, s in enumerate(sketches(block, k, words))]
                rows = held + rows
                yield _compared(rows, k, words)
                held = [rows[-1].copied()] if n else held
        if held and not held[0].follows:
            raise ValueError("the rows of docs changed places while they were read; write them first")

    return _dealt_in_runs(by_small_batches(docs)).mapInArrow(run, schema)


class _Held:
    """A row that waits for its successor."""

    def __init__(self, doc_id: int | None, run: int, follows: bool, data: np.ndarray, sketch: np.ndarray):
        self.doc_id, self.run, self.follows, self.data, self.sketch = doc_id, run, follows, data, sketch

    def copied(self) -> _Held:
        return _Held(self.doc_id, self.run, self.follows, self.data.copy(), self.sketch)


def _compared(rows: list[_Held], k: int, words: int) -> pa.RecordBatch:
    """The results of all rows but the last and those that only follow."""
    pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a.follows]
    counts, edited = [], []
    for a, b in pairs:
        points = np.flatnonzero((a.data & 0xC0) != 0x80)
        n = len(points)
        cut = n // 4
        more = np.flatnonzero((b.data[: 4 * cut] & 0xC0) != 0x80)
        upto = more[cut] if len(more) > cut else min(len(b.data), 4 * cut)
        kept = a.data[: points[n - cut]] if cut else a.data
        counts.append(n)
        edited.append(np.concatenate([kept, b.data[:upto]]) if cut else kept)
    sizes = np.array([len(e) for e in edited], np.int64)
    ends = np.cumsum(sizes)
    block = TextBlock(np.concatenate(edited) if edited else np.zeros(0, np.uint8), ends - sizes, ends)
    made = sketches(block, k, words)
    columns = [
        pa.array([a.doc_id for a, _ in pairs], pa.int64()),
        pa.array(counts, pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array([encode(a.sketch) for a, _ in pairs], pa.string()),
        pa.array([encode(s) for s in made], pa.string()),
        pa.array([resemblance(a.sketch, s, k) for (a, _), s in zip(pairs, made, strict=True)], pa.float64()),
        pa.array([resemblance(a.sketch, b.sketch, k) for a, b in pairs], pa.float64()),
        pa.array([distinct_count(a.sketch, k) for a, _ in pairs], pa.float64()),
        pa.array([containment(a.sketch, s, k) for (a, _), s in zip(pairs, made, strict=True)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct", "in_edited"])
