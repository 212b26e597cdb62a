"""Importance resampling towards a target: bucketed features, gains, and exact weights from bit planes.

Features fall into buckets by their checksum. A bucket's gain is the logarithm of its share in
the target over its share in the documents. A document's counts by bucket are cut into bit
planes of one bit for each bucket, and so are the gains, by sign. The sum of counts times gains
is then a sum over pairs of planes: how many bits both have, times a power of two. It is exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.llm.cluster import by_small_batches, durable
from reachbase.llm.textblock import NumberedWords, TextBlock, blocks
from reachbase.operators.ranges import places

BUCKETS = 10_000
#: Words that a document needs to be drawn, and the share of such documents that is drawn, in percent.
MIN_WORDS, PERCENT = 20, 10
SEED = 2024
#: Documents whose planes are made together, and 64-bit words of a plane.
DOCUMENTS_AT_ONCE = 64
PLANE_WORDS = -(-BUCKETS // 64)

#: Bytes between words: ASCII that is neither a digit nor, once lower-cased, a letter.
_APART = np.zeros(256, bool)
_APART[:128] = True
_APART[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False


def bucketed(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of a lower-cased block, and the first word of each document (one more at the end)."""
    words = NumberedWords(block, _APART)
    of_distinct = np.fromiter((zlib.crc32(w) % BUCKETS for w in words.distinct.to_pylist()), np.int64, len(words.distinct))
    return of_distinct[words.ids], words.bounds


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many features a task's texts have in each bucket; a row for each bucket and table at most."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        target = batch.column("target").to_numpy(zero_copy_only=False)
        for part, block in blocks(batch.column("text"), lower=True):
            bucket, bounds = bucketed(block)
            key = bucket + BUCKETS * np.repeat(target[part].astype(np.int64), np.diff(bounds))
            counts += np.bincount(key, minlength=2 * BUCKETS).reshape(2, -1)
    used = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], ["bucket", "s", "t"])


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, s and t (its features in all documents and in all target texts), and gain, of every bucket. All texts count.

    Null and empty texts have no features; without any text on either side every gain is 0.
    """
    texts = by_small_batches(docs).select("text", F.lit(False).alias("target")).union(target.select("text", F.lit(True)))
    counted = texts.mapInArrow(_count_batches, "bucket long, s long, t long").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(counted, "bucket", "left").na.fill(0)
    sums = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + BUCKETS).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + BUCKETS).cast("double")
    return every.crossJoin(F.broadcast(sums)).select("bucket", "s", "t", F.floor(1000 * F.log(up / down)).alias("gain"))  # sums is one row


def bit_planes(bits: np.ndarray) -> np.ndarray:
    """Rows of BUCKETS bits as rows of PLANE_WORDS 64-bit words."""
    packed = np.zeros((len(bits), PLANE_WORDS * 8), np.uint8)
    small = np.packbits(bits, axis=1, bitorder="little")
    packed[:, : small.shape[1]] = small
    return packed.view(np.uint64)


def signed_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(plus or minus a power of two, plane): what the gains consist of, by sign and bit. Planes without a bit are left out."""
    out = []
    for sign, size in ((1, np.maximum(gain, 0)), (-1, np.maximum(-gain, 0))):
        for k in range(int(size.max()).bit_length()):
            plane = bit_planes((size >> k & 1).astype(bool)[None])[0]
            if plane.any():
                out.append((sign << k, plane))
    return out


def weight_sums(bucket: np.ndarray, bounds: np.ndarray, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Of each document the sum of its features' gains."""
    out = np.zeros(len(bounds) - 1, np.int64)
    of_doc = np.repeat(np.arange(len(out)), np.diff(bounds))
    for first in range(0, len(out), DOCUMENTS_AT_ONCE):
        last = min(first + DOCUMENTS_AT_ONCE, len(out))
        words = slice(bounds[first], bounds[last])
        keys, times = np.unique((of_doc[words] - first) * BUCKETS + bucket[words], return_counts=True)
        for j in range(int(times.max(initial=0)).bit_length()):
            bits = np.zeros((last - first) * BUCKETS, bool)
            bits[keys[(times >> j & 1).astype(bool)]] = True
            counts = bit_planes(bits.reshape(last - first, BUCKETS))
            for power, plane in planes:
                out[first:last] += (power << j) * np.bitwise_count(counts & plane).sum(1, dtype=np.int64)
    return out


def _weigh_batches(gain: np.ndarray):
    """For mapInArrow over doc_id and text: doc_id, n_features and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = signed_planes(gain)
        for batch in batches:
            for part, block in blocks(batch.column("text"), lower=True):
                bucket, bounds = bucketed(block)
                n = np.diff(bounds).astype(np.int64)
                weight = np.where(n > 0, weight_sums(bucket, bounds, planes) // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.start, part.stop - part.start), pa.array(n), pa.array(weight)], ["doc_id", "n_features", "weight"])

    return run


def noise(doc_id: Column) -> Column:
    """Floored thousandths of a Gumbel number that follows from the seed and the id alone."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Draws percent of the documents with at least min_words words, so that they are more like the target's texts.

    docs have doc_id and text, target has text; further columns are ignored. Returns doc_id,
    n_features, weight (the floored mean gain of a document's features), score (weight and noise)
    and rank of every row: 1, 2, 3 ... by score, highest first, ties to the smaller doc_id, null
    for those not drawn. Features are words, lower-cased in ASCII only, with repeats.

    A null or empty text, or one without words, has no features and weight 0 and isn't drawn.
    A null doc_id counts as an empty one in the noise and comes before others in ties; repeated
    rows are drawn one by one, each with a rank of its own. Long texts count whole. Without
    documents the result is empty; without target texts all words of documents weigh little.
    """
    narrow = by_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    of_bucket = gains(narrow, target).toArrow()  # BUCKETS rows
    gain = np.zeros(BUCKETS, np.int64)
    gain[of_bucket.column("bucket").to_numpy()] = of_bucket.column("gain").to_numpy()
    weighed = durable(narrow.mapInArrow(_weigh_batches(gain), "doc_id long, n_features long, weight long"))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    able = F.col("n_features") >= min_words
    drawn = weighed.where(able).count() * percent // 100
    # Rows that are equal but for their place in the written table are spread too.
    ordered = scored.where(able).select("*", (-F.col("score")).alias("_down"), F.monotonically_increasing_id().alias("_row"))
    ranked = places(ordered, ["_down", "doc_id", "weight", "n_features", "_row"])
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).union(scored.where(~able).select(*columns, F.lit(None).cast("long")))
