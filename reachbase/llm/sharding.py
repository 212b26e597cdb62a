"""Sharding: global byte-size prefix sums, cut at equal targets into contiguous shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.operators.ranges import running_sums


def stored_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) and one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc32(text: str = "text") -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text has no bytes, which gives 0."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long")


def contiguous_shards(sizes: DataFrame, n_shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Adds ``shard`` (0 to n_shards - 1) and ``slot`` (its row number from 0 within the shard).

    Rows stand in the order of ``order``. A row goes to the shard in which the middle of its
    bytes falls when all bytes are cut at n_shards equal targets, so a shard's bytes differ from
    the target by at most the largest row. Only ``sizes``' own narrow columns move; texts don't.

    Nulls in the order come first; rows equal in it come in any order; sizes are at least 1, so
    every row has a shard. A row larger than a target leaves some shards empty. An empty table
    gives an empty result. Names starting with ``_`` are reserved.
    """
    before = running_sums(sizes.withColumn("_one", F.lit(1).cast("long")), order, {"_bytes_before": size, "_rows_before": "_one"})
    total = sizes.agg(F.sum(size)).first()[0] or 1
    middle = (2 * F.col("_bytes_before") + F.col(size)).cast("decimal(28, 0)") * n_shards
    cut = before.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle / (2 * total)).cast("int")))
    firsts = cut.groupBy("shard").agg(F.min("_rows_before").alias("_first"))  # n_shards rows
    return cut.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_rows_before") - F.col("_first")).drop("_one", "_bytes_before", "_rows_before", "_first")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Shards ``documents`` by the bytes of their texts, contiguous by doc_id.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null: this law
    doesn't keep rows in place when shards are added). Null texts count one byte; null doc_ids
    come first; repeated rows each get a slot of their own; further columns are ignored.
    """
    sizes = docs.select("doc_id", stored_size().alias("size"), text_crc32().alias("text_crc32"))
    done = contiguous_shards(sizes, n_shards, ["doc_id", "text_crc32", "size"])
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
