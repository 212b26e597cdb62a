"""Snapshot folders as streams: a file's name is its event time, files are only added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reachbase.functions.exprs import period_of
from reachbase.operators.speed import fleet_factors, segment_medians

SPEED_SCHEMA = "id string, s array<array<int>>"
FLEET_SCHEMA = "id string, no string, type string, n int"


def named_time(df: DataFrame) -> DataFrame:
    """Adds snapshot and at_minute from file names yyyyMMdd-HHmm; files with other names go."""
    name = F.col("_metadata.file_name")
    part = lambda i: F.regexp_extract(name, r"(\d{8})-(\d{2})(\d{2})", i)
    timed = df.select("*", part(1).alias("_d"), part(2).alias("_h"), part(3).alias("_m")).where("_d <> ''")
    return timed.select(*df.columns, F.to_date("_d", "yyyyMMdd").alias("snapshot"), (F.col("_h").cast("int") * 60 + F.col("_m").cast("int")).alias("at_minute"))


def speed_rows(df: DataFrame) -> DataFrame:
    """route, ord, meters, kmh, snapshot, at_minute from the nested triples."""
    each = df.select("id", "snapshot", "at_minute", F.explode("s").alias("x"))
    return each.select(F.col("id").alias("route"), F.col("x")[0].alias("ord"), F.col("x")[1].alias("meters"), F.col("x")[2].alias("kmh"), "snapshot", "at_minute")


def stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return named_time(spark.readStream.schema(schema).json(path))


def keep_history(rows: DataFrame, table: str, checkpoint: str, refresh: Callable[[DataFrame], DataFrame], out: str) -> StreamingQuery:
    """Takes all new files, adds their rows to the Parquet history, and writes ``refresh`` of the whole history.

    Middles over all history can't be kept incrementally; what each run saves is reading old
    files. A batch has its own folder, so one that is run again after a failure replaces itself;
    a run without new files changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        if not df.limit(1).count():
            return
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)
        refresh(df.sparkSession.read.parquet(table)).write.mode("overwrite").parquet(out)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flushed_cache(replies: DataFrame, cache: str, keys: list[str], newest: str, checkpoint: str, at_least_once: Callable[[int], None] | None = None) -> StreamingQuery:
    """Takes landed replies in bounded micro-batches and flushes each into a keyed cache before the next one begins.

    replies: a file stream with ``maxFilesPerTrigger``, so a batch is what may be lost, and redone,
    when the work stops. A batch's replies are one version of the cache, in a folder of its
    own that a repeated batch replaces; the stream's own checkpoint, written after the batch, is
    the cursor. So a run that stops between two batches, or inside one, goes on where it was,
    without a lost or doubled key. at_least_once is called with the batch's number after its flush.
    """

    def batch(df: DataFrame, number: int) -> None:
        latest_per_key(df, keys, newest).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(cache)
        if at_least_once:
            at_least_once(number)

    return replies.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_per_key(rows: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row for each key: that with the greatest ``newest``, and of equal ones the greatest by its other columns."""
    others = [c for c in rows.columns if c not in (*keys, newest)]
    return rows.groupBy(*keys).agg(F.max(F.struct(newest, *others)).alias("_l")).select(*keys, "_l.*")


def read_cache(spark: SparkSession, cache: str, keys: list[str], newest: str) -> DataFrame:
    """The cache as it stands after its last flush: of each key the newest reply, later batches first among equal times."""
    rows = spark.read.parquet(cache)
    return latest_per_key(rows.withColumn("_at", F.struct(newest, "batch")), keys, "_at").drop("_at", "batch")


def speed_refresh(history: DataFrame) -> DataFrame:
    return segment_medians(history)


def fleet_refresh(history: DataFrame) -> DataFrame:
    return fleet_factors(history)


def period_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """An extension: events (ts, event_type) by service period of each day, late ones up to the watermark."""
    timed = events.withWatermark("ts", late).withColumn("period", period_of(F.hour("ts") * 60 + F.minute("ts")))
    return timed.groupBy(F.window("ts", "1 day").alias("day"), "event_type", "period").agg(F.count("*").alias("n"))
