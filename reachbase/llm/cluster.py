"""What the operators ask of the session: the shared checkpoint folder, small batches and partition counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reachbase.operators.graph import cut_lineage, shared_folder, shuffles_dropped


def durable(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, so that lost executors don't lose them."""
    return cut_lineage(df)


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder that folder() has named, through the file system that it is in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet below the shared checkpoint folder and read again."""
    path = folder(df.sparkSession, "stored")
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Bytes of texts that go to a Python worker at once.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def by_small_batches(docs: DataFrame) -> DataFrame:
    """docs, in a session whose Arrow batches hold about BATCH_BYTES, unless its user has set their size.

    Ten thousand whole texts, Spark's default batch, take much of an executor's memory twice.
    """
    conf = docs.sparkSession.conf
    if conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return docs


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
