"""Graphs as edge tables: components, bounded shortest paths, path unwinding."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset and the session runs on one machine, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile needs its shuffle files no longer; by default they stay until the driver collects garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that loops don't grow the plan and lost executors don't lose rounds."""
    shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.checkpoint()


def packed(df: DataFrame) -> DataFrame:
    """As cut_lineage, but as Parquet: long tables of numbers take a fraction of the disk."""
    path = f"{shared_folder(df.sparkSession)}/packed-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that edges (a, b) reach. Labels spread and jump until none changes.

    Joins carry a merge hint, as estimates of packed files would send all labels through the driver.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("_near"))
        stepped = labels.join(seen.hint("merge"), F.col("node") == F.col("a")).select("node", F.col("component").alias("_was"), F.least("component", "_near").alias("_now"))
        jump = labels.select(F.col("node").alias("_via"), F.col("component").alias("_end"))
        merged = stepped.join(jump.hint("merge"), F.col("_now") == F.col("_via"), "left").select("node", "_was", F.least("_now", "_end").alias("component"))
        merged = cut_lineage(merged)
        labels = merged.select("node", "component")
        if not merged.where("component < _was").limit(1).count():
            return labels


def component_sizes(edges: DataFrame) -> DataFrame:
    """node, component and the component's number of nodes."""
    found = connected(edges)
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").select("node", "component", "size")


def undominated(edges: DataFrame, near: int) -> DataFrame:
    """Edges (src, dst, cost in whole numbers) without those that a step of at most ``near`` and another edge replace at no more cost.

    Both have to cost less than the edge itself, so by induction over costs every least cost stays.
    """
    first = edges.where((F.col("cost") <= near) & (F.col("cost") > 0)).select("src", F.col("dst").alias("_via"), F.col("cost").alias("_first"))
    rest = edges.select(F.col("src").alias("_via"), "dst", F.col("cost").alias("_rest"))
    ways = edges.join(first, "src").where("_first < cost").join(rest, ["_via", "dst"]).where("_rest < cost AND _first + _rest <= cost")
    return edges.join(ways.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("src", "dst", "cost")


def costs_within(starts: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """start, node, cost: the least cost from each start (start, node, cost) over edges (src, dst, cost) up to limit.

    Only nodes whose cost fell spread further, so each round joins the frontier alone; what it
    offers is grouped together with the costs known so far.
    """
    best = cut_lineage(starts.groupBy("start", "node").agg(F.min("cost").alias("cost")))
    frontier = best
    while frontier.limit(1).count():
        step = frontier.join(edges.withColumnRenamed("cost", "_step"), F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), (F.col("cost") + F.col("_step")).alias("cost"))
        offer = step.where(F.col("cost") <= limit).withColumn("_was", F.lit(None).cast(dict(best.dtypes)["cost"]))
        both = best.withColumn("_was", F.col("cost")).unionByName(offer).groupBy("start", "node").agg(F.min("cost").alias("cost"), F.min("_was").alias("_was"))
        both = cut_lineage(both.select("start", "node", "cost", (F.col("_was").isNull() | (F.col("cost") < F.col("_was"))).alias("_new")))
        best, frontier = both.select("start", "node", "cost"), both.where("_new").select("start", "node", "cost")
    return best
