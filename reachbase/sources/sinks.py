"""Sinks: landed rows, reports, drawings' texts, enriched tables, and when to write at all."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachbase.sources.files import content_hash, read_or_empty


def append_json(df: DataFrame, path: str) -> None:
    """Adds the rows to a folder of JSON lines. Nothing to add writes nothing."""
    if df.limit(1).count():
        df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_metrics(df: DataFrame, path: str, at: str) -> None:
    """Adds a run's figures with its time, and leaves earlier runs as they are."""
    df.withColumn("run_at", F.lit(at)).write.mode("append").parquet(path)


def recent_metrics(spark: SparkSession, path: str, since: str) -> DataFrame:
    """The figures of runs at ``since`` or later: how long logs are kept is a matter of reading."""
    return spark.read.parquet(path).where(F.col("run_at") >= since)


def advance_cursor(received: DataFrame, cursors: DataFrame, key: str, at: str) -> DataFrame:
    """key, at: the cursor of each feed after what was received (key, at); what received nothing stays where it was."""
    latest = received.groupBy(key).agg(F.max(at).alias("_at"))
    return cursors.join(latest, key, "full").select(key, F.greatest(at, "_at").alias(at))


def when_changed(spark: SparkSession, df: DataFrame, state: str, build: Callable[[DataFrame], None]) -> bool:
    """Runs build unless the table's content is what it was at the last run; the state is one small JSON row, written last."""
    now = content_hash(df)
    before = read_or_empty(spark, state, "hash string").first()
    if before is not None and before["hash"] == now:
        return False
    build(df)
    spark.createDataFrame([(now,)], "hash string").coalesce(1).write.mode("overwrite").json(state)
    return True


def enriched(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """rows with more's columns, new values before old ones; for a new version of the table, never in its place."""
    own = [c for c in more.columns if c != key]
    joined = rows.join(more.select(key, *[F.col(c).alias(f"_{c}") for c in own]), key, "left")
    values = [F.coalesce(f"_{c}", c).alias(c) if c in rows.columns else F.col(f"_{c}").alias(c) for c in own]
    return joined.select(*[c for c in rows.columns if c not in own], *values)


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """place, value: GML of nodes (id, label, line_no, station_name, lat, lon) and edges (source, target, line_no), in the order of place."""
    text = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), '"', "&#34;")
    node = F.format_string('  node [\n    id %s\n    label "%s"\n    line_no "%s"\n    station_name "%s"\n    pos %.6f\n    pos %.6f\n  ]', F.col("id").cast("string"), text("label"), text("line_no"), text("station_name"), "lon", "lat")
    edge = F.format_string('  edge [\n    source %s\n    target %s\n    line_no "%s"\n  ]', F.col("source").cast("string"), F.col("target").cast("string"), text("line_no"))
    spark = nodes.sparkSession
    frame = spark.createDataFrame([("0", "graph ["), ("3", "]")], "place string, value string")
    return frame.unionByName(nodes.select(F.lit("1").alias("place"), node.alias("value"))).unionByName(edges.select(F.lit("2").alias("place"), edge.alias("value")))


def publish_findings(rows: dict[str, int], axis: DataFrame, sizes: DataFrame, manifest_at: float, files_at: float) -> list[str]:
    """Why a bundle must not be published: counts that are 0, an axis (idx) with gaps, matrices (bytes) of several sizes, a manifest that isn't the newest."""
    out = [f"{name} is empty" for name, n in rows.items() if n <= 0]
    got = axis.agg(F.count("*").alias("n"), F.count_distinct("idx").alias("d"), F.min("idx").alias("low"), F.max("idx").alias("high")).first()
    if got["n"] and (got["low"] != 0 or got["high"] != got["n"] - 1 or got["d"] != got["n"]):
        out.append("the axis has gaps")
    if sizes.select("bytes").distinct().count() > 1:
        out.append("matrices differ in size")
    if manifest_at < files_at:
        out.append("the manifest is older than the matrices")
    return out


# Fixed values of the format: magic and version of a walk graph, big-endian numbers after them.
WALK_MAGIC, WALK_VERSION = b"WALK", 1


def encode_walk_graph(xy: np.ndarray, first: np.ndarray, to: np.ndarray, cost: np.ndarray) -> bytes:
    """Magic, version, numbers of nodes and edges, coordinates, first edges (one more), targets and costs."""
    head = WALK_MAGIC + struct.pack(">iii", WALK_VERSION, len(xy), len(to))
    return head + xy.astype(">f8").tobytes() + b"".join(x.astype(">i4").tobytes() for x in (first, to, cost))


def read_walk_graph(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, cost of walk graph files; a file is read whole in one task, as its format asks."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                if content[:4] != WALK_MAGIC:
                    raise ValueError("not a walk graph")
                version, n, m = struct.unpack(">iii", content[4:16])
                if version != WALK_VERSION:
                    raise ValueError("not a walk graph of this version")
                numbers = np.frombuffer(content, ">i4", offset=16 + 16 * n)
                first, to, cost = numbers[: n + 1], numbers[n + 1 : n + 1 + m], numbers[n + 1 + m :]
                yield pd.DataFrame({"src": np.repeat(np.arange(n), np.diff(first)).astype(np.int64), "dst": to.astype(np.int64), "cost": cost.astype(np.int32)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(edges, "src long, dst long, cost int")
