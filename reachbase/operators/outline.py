"""Outlines of bands of cells: the edges between bands, stitched into rings by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachbase.operators.graph import cut_lineage

#: Steps of an edge by its direction: east, north, west, south. Edges keep their cell on the left.
_STEP = ((1, 0), (0, 1), (-1, 0), (0, -1))


def _stepped(axis: int):
    d = F.col("d")
    out = F.lit(0)
    for i, step in enumerate(_STEP):
        out = F.when(d == i, step[axis]).otherwise(out)
    return out


def boundary(cells: DataFrame) -> DataFrame:
    """band, x, y, d: the directed edges around the cells (row, col, band) of each band; edges between cells of one band go.

    Cell (row, col) covers col to col + 1 and row to row + 1.
    """
    r, c = F.col("row").cast("long"), F.col("col").cast("long")
    sides = ((c, r, c, r, True, 0), (c + 1, r, c + 1, r, False, 1), (c + 1, r + 1, c, r + 1, True, 2), (c, r + 1, c, r, False, 3))
    edges = F.array(*[F.struct(x.alias("x"), y.alias("y"), kx.alias("kx"), ky.alias("ky"), F.lit(flat).alias("flat"), F.lit(d).alias("d")) for x, y, kx, ky, flat, d in sides])
    each = cells.select("band", F.explode(edges).alias("e")).select("band", "e.*")
    single = each.groupBy("band", "kx", "ky", "flat").agg(F.count("*").alias("_n"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("d").alias("d")).where("_n = 1")
    return single.select("band", "x", "y", "d")


def successors(edges: DataFrame) -> DataFrame:
    """edges with ``next``, the edge (x, y, d) that goes on from its end: to the left, else straight, else to the right.

    So cells of a band that only touch at a corner have rings of their own.
    """
    ends = edges.withColumn("_ex", F.col("x") + _stepped(0)).withColumn("_ey", F.col("y") + _stepped(1))
    onward = edges.select("band", F.col("x").alias("_ex"), F.col("y").alias("_ey"), F.col("d").alias("_d"))
    turn = F.pmod(F.col("d") + 1 - F.col("_d"), F.lit(4))  # 0: left, 1: straight, 2: right
    best = F.min(F.struct(turn.alias("turn"), F.col("_ex").alias("x"), F.col("_ey").alias("y"), F.col("_d").alias("d"))).alias("_b")
    found = ends.join(onward, ["band", "_ex", "_ey"]).groupBy("band", "x", "y", "d").agg(best)
    return found.select("band", F.struct("x", "y", "d").alias("edge"), F.struct("_b.x", "_b.y", "_b.d").alias("next"))


def rings(cells: DataFrame) -> DataFrame:
    """band, ring, seq, x, y: the corners of each band's rings, in order; outer rings turn left, those around holes right.

    ring is the ring's smallest edge, from whose start seq counts. Both are found by doubling:
    each edge knows the smallest of the next 1, 2, 4 ... edges, then how many are left to the ring's
    end, so a ring of n edges takes some 2 log n joins and no task walks one.
    """
    edges = cut_lineage(successors(boundary(cells)))
    known = cut_lineage(edges.select("band", "edge", F.least("edge", "next").alias("low"), F.col("next").alias("far")))
    while True:
        ahead = known.select("band", F.col("edge").alias("far"), F.col("low").alias("_low"), F.col("far").alias("_far"))
        known = cut_lineage(known.join(ahead, ["band", "far"]).select("band", "edge", F.least("low", "_low").alias("low"), F.col("_far").alias("far")))
        after = known.select("band", F.col("edge").alias("next"), F.col("low").alias("_low"))
        if not edges.join(known.select("band", "edge", "low"), ["band", "edge"]).join(after, ["band", "next"]).where("low <> _low").limit(1).count():
            break
    joined = edges.join(known.select("band", "edge", F.col("low").alias("ring")), ["band", "edge"])
    # The edge before the ring's first one is its end.
    left = cut_lineage(joined.select("band", "ring", "edge", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("n")))
    while left.where("next IS NOT NULL").limit(1).count():
        ahead = left.select("band", F.col("edge").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"))
        left = cut_lineage(left.join(ahead, ["band", "next"], "left").select("band", "ring", "edge", F.col("_next").alias("next"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")))
    sizes = left.where(F.col("edge") == F.col("ring")).select("band", "ring", F.col("n").alias("_size"))
    numbered = left.join(sizes, ["band", "ring"]).withColumn("_i", F.col("_size") - F.col("n"))
    before = numbered.select("band", "ring", F.pmod(F.col("_i") + 1, F.col("_size")).alias("_i"), F.col("edge.d").alias("_d"))
    corners = cut_lineage(numbered.join(before, ["band", "ring", "_i"]).where(F.col("edge.d") != F.col("_d")).select("band", "ring", "_i", "edge.x", "edge.y"))
    seq = F.row_number().over(Window.partitionBy("band", "ring").orderBy("_i")) - 1
    return corners.select("band", F.concat_ws(",", *[F.col(f"ring.{c}").cast("string") for c in ("x", "y", "d")]).alias("ring"), seq.cast("int").alias("seq"), "x", "y")


def ring_areas(corners: DataFrame) -> DataFrame:
    """band, ring, corners and area of rings (band, ring, seq, x, y); holes have negative areas."""
    along = Window.partitionBy("band", "ring").orderBy("seq")
    first = Window.partitionBy("band", "ring").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = {c: F.coalesce(F.lead(c).over(along), F.first(c).over(first)) for c in ("x", "y")}
    cross = F.col("x") * F.col("_y") - F.col("_x") * F.col("y")
    return corners.withColumn("_x", to["x"]).withColumn("_y", to["y"]).groupBy("band", "ring").agg(F.count("*").alias("corners"), (F.sum(cross) / 2).cast("long").alias("area"))
