"""Walking: which ways can be walked, stops around a point, heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.functions.exprs import WALK_M_PER_S, haversine
from reachbase.operators.graph import connected, costs_within
from reachbase.operators.spatial import nearest, within

#: Metres that access walks, metres to the nearest walkable node, and nodes that its component must have.
REACH_M, SNAP_M, MIN_COMPONENT = 990, 300, 200
#: Steps count for more than their length.
STEPS_FACTOR = 2.2
# Ways that people walk on.
WALKED = """footway path pedestrian steps living_street track residential service unclassified road
tertiary tertiary_link secondary secondary_link primary primary_link cycleway""".split()


def is_walkable(tags: Column) -> Column:
    """Whether a way's tags let people walk on it; what they don't say is allowed."""
    closed = (tags["foot"] == "no") | tags["access"].isin("no", "private")
    return F.coalesce(tags["highway"].isin(*WALKED), F.lit(False)) & ~F.coalesce(closed, F.lit(False))


def walkable_filter() -> str:
    """is_walkable() as the filter of a map server's query, so that less is landed; the predicate still decides."""
    return f'["highway"~"^({"|".join(WALKED)})$"]["foot"!="no"]["access"!~"^(no|private)$"]'


def walk_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, meters, both ways, of walkable ways (id, tags, refs) over nodes (id, lat, lon); only nodes on such ways are read on."""
    steps = ways.where(is_walkable(F.col("tags"))).select("id", F.posexplode("refs").alias("pos", "node"))
    pairs = ways.where(is_walkable(F.col("tags"))).select((F.col("tags")["highway"] == "steps").alias("steps"), F.explode(F.arrays_zip(F.expr("slice(refs, 1, size(refs) - 1)").alias("a"), F.expr("slice(refs, 2, size(refs) - 1)").alias("b"))).alias("p")).select("steps", "p.a", "p.b")
    used = nodes.join(steps.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    a, b = (used.select(F.col("id").alias(s), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon")) for s in "ab")
    joined = pairs.where("a <> b").join(a, "a").join(b, "b")
    far = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) * F.when(F.col("steps"), STEPS_FACTOR).otherwise(1.0)
    meters = F.floor(far * 10).cast("long") / 10
    one = joined.select(F.col("a").alias("src"), F.col("b").alias("dst"), meters.alias("meters"))
    return one.union(one.select("dst", "src", "meters")).groupBy("src", "dst").agg(F.min("meters").alias("meters"))


def walkable_nodes(nodes: DataFrame, edges: DataFrame, least: int = MIN_COMPONENT) -> DataFrame:
    """nodes (id, lat, lon) in components of at least ``least`` nodes."""
    found = connected(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    large = found.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("component")
    return nodes.join(found.join(large, "component").select(F.col("node").alias("id")), "id", "left_semi")


def access_stops(points: DataFrame, stops: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, stop_id, sec: stops (stop_id, lat, lon) that points (a, a_lat, a_lon) can walk to.

    Point and stop each snap to the nearest of nodes; the way between them and both snaps
    together take up to REACH_M. A point without such a way goes straight, at 1.4 times the distance.
    """
    b = nodes.select(F.col("id").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    snapped = nearest(points, b, SNAP_M).select("a", F.col("b").alias("node"), F.col("meters").alias("snap"))
    as_points = stops.select(F.col("stop_id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    stop_at = nearest(as_points, b, SNAP_M).select(F.col("a").alias("stop_id"), F.col("b").alias("node"), F.col("meters").alias("stop_snap"))
    walked = costs_within(snapped.select(F.col("a").alias("start"), "node", F.col("snap").alias("cost")), edges.select("src", "dst", F.col("meters").alias("cost")), REACH_M)
    by_way = walked.join(stop_at, "node").withColumn("_m", F.col("cost") + F.col("stop_snap")).where(F.col("_m") <= REACH_M).groupBy(F.col("start").alias("a"), "stop_id").agg(F.min("_m").alias("_m"))
    way = by_way.select("a", "stop_id", F.greatest(F.lit(10), F.floor(F.col("_m") / WALK_M_PER_S).cast("int")).alias("sec"))
    without = points.join(way.select("a").distinct(), "a", "left_anti")
    straight = within(without, stops.select(F.col("stop_id").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")), REACH_M / 1.4)
    return way.unionByName(straight.select("a", F.col("b").alias("stop_id"), F.greatest(F.lit(10), F.floor(F.col("meters") * 1.4 / WALK_M_PER_S).cast("int")).alias("sec")))


def ground_heights(points: DataFrame, heights: DataFrame, step: float) -> DataFrame:
    """a, metres: the least height of the 3 x 3 probes around each point; heights (row, col, metres) lie on a grid of step degrees."""
    row, col = F.floor(F.col("a_lat") / step + 0.5), F.floor(F.col("a_lon") / step + 0.5)
    around = F.explode(F.array(*[F.struct((row + i).alias("row"), (col + j).alias("col")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_p")
    probes = points.select("a", around).select("a", "_p.row", "_p.col")
    return probes.join(heights, ["row", "col"]).groupBy("a").agg(F.min("metres").alias("metres"))


def rephased(windows: DataFrame, salt: int) -> DataFrame:
    """Raw windows (trip_id, first_start, last_start, headway, phase) baked with another phase, for diagnosis; in 64 bits throughout."""
    from reachbase.functions.exprs import bake

    phase = (F.col("phase").cast("long") * 31 + salt).bitwiseAND(F.lit(0x3FFFFFF))
    first, last = bake(F.col("first_start"), F.col("last_start"), F.col("headway"), phase)
    return windows.select("trip_id", first.alias("first_start"), last.alias("last_start"), "headway")
