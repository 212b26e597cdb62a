"""Rail routes of an extract: relations and their stop nodes, as the lines' patterns and the network built from them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachbase.functions.exprs import strip_parenthetical
from reachbase.operators import build
from reachbase.operators.graph import cut_lineage
from reachbase.operators.network import is_express
from reachbase.operators.ordered import renumbered

# Kinds of routes that run on rails, and metres within which nodes of one name are one station.
ROUTE_KINDS = ("subway", "train", "light_rail", "monorail")
SAME_STATION_M = 1500.0


class RailNetwork(NamedTuple):
    """stations: id, station. platforms: station, line, lat, lon. patterns: line, express, pattern_id, pos, node (a platform's
    station). tracks: line, a, b. transfers: station, from_line, to_line, sec."""

    stations: DataFrame
    platforms: DataFrame
    patterns: DataFrame
    tracks: DataFrame
    transfers: DataFrame


def rail_routes(relations: DataFrame) -> DataFrame:
    """pattern_id, name, ref, pos, node of the routes on rails: a relation's node members with a role of a stop, two at least, in order.

    relations: id, tags and members, as the source ``osm_extract`` gives them. Platforms are other members.
    """
    kind = F.col("tags")["route"]
    routes = relations.where((F.col("tags")["type"] == "route") & kind.isin(*ROUTE_KINDS))
    stops = F.filter("members", lambda m: (m["kind"] == "node") & F.startswith(m["role"], F.lit("stop")))
    each = routes.select(F.col("id").alias("pattern_id"), F.coalesce(F.col("tags")["name"], F.lit("")).alias("name"), F.coalesce(F.col("tags")["ref"], F.lit("")).alias("ref"), stops.alias("_s")).where(F.size("_s") > 1)
    return each.select("pattern_id", "name", "ref", F.posexplode("_s").alias("pos", "_m")).select("pattern_id", "name", "ref", "pos", F.col("_m.id").alias("node"))


def named_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, name, lat, lon of the wanted nodes (node) that have a name, in Korean if there is one, without notes in brackets."""
    name = strip_parenthetical(F.coalesce(F.col("tags")["name:ko"], F.col("tags")["name"], F.lit("")))
    own = nodes.join(wanted.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    return own.select("id", name.alias("name"), "lat", "lon").where("name <> ''")


def rail_network(spark: SparkSession, path: str, lines: DataFrame, box: tuple[float, float, float, float], overhead: int = 90) -> RailNetwork:
    """The network of the rail routes of an extract that lines (ref, line) name and that stop in the box (south, west, north, east).

    Relations are read without nodes first; of the nodes, the far greater part, only the stops
    of the routes in use go on. Nodes of one name that stand together are one station, a platform
    is a station of a line, and what a route visits twice in a row counts once. Express routes lay no tracks.
    """
    reader = spark.read.format("osm_extract")
    routes = cut_lineage(rail_routes(reader.option("kinds", "relation").load(path)).join(lines, "ref"))
    found = cut_lineage(named_nodes(reader.option("kinds", "node").load(path), routes))
    south, west, north, east = box
    inside = found.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).select(F.col("id").alias("node"))
    used = routes.join(routes.join(inside, "node", "left_semi").select("pattern_id").distinct(), "pattern_id", "left_semi")
    stations = cut_lineage(build.stations_of(found.join(used.select(F.col("node").alias("id")), "id", "left_semi"), SAME_STATION_M))
    placed = used.withColumn("express", is_express(F.col("name"))).join(stations.withColumnRenamed("id", "node"), "node")
    stops = cut_lineage(placed.select("line", "express", "pattern_id", "pos", "node", "station"))
    patterns = cut_lineage(renumbered(stops.select("line", "express", "pattern_id", "pos", F.col("station").alias("node")), "pattern_id", "pos", "node"))
    platforms = cut_lineage(build.platforms(stops, stations, found))
    own = patterns.select(F.col("node").alias("id"), F.col("node").alias("station")).distinct()
    tracks = build.track_edges(patterns, own)
    return RailNetwork(stations, platforms, patterns, tracks, build.station_transfers(platforms, overhead))
