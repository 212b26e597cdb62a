"""Network build: stations, platforms, tracks and transfers from lines' patterns; runs between ends; service of a line."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions.exprs import haversine, transfer_seconds
from reachbase.operators.spatial import clusters_by_name

#: Seconds that changing between platforms of a station takes besides the way.
CHANGE_OVERHEAD = 120


def stations_of(nodes: DataFrame, radius: float) -> DataFrame:
    """id, station of nodes (id, name, lat, lon): nodes of one name that stand together are one station, named by its smallest node."""
    return clusters_by_name(nodes, radius).select("id", F.col("cluster").alias("station"))


def platforms(stops: DataFrame, stations: DataFrame, nodes: DataFrame) -> DataFrame:
    """station, line, lat, lon: the lines' platforms at the middle of their nodes; stops: line, pattern_id, express, pos, node."""
    at = stops.select("line", F.col("node").alias("id")).distinct().join(stations, "id").join(nodes.select("id", "lat", "lon"), "id")
    return at.groupBy("station", "line").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def track_edges(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """line, a, b (a < b): stations that follow each other in a pattern that isn't express, each pair once."""
    along = Window.partitionBy("pattern_id").orderBy("pos")
    placed = stops.where("NOT express").join(stations.withColumnRenamed("id", "node"), "node")
    hops = placed.select("line", "station", F.lead("station").over(along).alias("_to")).where("_to IS NOT NULL AND _to <> station")
    return hops.select("line", F.least("station", "_to").alias("a"), F.greatest("station", "_to").alias("b")).distinct()


def station_transfers(platform_rows: DataFrame, overhead: int = CHANGE_OVERHEAD) -> DataFrame:
    """station, from_line, to_line, sec: all changes between the platforms of a station, a few lines each."""
    a, b = platform_rows.toDF("station", "from_line", "_la", "_lo"), platform_rows.toDF("station", "to_line", "_lb", "_mb")
    far = haversine(F.col("_la"), F.col("_lo"), F.col("_lb"), F.col("_mb"))
    return a.join(b, "station").where("from_line <> to_line").select("station", "from_line", "to_line", transfer_seconds(far, overhead).alias("sec"))


def terminal_runs(edges: DataFrame) -> DataFrame:
    """line, run_id, pos, node: the way between each two ends of a line (edges line, a, b), the shorter id first.

    Ends are nodes with one neighbour. The way is the one with the fewest stations, ties to the
    smaller nodes. A line with fewer than three ends has none here: its chains are its runs. A
    group is one line's edges, some hundreds, and its few ends.
    """

    def trace(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(rows.a, rows.b, strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        ends = sorted(n for n in near if len(near[n]) == 1)
        out = []
        for i, start in enumerate(ends if len(ends) > 2 else []):
            before, layer = {start: None}, [start]
            while layer:
                found: list = []
                for at in layer:
                    for to in sorted(near[at]):
                        if to not in before:
                            before[to] = at
                            found.append(to)
                layer = found
            for goal in ends[i + 1 :]:
                at, path = goal, []
                while goal in before and at is not None:
                    path.append(at)
                    at = before[at]
                out += [(rows.line.iloc[0], f"{start}-{goal}", k, n) for k, n in enumerate(reversed(path))]
        return pd.DataFrame(out, columns=["line", "run_id", "pos", "node"])

    kind = dict(edges.dtypes)
    return edges.select("line", "a", "b").groupBy("line").applyInPandas(trace, f"line {kind['line']}, run_id string, pos int, node {kind['a']}")


def service_trips(services: DataFrame, periods: DataFrame) -> DataFrame:
    """pattern_id, start, end, headway: services (pattern_id, factor, scale) over periods (start, end, headway), a minute at least."""
    each = services.join(F.broadcast(periods), F.lit(True))  # half a dozen periods
    return each.select("pattern_id", "start", "end", F.greatest(F.lit(60), F.floor(F.col("headway") * F.col("factor") * F.col("scale"))).cast("int").alias("headway"))


def covered_names(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, n: how many nodes (name) each expected name has; 0 where the network misses it."""
    counts = nodes.groupBy("name").agg(F.count("*").alias("_n"))
    return names.join(counts, "name", "left").select("name", F.coalesce("_n", F.lit(0)).alias("n"))


# Boxes (south, west, north, east) that data must lie in.
BOXES = {"country": (33.0, 124.0, 39.0, 132.0), "city": (37.4, 126.7, 37.75, 127.25)}


def in_boxes(points: DataFrame, boxes: dict[str, tuple[float, float, float, float]] = BOXES) -> DataFrame:
    """points (lat, lon) with a column for each box: whether they lie in it; null without coordinates."""
    return points.select("*", *[(F.col("lat").between(s, n) & F.col("lon").between(w, e)).alias(f"in_{name}") for name, (s, w, n, e) in boxes.items()])


def allowed_lines(routes: DataFrame, names: DataFrame) -> DataFrame:
    """Routes (ref) that a list (ref, line) allows, with the line's name; the list is a dimension of some dozens."""
    return routes.join(F.broadcast(names), "ref")


def platform_pairs(platform_rows: DataFrame) -> DataFrame:
    """station, a, b: all ordered pairs of a station's lines, a few each."""
    a, b = platform_rows.select("station", F.col("line").alias("a")), platform_rows.select("station", F.col("line").alias("b"))
    return a.join(b, "station").where("a <> b")


def chain_sizes(stops: DataFrame) -> DataFrame:
    """line, chains, longest, least of patterns (line, pattern_id, pos)."""
    sizes = stops.groupBy("line", "pattern_id").agg(F.count("*").alias("_n"))
    return sizes.groupBy("line").agg(F.count("*").alias("chains"), F.max("_n").alias("longest"), F.min("_n").alias("least"))


def sorted_departures(connections: DataFrame) -> DataFrame:
    """origin, dest, departures: a day's departures (origin, dest, dep, arr) between two platforms by time, the soonest arrival of equal ones."""
    each = connections.groupBy("origin", "dest", "dep").agg(F.min("arr").alias("arr"))
    return each.groupBy("origin", "dest").agg(F.array_sort(F.collect_list(F.struct("dep", "arr"))).alias("departures"))


def detours(costs: DataFrame, points: DataFrame) -> DataFrame:
    """start, node, ratio: how much longer the ways of costs (start, node, cost in metres) are than the straight lines between points (id, lat, lon).

    Points may stand for several in one place: a way from one to itself has cost 0 and ratio 0.
    """
    a, b = points.toDF("start", "_la", "_lo"), points.toDF("node", "_lb", "_mb")
    straight = haversine(F.col("_la"), F.col("_lo"), F.col("_lb"), F.col("_mb"))
    return costs.join(a, "start").join(b, "node").select("start", "node", F.round(F.col("cost") / F.greatest(F.lit(1.0), straight), 4).alias("ratio"))


def same_names(nodes: DataFrame) -> DataFrame:
    """name, n, meters: names that several nodes (id, name, lat, lon) have, and how far the farthest stands from the one with the smallest id.

    Each node meets its name's first one alone, so a frequent name makes no pairs.
    """
    first = nodes.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("id", "lat", "lon")).alias("_f")).where("n > 1")
    far = haversine(F.col("_f.lat"), F.col("_f.lon"), F.col("lat"), F.col("lon"))
    return nodes.join(first, "name").groupBy("name", "n").agg(F.round(F.max(far), 3).alias("meters"))
