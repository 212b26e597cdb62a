"""Feeds of routes, stops, fleets and contracts: one shape for all sources, cleaning, and joins to what is known already."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions.exprs import clock_or, coordinate_key, day_fraction_seconds, headway_of, longest_prefix, route_type_name, split_route_name
from reachbase.operators.ranges import dealt

#: Prefixes that a region puts before the numbers of a city's routes.
REGION_PREFIXES = ("GGGB", "GICB")
#: What a slot of departure starts with.
DEPART_WORD = "출발"


def region_routes(routes: DataFrame, details: DataFrame) -> DataFrame:
    """Routes of a region in the common shape: id, no, tail, type, first_at, last_at, headway, city.

    routes: id, city, no, type. details: id, first, last, headway; a route without details has
    the default day and no headway.
    """
    joined = routes.join(details.select("id", "first", "last", "headway"), "id", "left")
    name = split_route_name(F.coalesce("no", F.lit("")))
    return joined.select("id", name["number"].alias("no"), name["tail"].alias("tail"), "type", clock_or("first", "0500").alias("first_at"), clock_or("last", "2300").alias("last_at"), F.col("headway").cast("int").alias("headway"), "city")


def city_routes(routes: DataFrame) -> DataFrame:
    """Routes of a city (id, no, type as a code, first, last, headway) in the common shape; ids get the city's letter."""
    name = split_route_name(F.coalesce("no", F.lit("")))
    return routes.select(F.concat(F.lit("S"), "id").alias("id"), name["number"].alias("no"), name["tail"].alias("tail"), route_type_name("type").alias("type"), clock_or("first", "0500").alias("first_at"), clock_or("last", "2300").alias("last_at"), F.col("headway").cast("int").alias("headway"), F.lit("S").alias("city"))


def handovers(city: DataFrame, region: DataFrame, prefixes: tuple[str, ...] = REGION_PREFIXES) -> DataFrame:
    """id, region_id of city routes (id) that a region has as well, under the first prefix that fits; the others have a null region_id."""
    out = city.select("id")
    for i, prefix in enumerate(prefixes):
        known = region.select(F.col("id").alias(f"_r{i}")).distinct()
        out = out.join(known, F.concat(F.lit(prefix), F.col("id").cast("string")) == F.col(f"_r{i}"), "left")
    return out.select("id", F.coalesce(*[F.col(f"_r{i}") for i in range(len(prefixes))]).alias("region_id"))


def route_stops(stops: DataFrame, table: DataFrame, least: int = 2) -> DataFrame:
    """route_id, ord, stop_id, lat, lon: stops whose place table knows; routes with fewer than ``least`` of them go."""
    placed = stops.join(table.where("lat IS NOT NULL AND lon IS NOT NULL").select("stop_id", "lat", "lon"), "stop_id")
    sizes = placed.groupBy("route_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return placed.join(sizes, "route_id", "left_semi").select("route_id", "ord", "stop_id", "lat", "lon")


def city_fleet(vehicles: DataFrame) -> DataFrame:
    """route_id, n of running vehicles (route_id, running '1'); routes without one go."""
    return vehicles.groupBy("route_id").agg(F.count_if(F.col("running") == "1").alias("n")).where("n > 0")


def region_fleet(replies: DataFrame) -> DataFrame:
    """route_id, n of replies (route_id, body): how often a vehicle's number stands in a body; routes without one go."""
    return replies.groupBy("route_id").agg(F.sum(F.regexp_count("body", F.lit("<vehicleno>"))).cast("long").alias("n")).where("n > 0")


def split_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks, and transfers: edges (source, target, line) without a line."""
    named = F.coalesce("line", F.lit("")) != ""
    return edges.where(named), edges.where(~named)


def clean_feed(stops: DataFrame, stop_times: DataFrame, windows: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stops that aren't stations (location_type 1), windows that run, and times of trips with such a window and two stops at least.

    parts: in how many parts times are dealt by stop, then by trip.
    """
    running = windows.where("last_start > first_start AND headway > 0")
    own = stops.where(F.coalesce("location_type", F.lit(0)) != 1)
    at_own = dealt(stop_times, parts, "stop_id").join(own.select("stop_id"), "stop_id", "left_semi")
    times = dealt(at_own, parts, "trip_id").join(dealt(running.select("trip_id"), parts, "trip_id").distinct(), "trip_id", "left_semi")
    long = times.groupBy("trip_id").agg(F.count("*").alias("_n")).where("_n >= 2")
    return own, times.join(long, "trip_id", "left_semi"), running.join(long, "trip_id", "left_semi")


def spreadsheet_stops(rows: DataFrame, lines: dict[str, str], weekday: str) -> DataFrame:
    """line, train, express, station, arr, dep (seconds) of a spreadsheet's rows (day, line_name, train, kind, station, arr, dep).

    Weekdays on listed lines with a station and one time at least.
    """
    known = rows.where((F.col("day") == weekday) & F.col("line_name").isin(*lines))
    timed = known.select(longest_prefix("line_name", lines).alias("line"), F.trim("train").alias("train"), (F.col("kind") == "급행").alias("express"), F.trim("station").alias("station"), day_fraction_seconds("arr").alias("arr"), day_fraction_seconds("dep").alias("dep"))
    return timed.where("(arr IS NOT NULL OR dep IS NOT NULL) AND station <> ''")


def located(found: DataFrame) -> DataFrame:
    """Geocoded buildings that can be shown: with coordinates, and no single houses."""
    return found.where("lat IS NOT NULL AND lon IS NOT NULL AND coalesce(kind, '') <> 'HOUSE'")


def sound_contracts(contracts: DataFrame) -> DataFrame:
    return contracts.where("coalesce(trim(name), '') <> '' AND coalesce(trim(seq), '') <> ''")


def of_category(places: DataFrame, keyword: str) -> DataFrame:
    """Places whose category ends with the keyword, spaces after it aside."""
    return places.where(F.endswith(F.rtrim("category"), F.lit(keyword)))


def departing(slot: Column) -> Column:
    """Whether a sample's slot is one of departure."""
    return F.startswith(slot, F.lit(DEPART_WORD))


def from_cache(rows: DataFrame, cache: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """rows with the cache's columns and ``cached``: whether there is an entry; the others are asked for anew.

    Of a key's entries the one with the greatest ``newest`` counts, or else the greatest by all its columns.
    """
    others = [c for c in cache.columns if c not in keys]
    order = F.struct(*([newest] if newest else []), *[c for c in others if c != newest], F.lit(True).alias("_hit"))
    one = cache.groupBy(*keys).agg(F.max(order).alias("_e")).select(*keys, *[f"_e.{c}" for c in others], "_e._hit")
    return rows.join(one, keys, "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def unique_places(ods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ods (lat, lon) with the place that each starts from, and the distinct places: what is searched once and joined back."""
    keyed = ods.withColumn("place", coordinate_key("lat", "lon", 6))
    return keyed, keyed.groupBy("place").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.count("*").alias("n"))


def measured_routes(routes: DataFrame, speeds: DataFrame) -> DataFrame:
    """Routes (route) with a speed at least."""
    return routes.join(speeds.where("kmh > 0").select("route").distinct(), "route", "left_semi")


def station_times(labels: DataFrame, platforms: DataFrame) -> DataFrame:
    """query, station, t: the least time of a station's platforms (node, station)."""
    return labels.join(platforms, "node").groupBy("query", "station").agg(F.min("t").alias("t"))


def centroids(nodes: DataFrame, key: str) -> DataFrame:
    """The mean place of each cluster's nodes, and how many it has."""
    return nodes.groupBy(key).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))


def both_directions(stops: DataFrame) -> DataFrame:
    """Each chain (chain, pos, stop_id) forwards (dir 0) and backwards (dir 1), pos from 1."""
    last = F.max("pos").over(Window.partitionBy("chain"))
    forth = stops.select("chain", F.lit(0).alias("dir"), "pos", "stop_id")
    return forth.unionByName(stops.select("chain", F.lit(1).alias("dir"), (last + 1 - F.col("pos")).alias("pos"), "stop_id"))


def two_laps(stops: DataFrame, found: DataFrame) -> DataFrame:
    """trip_id, pos, stop_id of the round trips of found (trip_id, lap_from, lap_to): the circle once more behind itself.

    The stop where the circle closes stands once between the laps.
    """
    inside = stops.join(found, "trip_id").where("pos BETWEEN lap_from AND lap_to")
    size = F.col("lap_to") - F.col("lap_from")
    lap = F.explode(F.when(F.col("pos") == F.col("lap_from"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("_lap")
    return inside.select("trip_id", "stop_id", (F.col("pos") - F.col("lap_from") + 1).alias("_at"), size.alias("_size"), lap).select("trip_id", (F.col("_at") + F.col("_lap") * F.col("_size")).alias("pos"), "stop_id")


# What village buses are called, what their ids start with, and the box of a station's place.
VILLAGE_TYPE, VILLAGE_PREFIX = "마을버스", "GGB"
VILLAGE_BOX = (32.0, 124.0, 40.0, 132.0)


def four_digits(text: Column) -> Column:
    """The digits of a clock's text where there are four, else null: 06:00 is 0600."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) == 4, digits)


def village_routes(routes: DataFrame, stations: DataFrame, sequence: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Village buses of a workbook in the common shape, and their stops.

    routes: row (its place in the sheet), id, no, gov, start, goal, up_first, up_last, down_first,
    down_last, week, weekend, all texts as cells have them; of rows with one id the first counts.
    stations: row, id, name, lat, lon as texts; the last row of an id counts, and those without a
    place in VILLAGE_BOX are unknown. sequence: route, ord (text), stop. known: ids that another
    feed has already. Rows without ids or numbers, as headers are, go; so do routes with fewer
    than two known stops.

    Returns id, no, type, city, from_name, to_name, first_at, last_at, headway, weekend_headway;
    and route_id, ord, stop_id, name, lat, lon.
    """
    number = lambda c, kind: F.trim(F.col(c)).try_cast(kind)
    south, west, north, east = VILLAGE_BOX
    filled = F.coalesce("id", F.lit("")) != ""
    placed = stations.where(filled).withColumn("_lat", number("lat", "double")).withColumn("_lon", number("lon", "double"))
    inside = placed.where((F.col("_lat") > south) & (F.col("_lat") < north) & (F.col("_lon") > west) & (F.col("_lon") < east))
    latest = inside.groupBy("id").agg(F.max(F.struct("row", "name", "_lat", "_lon")).alias("_s"))
    table = latest.select(F.col("id").alias("stop"), F.coalesce(F.nullif(F.col("_s.name"), F.lit("")), "id").alias("name"), F.col("_s._lat").alias("lat"), F.col("_s._lon").alias("lon"))

    first = routes.where(filled).groupBy("id").agg(F.min(F.struct("row", *[c for c in routes.columns if c not in ("row", "id")])).alias("_r")).select("id", "_r.*")
    unknown = first.join(known.select(F.expr(f"substring(id, {len(VILLAGE_PREFIX) + 1})").alias("id")).distinct(), "id", "left_anti")
    own = sequence.withColumn("ord", number("ord", "int")).where(F.col("ord").isNotNull()).select(F.col("route").alias("id"), "ord", "stop")
    stops = own.join(unknown.select("id"), "id", "left_semi").join(table, "stop")
    ends = stops.groupBy("id").agg(F.count("*").alias("_n"), F.min(F.struct("ord", "stop", "name")).alias("_a"), F.max(F.struct("ord", "stop", "name")).alias("_b")).where("_n > 1")

    given = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    prefixed = F.concat(F.lit(VILLAGE_PREFIX), "id")
    week = headway_of("week")
    shaped = unknown.join(ends, "id").select(
        prefixed.alias("id"), given("no", F.col("id")).alias("no"), F.lit(VILLAGE_TYPE).alias("type"), F.col("gov").alias("city"), given("start", F.col("_a.name")).alias("from_name"), given("goal", F.col("_b.name")).alias("to_name"),
        F.coalesce(four_digits(F.col("up_first")), four_digits(F.col("down_first"))).alias("first_at"), F.coalesce(four_digits(F.col("up_last")), four_digits(F.col("down_last"))).alias("last_at"), week.alias("headway"), F.coalesce(headway_of("weekend"), week).alias("weekend_headway"),
    )
    kept = stops.join(ends.select("id"), "id", "left_semi")
    return shaped, kept.select(prefixed.alias("route_id"), "ord", F.concat(F.lit(VILLAGE_PREFIX), "stop").alias("stop_id"), "name", "lat", "lon")


def one_shape(*sources: DataFrame) -> DataFrame:
    """All rows of sources that have the same columns in any order."""
    return reduce(DataFrame.unionByName, sources)
