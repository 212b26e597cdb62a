"""Checks of a timetable: findings as rows (severity, rule, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachbase.operators.graph import cut_lineage
from reachbase.operators.ordered import implied_speeds
from reachbase.operators.ranges import dealt, places


def _finding(rows: DataFrame, severity: str, rule: str, key: str) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def timetable_errors(stops: DataFrame, trips: DataFrame, stop_times: DataFrame, windows: DataFrame, parts: int | None = None) -> DataFrame:
    """Missing references, trips without times or windows, single-stop trips, times that go backwards, bad windows, doubled ids.

    Times are narrowed to a row for each trip and the stops' ids before they meet anything.
    parts: in how many parts times are dealt by trip.
    """
    order = Window.partitionBy("trip_id").orderBy("pos")
    steps = dealt(stop_times, parts, "trip_id").withColumn("_d", F.col("off") - F.lag("off").over(order))
    timed = steps.groupBy("trip_id").agg(F.count("*").alias("_n"), F.count_if(F.col("_d") < 0).alias("_back"))
    used = stop_times.select("stop_id").distinct()
    out = [
        _finding(used.join(stops, "stop_id", "left_anti"), "error", "unknown stop", "stop_id"),
        _finding(timed.join(trips, "trip_id", "left_anti"), "error", "unknown trip", "trip_id"),
        _finding(trips.join(timed, "trip_id", "left_anti"), "error", "trip without times", "trip_id"),
        _finding(trips.join(windows, "trip_id", "left_anti"), "error", "trip without windows", "trip_id"),
        _finding(timed.where("_n < 2"), "error", "single stop", "trip_id"),
        _finding(timed.where("_back > 0"), "error", "time goes backwards", "trip_id"),
        _finding(windows.where("last_start < first_start OR headway <= 0"), "error", "bad window", "trip_id"),
        _finding(stops.groupBy("stop_id").count().where("count > 1"), "error", "doubled stop", "stop_id"),
        _finding(stops.where("lat NOT BETWEEN 33 AND 39 OR lon NOT BETWEEN 124 AND 132"), "error", "coordinate out of range", "stop_id"),
        _finding(windows.where("headway > 14400"), "warning", "headway over four hours", "trip_id"),
        _finding(stops.join(used, "stop_id", "left_anti"), "warning", "unused stop", "stop_id"),
    ]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def route_findings(routes: DataFrame, trips: DataFrame, services: DataFrame) -> DataFrame:
    """Doubled ids, unknown references and odd codes of routes (route_id, route_type) and trips (trip_id, route_id, service, direction).

    Services are those of the calendar; without any, none is unknown. A missing direction is fine.
    """
    any_service = services.limit(1).select(F.lit(True).alias("_any"))
    unknown = trips.join(services, "service", "left_anti").join(any_service, F.lit(True), "left_semi")
    out = [
        _finding(trips.groupBy("trip_id").count().where("count > 1"), "error", "doubled trip", "trip_id"),
        _finding(routes.groupBy("route_id").count().where("count > 1"), "error", "doubled route", "route_id"),
        _finding(trips.join(routes, "route_id", "left_anti").select("route_id").distinct(), "error", "unknown route", "route_id"),
        _finding(unknown.select("service").distinct(), "error", "unknown service", "service"),
        _finding(routes.where("route_type IS NULL OR route_type NOT BETWEEN 0 AND 12").select("route_id").distinct(), "error", "odd route type", "route_id"),
        _finding(trips.where("direction IS NOT NULL AND direction NOT IN (0, 1)").select("trip_id").distinct(), "error", "odd direction", "trip_id"),
    ]
    return reduce(DataFrame.unionByName, out)


def missing_files(present: list[str], needed: tuple[str, ...] = ("agency.txt", "stops.txt", "routes.txt", "trips.txt", "stop_times.txt", "calendar.txt", "frequencies.txt")) -> list[str]:
    """The required files of a feed that aren't there."""
    return [name for name in needed if name not in set(present)]


def file_order_findings(rows: DataFrame, order: list[str]) -> DataFrame:
    """rule, trip_id, n of rows (trip_id, sequence) in the order of their file: trips in several pieces, and sequences that don't grow.

    Rows are numbered by ranges, and each meets the row before it by number.
    """
    placed = cut_lineage(places(rows, order, name="_line").select("trip_id", "sequence", "_line"))
    before = placed.select((F.col("_line") + 1).alias("_line"), F.col("trip_id").alias("_before"))
    starts = placed.join(before, "_line", "left").where(~F.col("_before").eqNullSafe(F.col("trip_id")))
    scattered = starts.groupBy("trip_id").agg(F.count("*").alias("n")).where("n > 1")
    was = F.lag("sequence").over(Window.partitionBy("trip_id").orderBy("_line"))
    back = placed.withColumn("_was", was).where("sequence <= _was").groupBy("trip_id").agg(F.count("*").alias("n"))
    return scattered.select(F.lit("scattered").alias("rule"), "trip_id", "n").unionByName(back.select(F.lit("sequence").alias("rule"), "trip_id", "n"))


def error_signatures(messages: DataFrame, column: str, limit: int = 8) -> DataFrame:
    """The most frequent shapes of messages: digits give way to dots, 60 characters, ties by text."""
    shape = F.substring(F.regexp_replace(F.col(column), r"[0-9]+", "…"), 1, 60)
    return messages.groupBy(shape.alias("signature")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "signature").limit(limit)


def leg_matches(asks: DataFrame, stop_times: DataFrame) -> DataFrame:
    """For asks (ask_id, from_stop, to_stop, want): the trip (trip_id, pos, stop_id, off) that fits best.

    For each boarding the first alighting after it; least off in stops by more than one, then by
    how many, then in time. A fit that is off by more than max(2, want / 2) is none. Asks of one
    pair of stops share its search, and of its rides with equally many stops only the quickest
    meets them, so neither a busy stop nor a popular pair multiplies the other.
    """
    asked = asks.select("from_stop", "to_stop").distinct()
    a = stop_times.select("trip_id", F.col("pos").alias("_i"), F.col("stop_id").alias("from_stop"), F.col("off").alias("_dep"))
    b = stop_times.select("trip_id", F.col("pos").alias("_j"), F.col("stop_id").alias("to_stop"), F.col("off").alias("_arr"))
    boardings = a.join(asked, "from_stop")
    first = boardings.join(b, ["trip_id", "to_stop"]).where("_j > _i").groupBy("from_stop", "to_stop", "trip_id", "_i").agg(F.min(F.struct("_j", (F.col("_arr") - F.col("_dep")).alias("sec"))).alias("_b"))
    quickest = first.groupBy("from_stop", "to_stop", (F.col("_b._j") - F.col("_i")).alias("_stops")).agg(F.min(F.struct(F.col("_b.sec").alias("sec"), "trip_id")).alias("_q"))
    off = F.abs(F.col("_stops") - F.col("want"))
    best = F.min(F.struct((off > 1).alias("far"), off.alias("off"), F.col("_q.sec").alias("sec"), F.col("_q.trip_id").alias("trip_id")))
    chosen = asks.join(quickest, ["from_stop", "to_stop"]).groupBy("ask_id", "want").agg(best.alias("_c")).where(F.col("_c.off") <= F.greatest(F.lit(2), F.floor(F.col("want") / 2)))
    return chosen.select("ask_id", "want", F.col("_c.trip_id").alias("trip_id"), F.col("_c.off").alias("off_by"), F.col("_c.sec").alias("sec"))


def plausibility(stops: DataFrame, stop_times: DataFrame, windows: DataFrame, parts: int | None = None) -> DataFrame:
    """Warnings: hops (trip_id, pos, stop_id, off) out of 3 to 90 km/h or far without time, headways over four hours, unused stops.

    parts: in how many parts stop times are dealt by stop, and hops by trip.
    """
    placed = dealt(stop_times, parts, "stop_id").join(stops.select("stop_id", "lat", "lon"), "stop_id")
    hops = implied_speeds(placed, parts).where("finding IS NOT NULL")
    odd = hops.select(F.lit("warning").alias("severity"), F.col("finding").alias("rule"), F.col("trip_id").cast("string").alias("key"))
    rare = _finding(windows.where("headway > 14400"), "warning", "headway over four hours", "trip_id")
    return odd.unionByName(rare).unionByName(_finding(stops.join(stop_times.select("stop_id").distinct(), "stop_id", "left_anti"), "warning", "unused stop", "stop_id"))


def axis_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """idx, name and other of two axes (idx, name) where they differ or one side has none."""
    both = left.select("idx", "name").join(right.select("idx", F.col("name").alias("other")), "idx", "full")
    return both.where(~F.col("name").eqNullSafe(F.col("other")))
