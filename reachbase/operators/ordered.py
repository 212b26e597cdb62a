"""Ordered analytics over stop sequences: running sums, islands, splits and laps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions.exprs import PERIODS, haversine
from reachbase.operators.ranges import dealt


def running_seconds(segments: DataFrame, dwell: int) -> DataFrame:
    """Adds ``at``: whole seconds of all segments (trip_id, pos, meters, kmh, pass_through) up to the stop, each cut to seconds first.

    Nobody dwells at a point that is only passed through, nor at the first stop.
    """
    order = Window.partitionBy("trip_id").orderBy("pos")
    stay = F.when(F.coalesce("pass_through", F.lit(False)), 0).otherwise(dwell)
    own = F.when(F.col("pos") == 1, 0).otherwise(F.floor(F.col("meters") / (F.col("kmh") / 3.6)) + stay)
    return segments.withColumn("at", F.sum(own).over(order).cast("long"))


def served_stops(timed: DataFrame) -> DataFrame:
    """The rows without points that are passed through, with their ``place`` from 1 in what is left."""
    order = Window.partitionBy("trip_id").orderBy("pos")
    return timed.where(~F.coalesce("pass_through", F.lit(False))).withColumn("place", F.row_number().over(order))


def implied_speeds(stops: DataFrame, parts: int | None = None) -> DataFrame:
    """Speed of each hop of (trip_id, pos, off, lat, lon), and whether it is out of 3 to 90 km/h or stands still too far.

    parts: in how many parts the rows are dealt by trip.
    """
    order = Window.partitionBy("trip_id").orderBy("pos")
    lag = {f"_{c}": F.lag(c).over(order) for c in ("lat", "lon", "off")}
    hop = dealt(stops.select("trip_id", "pos", "off", "lat", "lon"), parts, "trip_id").withColumns(lag).where("_off IS NOT NULL")
    hop = hop.withColumn("meters", haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))).withColumn("seconds", F.col("off") - F.col("_off"))
    hop = hop.withColumn("kmh", F.when(F.col("seconds") > 0, F.col("meters") / F.col("seconds") * 3.6))
    odd = F.when((F.col("seconds") <= 0) & (F.col("meters") > 100), "no time").when(F.col("kmh") > 90, "too fast").when(F.col("kmh") < 3, "too slow")
    return hop.select("trip_id", "pos", "meters", "seconds", "kmh", odd.alias("finding"))


def islands(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Runs of one value along the order. A run's last row opens the next run too; a run of one row goes.

    Adds island (from 0) and place (from 1).
    """
    along = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce((F.col(value) != F.lag(value).over(along)).cast("int"), F.lit(0))
    named = rows.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(along).cast("int"))
    closes = F.lead("_changed").over(along) == 1
    shared = named.withColumn("_also", F.when(closes, F.array(F.col("island"), F.col("island") + 1)).otherwise(F.array("island"))).withColumn("island", F.explode("_also"))
    own = Window.partitionBy(key, "island")
    out = shared.withColumn("_n", F.count("*").over(own)).where("_n > 1")
    return out.withColumn("place", F.row_number().over(own.orderBy(order))).drop("_changed", "_also", "_n")


def turnarounds(stops: DataFrame, retrace_m: float = 150, least: float = 0.45) -> DataFrame:
    """trip_id, n, far and split: where a trip (trip_id, pos from 1, lat, lon) turns back, and whether it is cut there.

    far is the index from 0 of the farthest stop from the first. A trip is cut where far lies
    between 10 and 80 percent of it, its end is within 35 percent of the greatest distance, and
    of the stops from far on at least ``least`` lie within retrace_m of one before.
    """
    trip = Window.partitionBy("trip_id")
    first = {f"_{c}0": F.first(c).over(trip.orderBy("pos")) for c in ("lat", "lon")}
    d = stops.withColumns(first).withColumn("_d", F.round(haversine(F.col("_lat0"), F.col("_lon0"), F.col("lat"), F.col("lon")), 6))
    d = d.select("trip_id", "pos", "lat", "lon", "_d")
    whole = d.groupBy("trip_id").agg(F.count("*").alias("n"), F.max(F.struct("_d", (-F.col("pos")).alias("m"))).alias("_far"), F.max_by("_d", "pos").alias("_end"))
    whole = whole.select("trip_id", "n", (-F.col("_far.m") - 1).alias("far"), F.col("_far._d").alias("_most"), "_end")
    likely = whole.where("far < n * 0.8 AND far > n * 0.1 AND _end <= _most * 0.35")
    back = d.join(likely.select("trip_id", "far"), "trip_id").where("pos > far").select("trip_id", F.col("pos").alias("_p"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    forth = d.join(likely.select("trip_id", "far"), "trip_id").where("pos <= far + 1").select("trip_id", "lat", "lon")
    meets = back.join(forth, "trip_id").where(haversine(F.col("lat"), F.col("lon"), F.col("_la"), F.col("_lo")) <= retrace_m).groupBy("trip_id", "_p").agg(F.lit(1).alias("_met"))
    share = back.join(meets, ["trip_id", "_p"], "left").groupBy("trip_id").agg((F.count("_met") / F.count("*")).alias("_share"))
    return whole.join(share, "trip_id", "left").select("trip_id", "n", "far", F.coalesce(F.col("_share") >= least, F.lit(False)).alias("split"))


def laps(stops: DataFrame, apart: int = 8) -> DataFrame:
    """trip_id, lap_from, lap_to: the first return to a stop of (trip_id, pos, stop_id) at least ``apart`` places later."""
    same = Window.partitionBy("trip_id", "stop_id").orderBy("pos")
    again = stops.withColumn("_first", F.min("pos").over(same)).where(F.col("pos") - F.col("_first") >= apart)
    best = F.min(F.struct("pos", "_first"))
    return again.groupBy("trip_id").agg(best.alias("_b")).select("trip_id", F.col("_b._first").alias("lap_from"), F.col("_b.pos").alias("lap_to"))


def service_windows(routes: DataFrame, factors: DataFrame) -> DataFrame:
    """Cuts each route's day (route_id, type, start_min, end_min, headway in s) at the period edges and merges equal neighbours.

    factors: type, period, factor (missing: 1). A piece shorter than its headway goes; if none
    is left, the day stays as it was. Returns route_id, window_from, window_to, headway.
    """
    edges = sorted({a for a, _ in PERIODS} | {a + 1440 for a, _ in PERIODS})
    inner = F.filter(F.array(*[F.lit(e).cast("long") for e in edges]), lambda c: (c > F.col("start_min")) & (c < F.col("end_min")))
    start, end = F.col("start_min").cast("long"), F.col("end_min").cast("long")
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(start, end), inner)))
    # A day has two dozen pieces at most: they stay in its row, which nothing deals or sorts. Types are a dimension.
    by_type = factors.where("period IS NOT NULL").groupBy(F.col("type").alias("_t")).agg(F.map_from_entries(F.collect_list(F.struct("period", "factor"))).alias("_factors"))
    days = routes.join(F.broadcast(by_type), F.col("type") == F.col("_t"), "left").withColumn("_cuts", cuts)

    def piece(a: Column, b: Column) -> Column:
        minute = a % 1440
        factor = F.lit(None).cast("double")
        for i, (low, high) in reversed(list(enumerate(PERIODS))):
            factor = F.when((minute >= low) & (minute < high), F.col("_factors")[i]).otherwise(factor)
        seconds = F.greatest(F.lit(60), F.floor(F.col("headway") * F.coalesce(factor, F.lit(1.0)) + 0.5).cast("int"))
        return F.struct(a.alias("window_from"), b.alias("window_to"), seconds.alias("headway"))

    def merged(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["window_from"].alias("window_from"), x["window_to"].alias("window_to"), x["headway"].alias("headway"))
        return F.when(last["headway"] == x["headway"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    rest = F.size("_cuts") - 1
    pieces = F.zip_with(F.slice("_cuts", 1, rest), F.slice("_cuts", 2, rest), piece)
    kept = days.select("*", F.filter(pieces, lambda p: (p["window_to"] - p["window_from"]) * 60 >= p["headway"]).alias("_kept"))
    whole = F.array(F.struct(start.alias("window_from"), end.alias("window_to"), F.col("headway").cast("int").alias("headway")))
    windows = F.when(F.size("_kept") > 0, F.aggregate("_kept", F.filter("_kept", lambda p: F.lit(False)), merged)).otherwise(whole)
    return kept.select("route_id", F.explode(windows).alias("_w")).select("route_id", "_w.window_from", "_w.window_to", "_w.headway")


def renumbered(rows: DataFrame, key: str, order: str, value: str, least: int = 2) -> DataFrame:
    """Rows without those that repeat the value before them, numbered anew from 1; keys with fewer than ``least`` rows left go."""
    along = Window.partitionBy(key).orderBy(order)
    last = F.lag(value).over(along)
    kept = rows.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("_last") != F.col(value))).drop("_last")
    counted = kept.withColumn(order, F.row_number().over(along)).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return counted.where(F.col("_n") >= least).drop("_n")
