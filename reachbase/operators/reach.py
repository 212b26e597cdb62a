"""Searching what is in reach: thresholds, prices, amenities, ranks, rasters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.functions.exprs import band_breaks
from reachbase.functions.medians import at_share
from reachbase.operators.ranges import places

#: Contracts that a price must rest on.
MIN_SAMPLES, FLAT_CLIMB = 10, 10


def within_budget(reach: DataFrame, budget: int, walk_cap: int | None = None) -> DataFrame:
    walk = F.lit(True) if walk_cap is None else F.col("walk").isNull() | (F.col("walk") <= walk_cap)
    return reach.where((F.col("minutes") <= budget) & walk)


def affordable(reach: DataFrame, rooms: DataFrame, room: str, tenure: str, cap: int, budget: int, climbs: DataFrame | None = None) -> DataFrame:
    """reach's columns (dong_id, minutes, any more) with price, deposit and n of the neighbourhoods that fit.

    rooms: dong_id, room, jeonse, deposit, rent, n. A price must rest on MIN_SAMPLES contracts
    and not exceed the cap (0: none). A rent needs a deposit. With climbs (dong_id, climb) only
    neighbourhoods that are known to be flat count. Unknown minutes are out of the budget.
    """
    rent = tenure != "JEONSE"
    price, deposit = (F.when(F.col("rent") > 0, F.col("rent")), F.col("deposit")) if rent else (F.col("jeonse"), F.col("jeonse"))
    known = rooms.where((F.col("room") == room) & (F.col("n") >= MIN_SAMPLES)).select("dong_id", price.alias("price"), deposit.alias("deposit"), "n").where("price IS NOT NULL AND deposit IS NOT NULL")
    if cap:
        known = known.where(F.col("price") <= cap)
    if climbs is not None:
        known = known.join(climbs.where(F.col("climb") <= FLAT_CLIMB).select("dong_id"), "dong_id", "left_semi")
    return reach.where(F.col("minutes") <= budget).join(known, "dong_id")


def affordable_buildings(reach: DataFrame, buildings: DataFrame, room: str, tenure: str, cap: int, budget: int) -> DataFrame:
    """reach's columns (dong_id, minutes, any more) with seq, price and n of buildings (seq, dong_id, room, n, m, j) that have the room."""
    price = F.col("j") if tenure == "JEONSE" else F.col("m")
    known = buildings.where(F.col("room") == room).select("seq", "dong_id", price.alias("price"), "n").where("price IS NOT NULL")
    return reach.where(F.col("minutes") <= budget).join(known.where(F.col("price") <= cap) if cap else known, "dong_id")


def on_field(points: DataFrame, field: DataFrame, cell_m: float, budget: int) -> DataFrame:
    """points (y, x in metres, any more) with the minutes of the nearest cell centre of field (row, col, value) within the budget."""
    row, col = F.floor(F.col("y") / cell_m).cast("int"), F.floor(F.col("x") / cell_m).cast("int")
    placed = points.withColumn("row", row).withColumn("col", col)
    return placed.join(field.where(F.col("value") <= budget), ["row", "col"]).drop("row", "col").withColumnRenamed("value", "minutes")


def detail_card(rooms: DataFrame) -> DataFrame:
    """rooms (dong_id, room, n, rent, trend) with what a card says: few contracts, and a trend of three known months at least."""
    known = F.filter("trend", lambda x: x.isNotNull())
    shown = (F.col("rent") > 0) & (F.size(known) >= 3)
    return rooms.select("dong_id", "room", "n", (F.col("n") < MIN_SAMPLES).alias("few"), F.when(shown, F.col("trend")).alias("trend"), F.when(shown, F.array_min(known)).alias("low"), F.when(shown, F.array_max(known)).alias("high"))


def padded_bounds(points: DataFrame, walk_cap: int) -> DataFrame:
    """west, east, south, north around the middle nine tenths of the points, and as far as one walks."""
    pad = walk_cap * 80 + 1500
    low = {f"{n}_{c}": at_share(c, s) for c in ("lat", "lon") for n, s in (("low", 0.05), ("high", 0.95))}
    box = points.agg(*[v.alias(k) for k, v in low.items()], at_share("lat", 0.5).alias("_mid"))
    wide = F.lit(float(pad)) / (111_000 * F.cos(F.radians("_mid")))
    return box.select((F.col("low_lon") - wide).alias("west"), (F.col("high_lon") + wide).alias("east"), (F.col("low_lat") - pad / 111_000).alias("south"), (F.col("high_lat") + pad / 111_000).alias("north"))


def drawn_stations(stations: DataFrame, lat: float, lon: float, most: int = 300) -> DataFrame:
    """The stations (station_id, lat, lon) that a map draws, the nearest first; ties by id."""
    dx = (F.col("lon") - lon) * math.cos(math.radians(lat))
    return stations.withColumn("d2", dx * dx + F.pow(F.col("lat") - lat, 2)).orderBy("d2", "station_id").limit(most)


def first_five(found: DataFrame, order: list[Column]) -> DataFrame:
    return found.orderBy(*order, "dong_id").limit(5)


def amenity_thresholds(amenities: DataFrame, distance: list[str], presence: list[str]) -> DataFrame:
    """code, threshold: 1 for presence, the 40% value to 500 m for distances, else the 60% value."""
    code = F.col("code")
    got = amenities.groupBy("code").agg(at_share("n", 0.6).alias("_hi"), at_share("n", 0.4).alias("_lo"))
    far = F.greatest(F.lit(500), F.floor(F.col("_lo") / 500 + 0.5) * 500)
    return got.select("code", F.when(code.isin(presence), 1).when(code.isin(distance), far).otherwise(F.col("_hi")).cast("int").alias("threshold"))


def passing(amenities: DataFrame, thresholds: DataFrame, selected: list[str], distance: list[str]) -> DataFrame:
    """dong_id of those that meet every selected code; a missing code fails."""
    joined = amenities.where(F.col("code").isin(selected)).join(thresholds, "code")
    ok = F.when(F.col("code").isin(distance), F.col("n") <= F.col("threshold")).otherwise(F.col("n") >= F.col("threshold"))
    return joined.groupBy("dong_id").agg(F.count_if(ok).alias("_met")).where(F.col("_met") == len(selected)).select("dong_id")


def amenity_ranks(keys: DataFrame, amenities: DataFrame, codes: list[str], distance: list[str]) -> DataFrame:
    """dong_id, rank: the mean over codes of each one's place among all (0 to 1); missing counts as worst."""
    grid = keys.select("dong_id", F.explode(F.array(*[F.lit(c) for c in codes])).alias("code"))
    missing = F.when(F.col("code").isin(distance), 1_000_000_000).otherwise(0)
    value = F.coalesce("n", missing) * F.when(F.col("code").isin(distance), -1).otherwise(1)
    rows = grid.join(amenities, ["dong_id", "code"], "left").withColumn("_v", value)
    sizes = rows.groupBy("code").agg(F.count("*").alias("_n"))
    placed = places(rows, ["_v", "dong_id"], "code", "_at").join(sizes, "code")
    return placed.withColumn("_p", F.col("_at") / F.greatest(F.lit(1), F.col("_n") - 1)).groupBy("dong_id").agg(F.round(F.avg("_p"), 9).alias("rank"))


def best_values(rows: DataFrame, measures: dict[str, bool]) -> DataFrame:
    """Long form of the measures (name: whether less is better): key, measure, value, best. With one value none is best."""
    pairs = ", ".join(f"'{m}', CAST({m} AS double)" for m in measures)
    long = rows.selectExpr("key", f"stack({len(measures)}, {pairs}) AS (measure, value)").where("value IS NOT NULL")
    less = F.col("measure").isin([m for m, low in measures.items() if low])
    goals = long.groupBy("measure").agg(F.count("*").alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high"))
    joined = long.join(F.broadcast(goals), "measure")  # a row for each of the named measures
    return joined.select("key", "measure", "value", ((F.col("_n") > 1) & (F.col("value") == F.when(less, F.col("_low")).otherwise(F.col("_high")))).alias("best"))


def raster(points: DataFrame, budget: int, cell_m: float, reach_m: float, speed: float = 66.0) -> DataFrame:
    """row, col, value: the least minutes of each cell that a point (y and x in metres, minutes) covers.

    A point covers the cells within the metres that its remaining minutes allow, up to reach_m; a cell's value adds the walk.
    """
    radius = F.least((F.lit(budget) - F.col("minutes")) * speed, F.lit(reach_m))
    span = F.ceil(radius / cell_m).cast("int")
    row, col = F.floor(F.col("y") / cell_m).cast("int"), F.floor(F.col("x") / cell_m).cast("int")
    near = points.where(F.col("minutes") <= budget).withColumns({"_r": radius, "_s": span, "_row": row, "_col": col})
    near = near.withColumn("row", F.explode(F.sequence(F.col("_row") - F.col("_s"), F.col("_row") + F.col("_s")))).withColumn("col", F.explode(F.sequence(F.col("_col") - F.col("_s"), F.col("_col") + F.col("_s"))))
    d = F.sqrt(F.pow((F.col("row") + 0.5) * cell_m - F.col("y"), 2) + F.pow((F.col("col") + 0.5) * cell_m - F.col("x"), 2))
    return near.withColumn("_d", d).where("_d <= _r").groupBy("row", "col").agg(F.round(F.min(F.col("minutes") + F.col("_d") / speed), 6).alias("value"))


def field_grid(points: DataFrame, budget: int, cell_m: float = 200.0, reach_m: float = 990.0, speed: float = 66.0, most_cells: int = 160_000) -> DataFrame:
    """row, col, minutes of all cells around points (lat, lon, minutes): the least of what covers one, else 1.4 budgets.

    Cells grow by half until there are at most ``most_cells``, eight times at most. One row with the extent comes
    to the driver. A point covers the grid's crossings within what its remaining minutes allow.
    """
    inside = points.where(F.col("minutes") <= budget)
    box = inside.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max))]).first()
    if box["low_lat"] is None:
        return inside.select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0.0).alias("minutes")).limit(0)
    per_lat = 111_320.0
    per_lon = per_lat * math.cos(math.radians((box["low_lat"] + box["high_lat"]) / 2))
    low = box["low_lat"] - reach_m / per_lat, box["low_lon"] - reach_m / per_lon
    extent = (box["high_lat"] + reach_m / per_lat - low[0]) * per_lat, (box["high_lon"] + reach_m / per_lon - low[1]) * per_lon
    for _ in range(8):
        if math.ceil(extent[0] / cell_m) * math.ceil(extent[1] / cell_m) <= most_cells:
            break
        cell_m *= 1.5
    rows, cols = (math.ceil(x / cell_m) + 1 for x in extent)
    y, x = (F.col("lat") - low[0]) * per_lat, (F.col("lon") - low[1]) * per_lon
    radius = F.least((F.lit(budget) - F.col("minutes")) * speed, F.lit(reach_m))
    near = inside.select("minutes", y.alias("_y"), x.alias("_x"), radius.alias("_r")).where("_r > 0")
    span = F.ceil(F.col("_r") / cell_m).cast("int") + 1
    for name, at, count in (("row", "_y", rows), ("col", "_x", cols)):
        middle = F.floor(F.col(at) / cell_m + 0.5).cast("int")
        near = near.withColumn(name, F.explode(F.sequence(F.greatest(F.lit(0), middle - span), F.least(F.lit(count - 1), middle + span))))
    far = F.sqrt(F.pow(F.col("row") * cell_m - F.col("_y"), 2) + F.pow(F.col("col") * cell_m - F.col("_x"), 2))
    total = F.col("minutes") + far / speed
    covered = near.where((far <= F.col("_r")) & (total <= budget)).groupBy("row", "col").agg(F.min(total).alias("_least"))
    whole = points.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return whole.join(covered, ["row", "col"], "left").select("row", "col", F.round(F.coalesce("_least", F.lit(budget * 1.4)), 6).alias("minutes"))


def banded(field: DataFrame, budget: int) -> DataFrame:
    """row, col, band: the lower bound of the band in which a cell's minutes fall; cells out of reach go."""
    breaks = band_breaks(F.lit(budget))
    band = F.array_max(F.filter(breaks, lambda b: b <= F.col("minutes")))
    return field.where(F.col("minutes") < budget * 1.4).select("row", "col", F.least(band, F.lit(budget)).cast("int").alias("band"))


def smoothed(field: DataFrame) -> DataFrame:
    """One pass of weights 4, 1 and 1/2 over 3 x 3 cells (row, col, value) that have all neighbours; the others stay."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(4.0 if i == j == 0 else 1.0 if 0 in (i, j) else 0.5).alias("w")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = field.withColumn("_o", F.explode(offsets)).select((F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"), (F.col("value") * F.col("_o.w")).alias("_v"))
    sums = spread.groupBy("row", "col").agg((F.sum("_v") / 10).alias("_m"), F.count("*").alias("_n"))
    return field.join(sums, ["row", "col"]).select("row", "col", F.when(F.col("_n") == 9, F.col("_m")).otherwise(F.col("value")).alias("value"))


def core_bounds(points: DataFrame) -> DataFrame:
    """The box around the middle nine tenths of the points (lat, lon)."""
    return points.agg(*[at_share(c, s).alias(f"{n}_{c}") for c in ("lat", "lon") for n, s in (("low", 0.05), ("high", 0.95))])


def prefix_search(names: DataFrame, needle: str, limit: int = 120) -> DataFrame:
    """key, name, prefix, matches: names that start with the needle before those that have it inside; the first ``limit``."""
    hit = names.where(F.instr(F.lower("name"), needle.lower()) > 0).withColumn("prefix", F.startswith(F.lower("name"), F.lit(needle.lower())))
    total = hit.agg(F.count("*").alias("matches"))
    return hit.orderBy(F.col("prefix").desc(), "key").limit(limit).join(F.broadcast(total), F.lit(True))


def amenities_by_name(places: DataFrame, amenities: DataFrame) -> DataFrame:
    """places (district, name) with the columns of amenities (key ``district|name``); null where none is known."""
    district, name = F.substring_index("key", "|", 1), F.expr("substring(key, instr(key, '|') + 1)")
    keyed = amenities.withColumn("district", district).withColumn("name", name).drop("key")
    return places.join(keyed, ["district", "name"], "left")
