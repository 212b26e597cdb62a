"""Observed speeds, learned curves, fleet factors and headways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions.exprs import length_bin, period_of, top_speed, type_speed
from reachbase.functions.medians import upper_middle

#: Values that a bin of the common curve, or of a type's own, must have.
MIN_ALL, MIN_TYPE = 30, 100
#: Values that a period, and a type, must have for a factor of its own.
MIN_PERIOD, MIN_FLEET = 12, 24
DEFAULT_KMH, LONG_METERS, TOP_KMH = 19.0, 1500, 95.0


def sound(obs: DataFrame) -> DataFrame:
    """Observations of 5 km/h up to the limit of their length."""
    return obs.where((F.col("kmh") >= 5) & (F.col("kmh") <= top_speed("meters")))


def segment_medians(obs: DataFrame) -> DataFrame:
    """route, ord: the middle speed over all snapshots, and how many there were."""
    return sound(obs).groupBy("route", "ord").agg(upper_middle("kmh").alias("kmh"), F.count("*").alias("n"))


def speed_curve(obs: DataFrame, least: int, by: list[str]) -> DataFrame:
    """Middle speed by length bin, never falling with length; empty bins take a neighbour's.

    by: columns that have a curve each (may be none). A curve without a single full bin is absent.
    """
    full = sound(obs).withColumn("bin", length_bin("meters")).groupBy(*by, "bin").agg(upper_middle("kmh").alias("_v"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    bins = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("bin")
    grid = full.groupBy(*by).agg(F.count("*").alias("_any")).where("_any > 0").select(*by, bins) if by else full.agg(F.count("*").alias("_any")).where("_any > 0").select(bins)
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    rows = grid.join(full.drop("_n"), [*by, "bin"], "left").withColumn("_up", F.max("_v").over(up))
    return rows.withColumn("kmh", F.coalesce("_up", F.first("_up", ignorenulls=True).over(down))).select(*by, "bin", "kmh")


def resolved(segments: DataFrame, obs: DataFrame, long_factor: float = 1.25) -> DataFrame:
    """A speed for each segment (route, ord, type, meters): measured, the type's curve, the common curve, or a fixed one."""
    typed = speed_curve(obs, MIN_TYPE, ["type"]).withColumnRenamed("kmh", "_typed")
    common = speed_curve(obs, MIN_ALL, []).withColumnRenamed("kmh", "_common")
    measured = segment_medians(obs).select("route", "ord", F.col("kmh").alias("_measured"))
    rows = segments.withColumn("bin", length_bin("meters")).join(measured, ["route", "ord"], "left").join(typed, ["type", "bin"], "left").join(common, "bin", "left")
    kmh = F.coalesce("_measured", "_typed", "_common", type_speed("type"), F.lit(DEFAULT_KMH)).cast("double")
    kmh = F.least(F.lit(TOP_KMH), F.when(F.col("meters") >= LONG_METERS, kmh * long_factor).otherwise(kmh))
    source = F.when(F.col("_measured").isNotNull(), "measured").when(F.col("_typed").isNotNull(), "type").when(F.col("_common").isNotNull(), "common").otherwise("fixed")
    return rows.select("route", "ord", "type", "meters", kmh.alias("kmh"), source.alias("source"))


def fleet_factors(fleet: DataFrame) -> DataFrame:
    """type, period, factor: the day's middle number of vehicles over the period's, 1 where there are few values."""
    rows = fleet.withColumn("period", period_of("at_minute")).where("period IS NOT NULL")
    day = rows.groupBy("type").agg(upper_middle("n").alias("_base"), F.count("*").alias("_all")).where(f"_all >= {MIN_FLEET} AND _base > 0")
    part = rows.groupBy("type", "period").agg(upper_middle("n").alias("_mid"), F.count("*").alias("_n"))
    grid = day.select("type", "_base", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("period"))
    factor = F.when((F.col("_n") >= MIN_PERIOD) & (F.col("_mid") > 0), F.floor(F.col("_base") / F.col("_mid") * 100 + 0.5) / 100).otherwise(1.0)
    return grid.join(part, ["type", "period"], "left").select("type", "period", F.coalesce(factor, F.lit(1.0)).alias("factor"))


def imputed_headways(routes: DataFrame) -> DataFrame:
    """routes (route_id, type, headway) with zeros replaced by the type's middle, the common one, or 20; and by which."""
    by_type = routes.where("headway > 0").groupBy("type").agg(upper_middle("headway").alias("_typed"))
    common = routes.where("headway > 0").agg(upper_middle("headway").alias("_common"))
    rows = routes.join(by_type, "type", "left").join(F.broadcast(common), F.lit(True))  # one row
    known = F.col("headway") > 0
    source = F.when(known, "given").when(F.col("_typed").isNotNull(), "type").when(F.col("_common").isNotNull(), "common").otherwise("fixed")
    return rows.select("route_id", "type", F.when(known, F.col("headway")).otherwise(F.coalesce("_typed", "_common", F.lit(20))).alias("headway"), source.alias("source"))
