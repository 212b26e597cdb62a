"""Errors against outside samples, fits and grid searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.functions.medians import at_share, upper_middle
from reachbase.operators.graph import cut_lineage
from reachbase.operators.ranges import places


def bias_report(rows: DataFrame, by: list[str], error: str = "error", outside: str = "ext_sec", least: int = 3) -> DataFrame:
    """n, bias, relative (mean percent of the outside value), median, mae and within (share up to 180).

    Over all rows, and by each column of ``by`` alone; ``part`` says which (null: all rows) and
    ``value`` which group. Groups of fewer than ``least`` rows go.
    """
    rel = F.col(error) * 100.0 / F.nullif(F.col(outside), F.lit(0))
    names = F.array(F.struct(F.lit(None).cast("string").alias("part"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(c).alias("part"), F.col(c).cast("string").alias("value")) for c in by])
    each = rows.select(F.col(error).alias("_e"), rel.alias("_rel"), F.inline(names))
    out = each.groupBy("part", "value").agg(F.count("*").alias("n"), F.avg("_e").alias("bias"), F.avg("_rel").alias("relative"), upper_middle("_e").alias("median"), F.avg(F.abs("_e")).alias("mae"), F.avg((F.abs("_e") <= 180).cast("double")).alias("within"))
    return out.where(F.col("n") >= least).select("part", "value", "n", *[F.round(c, 4).alias(c) for c in ("bias", "relative", "mae", "within")], "median")


def ols3(rows: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Least squares y = pa * a + pb * b + pc: one row, null where the columns don't span."""
    s = rows.agg(*[F.sum(F.col(p).cast("double") * F.col(q)).alias(n) for n, p, q in (("aa", a, a), ("ab", a, b), ("bb", b, b), ("ay", a, y), ("by", b, y))], *[F.sum(F.col(c).cast("double")).alias(f"s{n}") for n, c in (("a", a), ("b", b), ("y", y))], F.count("*").cast("double").alias("n"))

    def det(m: list[list[str]]) -> Column:
        c = [[F.col(x) for x in row] for row in m]
        return c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1]) - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0]) + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])

    m = [["aa", "ab", "sa"], ["ab", "bb", "sb"], ["sa", "sb", "n"]]
    right = ["ay", "by", "sy"]
    whole = det(m)
    sub = [det([[right[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) for k in range(3)]
    return s.select(*[F.when(F.abs(whole) > 1e-9, x / whole).alias(n) for n, x in zip(("pa", "pb", "pc"), sub, strict=True)], F.col("n").cast("long").alias("n"))


def split_holdout(rows: DataFrame, key: str = "od_id") -> DataFrame:
    """Adds train: whether the key's place among all sorted keys, from 0, is even.

    """
    place = places(rows.select(key).distinct(), [key], name="_place")
    return rows.join(place, key).withColumn("train", F.col("_place") % 2 == 0).drop("_place")


def grid_search(rows: DataFrame, candidates: list[float], by: list[str], error: Callable[[Column], Column]) -> DataFrame:
    """value, mae, bias and within (share up to 180) of each candidate over all rows.

    error gives a row's error for a candidate, from the columns ``by`` alone: rows that are equal
    in these are counted first, and only their counts meet the grid, a fixed one of a few hundred
    values, in the task that has them.
    """
    counted = rows.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("value", F.explode(F.array(*[F.lit(c) for c in candidates])))
    tried = counted.withColumn("_e", error(F.col("value")))
    n = F.sum("_n")
    out = tried.groupBy("value").agg((F.sum(F.col("_n") * F.abs("_e")) / n).alias("mae"), (F.sum(F.col("_n") * F.col("_e")) / n).alias("bias"), (F.sum(F.when(F.abs("_e") <= 180, F.col("_n")).otherwise(0)) / n).alias("within"))
    return out.select("value", *[F.round(c, 6).alias(c) for c in ("mae", "bias", "within")])


def best_of(grid: DataFrame) -> DataFrame:
    """The value with the least error; of equals the smallest."""
    best = F.min(F.struct("mae", "value"))
    return grid.agg(best["value"].alias("value"), best["mae"].alias("mae"))


#: Metres between stops from which a segment is long, and by how much a fit must move to count: seconds, and a factor.
LONG_M, DEAD_SECONDS, DEAD_FACTOR = 1500.0, 2, 0.05
#: Rows that a fit needs on either side, and long ones that the factor needs.
MIN_SIDE, MIN_LONG = 50, 20
# The grids that are searched, factors of long segments and seconds at a stop.
FACTORS = [round(0.40 + 0.05 * i, 2) for i in range(53)]
DWELLS = list(range(181))
#: Metres from which a leg tells a ratio of distances, ratios that it takes, and by how much a ratio must move to count.
RATIO_M, MIN_RATIOS, DEAD_RATIO = 300, 30, 0.01


def refit(rows: DataFrame, dwell: int, factor: float) -> DataFrame:
    """One row: dwell and factor fitted on half of the journeys, and bias, mae and within on the other half.

    rows: od_id, stops, ours_sec (with the given dwell and factor), ext_sec, ext_m. First the
    factor of long segments, where few stops leave speed alone to tell, then the dwell; each by
    the least mean error on a grid, ties to the smaller. What moved less than the dead-band
    stays. With too few rows on either side nothing is fitted (fitted is false).
    """
    hops = F.col("stops") - 1
    long = F.col("ext_m") / F.greatest(F.lit(1), hops) >= LONG_M
    ride = F.greatest(F.lit(1.0), F.col("ours_sec") - hops * dwell) * F.when(long, factor).otherwise(1.0)
    split = cut_lineage(split_holdout(rows).select("train", hops.alias("hops"), long.alias("long"), ride.alias("ride"), F.col("ext_sec").alias("ext")))
    sizes = split.agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("test"), F.count_if(F.col("train") & F.col("long")).alias("long")).first()
    fitted = min(sizes["train"], sizes["test"]) >= MIN_SIDE
    best_factor, best_dwell = factor, dwell
    by = ["hops", "long", "ride", "ext"]
    if fitted and sizes["long"] >= MIN_LONG:
        best_factor = best_of(grid_search(split.where("train AND long"), FACTORS, by, lambda f: F.col("ride") / f + F.col("hops") * dwell - F.col("ext"))).first()["value"]
    slowed = F.col("ride") / F.when(F.col("long"), best_factor).otherwise(1.0)
    if fitted:
        best_dwell = best_of(grid_search(split.where("train"), DWELLS, by, lambda b: slowed + F.col("hops") * b - F.col("ext"))).first()["value"]
        best_dwell = dwell if abs(best_dwell - dwell) < DEAD_SECONDS else best_dwell
        best_factor = factor if abs(best_factor - factor) < DEAD_FACTOR else best_factor
    slowed = F.col("ride") / F.when(F.col("long"), best_factor).otherwise(1.0)
    e = slowed + F.col("hops") * best_dwell - F.col("ext")
    held = split.where("NOT train").agg(F.round(F.avg(e), 4).alias("bias"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.avg((F.abs(e) <= 180).cast("double")), 4).alias("within"))
    return held.select(F.lit(fitted).alias("fitted"), F.lit(int(best_dwell)).alias("dwell"), F.lit(float(best_factor)).alias("factor"), "bias", "mae", "within")


def refit_ratios(rows: DataFrame, ratio: float, regional_ratio: float, regional_types: list[str]) -> DataFrame:
    """One row: ratio and regional_ratio, measured on legs (type, ours_m, ext_m) as the middle of outside over own metres.

    Ratios are measured, not fitted, so no half is held out. The ratio of all legs stays as it is
    where it would move by less than DEAD_RATIO; the one of regional types, on whose straight
    lines everything there rests, always follows. Too few legs change nothing.
    """
    legs = rows.where(F.col("ours_m") > RATIO_M).select((F.col("ext_m") / F.col("ours_m")).alias("_r"), F.coalesce(F.col("type").isin(regional_types), F.lit(False)).alias("_g"))
    got = legs.agg(F.count("*").alias("_n"), F.round(at_share("_r", 0.5), 3).alias("_all"))
    own = legs.where("_g").agg(F.count("*").alias("_m"), F.round(at_share("_r", 0.5), 3).alias("_regional"))
    moved = (F.col("_n") >= MIN_RATIOS) & (F.abs(F.col("_all") - ratio) >= DEAD_RATIO)
    both = got.crossJoin(F.broadcast(own))  # one row each
    return both.select(F.when(moved, F.col("_all")).otherwise(ratio).alias("ratio"), F.when(F.col("_m") >= MIN_RATIOS, F.col("_regional")).otherwise(regional_ratio).alias("regional_ratio"))


def detour_ratio(rows: DataFrame, by: list[str], least: int = 30, default: float = 1.07) -> DataFrame:
    """The middle of outside over own metres for legs above 300 m, to three decimals; default where they are few."""
    legs = rows.where("ours_m > 300").withColumn("_r", F.col("ext_m") / F.col("ours_m"))
    out = legs.groupBy(*by).agg(F.count("*").alias("n"), at_share("_r", 0.5).alias("_m"))
    return out.select(*by, "n", F.when(F.col("n") >= least, F.round("_m", 3)).otherwise(default).alias("ratio"))


def verdicts(samples: DataFrame) -> DataFrame:
    """band, verdict, count: samples (od_id, band, minutes of each departure, ext) against their least and most."""
    one = samples.groupBy("od_id", "band").agg(F.min("minutes").alias("low"), F.max("minutes").alias("high"), F.max("ext").alias("ext"))
    verdict = F.when(F.col("ext") < F.col("low"), "network missing").when(F.col("ext") > F.col("high"), "optimistic").otherwise("luck")
    return one.groupBy("band", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def effective_speeds(rows: DataFrame, by: list[str]) -> DataFrame:
    """n and the middle km/h of legs (ours_m, ours_sec) above 300 m."""
    legs = rows.where("ours_m > 300 AND ours_sec > 0").withColumn("_v", F.col("ours_m") / F.col("ours_sec") * 3.6)
    return legs.groupBy(*by).agg(F.count("*").alias("n"), F.round(at_share("_v", 0.5), 3).alias("kmh"))


def worst(rows: DataFrame, error: str, ties: list[str], limit: int = 12) -> DataFrame:
    """The rows that are furthest off."""
    return rows.orderBy(F.abs(F.col(error)).desc(), *ties).limit(limit)


def door_to_door(ods: DataFrame, budget: int) -> DataFrame:
    """One row over ods (ours, ext in minutes): how well being within the budget agrees, and the errors.

    precision: of those that ours calls within, the share that the outside does; recall the other way round.
    """
    ours, ext = F.col("ours") <= budget, F.col("ext") <= budget
    both, mine, theirs = F.count_if(ours & ext), F.count_if(ours), F.count_if(ext)
    error = F.col("ours") - F.col("ext")
    return ods.agg(F.count("*").alias("n"), F.round(both / F.nullif(mine, F.lit(0)), 4).alias("precision"), F.round(both / F.nullif(theirs, F.lit(0)), 4).alias("recall"), F.round(F.avg(error), 4).alias("bias"), F.round(F.avg(F.abs(error)), 4).alias("mae"), upper_middle("ours - ext").alias("median"))
