"""Rental contracts: medians by neighbourhood, room and building. Money is in units of 10,000."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions.exprs import room_type
from reachbase.functions.medians import upper_middle

#: Yearly rate at which a deposit counts as rent, and the deposit that rents are compared at.
RATE, BASE_DEPOSIT = 0.055, 1000


def monthly_equivalent() -> Column:
    return F.col("monthly") + F.col("amount") * RATE / 12


def base_rent(value: str = "equivalent", where: str | None = None) -> Column:
    """The middle monthly equivalent less the base deposit's share, rounded, 1 at least."""
    middle = upper_middle(value, where)
    return F.when(middle.isNotNull(), F.greatest(F.lit(1), F.floor(middle - BASE_DEPOSIT * RATE / 12 + 0.5).cast("int")))


def with_rooms(deals: DataFrame) -> DataFrame:
    return deals.withColumn("room", room_type("area")).where("room IS NOT NULL").withColumn("equivalent", monthly_equivalent())


def area_rooms(deals: DataFrame) -> DataFrame:
    """sgg, umd, room: deals, jeonse and its count, base rent and its count."""
    rooms = with_rooms(deals)
    return rooms.groupBy("sgg", "umd", "room").agg(
        F.count("*").alias("deals"),
        upper_middle("amount", "monthly = 0 AND amount > 0").alias("jeonse"),
        F.count_if((F.col("monthly") == 0) & (F.col("amount") > 0)).alias("jeonse_n"),
        base_rent(where="monthly > 0").alias("rent"),
        F.count_if(F.col("monthly") > 0).alias("rent_n"),
    )


def room_trend(deals: DataFrame) -> DataFrame:
    """sgg, umd, room: base rents of all months of the table as an array, null where there was none."""
    rooms = with_rooms(deals)
    months = deals.select("ym").distinct()
    groups = rooms.select("sgg", "umd", "room").distinct()
    by_month = rooms.groupBy("sgg", "umd", "room", "ym").agg(base_rent(where="monthly > 0").alias("rent"))
    grid = groups.crossJoin(F.broadcast(months))  # months are a calendar, a few hundred at most
    rows = grid.join(by_month, ["sgg", "umd", "room", "ym"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("ym", "rent")))
    return rows.groupBy("sgg", "umd", "room").agg(F.transform(ordered, lambda x: x["rent"]).alias("trend"))


def building_summary(deals: DataFrame, ordinal: list[str]) -> DataFrame:
    """One row for each building: its latest contract's place, prices, area range and count.

    Of contracts in the latest month the first by ordinal gives the place. Sales (trade SALE)
    aren't long leases. A rent is compared at the base deposit: deposit and rent aren't medians
    of their own, which need not belong together. Null prices where there is no such contract.
    """
    latest = F.min(F.struct((-F.col("ym")).alias("_ym"), *ordinal, "umd"))
    sold = "trade = 'SALE' AND amount > 0"
    rent = base_rent(where="monthly > 0")
    return deals.withColumn("equivalent", monthly_equivalent()).groupBy("seq").agg(
        latest["umd"].alias("umd"),
        F.max("ym").alias("ym"),
        upper_middle("amount", sold).alias("sale"),
        upper_middle("amount", "trade <> 'SALE' AND monthly = 0 AND amount > 0").alias("jeonse"),
        F.when(rent.isNotNull(), BASE_DEPOSIT).alias("deposit"),
        rent.alias("monthly"),
        F.min(F.when(F.col("area") > 0, F.col("area"))).alias("area_min"),
        F.max(F.when(F.col("area") > 0, F.col("area"))).alias("area_max"),
        F.count("*").alias("deals"),
    )


def building_rooms(deals: DataFrame) -> DataFrame:
    """seq, room: count, base rent and jeonse."""
    rooms = with_rooms(deals)
    return rooms.groupBy("seq", "room").agg(F.count("*").alias("n"), base_rent(where="monthly > 0").alias("m"), upper_middle("amount", "monthly = 0").alias("j"))


def reprice(buildings: DataFrame, deals: DataFrame) -> DataFrame:
    """buildings with the rooms' new prices where there are any (seq, rooms), and whether they were found."""
    fresh = building_rooms(deals).groupBy("seq").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("room", F.struct("n", "m", "j").alias("price"))))).alias("_rooms"))
    joined = buildings.join(fresh, "seq", "left")
    return joined.withColumn("rooms", F.coalesce("_rooms", "rooms")).withColumn("found", F.col("_rooms").isNotNull()).drop("_rooms")


def bag_union(rows: DataFrame, ids: list[str], file: str = "file_no") -> DataFrame:
    """All rows but those whose ids stood in an earlier file; repeats within a file are meant."""
    first = Window.partitionBy(*ids)
    return rows.withColumn("_first", F.min(file).over(first)).where(F.col(file) == F.col("_first")).drop("_first")
