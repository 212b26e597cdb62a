"""Contracts and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachbase.functions.exprs import price_label
from reachbase.operators import housing
from reachbase.plans.registry import query

_ROOMS = """
rooms AS (
  SELECT *, CASE WHEN area <= 33 THEN 'ONE' WHEN area <= 50 THEN 'TWO' ELSE 'THREE' END AS room, monthly + amount * CAST(0.055 AS double) / 12 AS equivalent
  FROM {deal} WHERE area > 0
)"""
_RENT = "CASE WHEN count(*) FILTER (WHERE monthly > 0) > 0 THEN CAST(greatest(1, floor(list_sort(list(equivalent) FILTER (WHERE monthly > 0))[count(*) FILTER (WHERE monthly > 0) // 2 + 1] - 1000 * CAST(0.055 AS double) / 12 + 0.5)) AS int) END"


def _upper(value: str, where: str) -> str:
    return f"list_sort(list({value}) FILTER (WHERE {where}))[count(*) FILTER (WHERE {where}) // 2 + 1]"


@query(f"""
WITH {_ROOMS}
SELECT sgg, umd, room, count(*) AS deals, {_upper('amount', 'monthly = 0 AND amount > 0')} AS jeonse, count(*) FILTER (WHERE monthly = 0 AND amount > 0) AS jeonse_n,
       {_RENT} AS rent, count(*) FILTER (WHERE monthly > 0) AS rent_n
FROM rooms GROUP BY sgg, umd, room""")
def room_price_by_area(t):
    return housing.area_rooms(t("deal"))


@query(f"""
WITH {_ROOMS}, by_month AS (SELECT sgg, umd, room, ym, {_RENT} AS rent FROM rooms GROUP BY sgg, umd, room, ym),
grid AS (SELECT * FROM (SELECT DISTINCT sgg, umd, room FROM rooms) CROSS JOIN (SELECT DISTINCT ym FROM {{deal}}))
SELECT sgg, umd, room, array_to_string(list(coalesce(CAST(rent AS varchar), '-') ORDER BY ym), ',') AS trend
FROM grid LEFT JOIN by_month USING (sgg, umd, room, ym) GROUP BY sgg, umd, room""")
def price_trend_array(t):
    trend = housing.room_trend(t("deal"))
    return trend.withColumn("trend", F.array_join(F.transform("trend", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ","))


@query(f"""
WITH d AS (
  SELECT *, monthly + amount * CAST(0.055 AS double) / 12 AS equivalent, row_number() OVER (PARTITION BY seq ORDER BY ym DESC, ord, line_no, umd) AS place FROM {{deal}})
SELECT seq, max(umd) FILTER (WHERE place = 1) AS umd, max(ym) AS ym, {_upper('amount', "trade = 'SALE' AND amount > 0")} AS sale,
       {_upper('amount', "trade <> 'SALE' AND monthly = 0 AND amount > 0")} AS jeonse, CAST(CASE WHEN max(monthly) > 0 THEN 1000 END AS int) AS deposit, {_RENT} AS monthly,
       min(area) FILTER (WHERE area > 0) AS area_min, max(area) FILTER (WHERE area > 0) AS area_max, count(*) AS deals
FROM d GROUP BY seq""")
def building_summary(t):
    return housing.building_summary(t("deal"), ["ord", "line_no"])


@query(f"""
WITH {_ROOMS}
SELECT seq, room, count(*) AS n, {_RENT} AS m, {_upper('amount', 'monthly = 0')} AS j FROM rooms GROUP BY seq, room""")
def building_room_prices(t):
    return housing.building_rooms(t("deal"))


@query("""
SELECT count(*) AS n, file_no, sum(amount) AS amount FROM (
  SELECT d.* FROM {deal} d WHERE NOT EXISTS (
    SELECT 1 FROM {deal} e WHERE e.seq = d.seq AND e.umd = d.umd AND e.ym = d.ym AND e.kind = d.kind AND e.monthly = d.monthly AND e.file_no < d.file_no)
) GROUP BY file_no""")
def contracts_bag_union(t):
    kept = housing.bag_union(t("deal"), ["seq", "umd", "ym", "kind", "monthly"])
    return kept.groupBy("file_no").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query(f"""
WITH {_ROOMS} SELECT kind, ym, {_RENT} AS rent, count(*) AS deals FROM rooms GROUP BY kind, ym""")
def base_rent_normalised(t):
    return housing.with_rooms(t("deal")).groupBy("kind", "ym").agg(housing.base_rent(where="monthly > 0").alias("rent"), F.count("*").alias("deals"))


@query("""
SELECT seq, ord, CASE WHEN amount >= 10000 THEN regexp_replace(printf('%.1f', floor(amount / 1000.0 + 0.5) / 10), '[.]0$', '') || '억' ELSE format('{:,}', amount) || '만' END AS label
FROM {deal}""".replace("{:,}", "{{:,}}"))
def price_label_text(t):
    return t("deal").select("seq", "ord", price_label("amount").alias("label"))


@query(f"""
WITH {_ROOMS}, old AS (SELECT seq, room, count(*) AS n FROM rooms WHERE file_no = 0 GROUP BY seq, room), fresh AS (SELECT seq, room, count(*) AS n, {_RENT} AS m FROM rooms WHERE file_no = 1 GROUP BY seq, room),
b AS (SELECT seq, array_to_string(list(room || ':' || CAST(n AS varchar) ORDER BY room), ',') AS rooms FROM old GROUP BY seq), f AS (SELECT seq, array_to_string(list(room || ':' || CAST(n AS varchar) ORDER BY room), ',') AS rooms FROM fresh GROUP BY seq)
SELECT b.seq, coalesce(f.rooms, b.rooms) AS rooms, f.seq IS NOT NULL AS found FROM b LEFT JOIN f USING (seq)""")
def repriced_buildings(t):
    deals = t("deal")
    rooms = housing.building_rooms(deals.where("file_no = 0")).groupBy("seq").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("room", F.struct("n", "m", "j").alias("price"))))).alias("rooms"))
    got = housing.reprice(rooms, deals.where("file_no = 1"))
    return got.select("seq", F.array_join(F.transform(F.array_sort(F.map_entries("rooms")), lambda e: F.concat_ws(":", e["key"], e["value"]["n"].cast("string"))), ",").alias("rooms"), "found")
