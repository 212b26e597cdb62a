"""Searching neighbourhoods, amenities, names and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachbase.functions import exprs
from reachbase.functions.medians import upper_middle
from reachbase.operators import graph, housing, outline, reach
from reachbase.plans.housing_queries import _RENT, _ROOMS, _upper
from reachbase.plans.registry import query
from reachbase.sources import files

BUDGET, WALK_CAP, PRICE_CAP = 60, 15, 9000
_DISTANCE, _PRESENCE = ["MACHINERY"], ["FURNITURE"]

_PRICES = f"""{_ROOMS},
prices AS (SELECT umd AS dong_id, room, {_upper('amount', 'monthly = 0 AND amount > 0')} AS jeonse, {_RENT} AS rent, count(*) AS n FROM rooms GROUP BY umd, room),
near AS (SELECT origin, dong_id, min(minutes) AS minutes FROM {{reach}} WHERE minutes <= 60 AND (walk IS NULL OR walk <= 15) GROUP BY origin, dong_id)"""


def _prices(t):
    rooms = housing.with_rooms(t("deal")).groupBy(F.col("umd").alias("dong_id"), "room")
    rent = housing.base_rent(where="monthly > 0")
    return rooms.agg(upper_middle("amount", "monthly = 0 AND amount > 0").alias("jeonse"), F.when(rent.isNotNull(), housing.BASE_DEPOSIT).alias("deposit"), rent.alias("rent"), F.count("*").alias("n"))


def _near(t):
    return reach.within_budget(t("reach"), BUDGET, WALK_CAP).groupBy("origin", "dong_id").agg(F.min("minutes").alias("minutes"))


@query("SELECT origin, slot, count(*) AS n, min(minutes) AS least FROM {reach} WHERE minutes <= 60 AND (walk IS NULL OR walk <= 15) GROUP BY origin, slot")
def reach_threshold(t):
    return reach.within_budget(t("reach"), BUDGET, WALK_CAP).groupBy("origin", "slot").agg(F.count("*").alias("n"), F.min("minutes").alias("least"))


@query(f"WITH {_PRICES} SELECT origin, dong_id, minutes, jeonse AS price, n FROM near JOIN prices USING (dong_id) WHERE room = 'ONE' AND n >= 10 AND jeonse <= {PRICE_CAP}")
def dong_search(t):
    return reach.affordable(_near(t), _prices(t), "ONE", "JEONSE", PRICE_CAP, BUDGET).select("origin", "dong_id", "minutes", "price", "n")


@query(f"""
WITH {_PRICES}, flat AS (SELECT stop_id AS dong_id FROM {{elevation}} WHERE metres <= 10)
SELECT origin, dong_id, minutes, rent AS price, 1000 AS deposit, n FROM near JOIN prices USING (dong_id) JOIN flat USING (dong_id) WHERE room = 'TWO' AND n >= 10 AND rent > 0 AND minutes <= 60""")
def dong_search_flat(t):
    climbs = t("elevation").select(F.col("stop_id").alias("dong_id"), F.col("metres").alias("climb"))
    return reach.affordable(_near(t), _prices(t), "TWO", "WOLSE", 0, BUDGET, climbs).select("origin", "dong_id", "minutes", "price", "deposit", "n")


@query(f"""
WITH {_PRICES}, own AS (SELECT seq, umd AS dong_id, room, count(*) AS n, {_RENT} AS m FROM rooms GROUP BY seq, umd, room)
SELECT origin, seq, dong_id, minutes, m AS price, own.n FROM near JOIN own USING (dong_id) WHERE room = 'ONE' AND m <= 120""")
def rental_search(t):
    own = housing.with_rooms(t("deal")).groupBy("seq", F.col("umd").alias("dong_id"), "room").agg(F.count("*").alias("n"), housing.base_rent(where="monthly > 0").alias("m"), F.lit(None).cast("int").alias("j"))
    return reach.affordable_buildings(_near(t), own, "ONE", "WOLSE", 120, BUDGET).select("origin", "seq", "dong_id", "minutes", "price", "n")


@query(f"""
WITH {_ROOMS}, by_month AS (SELECT umd, room, ym // 100 AS y, {_RENT} AS v FROM rooms GROUP BY umd, room, ym // 100),
c AS (SELECT umd AS dong_id, room, list(v ORDER BY y) AS trend, count(v) AS known, min(v) AS low, max(v) AS high FROM by_month GROUP BY umd, room),
p AS (SELECT umd AS dong_id, room, count(*) AS n, {_RENT} AS rent FROM rooms GROUP BY umd, room)
SELECT dong_id, room, n, n < 10 AS few, CASE WHEN rent > 0 AND known >= 3 THEN array_to_string(list_filter(trend, lambda x: x IS NOT NULL), ',') END AS trend, CASE WHEN rent > 0 AND known >= 3 THEN low END AS low, CASE WHEN rent > 0 AND known >= 3 THEN high END AS high
FROM c JOIN p USING (dong_id, room)""")
def detail_cards(t):
    years = housing.with_rooms(t("deal")).groupBy(F.col("umd").alias("dong_id"), "room", F.floor(F.col("ym") / 100).alias("y")).agg(housing.base_rent(where="monthly > 0").alias("v"))
    trend = years.groupBy("dong_id", "room").agg(F.array_sort(F.collect_list(F.struct("y", "v"))).alias("_t")).select("dong_id", "room", F.transform("_t", lambda x: x["v"]).alias("trend"))
    cards = reach.detail_card(_prices(t).join(trend, ["dong_id", "room"]))
    return cards.withColumn("trend", F.array_join("trend", ","))


@query(f"WITH {_PRICES}, b AS (SELECT dong_id, min(minutes) AS minutes FROM near GROUP BY dong_id) SELECT dong_id, minutes, jeonse AS price, n FROM b JOIN prices USING (dong_id) WHERE room = 'ONE' AND n >= 10 AND jeonse <= {PRICE_CAP} ORDER BY price, minutes, dong_id LIMIT 5")
def dong_rank_top5(t):
    best = _near(t).groupBy("dong_id").agg(F.min("minutes").alias("minutes"))
    found = reach.affordable(best, _prices(t), "ONE", "JEONSE", PRICE_CAP, BUDGET).select("dong_id", "minutes", "price", "n")
    return reach.first_five(found, [F.col("price"), F.col("minutes")])


@query("""
WITH c AS (SELECT origin, dong_id, min(minutes) AS m FROM {reach} GROUP BY ALL)
SELECT a.dong_id, a.origin AS origin, b.origin AS other, greatest(a.m, b.m) AS minutes FROM c a JOIN c b ON a.dong_id = b.dong_id AND b.origin = a.origin + 1 WHERE greatest(a.m, b.m) <= 60""")
def two_origin_intersection(t):
    c = t("reach").groupBy("origin", "dong_id").agg(F.min("minutes").alias("m"))
    other = c.select("dong_id", F.col("origin").alias("other"), F.col("m").alias("m2"), (F.col("origin") - 1).alias("origin"))
    both = c.join(other, ["dong_id", "origin"]).withColumn("minutes", F.greatest("m", "m2")).where(F.col("minutes") <= BUDGET)
    return both.select("dong_id", "origin", "other", "minutes")


_THRESHOLDS = """
th AS (SELECT code, CAST(CASE WHEN code = 'FURNITURE' THEN 1 WHEN code = 'MACHINERY' THEN greatest(500, floor(list_sort(list(n))[least(count(*), CAST(floor(count(*) * 0.4) AS bigint) + 1)] / 500.0 + 0.5) * 500) ELSE list_sort(list(n))[least(count(*), CAST(floor(count(*) * 0.6) AS bigint) + 1)] END AS int) AS threshold FROM {amenity} GROUP BY code)"""


@query(f"WITH {_THRESHOLDS} SELECT * FROM th")
def amenity_thresholds(t):
    return reach.amenity_thresholds(t("amenity"), _DISTANCE, _PRESENCE)


@query(f"""
WITH {_THRESHOLDS} SELECT dong_id FROM {{amenity}} JOIN th USING (code) WHERE code IN ('MACHINERY', 'BUILDING', 'FURNITURE')
GROUP BY dong_id HAVING count(*) FILTER (WHERE CASE WHEN code = 'MACHINERY' THEN n <= threshold ELSE n >= threshold END) = 3""")
def amenity_filter(t):
    return reach.passing(t("amenity"), reach.amenity_thresholds(t("amenity"), _DISTANCE, _PRESENCE), ["MACHINERY", "BUILDING", "FURNITURE"], _DISTANCE)


@query("""
WITH g AS (SELECT dong_id, code FROM {dong} CROSS JOIN (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS code)),
v AS (SELECT g.dong_id, g.code, coalesce(a.n, CASE WHEN g.code = 'MACHINERY' THEN 1000000000 ELSE 0 END) * CASE WHEN g.code = 'MACHINERY' THEN -1 ELSE 1 END AS v FROM g LEFT JOIN {amenity} a ON a.dong_id = g.dong_id AND a.code = g.code),
p AS (SELECT dong_id, (row_number() OVER (PARTITION BY code ORDER BY v, dong_id) - 1)::double / greatest(1, count(*) OVER (PARTITION BY code) - 1) AS p FROM v)
SELECT dong_id, round(avg(p), 9) AS rank FROM p GROUP BY dong_id""")
def amenity_rank(t):
    return reach.amenity_ranks(t("dong"), t("amenity"), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], _DISTANCE)


@query(f"""
WITH {_PRICES}, m AS (SELECT room AS key, avg(jeonse) AS jeonse, avg(rent) AS rent, sum(n)::double AS n FROM prices GROUP BY room),
l AS (SELECT key, 'jeonse' AS measure, round(jeonse, 6) AS value, true AS low FROM m UNION ALL SELECT key, 'rent', round(rent, 6), true FROM m UNION ALL SELECT key, 'n', n, false FROM m)
SELECT key, measure, value, count(*) OVER (PARTITION BY measure) > 1 AND value = CASE WHEN low THEN min(value) OVER (PARTITION BY measure) ELSE max(value) OVER (PARTITION BY measure) END AS best FROM l WHERE value IS NOT NULL""")
def compare_best(t):
    rows = _prices(t).groupBy(F.col("room").alias("key")).agg(F.round(F.avg("jeonse"), 6).alias("jeonse"), F.round(F.avg("rent"), 6).alias("rent"), F.sum("n").alias("n"))
    return reach.best_values(rows, {"jeonse": True, "rent": True, "n": False})


@query("""
WITH h AS (SELECT p_partkey AS key, p_name AS name, starts_with(lower(p_name), 're') AS prefix FROM {part} WHERE contains(lower(p_name), 're')), c AS (SELECT count(*) AS matches FROM h)
SELECT key, name, prefix, matches FROM h CROSS JOIN c ORDER BY prefix DESC, key LIMIT 120""")
def prefix_search(t):
    return reach.prefix_search(t("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")), "re")


@query("""
WITH n AS (SELECT p_partkey, CAST(p_size AS varchar) || CASE WHEN p_partkey % 3 = 0 THEN '출근' WHEN p_partkey % 3 = 1 THEN '' ELSE '-1예약' END AS name FROM {part})
SELECT p_partkey, CASE WHEN regexp_extract(name, '^(.*?)([가-힣]+)$', 1) <> '' THEN regexp_extract(name, '^(.*?)([가-힣]+)$', 1) ELSE name END AS number, CASE WHEN regexp_extract(name, '^(.*?)([가-힣]+)$', 1) <> '' THEN regexp_extract(name, '^(.*?)([가-힣]+)$', 2) ELSE '' END AS tail FROM n""")
def route_name_split(t):
    k = F.col("p_partkey")
    name = F.concat(F.col("p_size").cast("string"), F.when(k % 3 == 0, "출근").when(k % 3 == 1, "").otherwise("-1예약"))
    return t("part").select(k, exprs.split_route_name(name).alias("_s")).select("p_partkey", "_s.number", "_s.tail")


@query("SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\([^)]*\\)', '', 'g'), '[\\s.·,\\-]', '', 'g') AS name_key FROM {documents}")
def name_normalise(t):
    return t("documents").select("doc_id", exprs.stop_name_key("text").alias("name_key"))


@query("""
WITH x AS (SELECT page_id, '<item><id>' || page_id || '</id>' || '<url> ' || replace(coalesce(url, ''), '&', '&amp;') || ' </url></item><item><id>n' || coalesce(strlen(html), 0) || '</id></item>' AS body FROM {pages}),
i AS (SELECT page_id, unnest(regexp_extract_all(body, '(?s)<item>(.*?)</item>', 1)) AS item FROM x),
v AS (SELECT page_id, trim(regexp_extract(item, '(?s)<id>(.*?)</id>', 1)) AS id, trim(regexp_extract(item, '(?s)<url>(.*?)</url>', 1)) AS url FROM i)
SELECT page_id, id, replace(replace(replace(replace(replace(replace(url, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&') AS url FROM v""")
def landed_items(t):
    item = F.concat(F.lit("<item><id>"), F.col("page_id").cast("string"), F.lit("</id><url> "), F.replace(F.coalesce("url", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit(" </url></item><item><id>n"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"), F.lit("</id></item>"))
    return files.xml_items(t("pages").select("page_id", item.alias("body")), "body", "item", ["id", "url"], keep=["page_id"])


@query("""
WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>([^<]*(?:<[^/l][^>]*>[^<]*</a>)?)</li>', 1)) AS item FROM {pages})
SELECT page_id, replace(replace(replace(replace(replace(replace(item, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&') AS item, count(*) AS n FROM i GROUP BY 1, 2""")
def xml_items(t):
    items = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<li>([^<]*(?:<[^/l][^>]*>[^<]*</a>)?)</li>"), 1)).alias("item"))
    return items.groupBy("page_id", exprs.unescape_xml("item").alias("item")).agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 250 <= 200 THEN CAST(c_custkey % 250 AS int) END AS t, CASE WHEN c_custkey % 140 BETWEEN 10 AND 120 THEN CAST(c_custkey % 140 AS int) END AS b, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS room FROM {customer}""")
def share_state(t):
    k = F.col("c_custkey")
    link = F.concat_ws("&", F.concat(F.lit("t="), k % 250), F.concat(F.lit("b="), k % 140), F.concat(F.lit("r="), F.url_encode("c_mktsegment")))
    got = F.str_to_map(link, F.lit("&"), F.lit("="))
    value = lambda name, low, high: F.when(got[name].try_cast("int").between(low, high), got[name].try_cast("int"))
    room = F.url_decode(got["r"])
    return t("customer").select("c_custkey", value("t", 0, 200).alias("t"), value("b", 10, 120).alias("b"), F.when(room.isin("BUILDING", "MACHINERY"), room).alias("room"))


_POINTS = "pts AS (SELECT c_custkey AS id, CAST((c_custkey * 53) % 101 * 40 AS double) AS y, CAST((c_custkey * 29) % 103 * 40 AS double) AS x, CAST(c_custkey % 80 AS int) AS minutes FROM {customer})"
_RASTER = f"""{_POINTS},
p AS (SELECT *, least((60 - minutes) * 66.0::double, 990.0::double) AS r FROM pts WHERE minutes <= 60),
c AS (SELECT p.*, i AS row, j AS col, sqrt(pow((i + 0.5::double) * 200 - y, 2) + pow((j + 0.5::double) * 200 - x, 2)) AS d FROM p CROSS JOIN range(-6, 27) a(i) CROSS JOIN range(-6, 27) b(j)),
field AS (SELECT row, col, round(min(minutes + d / 66.0::double), 6) AS value FROM c WHERE d <= r GROUP BY row, col)"""


def _field(t):
    k = F.col("c_custkey")
    pts = t("customer").select(((k * 53) % 101 * 40).cast("double").alias("y"), ((k * 29) % 103 * 40).cast("double").alias("x"), (k % 80).cast("int").alias("minutes"))
    return reach.raster(pts, 60, 200.0, 990.0)


@query(f"WITH {_RASTER} SELECT CAST(row AS int) AS row, CAST(col AS int) AS col, value FROM field")
def raster_scatter_min(t):
    return _field(t)


@query(f"""
WITH {_RASTER}, m AS (SELECT a.row, a.col, a.value, count(*) AS n, sum(b.value * CASE WHEN a.row = b.row AND a.col = b.col THEN 4.0::double WHEN a.row = b.row OR a.col = b.col THEN 1.0::double ELSE 0.5::double END) / 10 AS mean FROM field a JOIN field b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL)
SELECT CAST(row AS int) AS row, CAST(col AS int) AS col, round(CASE WHEN n = 9 THEN mean ELSE value END, 4) AS value FROM m""")
def smooth_pass(t):
    return reach.smoothed(_field(t)).withColumn("value", F.round("value", 4))


@query("""
WITH b AS (SELECT c_custkey, 10 + c_custkey % 111 AS budget FROM {customer}),
s AS (SELECT c_custkey, budget, (SELECT arg_min(step, abs(ceil(budget / step) - 4) * 1000 - step) FROM (SELECT unnest([5.0, 10, 15, 20, 30, 60]) AS step)) AS step FROM b)
SELECT c_custkey, budget, array_to_string(list_append(list_filter(range(0, 200, 5), lambda v: v < budget AND v % CAST(step AS bigint) = 0), budget), ',') AS breaks FROM s""")
def band_breaks(t):
    b = t("customer").select("c_custkey", (10 + F.col("c_custkey") % 111).alias("budget"))
    return b.select("c_custkey", "budget", F.array_join(exprs.band_breaks("budget"), ",").alias("breaks"))


@query("""
SELECT list_sort(list(lat))[CAST(floor(count(*) * 0.05) AS bigint) + 1] AS low_lat, list_sort(list(lat))[CAST(floor(count(*) * 0.95) AS bigint) + 1] AS high_lat,
       list_sort(list(lon))[CAST(floor(count(*) * 0.05) AS bigint) + 1] AS low_lon, list_sort(list(lon))[CAST(floor(count(*) * 0.95) AS bigint) + 1] AS high_lon FROM {place}""")
def core_bounds(t):
    return reach.core_bounds(t("place"))


@query("SELECT stop_id, CAST(floor(metres + 0.5) AS bigint) AS metres, CASE WHEN floor(metres + 0.5) >= 40 THEN 'steep' WHEN floor(metres + 0.5) >= 20 THEN 'hilly' WHEN floor(metres + 0.5) > 10 THEN 'rising' ELSE 'flat' END AS word FROM {elevation}")
def climb_words(t):
    rounded = exprs.java_round(F.col("metres"))
    return t("elevation").select("stop_id", rounded.alias("metres"), exprs.climb_word(rounded).alias("word"))


@query(f"""
WITH {_RASTER}, homes AS (SELECT c_custkey AS id, CAST((c_custkey * 31) % 4200 AS double) AS y, CAST((c_custkey * 17) % 4300 AS double) AS x FROM {{customer}})
SELECT id, value AS minutes FROM homes JOIN field ON field.row = floor(y / 200) AND field.col = floor(x / 200) WHERE value <= 45""")
def complexes_on_field(t):
    k = F.col("c_custkey")
    pts = t("customer").select(k.alias("id"), (k * 31 % 4200).cast("double").alias("y"), (k * 17 % 4300).cast("double").alias("x"))
    return reach.on_field(pts, _field(t), 200.0, 45).select("id", "minutes")


_BOX = """
pts AS (SELECT place_id, lat, lon, CAST(place_id % 80 AS int) AS minutes FROM {place}), inside AS (SELECT * FROM pts WHERE minutes <= 60),
b AS (SELECT min(lat) AS la, max(lat) AS lb, min(lon) AS oa, max(lon) AS ob, 111320.0::double AS ky, 111320.0::double * cos(radians((min(lat) + max(lat)) / 2)) AS kx FROM inside),
e AS (SELECT *, la - 990.0::double / ky AS y0, oa - 990.0::double / kx AS x0, (lb + 990.0::double / ky - (la - 990.0::double / ky)) * ky AS h, (ob + 990.0::double / kx - (oa - 990.0::double / kx)) * kx AS w FROM b),
z AS (SELECT min(i) AS i FROM range(9) r(i) CROSS JOIN e WHERE ceil(h / (25 * pow(1.5, i))) * ceil(w / (25 * pow(1.5, i))) <= 16000),
g AS (SELECT *, 25 * pow(1.5, i) AS cell, ceil(h / (25 * pow(1.5, i))) + 1 AS nr, ceil(w / (25 * pow(1.5, i))) + 1 AS nc FROM e CROSS JOIN z),
p AS (SELECT minutes, (lat - y0) * ky AS y, (lon - x0) * kx AS x, least((60 - minutes) * 66.0::double, 990.0::double) AS r, cell, nr, nc FROM inside CROSS JOIN g WHERE minutes < 60),
s AS (SELECT p.*, CAST(floor(y / cell + 0.5) AS int) AS mr, CAST(floor(x / cell + 0.5) AS int) AS mc, CAST(ceil(r / cell) + 1 AS int) AS sp FROM p),
i AS (SELECT *, unnest(range(greatest(0, mr - sp), least(nr - 1, mr + sp)::int + 1)) AS row FROM s), j AS (SELECT *, unnest(range(greatest(0, mc - sp), least(nc - 1, mc + sp)::int + 1)) AS col FROM i),
d AS (SELECT *, sqrt(pow(row * cell - y, 2) + pow(col * cell - x, 2)) AS d FROM j),
cov AS (SELECT row, col, min(minutes + d / 66.0::double) AS v FROM d WHERE d <= r AND minutes + d / 66.0::double <= 60 GROUP BY row, col),
fld AS (SELECT CAST(a.row AS int) AS row, CAST(b.col AS int) AS col, round(coalesce(v, 84.0::double), 6) AS minutes FROM (SELECT unnest(range(nr::int)) AS row FROM g) a CROSS JOIN (SELECT unnest(range(nc::int)) AS col FROM g) b LEFT JOIN cov ON cov.row = a.row AND cov.col = b.col)"""


def _grid(t):
    pts = t("place").withColumn("minutes", (F.col("place_id") % 80).cast("int"))
    return reach.field_grid(pts, 60, cell_m=25.0, most_cells=16_000)


@query(f"WITH {_BOX} SELECT row, col, minutes FROM fld")
def field_with_growing_cells(t):
    return _grid(t)


@query(f"WITH {_BOX} SELECT row, col, CAST(least(60, floor(minutes / 15) * 15) AS int) AS band FROM fld WHERE minutes < 84")
def band_of_cells(t):
    return reach.banded(_grid(t), 60)


@query(f"""
WITH {_RASTER}, p0 AS (SELECT row, col, value FROM field),
""" + ",\n".join(f"""m{i} AS (SELECT a.row, a.col, a.value, count(*) AS n, sum(b.value * CASE WHEN a.row = b.row AND a.col = b.col THEN 4.0::double WHEN a.row = b.row OR a.col = b.col THEN 1.0::double ELSE 0.5::double END) / 10 AS mean FROM p{i} a JOIN p{i} b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL),
p{i + 1} AS (SELECT row, col, CASE WHEN n = 9 THEN mean ELSE value END AS value FROM m{i})""" for i in range(6)) + "\nSELECT CAST(row AS int) AS row, CAST(col AS int) AS col, round(value, 4) AS value FROM p6")
def smooth_six_passes(t):
    field = _field(t)
    for _ in range(6):
        field = reach.smoothed(field)
    return field.withColumn("value", F.round("value", 4))


@query("""
WITH q AS (SELECT list_sort(list(lat)) AS a, list_sort(list(lon)) AS o, count(*) AS n FROM {place}),
v AS (SELECT a[least(n, floor(n * 0.05)::bigint + 1)] AS la, a[least(n, floor(n * 0.95)::bigint + 1)] AS lb, a[least(n, floor(n * 0.5)::bigint + 1)] AS mid, o[least(n, floor(n * 0.05)::bigint + 1)] AS oa, o[least(n, floor(n * 0.95)::bigint + 1)] AS ob FROM q)
SELECT oa - 2700.0::double / (111000 * cos(radians(mid))) AS west, ob + 2700.0::double / (111000 * cos(radians(mid))) AS east, la - 2700.0::double / 111000 AS south, lb + 2700.0::double / 111000 AS north FROM v""")
def padded_bounds(t):
    return reach.padded_bounds(t("place"), 15)


@query("SELECT stop_id AS station_id, pow((lon - 127.01::double) * cos(radians(37.51::double)), 2) + pow(lat - 37.51::double, 2) AS d2 FROM {stop} ORDER BY d2, stop_id LIMIT 300")
def drawn_stations(t):
    stations = t("stop").select(F.col("stop_id").alias("station_id"), "lat", "lon")
    return reach.drawn_stations(stations, 37.51, 127.01).select("station_id", "d2")


@query(f"""
WITH RECURSIVE {_RASTER}, cell AS (SELECT CAST(floor(value / 15) AS int) AS band, row, col FROM field),
side AS (SELECT band, col + u AS x, row + v AS y, col + k AS kx, row + l AS ky, flat, d FROM cell CROSS JOIN (VALUES (0, 0, 0, 0, true, 0), (1, 0, 1, 0, false, 1), (1, 1, 0, 1, true, 2), (0, 1, 0, 0, false, 3)) s(u, v, k, l, flat, d)),
edge AS (SELECT band, x, y, d FROM side QUALIFY count(*) OVER (PARTITION BY band, kx, ky, flat) = 1),
ends AS (SELECT *, x + CASE d WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS ex, y + CASE d WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS ey FROM edge),
nxt AS MATERIALIZED (SELECT e.band, e.x, e.y, e.d, o.x AS nx, o.y AS ny, o.d AS nd FROM ends e JOIN edge o ON o.band = e.band AND o.x = e.ex AND o.y = e.ey QUALIFY row_number() OVER (PARTITION BY e.band, e.x, e.y, e.d ORDER BY (e.d + 5 - o.d) % 4) = 1),
walk AS (SELECT band, x AS sx, y AS sy, d AS sd, x, y, d FROM edge UNION SELECT w.band, w.sx, w.sy, w.sd, nx, ny, nd FROM walk w JOIN nxt n ON n.band = w.band AND n.x = w.x AND n.y = w.y AND n.d = w.d),
ring AS (SELECT band, sx, sy, sd, min([x, y, d]) AS ring FROM walk GROUP BY ALL),
turn AS (SELECT n.band, r.ring, n.x, n.y, n.nx, n.ny, n.d <> n.nd AS turns FROM nxt n JOIN ring r ON r.band = n.band AND r.sx = n.x AND r.sy = n.y AND r.sd = n.d)
SELECT band, array_to_string(ring, ',') AS ring, count(*) FILTER (WHERE turns) AS corners, CAST(sum(x * ny - nx * y) / 2 AS bigint) AS area FROM turn GROUP BY band, ring""")
def band_outlines(t):
    """Rings around the cells of each band of 15 minutes, with their corners and areas; holes are negative."""
    cells = _field(t).select(F.floor(F.col("value") / 15).cast("int").alias("band"), "row", "col")
    return outline.ring_areas(outline.rings(graph.cut_lineage(cells)))
