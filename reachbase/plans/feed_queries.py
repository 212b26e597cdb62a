"""Feeds in one shape, cleaning, joins to what is known, and the scalar rules that they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachbase.functions import exprs
from reachbase.operators import checks, feeds, ordered
from reachbase.operators.ranges import parts_for
from reachbase.plans.registry import query

_KIND = "CASE CAST({c} AS varchar) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in exprs.ROUTE_TYPES.items()) + " ELSE '일반버스' END"

# A region has the routes whose key isn't a multiple of 3; a city all, some of them under a region's prefix.
_CITY = "city AS (SELECT CAST(s_suppkey AS varchar) AS id, CAST(s_suppkey % 9 AS varchar) AS type, s_suppkey AS k FROM {supplier})"
_REGION = "region AS (SELECT CASE WHEN s_suppkey % 3 = 1 THEN 'GGGB' ELSE 'GICB' END || CAST(s_suppkey AS varchar) AS id, s_suppkey AS k FROM {supplier} WHERE s_suppkey % 3 > 0)"


def _city(t):
    k = F.col("s_suppkey")
    return t("supplier").select(k.cast("string").alias("id"), F.concat(k.cast("string"), F.when(k % 4 == 0, "출근").otherwise("")).alias("no"), (k % 9).cast("string").alias("type"), F.format_string("%02d30", (k % 30).cast("int")).alias("first"), F.lit("2310").alias("last"), (k % 20 + 5).alias("headway"))


def _region(t):
    k = F.col("s_suppkey")
    own = t("supplier").where(k % 3 > 0).withColumn("id", F.concat(F.when(k % 3 == 1, "GGGB").otherwise("GICB"), k.cast("string")))
    routes = own.select("id", F.lit("G").alias("city"), F.concat(k.cast("string"), F.lit("-1")).alias("no"), F.lit("일반버스").alias("type"))
    return routes, own.where(k % 5 > 0).select("id", F.lit("0510").alias("first"), F.lit("").alias("last"), (k % 30 + 8).alias("headway"))


@query(f"""
WITH {_CITY}, {_REGION}
SELECT c.id, r.id AS region_id FROM city c LEFT JOIN region r ON r.k = c.k""")
def route_handover(t):
    return feeds.handovers(_city(t), _region(t)[0])


@query(f"""
WITH {_CITY}, {_REGION},
own AS (SELECT 'S' || id AS id, id AS no, CASE WHEN k % 4 = 0 THEN '출근' ELSE '' END AS tail, {_KIND.format(c='type')} AS type, CASE WHEN k % 30 <= 27 THEN printf('%02d30', k % 30) ELSE '0500' END AS first_at, '2310' AS last_at, CAST(k % 20 + 5 AS int) AS headway, 'S' AS city FROM city WHERE k % 3 = 0)
SELECT * FROM own UNION ALL
SELECT id, CAST(k AS varchar) || '-1', '', '일반버스', CASE WHEN k % 5 > 0 THEN '0510' ELSE '0500' END, '2300', CASE WHEN k % 5 > 0 THEN CAST(k % 30 + 8 AS int) END, 'G' FROM region""")
def routes_in_one_shape(t):
    routes, details = _region(t)
    alone = feeds.handovers(_city(t), routes).where("region_id IS NULL").select("id")
    return feeds.one_shape(feeds.city_routes(_city(t).join(alone, "id", "left_semi")), feeds.region_routes(routes, details))


@query("""
WITH s AS (SELECT l_orderkey AS route_id, l_linenumber AS ord, l_suppkey AS stop_id FROM {lineitem}),
j AS (SELECT s.*, lat, lon FROM s JOIN {stop} USING (stop_id) WHERE stop_id % 7 > 0)
SELECT route_id, count(*) AS n, sum(stop_id) AS stops FROM j WHERE route_id IN (SELECT route_id FROM j GROUP BY route_id HAVING count(*) >= 2) GROUP BY route_id""")
def route_stops_placed(t):
    stops = t("lineitem").select(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("ord"), F.col("l_suppkey").alias("stop_id"))
    table = t("stop").withColumn("lat", F.when(F.col("stop_id") % 7 > 0, F.col("lat")))
    return feeds.route_stops(stops, table).groupBy("route_id").agg(F.count("*").alias("n"), F.sum("stop_id").alias("stops"))


@query("""
SELECT 'city' AS feed, CAST(user_id AS varchar) AS route_id, count(*) FILTER (WHERE event_type = 'view') AS n FROM {events} GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'view') > 0
UNION ALL SELECT 'region', CAST(page_id AS varchar), len(regexp_extract_all(html, '<li>')) FROM {pages} WHERE contains(html, '<li>')""")
def fleets_in_one_shape(t):
    city = feeds.city_fleet(t("events").select(F.col("user_id").cast("string").alias("route_id"), F.when(F.col("event_type") == "view", "1").otherwise("0").alias("running")))
    bodies = t("pages").select(F.col("page_id").cast("string").alias("route_id"), F.regexp_replace("html", "<li>", "<vehicleno>").alias("body"))
    return feeds.one_shape(city.select(F.lit("city").alias("feed"), "*"), feeds.region_fleet(bodies).select(F.lit("region").alias("feed"), "*"))


@query("""
WITH e AS (SELECT l_suppkey AS source, l_partkey AS target, CASE WHEN l_linenumber = 3 THEN '' ELSE CAST(l_linenumber AS varchar) END AS line FROM {lineitem})
SELECT line <> '' AS track, line, count(*) AS n, sum(target) AS targets FROM e GROUP BY line""")
def tracks_and_transfers(t):
    line = F.col("l_linenumber")
    edges = t("lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.when(line == 3, "").otherwise(line.cast("string")).alias("line"))
    tracks, transfers = feeds.split_edges(edges)
    both = tracks.withColumn("track", F.lit(True)).unionByName(transfers.withColumn("track", F.lit(False)))
    return both.groupBy("track", "line").agg(F.count("*").alias("n"), F.sum("target").alias("targets"))


@query("""
WITH w AS (SELECT * FROM {pattern_window} WHERE last_start > first_start AND headway > 300),
s AS (SELECT stop_id FROM {stop} WHERE stop_id % 10 > 0),
tm AS (SELECT * FROM {pattern_stop} WHERE stop_id IN (SELECT stop_id FROM s) AND trip_id IN (SELECT trip_id FROM w)),
k AS (SELECT trip_id FROM tm GROUP BY trip_id HAVING count(*) >= 2)
SELECT 'stops' AS what, count(*) AS n FROM s UNION ALL SELECT 'times', count(*) FROM tm WHERE trip_id IN (SELECT trip_id FROM k) UNION ALL SELECT 'windows', count(*) FROM w WHERE trip_id IN (SELECT trip_id FROM k)""")
def clean_feed(t):
    stops = t("stop").withColumn("location_type", F.when(F.col("stop_id") % 10 == 0, 1))
    windows = t("pattern_window").withColumn("headway", F.when(F.col("headway") > 300, F.col("headway")).otherwise(0))
    return feeds.one_shape(*[x.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, x in zip(("stops", "times", "windows"), feeds.clean_feed(stops, t("pattern_stop"), windows, parts_for(t("lineitem"))), strict=True)])


_LINES = {"1호선": "1", "분당선": "B", "경의선": "K", "수인분당선": "B"}


@query("""
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN '휴일' ELSE '평일' END AS day, ['1호선', '분당선', '경의선', '다른선'][o_orderkey % 4 + 1] AS line_name FROM {orders})
SELECT k AS train, ['1', 'B', 'K'][k % 4 + 1] AS line, k % 2 = 0 AS express, CASE WHEN k % 6 > 0 THEN CAST(round_even(k % 1440 / 1440.0::double * 86400, 0) AS int) END AS arr, CASE WHEN k % 10 > 0 THEN CAST(round_even((k % 1440 + 1) / 1440.0::double * 86400, 0) AS int) END AS dep
FROM r WHERE day = '평일' AND line_name <> '다른선' AND (k % 6 > 0 OR k % 10 > 0) AND k % 11 > 0""")
def spreadsheet_trains(t):
    k = F.col("o_orderkey")
    fraction = lambda x: (x / 1440).cast("string")
    rows = t("orders").select(
        F.when(k % 4 == 0, "휴일").otherwise("평일").alias("day"), F.element_at(F.array(*[F.lit(x) for x in ("1호선", "분당선", "경의선", "다른선")]), (k % 4 + 1).cast("int")).alias("line_name"),
        k.cast("string").alias("train"), F.when(k % 2 == 0, "급행").otherwise("일반").alias("kind"), F.when(k % 11 > 0, " 역 ").otherwise(" ").alias("station"),
        F.when(k % 6 > 0, fraction(k % 1440)).otherwise("").alias("arr"), F.when(k % 10 > 0, fraction(k % 1440 + 1)).alias("dep"),
    )
    return feeds.spreadsheet_stops(rows, _LINES, "평일").select(F.col("train").cast("long").alias("train"), "line", "express", "arr", "dep")


@query("""
WITH p AS (SELECT place_id, category || CASE WHEN place_id % 3 = 0 THEN '  ' ELSE '' END AS category, lat, lon FROM {place}),
c AS (SELECT place_id % 1000 AS place, max(lat) AS metres FROM p WHERE place_id % 4 = 0 GROUP BY 1)
SELECT place_id, c.metres IS NOT NULL AS cached, round(c.metres, 6) AS metres FROM p LEFT JOIN c ON c.place = p.place_id WHERE ends_with(rtrim(p.category), 'ING')""")
def places_from_cache(t):
    places = t("place").withColumn("category", F.concat("category", F.when(F.col("place_id") % 3 == 0, "  ").otherwise("")))
    cache = t("place").where("place_id % 4 = 0").groupBy((F.col("place_id") % 1000).alias("place_id")).agg(F.round(F.max("lat"), 6).alias("metres"))
    return feeds.from_cache(feeds.of_category(places, "ING"), cache, ["place_id"]).select("place_id", "cached", "metres")


@query("""
WITH b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 > 0 THEN 37.5 END AS lat, CASE c_custkey % 3 WHEN 0 THEN 'HOUSE' WHEN 1 THEN 'APT' END AS kind, CASE WHEN c_custkey % 7 > 0 THEN c_name ELSE ' ' END AS name FROM {customer})
SELECT k FROM b WHERE lat IS NOT NULL AND coalesce(kind, '') <> 'HOUSE' AND trim(name) <> ''""")
def shown_buildings(t):
    k = F.col("c_custkey")
    found = t("customer").select(k.alias("k"), k.cast("string").alias("seq"), F.when(k % 7 > 0, F.col("c_name")).otherwise(" ").alias("name"), F.when(k % 5 > 0, 37.5).alias("lat"), F.lit(127.0).alias("lon"), F.when(k % 3 == 0, "HOUSE").when(k % 3 == 1, "APT").alias("kind"))
    return feeds.sound_contracts(feeds.located(found)).select("k")


@query("""
WITH o AS (SELECT o_orderkey AS od_id, o_custkey % 40 AS p FROM {orders} WHERE o_orderkey % 4 > 0),
u AS (SELECT p, count(*) AS n, 37.5::double + p / 1000.0::double AS lat FROM o GROUP BY p)
SELECT od_id, n, round(lat, 6) AS lat FROM o JOIN u USING (p)""")
def origins_searched_once(t):
    p = F.col("o_custkey") % 40
    ods = t("orders").select(F.col("o_orderkey").alias("od_id"), (37.5 + p / 1000).alias("lat"), (127 - p / 1000).alias("lon"), F.when(F.col("o_orderkey") % 4 > 0, "출발 08:30").otherwise("도착 09:00").alias("slot"))
    keyed, unique = feeds.unique_places(ods.where(feeds.departing(F.col("slot"))))
    return keyed.select("od_id", "place").join(unique, "place").select("od_id", "n", F.round("lat", 6).alias("lat"))


@query("SELECT c_custkey AS route FROM {customer} WHERE c_custkey IN (SELECT route FROM {speed_obs} WHERE kmh > 0)")
def routes_with_speeds(t):
    return feeds.measured_routes(t("customer").select(F.col("c_custkey").alias("route")), t("speed_obs"))


@query("""
SELECT l_orderkey AS query, CAST(l_suppkey % 20 AS int) AS station, min(CAST(floor(l_extendedprice) AS bigint)) AS t FROM {lineitem} GROUP BY 1, 2""")
def station_times(t):
    labels = t("lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("node"), F.floor("l_extendedprice").alias("t"))
    return feeds.station_times(labels, t("supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 20).cast("int").alias("station")))


@query("SELECT gu, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, count(*) AS n FROM {dong} GROUP BY gu")
def station_centroids(t):
    return feeds.centroids(t("dong"), "gu").select("gu", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "n")


@query("""
WITH m AS (SELECT *, max(pos) OVER (PARTITION BY trip_id) AS last FROM {pattern_stop})
SELECT trip_id AS chain, 0 AS dir, pos, stop_id FROM m UNION ALL SELECT trip_id, 1, last + 1 - pos, stop_id FROM m""")
def chains_both_ways(t):
    return feeds.both_directions(t("pattern_stop").select(F.col("trip_id").alias("chain"), "pos", "stop_id"))


_ROUND = "round AS (SELECT doc_id AS trip_id, i + 1 AS pos, w[i + 1] AS stop_id FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]+') AS w FROM {documents}), LATERAL (SELECT unnest(range(len(w))) AS i))"


@query(f"""
WITH {_ROUND},
f AS (SELECT *, min(pos) OVER (PARTITION BY trip_id, stop_id) AS first FROM round),
b AS (SELECT trip_id, min(pos) AS lap_to FROM f WHERE pos - first >= 8 GROUP BY trip_id),
l AS (SELECT b.trip_id, f.first AS lap_from, lap_to FROM b JOIN f ON f.trip_id = b.trip_id AND f.pos = b.lap_to),
inside AS (SELECT s.trip_id, s.stop_id, s.pos - lap_from + 1 AS at_place, lap_to - lap_from AS size, s.pos = lap_from AS opens FROM round s JOIN l USING (trip_id) WHERE s.pos BETWEEN lap_from AND lap_to)
SELECT trip_id, CAST(at_place AS bigint) AS pos, stop_id FROM inside UNION ALL SELECT trip_id, at_place + size, stop_id FROM inside WHERE NOT opens""")
def circle_lines_twice(t):
    words = t("documents").select(F.col("doc_id").alias("trip_id"), F.posexplode(F.regexp_extract_all("text", F.lit("([a-z]+)"), 1)).alias("_p", "stop_id"))
    stops = words.select("trip_id", (F.col("_p") + 1).cast("long").alias("pos"), "stop_id")
    return feeds.two_laps(stops, ordered.laps(stops))


_NAMES = {"FURNITURE": "가구"}
_PREFIXES = {"MACH": "m", "MACHINERY": "M", "AUTO": "A"}


@query("""
SELECT c_custkey, CASE c_mktsegment WHEN 'FURNITURE' THEN '가구' ELSE c_mktsegment END AS repaired, c_mktsegment || '|' || c_name AS alternatives, regexp_extract(c_name, '^[^ ]*') AS first,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'M' WHEN 'AUTOMOBILE' THEN 'A' END AS prefix_code,
       ['서울', '인천', '경기', NULL][CAST(c_custkey % 4 AS int) + 1] AS province, CASE WHEN c_custkey % 3 = 0 THEN '2호선' WHEN c_custkey % 3 = 1 THEN '경강' ELSE 'ZZ' END AS line,
       printf('%02d:%02d:00', c_custkey % 24, c_custkey % 60) AS clock, printf('%02d:%02d:00', c_custkey % 24 + CASE WHEN c_custkey % 24 * 60 + c_custkey % 60 <= 300 THEN 24 ELSE 0 END, c_custkey % 60) AS after,
       CAST(c_custkey % 24 * 60 + c_custkey % 60 AS int) AS minutes, printf('%02d:%02d:00', c_custkey % 3000 // 60, c_custkey % 3000 % 60) AS back,
       CASE WHEN c_custkey % 5 = 0 THEN '서울역' ELSE '강남' END AS station, CASE WHEN c_custkey % 70 >= 60 THEN '#d3e3f0' WHEN c_custkey % 70 >= 45 THEN '#aecfe4' WHEN c_custkey % 70 >= 30 THEN '#7fb3d5' WHEN c_custkey % 70 >= 20 THEN '#4a90c4' WHEN c_custkey % 70 >= 10 THEN '#2b6cb0' ELSE '#1a4d8f' END AS colour,
       printf('%+.1f', (c_custkey % 9 - 4)::double) AS off, '&lt;b&gt;' || CAST(c_custkey AS varchar) || '&amp;' AS html, '가A' || CAST(c_custkey AS varchar) AS gtfs_id
FROM {customer}""")
def name_and_time_rules(t):
    k = F.col("c_custkey")
    hhmm = F.format_string("%02d%02d", (k % 24).cast("int"), (k % 60).cast("int"))
    code = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("11", "28", "41", "99")]), (k % 4 + 1).cast("int")), F.lit("680"))
    return t("customer").select(
        "c_custkey", exprs.repaired("c_mktsegment", _NAMES).alias("repaired"), F.array_join(exprs.alternatives(F.concat(F.col("c_mktsegment"), F.lit(" / / "), F.col("c_name"))), "|").alias("alternatives"),
        exprs.first_word("c_name").alias("first"), exprs.longest_prefix("c_mktsegment", _PREFIXES).alias("prefix_code"), exprs.province(code).alias("province"),
        exprs.line_name(F.when(k % 3 == 0, "2").when(k % 3 == 1, "KK").otherwise("ZZ")).alias("line"), exprs.clock_text(hhmm).alias("clock"), exprs.clock_after(hhmm, F.lit("0500")).alias("after"),
        exprs.minutes_of(exprs.clock_text(hhmm)).alias("minutes"), exprs.minutes_clock(k % 3000).alias("back"), exprs.station_short(F.when(k % 5 == 0, "서울역").otherwise("강남역")).alias("station"),
        exprs.drawn_colour(k % 70).alias("colour"), exprs.offset_text(k % 9 - 4).alias("off"), exprs.escape_html(F.concat(F.lit("<b>"), k.cast("string"), F.lit("&"))).alias("html"), exprs.gtfs_id(F.concat(F.lit("가A-"), k.cast("string"), F.lit(" ."))).alias("gtfs_id"),
    )


@query("""
WITH s AS (SELECT c_custkey, c_custkey % 2 = 0 AS arrive, c_custkey % 260 AS slot, c_custkey % 150 AS budget, c_custkey % 20 AS walk_cap, ['ONE', 'TWO', 'SIX'][CAST(c_custkey % 3 AS int) + 1] AS room, c_custkey % 7 * 30000 AS cap, c_custkey % 4 = 0 AS flat FROM {customer})
SELECT c_custkey, arrive, CASE WHEN slot <= 200 THEN CAST(slot AS int) END AS slot, CASE WHEN budget BETWEEN 10 AND 120 THEN CAST(budget AS int) END AS budget, CASE WHEN walk_cap <= 15 THEN CAST(walk_cap AS int) END AS walk_cap,
       CASE WHEN room <> 'SIX' THEN room END AS room, 'WOLSE' AS tenure, CASE WHEN cap BETWEEN 1 AND 100000 THEN CAST(cap AS int) END AS cap, CASE WHEN flat THEN true END AS flat_only, '강남 & co' AS origin, 'CS2,MT1' AS amenities FROM s""")
def share_link_round_trip(t):
    k = F.col("c_custkey")
    state = F.struct(
        F.lit("강남 & co").alias("origin"), (k % 2 == 0).alias("arrive"), (k % 260).alias("slot"), (k % 150).alias("budget"), (k % 20).alias("walk_cap"), F.element_at(F.array(F.lit("ONE"), F.lit("TWO"), F.lit("SIX")), (k % 3 + 1).cast("int")).alias("room"),
        F.lit("WOLSE").alias("tenure"), (k % 7 * 30000).alias("cap"), F.array(F.lit("CS2"), F.lit("DEPT"), F.lit("MT1")).alias("amenities"), (k % 4 == 0).alias("flat_only"),
    )
    back = t("customer").select("c_custkey", exprs.state_of(exprs.state_text(state)).alias("_s"))
    return back.select("c_custkey", "_s.*").withColumn("amenities", F.array_join("amenities", ","))


# The line of a table's rows: findings that need the order of a file.
@query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line FROM {lineitem}),
o AS (SELECT l_orderkey AS trip_id, line, l_linenumber AS sequence, lag(l_orderkey) OVER (ORDER BY line) AS before, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY line) AS was FROM r)
SELECT 'scattered' AS rule, trip_id, count(*) FILTER (WHERE before IS DISTINCT FROM trip_id) AS n FROM o GROUP BY trip_id HAVING count(*) FILTER (WHERE before IS DISTINCT FROM trip_id) > 1
UNION ALL SELECT 'sequence', trip_id, count(*) FROM o WHERE sequence <= was GROUP BY trip_id""")
def stop_times_order(t):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return checks.file_order_findings(t("lineitem").withColumn("trip_id", F.col("l_orderkey")).withColumn("sequence", F.col("l_linenumber")), order)


@query("""
WITH tr AS (SELECT o_orderkey % 5000 AS trip_id, o_orderkey % 60 AS route_id, o_orderstatus AS service, CAST(o_orderkey % 4 AS int) AS direction FROM {orders}),
ro AS (SELECT s_suppkey % 50 AS route_id, CAST(s_suppkey % 16 AS int) AS route_type FROM {supplier})
SELECT 'doubled trip' AS rule, CAST(trip_id AS varchar) AS key FROM tr GROUP BY trip_id HAVING count(*) > 1
UNION ALL SELECT 'doubled route', CAST(route_id AS varchar) FROM ro GROUP BY route_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'unknown route', CAST(route_id AS varchar) FROM tr WHERE route_id NOT IN (SELECT route_id FROM ro)
UNION ALL SELECT DISTINCT 'unknown service', service FROM tr WHERE service NOT IN ('F', 'O')
UNION ALL SELECT DISTINCT 'odd route type', CAST(route_id AS varchar) FROM ro WHERE route_type NOT BETWEEN 0 AND 12
UNION ALL SELECT DISTINCT 'odd direction', CAST(trip_id AS varchar) FROM tr WHERE direction NOT IN (0, 1)""")
def route_and_trip_errors(t):
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    trips = t("orders").select((k % 5000).alias("trip_id"), (k % 60).alias("route_id"), F.col("o_orderstatus").alias("service"), (k % 4).cast("int").alias("direction"))
    services = t("orders").where("o_orderstatus IN ('F', 'O')").select(F.col("o_orderstatus").alias("service")).distinct()
    return checks.route_findings(t("supplier").select((s % 50).alias("route_id"), (s % 16).cast("int").alias("route_type")), trips, services).select("rule", "key")



_VILLAGE = """
WITH st AS (SELECT stop_id AS id, CASE WHEN stop_id % 3 = 0 THEN '' ELSE s_name END AS name, lat, lon FROM {stop} JOIN {supplier} ON s_suppkey = stop_id WHERE stop_id % 11 > 0),
sq AS (SELECT trip_id AS route, pos, stop_id AS stop FROM {pattern_stop} WHERE trip_id % 10 < 3),
ro AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_orderpriority AS gov FROM {orders} WHERE o_orderkey % 10 < 3 AND o_orderkey % 70 > 0),
seen AS (SELECT route AS id, pos, stop, coalesce(nullif(name, ''), CAST(stop AS varchar)) AS name, lat, lon FROM sq JOIN st ON st.id = stop JOIN ro ON ro.id = route),
ends AS (SELECT id, arg_min(name, pos) AS a, arg_max(name, pos) AS b FROM seen GROUP BY id HAVING count(*) > 1)"""


def _village(t):
    k = F.col("o_orderkey")
    stations = t("stop").join(t("supplier"), F.col("s_suppkey") == F.col("stop_id")).where("stop_id % 11 > 0")
    name = F.when(F.col("stop_id") % 3 == 0, "").otherwise(F.col("s_name"))
    cells = stations.select(F.col("stop_id").alias("row"), F.col("stop_id").cast("string").alias("id"), name.alias("name"), F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"))
    # An older row of each station, and one out of the box.
    older = cells.withColumn("row", F.lit(-1).cast("long")).withColumn("name", F.lit("old"))
    sequence = t("pattern_stop").where("trip_id % 10 < 3").select(F.col("trip_id").cast("string").alias("route"), F.col("pos").cast("string").alias("ord"), F.col("stop_id").cast("string").alias("stop"))
    routes = t("orders").where("o_orderkey % 10 < 3").select(
        k.alias("row"), k.cast("string").alias("id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("N"), (k % 5).cast("string"))).alias("no"), F.col("o_orderpriority").alias("gov"), F.when(k % 5 == 1, "start").otherwise("").alias("start"), F.lit("").alias("goal"),
        F.when(k % 5 == 2, "").otherwise("06:00").alias("up_first"), F.lit("23:10").alias("up_last"), F.lit("0530").alias("down_first"), F.lit("").alias("down_last"), F.concat((k % 5 + 10).cast("string"), F.lit("~20")).alias("week"), F.when(k % 5 == 3, "30").otherwise("-").alias("weekend"),
    )
    header = routes.limit(1).select(*[F.lit(0).cast("long").alias(c) if c == "row" else F.lit("").alias(c) for c in routes.columns])
    known = t("orders").where("o_orderkey % 70 = 0").select(F.concat(F.lit("GGB"), k.cast("string")).alias("id"))
    return feeds.village_routes(routes.unionByName(header), cells.unionByName(older), sequence, known)


@query(f"""{_VILLAGE}
SELECT 'GGB' || ro.id AS id, CASE WHEN k = 0 THEN CAST(ro.id AS varchar) ELSE 'N' || k END AS no, '마을버스' AS type, gov AS city, CASE WHEN k = 1 THEN 'start' ELSE a END AS from_name, b AS to_name,
       CASE WHEN k = 2 THEN '0530' ELSE '0600' END AS first_at, '2310' AS last_at, CAST(round_even((k + 30) / 2.0::double, 0) AS int) AS headway, CASE WHEN k = 3 THEN 30 ELSE CAST(round_even((k + 30) / 2.0::double, 0) AS int) END AS weekend_headway
FROM ro JOIN ends USING (id)""")
def village_routes(t):
    return _village(t)[0]


@query(f"""{_VILLAGE} SELECT 'GGB' || id AS route_id, CAST(pos AS int) AS ord, 'GGB' || stop AS stop_id, name, lat, lon FROM seen JOIN ends USING (id)""")
def village_stops(t):
    return _village(t)[1]
