"""Plausibility, inference and the remaining scalar rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reachbase.functions import exprs
from reachbase.operators import access, build, calibration, checks, feeds, matrix, network, reach
from reachbase.operators.ranges import dealt, parts_for
from reachbase.plans.registry import query
from reachbase.plans.transit_queries import _meters
from reachbase.sources import files


@query(f"""
WITH s AS (SELECT p.trip_id, p.pos, p.off, lat, lon FROM {{pattern_stop}} p JOIN {{stop}} USING (stop_id)),
l AS (SELECT *, lag(lat) OVER w AS zlat, lag(lon) OVER w AS zlon, lag(off) OVER w AS zoff FROM s WINDOW w AS (PARTITION BY trip_id ORDER BY pos)),
h AS (SELECT trip_id, {_meters('z', '')} AS meters, off - zoff AS seconds FROM l WHERE zoff IS NOT NULL),
f AS (SELECT CASE WHEN seconds <= 0 AND meters > 100 THEN 'no time' WHEN seconds > 0 AND meters / seconds * 3.6 > 90 THEN 'too fast' WHEN seconds > 0 AND meters / seconds * 3.6 < 3 THEN 'too slow' END AS rule, CAST(trip_id AS varchar) AS key FROM h
  UNION ALL SELECT 'headway over four hours', CAST(trip_id AS varchar) FROM {{pattern_window}} WHERE headway > 14400
  UNION ALL SELECT 'unused stop', CAST(stop_id AS varchar) FROM {{stop}} WHERE stop_id NOT IN (SELECT stop_id FROM {{pattern_stop}}))
SELECT 'warning' AS severity, rule, key, count(*) AS n FROM f WHERE rule IS NOT NULL GROUP BY rule, key""")
def gtfs_plausibility(t):
    return checks.plausibility(t("stop"), t("pattern_stop"), t("pattern_window"), parts_for(t("lineitem"))).groupBy("severity", "rule", "key").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT s_suppkey AS idx, s_name AS name FROM {supplier} WHERE s_suppkey % 17 > 0), r AS (SELECT s_suppkey AS idx, CASE WHEN s_suppkey % 10 = 0 THEN 'moved' ELSE s_name END AS other FROM {supplier} WHERE s_suppkey % 13 > 0)
SELECT coalesce(l.idx, r.idx) AS idx, name, other FROM l FULL JOIN r ON l.idx = r.idx WHERE name IS DISTINCT FROM other""")
def axis_mismatch(t):
    s, k = t("supplier"), F.col("s_suppkey")
    left = s.where(k % 17 > 0).select(k.alias("idx"), F.col("s_name").alias("name"))
    return checks.axis_mismatches(left, s.where(k % 13 > 0).select(k.alias("idx"), F.when(k % 10 == 0, "moved").otherwise(F.col("s_name")).alias("name")))


@query("SELECT origin, count(*) AS n FROM {reach} WHERE minutes >= 120 AND walk > 0 GROUP BY origin")
def walk_plane_check(t):
    seen = t("reach").withColumn("minutes", F.when(F.col("minutes") < 120, F.col("minutes")))
    return matrix.walk_without_reach(seen).groupBy("origin").agg(F.count("*").alias("n"))


@query("""
SELECT type, count(*) AS n, round(list_sort(list(ours_m / ours_sec * 3.6::double))[count(*) // 2 + 1], 3) AS kmh FROM {leg_obs} WHERE ours_m > 300 AND ours_sec > 0 GROUP BY type""")
def effective_speed(t):
    return calibration.effective_speeds(t("leg_obs"), ["type"])


@query("""
SELECT od_id, line_no, part, ours_sec - ext_sec AS error FROM {leg_obs} ORDER BY abs(ours_sec - ext_sec) DESC, od_id, line_no, part, ours_sec LIMIT 12""")
def worst_legs(t):
    rows = t("leg_obs").withColumn("error", F.col("ours_sec") - F.col("ext_sec"))
    return calibration.worst(rows, "error", ["od_id", "line_no", "part", "ours_sec"]).select("od_id", "line_no", "part", "error")


@query("""
WITH r AS (SELECT DISTINCT sgg FROM {deal}), m AS (SELECT DISTINCT ym FROM {deal}), k AS (SELECT DISTINCT kind FROM {deal})
SELECT sgg, ym, kind FROM r CROSS JOIN m CROSS JOIN k EXCEPT SELECT sgg, ym, kind FROM {deal} WHERE file_no = 0""")
def missing_contract_requests(t):
    deals = t("deal")
    plan = files.request_plan(*[deals.select(c) for c in ("sgg", "ym", "kind")])
    return files.missing_requests(plan, deals.where("file_no = 0"), ["sgg", "ym", "kind"])


@query("""
WITH n AS (SELECT DISTINCT l_orderkey AS node, l_suppkey AS line FROM {lineitem}),
e AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM {orders}),
l AS (SELECT node, list(line) AS lines FROM n GROUP BY node),
i AS (SELECT DISTINCT a, b, list_intersect(x.lines, y.lines) AS shared FROM e JOIN l x ON x.node = a JOIN l y ON y.node = b)
SELECT a, b, shared[1] AS line FROM i WHERE len(shared) = 1""")
def line_inference(t):
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    edges = t("orders").select(F.col("o_orderkey").alias("a"), after.alias("b")).where("b IS NOT NULL")
    return network.inferred_lines(edges, t("lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("line")))


@query("""
WITH v AS (SELECT DISTINCT trip_id, trip_id % 2 AS dir, stop_id FROM {pattern_stop}), n AS (SELECT stop_id, dir, count(*) AS n FROM v GROUP BY ALL)
SELECT trip_id AS pattern_id, list_sort(list(n))[count(*) // 2 + 1] AS scale FROM v JOIN n USING (stop_id, dir) GROUP BY trip_id""")
def pattern_scale(t):
    return network.pattern_scale(t("pattern_stop").select(F.col("trip_id").alias("pattern_id"), (F.col("trip_id") % 2).alias("dir"), F.col("stop_id").alias("node")))


@query("SELECT stop_id, count(DISTINCT route_id) AS routes FROM {pattern_stop} JOIN {trip} USING (trip_id) GROUP BY stop_id ORDER BY routes DESC, stop_id LIMIT 12")
def top_interchanges(t):
    return network.interchanges(t("pattern_stop").join(t("trip"), "trip_id").select("stop_id", "route_id"))


@query("""
WITH f AS (SELECT o_orderpriority AS name, min(o_orderkey) AS value FROM {orders} WHERE o_orderpriority < '3' GROUP BY 1 UNION ALL SELECT o_orderstatus, max(o_orderkey) FROM {orders} GROUP BY 1)
SELECT o_orderkey AS key, coalesce(a.value, b.value) AS value FROM {orders} LEFT JOIN f a ON a.name = o_orderpriority LEFT JOIN f b ON b.name = o_orderstatus WHERE coalesce(a.value, b.value) IS NOT NULL""")
def first_known_candidate(t):
    o = t("orders")
    urgent = o.where("o_orderpriority < '3'").groupBy(F.col("o_orderpriority").alias("name")).agg(F.min("o_orderkey").alias("value"))
    found = urgent.unionByName(o.groupBy(F.col("o_orderstatus").alias("name")).agg(F.max("o_orderkey").alias("value")))
    return network.first_candidates(o.select(F.col("o_orderkey").alias("key"), "o_orderpriority", "o_orderstatus"), "key", ["o_orderpriority", "o_orderstatus"], found)


@query("""
WITH h AS (SELECT floor(lat / 0.01::double + 0.5) AS r, floor(lon / 0.01::double + 0.5) AS c, min(metres) AS metres FROM {elevation} JOIN {stop} USING (stop_id) GROUP BY ALL)
SELECT place_id AS a, min(metres) AS metres FROM {place} JOIN h ON abs(r - floor(lat / 0.01::double + 0.5)) <= 1 AND abs(c - floor(lon / 0.01::double + 0.5)) <= 1 GROUP BY place_id""")
def ground_height(t):
    cell = lambda c: F.floor(F.col(c) / 0.01 + 0.5)
    heights = t("elevation").join(t("stop"), "stop_id").groupBy(cell("lat").alias("row"), cell("lon").alias("col")).agg(F.min("metres").alias("metres"))
    points = t("place").select(F.col("place_id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    return access.ground_heights(points, heights, 0.01)


@query("""
WITH x AS (SELECT p_partkey, CAST(p_size AS varchar) || '~' || CAST(p_partkey % 400 AS varchar) || '분' AS text FROM {part}),
n AS (SELECT p_partkey, list_filter(list_transform(regexp_extract_all(text, '[0-9]+'), lambda v: CAST(v AS int)), lambda v: v BETWEEN 1 AND 300) AS found FROM x)
SELECT p_partkey, CAST(round_even(list_avg(found), 0) AS int) AS headway FROM n""")
def headway_text(t):
    text = F.concat(F.col("p_size").cast("string"), F.lit("~"), (F.col("p_partkey") % 400).cast("string"), F.lit("분"))
    return t("part").select("p_partkey", exprs.headway_of(text).alias("headway"))


@query("""
WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS varchar) WHEN c_custkey % 3 = 1 THEN ' ' END AS apt, CAST(c_nationkey AS varchar) AS sgg, c_mktsegment AS umd, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 90 AS varchar) ELSE '' END AS lot FROM {customer})
SELECT c_custkey, coalesce(nullif(trim(apt), ''), sgg || '|' || umd || '|' || coalesce(nullif(trim(lot), ''), 'DONG')) AS building,
       umd || ' ' || ltrim(printf('%05d', c_custkey % 700 + 1), '0') || CASE WHEN c_custkey % 4 > 0 THEN '-' || CAST(c_custkey % 4 AS varchar) ELSE '' END AS address FROM x""")
def building_keys(t):
    k = F.col("c_custkey")
    apartment = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, " ")
    parcel = F.when(k % 5 > 0, (k % 90).cast("string")).otherwise("")
    main, sub = F.format_string("%05d", k % 700 + 1), F.format_string("%05d", k % 4)
    return t("customer").select(k, exprs.building_key(apartment, F.col("c_nationkey").cast("string"), "c_mktsegment", parcel).alias("building"), exprs.road_address("c_mktsegment", main, sub).alias("address"))


@query("""
WITH x AS (SELECT c_custkey AS k, 3.75e1 + (c_custkey % 101) / 2.5e3 AS lat, 1.27e2 + (c_custkey % 103) / 2.5e3 AS lon, (c_custkey * 607) % 100000 AS s FROM {customer})
SELECT k AS c_custkey, CAST(floor(least((k % 130)::double / 60, 1.0::double) * 6 + 0.5) AS int) AS ramp, CASE WHEN k % 2 = 0 THEN '도착' ELSE '출발' END || ' ' || printf('%02d:%02d', s // 3600 % 24, s % 3600 // 60) AS slot, CAST(k % 60 // 30 * 30 AS bigint) AS half,
       round(degrees(ln(tan(radians(lat) / 2 + pi() / 4))), 8) AS north, printf('%.5f,%.5f', lat, lon) AS cell, CASE k % 4 WHEN 0 THEN 2.5::double WHEN 1 THEN 3.5::double ELSE 1.0::double END AS factor,
       CASE k % 3 WHEN 0 THEN 14.0::double WHEN 1 THEN 40.0::double END AS kmh, k % 5 = 0 AS shape_only, CASE WHEN k % 7 < 6 THEN ['05:30~07:00', '07:00~09:00', '09:00~17:00', '17:00~20:00', '20:00~23:00', '23:00~00:40'][k % 7 + 1] END AS period FROM x""")
def scalar_rules(t):
    k = F.col("c_custkey")
    lat, lon, s = 37.5 + (k % 101) / 2500.0, 127.0 + (k % 103) / 2500.0, (k * 607) % 100000
    line = F.when(k % 4 == 0, "경의중앙선").when(k % 4 == 1, "GTX-A").otherwise("2호선")
    kind = F.when(k % 3 == 0, "마을버스").when(k % 3 == 1, "공항버스").otherwise("-")
    name = F.when(k % 10 == 0, "역앞(가상)").when(k % 5 == 0, "역앞(미정차)").otherwise("역앞")
    return t("customer").select(
        k, exprs.ramp_index(k % 130, F.lit(60), 7).alias("ramp"), exprs.slot_label(k % 2 == 0, s).alias("slot"), exprs.slot_floor(k % 60).alias("half"), F.round(exprs.mercator_y(lat), 8).alias("north"),
        exprs.coordinate_key(lat, lon).alias("cell"), exprs.line_factor(line).alias("factor"), exprs.type_speed(kind).alias("kmh"), exprs.is_pass_through(name).alias("shape_only"), exprs.period_label(k % 7).alias("period"),
    )


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '출발 08:00' WHEN o_orderkey % 3 = 0 THEN '도착 09:00' ELSE '' END AS slot FROM {orders})
SELECT o_orderkey, starts_with(slot, '출발') AS departs FROM o""")
def departing_slots(t):
    k = F.col("o_orderkey")
    slot = F.when(k % 2 == 0, "출발 08:00").when(k % 3 == 0, "도착 09:00").otherwise("")
    return t("orders").select(k, feeds.departing(slot).alias("departs"))


@query(r"""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' (' || p_brand || ')' WHEN p_partkey % 3 = 1 THEN '(' || p_brand || ') ' || p_name ELSE p_name END AS v FROM {part})
SELECT p_partkey, trim(regexp_replace(v, '^([^(]+)\(.*$', '\1')) AS name FROM p""")
def names_without_notes(t):
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    v = F.when(k % 3 == 0, F.concat(name, F.lit(" ("), brand, F.lit(")"))).when(k % 3 == 1, F.concat(F.lit("("), brand, F.lit(") "), name)).otherwise(name)
    return t("part").select(k, exprs.strip_parenthetical(v).alias("name"))


@query(r"""
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '역' WHEN s_suppkey % 3 = 1 THEN s_name || '역(' || s_suppkey || ')' ELSE s_name || ' · 역' END AS v FROM {supplier}),
k AS (SELECT s_suppkey, regexp_replace(regexp_replace(v, '\([^)]*\)', '', 'g'), '[\s.·,\-]', '', 'g') AS k FROM s)
SELECT s_suppkey, CASE WHEN length(k) > 2 THEN regexp_replace(k, '역$', '') ELSE k END AS name_key FROM k""")
def station_keys(t):
    k, name = F.col("s_suppkey"), F.col("s_name")
    v = F.when(k % 3 == 0, "역").when(k % 3 == 1, F.concat(name, F.lit("역("), k.cast("string"), F.lit(")"))).otherwise(F.concat(name, F.lit(" · 역")))
    return t("supplier").select(k, exprs.station_name_key(v).alias("name_key"))


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE ' ' || (o_orderkey // 1000) || ',' || lpad(CAST(o_orderkey % 1000 AS varchar), 3, '0') || ' ' END AS v FROM {orders})
SELECT o_orderkey, coalesce(try_cast(trim(replace(v, ',', '')) AS int), 0) AS amount FROM o""")
def money_texts(t):
    k = F.col("o_orderkey")
    v = F.when(k % 7 == 0, "none").otherwise(F.concat(F.lit(" "), F.floor(k / 1000).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" ")))
    return t("orders").select(k, exprs.money(v).alias("amount"))


@query("""
SELECT DISTINCT CAST(o_orderdate AS date) AS day, array_to_string(list_transform(range(1, 5), lambda i: strftime(CAST(o_orderdate AS date) - to_months(CAST(i AS int)), '%Y%m')), ',') AS months FROM {orders}""")
def months_back(t):
    day = F.to_date("o_orderdate")
    return t("orders").select(day.alias("day"), F.array_join(exprs.recent_months(day, 4), ",").alias("months")).distinct()


@query("""
WITH l AS (SELECT l_returnflag, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_extendedprice / 10 END AS road, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_extendedprice / 12 + l_quantity END AS straight FROM {lineitem})
SELECT l_returnflag, round(sum(CASE WHEN road > 0 AND (straight IS NULL OR road >= straight) THEN road WHEN straight IS NULL THEN 400 ELSE greatest(30, straight * 1.01::double) END), 2) AS meters, count(*) AS n FROM l GROUP BY 1""")
def segment_lengths(t):
    price = F.col("l_extendedprice")
    road = F.when(F.col("l_orderkey") % 5 == 0, 0.0).otherwise(price / 10)
    straight = F.when(F.col("l_partkey") % 7 != 0, price / 12 + F.col("l_quantity"))
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.sum(exprs.segment_meters(road, straight, 1.01)), 2).alias("meters"), F.count("*").alias("n"))


@query("""
WITH t AS (SELECT l_suppkey % 30 AS x, l_partkey % 30 AS y, min(CAST(l_extendedprice AS bigint)) AS sec FROM {lineitem} WHERE l_suppkey % 30 <> l_partkey % 30 GROUP BY 1, 2)
SELECT p.x AS a, p.y AS b, q.y AS c FROM t p JOIN t q ON q.x = p.y JOIN t d ON d.x = p.x AND d.y = q.y WHERE d.sec > p.sec + q.sec + 300""")
def triangle_check(t):
    a, b = F.col("l_suppkey") % 30, F.col("l_partkey") % 30
    times = t("lineitem").where(a != b).groupBy(a.alias("a"), b.alias("b")).agg(F.min(F.col("l_extendedprice").cast("long")).alias("sec"))
    return matrix.triangle_findings(times)


_THINNED = "shown AS (SELECT c_custkey // 50 AS view, c_custkey AS key, c_custkey * 53 % 101 AS x, c_custkey * 29 % 103 AS y, c_custkey * 7919 % 1000 AS priority FROM {customer})"


@query(f"""
WITH RECURSIVE {_THINNED}, f AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY priority DESC, key) AS rn FROM shown),
s AS (
  SELECT DISTINCT view, CAST(0 AS bigint) AS rn, CAST([] AS STRUCT(key bigint, x bigint, y bigint)[]) AS kept FROM f
  UNION ALL
  SELECT s.view, f.rn, CASE WHEN len(kept) < 12 AND len(list_filter(kept, lambda k: abs(k.x - f.x) < 20 AND abs(k.y - f.y) < 15)) = 0 THEN list_append(kept, {{{{'key': f.key, 'x': f.x, 'y': f.y}}}}) ELSE kept END
  FROM s JOIN f ON f.view = s.view AND f.rn = s.rn + 1),
done AS (SELECT view, arg_max(kept, rn) AS kept FROM s GROUP BY view)
SELECT view, unnest(kept).key AS key FROM done""")
def thinned_markers(t):
    """What each view shows is one group by its nature: a screen's markers."""
    k = F.col("c_custkey")
    shown = t("customer").select(F.floor(k / 50).cast("long").alias("view"), k.alias("key"), (k * 53 % 101).alias("x"), (k * 29 % 103).alias("y"), (k * 7919 % 1000).alias("priority"))
    return network.thinned(shown, 20, 15, 12)


@query("""
WITH a AS (SELECT n_name AS gu, s_name AS name, n AS shops FROM {amenity} JOIN {supplier} ON s_suppkey = dong_id JOIN {nation} ON n_nationkey = s_nationkey WHERE code = 'BUILDING' AND s_suppkey % 4 > 0)
SELECT dong_id, d.gu AS district, d.name, shops FROM {dong} d LEFT JOIN a ON a.gu = d.gu AND a.name = d.name""")
def amenities_by_name(t):
    d = t("dong").select("dong_id", F.col("gu").alias("district"), "name")
    known = t("amenity").where("code = 'BUILDING'").join(d, "dong_id").where("dong_id % 4 > 0")
    return reach.amenities_by_name(d, known.select(F.concat_ws("|", "district", "name").alias("key"), F.col("n").alias("shops")))


@query(f"""
WITH f AS (SELECT gu AS name, count(*) AS n, min(dong_id) AS first FROM {{dong}} GROUP BY gu HAVING count(*) > 1)
SELECT f.name, n, round(max({_meters('a.', 'b.')}), 3) AS meters FROM f JOIN {{dong}} a ON a.dong_id = f.first JOIN {{dong}} b ON b.gu = f.name GROUP BY f.name, n""")
def same_name_stations(t):
    return build.same_names(t("dong").select(F.col("dong_id").alias("id"), F.col("gu").alias("name"), "lat", "lon"))


@query("""
WITH a AS (SELECT c_name AS name, c_custkey + 1000000 AS station_id FROM {customer} WHERE c_custkey % 50 = 0),
f AS (SELECT DISTINCT CASE WHEN c_custkey % 50 = 0 THEN c_name ELSE substr(c_name, 1, CASE WHEN c_custkey % 3 = 0 THEN 17 ELSE 18 END) END AS ask FROM {customer}),
m AS (SELECT ask, count(*) AS n, min(c_custkey) AS station_id FROM f JOIN (SELECT c_custkey, c_name FROM {customer}) c ON starts_with(c.c_name, ask) WHERE ask NOT IN (SELECT name FROM a) GROUP BY ask)
SELECT ask AS name, station_id FROM m WHERE n = 1 UNION ALL SELECT name, station_id FROM a JOIN f ON ask = name""")
def aliased_prefixes(t):
    c, k = t("customer"), F.col("c_custkey")
    short = c.select(F.when(k % 50 == 0, F.col("c_name")).otherwise(F.substring("c_name", F.lit(1), F.when(k % 3 == 0, 17).otherwise(18))).alias("name")).distinct()
    aliases = c.where(k % 50 == 0).select(F.col("c_name").alias("name"), (k + 1_000_000).alias("station_id"))
    return network.unique_prefix(short, c.select(k.alias("station_id"), F.col("c_name").alias("full_name")), aliases=aliases)


@query(f"""
WITH seen AS (SELECT trip_id % 20 AS line, trip_id % 500 AS train, trip_id % 2 AS dir, p.stop_id AS station, (first_start + trip_id * 977 % 70000 + off) % 86400 AS "at", lat, lon FROM {{pattern_stop}} p JOIN {{pattern_window}} USING (trip_id) JOIN {{stop}} USING (stop_id)),
late AS (SELECT * REPLACE (CASE WHEN "at" < 14400 THEN "at" + 86400 ELSE "at" END AS "at") FROM seen),
gap AS (SELECT *, CASE WHEN "at" - lag("at") OVER w > 3600 THEN 1 ELSE 0 END AS g FROM late WINDOW w AS (PARTITION BY line, train, dir ORDER BY "at", station)),
cut AS (SELECT *, sum(g) OVER (PARTITION BY line, train, dir ORDER BY "at", station) AS run FROM gap),
hop AS (SELECT line, train, dir, run, station, "at", lag("at") OVER w AS zat, lat, lon, lag(lat) OVER w AS zlat, lag(lon) OVER w AS zlon FROM cut WINDOW w AS (PARTITION BY line, train, dir, run ORDER BY "at", station)),
bad AS (SELECT *, coalesce({_meters('z', '')} > ("at" - zat) * (150.0::double / 3.6::double), false) AS b, min("at") OVER (PARTITION BY line, train, dir, run) AS s FROM hop),
runs AS (SELECT line, s, string_agg(CAST(station AS varchar) || ':' || CAST("at" - s AS varchar), ',' ORDER BY "at", station) AS stops FROM bad GROUP BY line, train, dir, run, s HAVING count(*) > 1 AND NOT bool_or(b))
SELECT line, stops, string_agg(DISTINCT CAST(s AS varchar), ',' ORDER BY CAST(s AS varchar)) AS starts FROM runs GROUP BY line, stops""")
def timetable_patterns(t):
    k = F.col("trip_id")
    parts = parts_for(t("lineitem"))
    rows = dealt(t("pattern_stop").join(t("pattern_window"), "trip_id").select("trip_id", "first_start", "off", "stop_id"), parts, "stop_id").join(t("stop"), "stop_id")
    at = (F.col("first_start") + k * 977 % 70_000 + F.col("off")) % 86_400
    each = network.train_runs(rows.select((k % 20).alias("line"), (k % 500).alias("train"), (k % 2).alias("dir"), F.col("stop_id").alias("station"), at.alias("at"), "lat", "lon"), parts=parts)
    stop = F.concat_ws(":", F.col("station").cast("string"), F.col("off").cast("string"))
    whole = each.groupBy("line", "signature").agg(F.array_sort(F.collect_list(F.struct("pos", stop.alias("s")))).alias("_s"), F.first("starts").alias("_t"))
    starts = F.array_join(F.array_sort(F.transform("_t", lambda x: x.cast("string"))), ",")
    return whole.select("line", F.array_join(F.transform("_s", lambda x: x["s"]), ",").alias("stops"), starts.alias("starts"))
