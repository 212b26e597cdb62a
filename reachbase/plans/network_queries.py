"""Networks, counters and the smaller rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reachbase.functions import exprs
from reachbase.functions.medians import at_share
from reachbase.operators import access, build, calibration, graph, network, routing, service, spatial, speed
from reachbase.operators.ranges import parts_for
from reachbase.plans.registry import query
from reachbase.plans.transit_queries import _BIN, _CLUSTER_EDGES, _CURVES, _SOUND, _meters, walked_costs


@query("""
WITH h AS (SELECT trip_id, stop_id AS a, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY pos) AS b FROM {pattern_stop}),
e AS (SELECT DISTINCT trip_id, least(a, b) AS a, greatest(a, b) AS b FROM h WHERE b IS NOT NULL), n AS (SELECT a, b, count(*) AS n FROM e GROUP BY a, b)
SELECT trip_id AS run_id, max(n) AS scale FROM e JOIN n USING (a, b) GROUP BY trip_id""")
def run_scale(t):
    return network.overlap_scale(t("pattern_stop").select(F.col("trip_id").alias("run_id"), "pos", F.col("stop_id").alias("node")), parts_for(t("lineitem")))


@query("""
WITH d AS (SELECT s_suppkey AS node, count(l_orderkey) AS degree FROM {supplier} LEFT JOIN {lineitem} ON l_suppkey = s_suppkey GROUP BY s_suppkey)
SELECT node, degree, CAST(coalesce(sum(degree) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS first FROM d""")
def csr_offsets(t):
    return network.csr_offsets(t("lineitem").select(F.col("l_suppkey").alias("src")), t("supplier").select(F.col("s_suppkey").alias("node")))


@query("""
WITH d AS (SELECT s_suppkey AS node, count(l_orderkey) AS degree FROM {supplier} LEFT JOIN {lineitem} ON l_suppkey = s_suppkey GROUP BY s_suppkey)
SELECT round(avg(degree), 6) AS mean_degree, count(*) FILTER (WHERE degree = 0) AS isolated, count(*) AS nodes FROM d""")
def graph_sanity(t):
    rows = network.csr_offsets(t("lineitem").select(F.col("l_suppkey").alias("src")), t("supplier").select(F.col("s_suppkey").alias("node")))
    return rows.agg(F.round(F.avg("degree"), 6).alias("mean_degree"), F.count_if(F.col("degree") == 0).alias("isolated"), F.count("*").alias("nodes"))


@query("""
WITH m AS (SELECT trip_id, count(*) AS stops, max(off) // 60 AS minutes FROM {pattern_stop} GROUP BY trip_id)
SELECT count(*) AS trips, list_sort(list(minutes))[CAST(floor(count(*) * 0.1) AS bigint) + 1] AS p10, list_sort(list(minutes))[count(*) // 2 + 1] AS p50, list_sort(list(minutes))[CAST(floor(count(*) * 0.9) AS bigint) + 1] AS p90,
       max(minutes) AS longest, list_sort(list(stops))[count(*) // 2 + 1] AS stops_p50, max(stops) AS stops_max FROM m""")
def gtfs_summary(t):
    m = t("pattern_stop").groupBy("trip_id").agg(F.count("*").alias("stops"), F.floor(F.max("off") / 60).alias("minutes"))
    return m.agg(F.count("*").alias("trips"), *[at_share("minutes", s).alias(f"p{int(s * 100)}") for s in (0.1, 0.5, 0.9)], F.max("minutes").alias("longest"), at_share("stops", 0.5).alias("stops_p50"), F.max("stops").alias("stops_max"))


@query(f"""
WITH {_SOUND}, {_CURVES}, measured AS (SELECT route, ord FROM sound GROUP BY route, ord), segments AS (SELECT DISTINCT route, ord, type, meters FROM {{speed_obs}})
SELECT CASE WHEN m.route IS NOT NULL THEN 'measured' WHEN y.kmh IS NOT NULL THEN 'type' WHEN c.kmh IS NOT NULL THEN 'common' ELSE 'fixed' END AS source, count(*) AS n
FROM (SELECT *, {_BIN} AS bin FROM segments) s LEFT JOIN measured m ON m.route = s.route AND m.ord = s.ord LEFT JOIN typed y ON y.type = s.type AND y.bin = s.bin LEFT JOIN common c ON c.bin = s.bin GROUP BY 1""")
def source_mix(t):
    obs = t("speed_obs")
    return speed.resolved(obs.select("route", "ord", "type", "meters").distinct(), obs).groupBy("source").agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT DISTINCT substr(c_name, 1, CASE WHEN c_custkey % 3 = 0 THEN 17 ELSE 18 END) AS ask FROM {customer}),
m AS (SELECT ask, count(*) AS n, min(c_custkey) AS station_id FROM f JOIN (SELECT c_custkey, c_name FROM {customer}) c ON starts_with(c.c_name, ask) GROUP BY ask)
SELECT ask AS name, station_id FROM m WHERE n = 1""")
def unique_prefix_join(t):
    c = t("customer")
    short = c.select(F.substring("c_name", F.lit(1), F.when(F.col("c_custkey") % 3 == 0, 17).otherwise(18)).alias("name")).distinct()
    return network.unique_prefix(short, c.select(F.col("c_custkey").alias("station_id"), F.col("c_name").alias("full_name")))


@query("""
WITH st AS (SELECT p_partkey AS station_idx, p_name AS name, p_name || ' (' || p_brand || ')' AS label FROM {part}),
q AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' (' || p_brand || ')' WHEN 2 THEN substr(p_name, 1, 5) ELSE 'nowhere' END AS ask FROM {part}),
r AS (SELECT ask, 0 AS k, station_idx FROM q JOIN st ON label = ask UNION ALL SELECT ask, 1, station_idx FROM q JOIN st ON name = ask UNION ALL SELECT ask, 2, station_idx FROM q JOIN st ON starts_with(name, ask))
SELECT ask, min_by(station_idx, k * 1000000000 + station_idx) AS station_idx FROM r GROUP BY ask""")
def origin_resolution(t):
    p, k = t("part"), F.col("p_partkey")
    label = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))
    asked = p.select(F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, label).when(k % 4 == 2, F.substring("p_name", 1, 5)).otherwise("nowhere").alias("ask")).distinct()
    return network.resolve_origin(asked, p.select(k.alias("station_idx"), F.col("p_name").alias("name"), label.alias("label")))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM {events})
SELECT user_id, event_id, event_type FROM e WHERE last IS NULL OR last <> event_type""")
def consecutive_repeats(t):
    return network.without_repeats(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM {events} GROUP BY user_id, event_type")
def first_wins_dedupe(t):
    return network.first_wins(t("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("""
WITH l AS (SELECT o_custkey AS key, max(o_orderdate) AS last FROM {orders} GROUP BY o_custkey)
SELECT c_custkey AS key, last FROM {customer} LEFT JOIN l ON key = c_custkey ORDER BY last NULLS FIRST, c_custkey LIMIT 40""")
def least_recently_sampled(t):
    return network.least_recent(t("customer").select(F.col("c_custkey").alias("key")), t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at")), 40)


@query("""
WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS p, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM {customer})
SELECT c_custkey, c_mktsegment FROM r WHERE ((p - 200) % n + n) % n < 150""")
def round_robin_quota(t):
    return network.turn_quota(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 150, 200)


@query("""
WITH b AS (SELECT s_nationkey, l_shipdate, sum(l_quantity) AS q FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey GROUP BY ALL), m AS (SELECT s_nationkey, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS int) AS ym, CAST(sum(q) AS bigint) AS q FROM b GROUP BY ALL)
SELECT s_nationkey, min_by(q, ym) AS first, max_by(q, ym) AS last, max_by(q, ym) - min_by(q, ym) AS delta FROM m GROUP BY s_nationkey HAVING count(*) >= 3""")
def trend_delta(t):
    rows = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("ym")
    m = rows.groupBy("s_nationkey", month).agg(F.sum("l_quantity").cast("long").alias("q"))
    first, last = F.min_by("q", "ym"), F.max_by("q", "ym")
    return m.groupBy("s_nationkey").agg(first.alias("first"), last.alias("last"), (last - first).alias("delta"), F.count("*").alias("_n")).where("_n >= 3").drop("_n")


@query("SELECT trip_id, printf('%02d:%02d:%02d', first_start * 3 // 3600, first_start * 3 % 3600 // 60, first_start * 3 % 60) AS text, first_start * 3 AS seconds FROM {pattern_window}")
def service_clock(t):
    rows = t("pattern_window").select("trip_id", exprs.clock(F.col("first_start") * 3).alias("text"))
    return rows.select("trip_id", "text", exprs.seconds_of("text").cast("long").alias("seconds"))


@query("""
SELECT l_returnflag, CASE WHEN l_extendedprice < 1500 THEN 'short' ELSE 'long' END AS kind, count(*) AS n, CAST(sum(greatest(30, floor(l_extendedprice / (CASE WHEN l_extendedprice < 1500 THEN 32.0::double ELSE 50.0::double END / 3.6::double))) + 10) AS bigint) AS seconds,
       CAST(sum(greatest(60, floor(120 + l_extendedprice / 1.2::double))) AS bigint) AS transfer FROM {lineitem} GROUP BY 1, 2""")
def rail_segment_seconds(t):
    p = F.col("l_extendedprice")
    return t("lineitem").groupBy("l_returnflag", F.when(p < 1500, "short").otherwise("long").alias("kind")).agg(F.count("*").alias("n"), F.sum(exprs.rail_seconds(p)).cast("long").alias("seconds"), F.sum(exprs.transfer_seconds(p, 120)).cast("long").alias("transfer"))


@query("""
WITH p AS (SELECT * FROM (VALUES (19800, 25200, 360), (25200, 32400, 180), (32400, 61200, 360), (61200, 72000, 240), (72000, 82800, 300), (82800, 88800, 600)) v(s, e, h)),
g AS (SELECT trip_id AS chain, pos, leg, coalesce(sum(leg) OVER (PARTITION BY trip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {trip_leg}),
d AS (SELECT chain, pos, h, e, s + (((b - s) % h) + h) % h AS f FROM g CROSS JOIN p)
SELECT chain, CAST(sum(CASE WHEN f < e THEN (e - 1 - f) // h + 1 ELSE 0 END) AS bigint) AS departures, CAST(min(CASE WHEN f < e THEN f END) AS bigint) AS earliest FROM d GROUP BY chain""")
def synthetic_timetable(t):
    legs = t("trip_leg").select(F.col("trip_id").alias("chain"), F.col("pos").alias("seq"), F.col("stop_id").alias("origin"), F.col("stop_id").alias("dest"), F.col("leg").alias("seconds"))
    # The weekday's periods and headways.
    periods = legs.sparkSession.createDataFrame([(19800, 25200, 360), (25200, 32400, 180), (32400, 61200, 360), (61200, 72000, 240), (72000, 82800, 300), (82800, 88800, 600)], "start long, end long, headway long")
    return routing.synthetic_connections(legs, periods).groupBy("chain").agg(F.count("*").alias("departures"), F.min("dep").alias("earliest"))


@query("""
WITH k AS (SELECT stop_id, trip_id // 2 % 500 AS line, count(DISTINCT trip_id % 2) AS sides, count(*) AS visits FROM {pattern_stop} GROUP BY ALL)
SELECT stop_id, line, visits FROM k WHERE sides < 2""")
def one_direction_platforms(t):
    line = (F.floor(F.col("trip_id") / 2) % 500).alias("line")
    sides = t("pattern_stop").groupBy("stop_id", line).agg(F.count_distinct(F.col("trip_id") % 2).alias("_d"), F.count("*").alias("visits"))
    return sides.where("_d < 2").select("stop_id", "line", "visits")


_BUILT = f"""
WITH RECURSIVE {_CLUSTER_EDGES}, r AS (SELECT dong_id AS id, dong_id AS seen FROM {{dong}} UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a),
st AS (SELECT id, min(seen) AS station FROM r GROUP BY id),
ls AS (SELECT t.route_id AS line, p.trip_id AS pattern_id, p.trip_id % 3 = 0 AS express, p.pos, p.stop_id AS node FROM {{pattern_stop}} p JOIN {{trip}} t USING (trip_id)),
pf AS (SELECT station, line, avg(lat) AS lat, avg(lon) AS lon FROM (SELECT DISTINCT line, node FROM ls) x JOIN st ON st.id = node JOIN {{dong}} d ON d.dong_id = node GROUP BY station, line)"""


def _built(t):
    nodes = t("dong").select(F.col("dong_id").alias("id"), F.col("gu").alias("name"), "lat", "lon")
    stops = t("pattern_stop").join(t("trip"), "trip_id").select(F.col("route_id").alias("line"), F.col("trip_id").alias("pattern_id"), (F.col("trip_id") % 3 == 0).alias("express"), "pos", F.col("stop_id").alias("node"))
    return nodes, build.stations_of(nodes, 1500), stops


@query(f"{_BUILT} SELECT station, line, round(lat, 9) AS lat, round(lon, 9) AS lon FROM pf")
def network_platforms(t):
    nodes, stations, stops = _built(t)
    return build.platforms(stops, stations, nodes).select("station", "line", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(f"""{_BUILT},
h AS (SELECT line, station, lead(station) OVER (PARTITION BY pattern_id ORDER BY pos) AS nxt FROM ls JOIN st ON st.id = node WHERE NOT express)
SELECT DISTINCT line, least(station, nxt) AS a, greatest(station, nxt) AS b FROM h WHERE nxt IS NOT NULL AND nxt <> station""")
def network_tracks(t):
    _, stations, stops = _built(t)
    return build.track_edges(stops, stations)


@query(f"""{_BUILT}
SELECT a.station, a.line AS from_line, b.line AS to_line, CAST(greatest(60, floor(120 + {_meters('a.', 'b.')} / 1.2)) AS int) AS sec FROM pf a JOIN pf b ON a.station = b.station AND a.line <> b.line""")
def network_transfers(t):
    nodes, stations, stops = _built(t)
    return build.station_transfers(build.platforms(stops, stations, nodes))


# Lines of eight suppliers: six in a row, and a branch of two from the fourth.
_BRANCHED = """
sup AS (SELECT s_suppkey AS node, s_suppkey // 8 AS line, s_suppkey % 8 AS j FROM {supplier}),
edge AS (SELECT line, node - CASE WHEN j = 6 THEN 3 ELSE 1 END AS a, node AS b FROM sup WHERE j > 0)"""


def _branched(t):
    i = F.col("s_suppkey")
    rows = t("supplier").select(F.floor(i / 8).cast("long").alias("line"), (i % 8).alias("j"), F.col("s_suppkey").alias("b")).where("j > 0")
    return rows.select("line", (F.col("b") - F.when(F.col("j") == 6, 3).otherwise(1)).alias("a"), "b")


@query(f"""
WITH RECURSIVE {_BRANCHED},
near AS (SELECT line, a AS x, b AS y FROM edge UNION SELECT line, b, a FROM edge),
fin AS (SELECT line, x FROM near GROUP BY line, x HAVING count(*) = 1), many AS (SELECT line FROM fin GROUP BY line HAVING count(*) > 2),
way AS (SELECT line, x AS start, [x] AS path FROM fin JOIN many USING (line) UNION ALL SELECT w.line, w.start, list_append(path, n.y) FROM way w JOIN near n ON n.line = w.line AND n.x = path[-1] WHERE NOT list_contains(path, n.y)),
run AS (SELECT w.line, CAST(start AS varchar) || '-' || CAST(path[-1] AS varchar) AS run_id, path FROM way w JOIN fin f ON f.line = w.line AND f.x = path[-1] WHERE path[-1] > start)
SELECT line, run_id, CAST(unnest(range(len(path))) AS int) AS pos, unnest(path) AS node FROM run""")
def terminal_runs(t):
    """Ways between all ends of lines that branch; a line's ends are few and its length bounded, so the ways grow with the lines."""
    return build.terminal_runs(_branched(t))


@query(f"""
WITH {_BRANCHED}, used AS (SELECT line, max(j) AS far FROM sup GROUP BY line)
SELECT line, 0 AS chain, CAST(j AS int) AS seq, node FROM sup JOIN used USING (line) WHERE j <= 5 AND far > 0
UNION ALL SELECT line, 1, CAST(CASE j WHEN 3 THEN 0 ELSE j - 5 END AS int), node FROM sup JOIN used USING (line) WHERE j IN (3, 6, 7) AND far > 5""")
def line_chains(t):
    return network.chains(_branched(t))


@query("""
WITH p AS (SELECT * FROM (VALUES (19800, 25200, 480), (25200, 32400, 300), (32400, 61200, 600)) x("start", "end", headway)),
s AS (SELECT s_suppkey AS pattern_id, 1 + s_suppkey % 3 / 2.0::double AS factor, 1 + s_suppkey % 4 AS scale FROM {supplier})
SELECT pattern_id, "start", "end", CAST(greatest(60, floor(headway * factor * scale)) AS int) AS headway FROM s CROSS JOIN p""")
def service_headways(t):
    k = F.col("s_suppkey")
    services = t("supplier").select(k.alias("pattern_id"), (1 + k % 3 / 2).alias("factor"), (1 + k % 4).alias("scale"))
    return build.service_trips(services, services.sparkSession.createDataFrame([(19800, 25200, 480), (25200, 32400, 300), (32400, 61200, 600)], "start int, end int, headway int"))


@query("SELECT n_name || CASE WHEN n_nationkey % 4 = 0 THEN '?' ELSE '' END AS name, count(*) FILTER (WHERE s_suppkey IS NOT NULL AND n_nationkey % 4 > 0) AS n FROM nation LEFT JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def network_coverage(t):
    wanted = t("nation").select(F.concat("n_name", F.when(F.col("n_nationkey") % 4 == 0, "?").otherwise("")).alias("name"))
    return build.covered_names(wanted, t("dong").select(F.col("gu").alias("name")))


@query("""
SELECT stop_id, lat BETWEEN 33.0::double AND 39.0::double AND lon BETWEEN 124.0::double AND 132.0::double AS in_country, lat BETWEEN 37.4::double AND 37.75::double AND lon BETWEEN 126.7::double AND 127.25::double AS in_city, lat BETWEEN 37.51::double AND 37.52::double AND lon BETWEEN 127.0::double AND 127.02::double AS in_block FROM {stop}""")
def bounding_boxes(t):
    return build.in_boxes(t("stop"), build.BOXES | {"block": (37.51, 127.0, 37.52, 127.02)}).drop("lat", "lon")


@query("""
SELECT trip_id, route_id AS ref, n_name AS line FROM {trip} JOIN nation ON n_nationkey = route_id WHERE n_nationkey % 3 > 0""")
def allowed_refs(t):
    names = t("nation").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("ref"), F.col("n_name").alias("line"))
    return build.allowed_lines(t("trip").select("trip_id", F.col("route_id").alias("ref")), names)


@query(f"{_BUILT} SELECT a.station, a.line AS a, b.line AS b FROM pf a JOIN pf b ON a.station = b.station AND a.line <> b.line")
def platform_pairs(t):
    nodes, stations, stops = _built(t)
    return build.platform_pairs(build.platforms(stops, stations, nodes))


@query("""
WITH s AS (SELECT route_id AS line, trip_id, count(*) AS n FROM {pattern_stop} JOIN {trip} USING (trip_id) GROUP BY ALL)
SELECT line, count(*) AS chains, max(n) AS longest, min(n) AS least FROM s GROUP BY line""")
def chain_sizes(t):
    return build.chain_sizes(t("pattern_stop").join(t("trip"), "trip_id").select(F.col("route_id").alias("line"), F.col("trip_id").alias("pattern_id"), "pos"))


@query("""
WITH c AS (SELECT l_suppkey % 40 AS origin, l_partkey % 40 AS dest, l_orderkey % 86400 AS dep, min(l_orderkey % 86400 + CAST(l_quantity AS bigint)) AS arr FROM {lineitem} GROUP BY 1, 2, 3)
SELECT origin, dest, array_to_string(list(CAST(dep AS varchar) || '-' || CAST(arr AS varchar) ORDER BY dep), ',') AS departures FROM c GROUP BY origin, dest""")
def sorted_departures(t):
    k = F.col("l_orderkey") % 86400
    c = t("lineitem").select((F.col("l_suppkey") % 40).alias("origin"), (F.col("l_partkey") % 40).alias("dest"), k.alias("dep"), (k + F.col("l_quantity").cast("long")).alias("arr"))
    return build.sorted_departures(c).withColumn("departures", F.array_join(F.transform("departures", lambda x: F.concat_ws("-", x["dep"].cast("string"), x["arr"].cast("string"))), ","))


@query(f"""
WITH RECURSIVE e AS (SELECT a.stop_id AS src, b.stop_id AS dst, CAST(floor({_meters('a.', 'b.')}) AS bigint) AS cost FROM {{stop}} a JOIN {{stop}} b ON a.stop_id <> b.stop_id AND abs(a.lat - b.lat) < 0.01 AND {_meters('a.', 'b.')} <= 400),
r AS (SELECT stop_id AS start, stop_id AS node, CAST(0 AS bigint) AS cost FROM {{stop}} UNION SELECT r.start, e.dst, r.cost + e.cost FROM r JOIN e ON r.node = e.src WHERE r.cost + e.cost <= 990),
c AS (SELECT start, node, min(cost) AS cost FROM r GROUP BY start, node)
SELECT start, node, round(cost / greatest(1.0::double, {_meters('a.', 'b.')}), 4) AS ratio FROM c JOIN {{stop}} a ON a.stop_id = start JOIN {{stop}} b ON b.stop_id = node WHERE start <> node""")
def walk_detours(t):
    at, costs = walked_costs(t)
    return spatial.spread(build.detours(costs, at.where("stop_id = spot").select("stop_id", "lat", "lon")), at, "start", "node").where("start <> node")


@query("""
WITH w AS (SELECT trip_id, first_start, last_start, headway, (trip_id % 5000 * 31 + 77) & 67108863 AS phase FROM {pattern_window}),
f AS (SELECT *, first_start + phase % headway AS f FROM w)
SELECT trip_id, f AS first_start, CASE WHEN f > last_start THEN f ELSE f + (last_start - f) // headway * headway END AS last_start, headway FROM f""")
def rephased_windows(t):
    return access.rephased(t("pattern_window").withColumn("phase", F.col("trip_id") % 5000), 77)


@query("""
SELECT count(*) AS n, round(count(*) FILTER (WHERE ours <= 40 AND ext <= 40) / nullif(count(*) FILTER (WHERE ours <= 40), 0), 4) AS precision, round(count(*) FILTER (WHERE ours <= 40 AND ext <= 40) / nullif(count(*) FILTER (WHERE ext <= 40), 0), 4) AS recall,
       round(avg(ours - ext), 4) AS bias, round(avg(abs(ours - ext)), 4) AS mae, list_sort(list(ours - ext))[count(*) // 2 + 1] AS median FROM {od}""")
def door_to_door(t):
    return calibration.door_to_door(t("od"), 40)


_SERVED = """
WITH RECURSIVE ps AS (SELECT * FROM {line_pattern}),
hub AS (SELECT DISTINCT pattern_id AS a, min(pattern_id) OVER (PARTITION BY line, express, node) AS b FROM ps),
link AS (SELECT a, b FROM hub WHERE a <> b UNION SELECT b, a FROM hub WHERE a <> b),
reached AS (SELECT DISTINCT pattern_id AS p, pattern_id AS seen FROM ps UNION SELECT r.p, l.b FROM reached r JOIN link l ON r.seen = l.a),
comp AS (SELECT p AS pattern_id, min(seen) AS c FROM reached GROUP BY p),
pat AS (SELECT line, express, c, pattern_id, count(*) AS n, list(node ORDER BY pos) AS seq FROM ps JOIN comp USING (pattern_id) GROUP BY ALL),
ranked AS (SELECT *, list_reverse(seq) AS back, row_number() OVER (PARTITION BY c ORDER BY n DESC, pattern_id) AS rk FROM pat),
ref AS (SELECT c, node, min(pos) AS place FROM ps JOIN ranked USING (pattern_id) WHERE rk = 1 GROUP BY c, node),
known AS (SELECT pattern_id, ps.pos, place, lag(place) OVER (PARTITION BY pattern_id ORDER BY ps.pos) AS before FROM ps JOIN comp USING (pattern_id) JOIN ref USING (c, node)),
vote AS (SELECT pattern_id, count(*) FILTER (WHERE place < before) > count(*) FILTER (WHERE place > before) AS against FROM known GROUP BY pattern_id),
led AS (SELECT r.*, first_value(against) OVER w AS d0, first_value(seq) OVER w AS lead_seq, row_number() OVER w AS nth
  FROM ranked r LEFT JOIN vote USING (pattern_id) WINDOW w AS (PARTITION BY c, least(seq, back) ORDER BY rk)),
placed AS (SELECT line, express, c, pattern_id, seq, back, rk, CASE WHEN nth = 1 OR seq = lead_seq AND seq <> back THEN coalesce(d0, false)::int ELSE 1 - coalesce(d0, false)::int END AS dir FROM led),
first_at AS (SELECT DISTINCT arg_min(pattern_id, rk) AS pattern_id FROM ps JOIN placed USING (pattern_id) GROUP BY c, dir, node),
k0 AS (SELECT * FROM placed WHERE pattern_id IN (FROM first_at)),
k1 AS (SELECT * FROM k0 UNION ALL SELECT * FROM placed p WHERE dir = 0 AND pattern_id NOT IN (FROM first_at) AND EXISTS (SELECT 1 FROM k0 WHERE k0.c = p.c AND k0.dir = 1 AND k0.seq = p.back)),
served AS (SELECT * FROM k1 UNION ALL SELECT * FROM placed p WHERE dir = 1 AND pattern_id NOT IN (FROM first_at) AND EXISTS (SELECT 1 FROM k1 WHERE k1.c = p.c AND k1.dir = 0 AND k1.seq = p.back))"""


@query(f"{_SERVED} SELECT line, express, pattern_id, dir FROM served")
def service_set(t):
    return service.service_set(t("line_pattern"))


def _rail(t):
    platforms = t("stop").select(F.col("stop_id").alias("node"), "lat", "lon")
    pairs = t("line_pattern").where("express").select("pattern_id", "pos", "node")
    hop = pairs.withColumn("_to", F.lead("node").over(Window.partitionBy("pattern_id").orderBy("pos"))).where("_to IS NOT NULL")
    measured = hop.select(F.least("node", "_to").alias("a"), F.greatest("node", "_to").alias("b")).distinct().withColumn("meters", (500 + F.col("a") * 7 + F.col("b") * 3).cast("double"))
    lines = t("line_pattern").where("line % 5 = 0").select("line").distinct().withColumn("factor", 1 + F.col("line") % 4 / 2)
    # The weekday's periods and headways.
    periods = platforms.sparkSession.createDataFrame([(19800, 25200, 360), (25200, 32400, 180), (32400, 61200, 360), (61200, 72000, 240), (72000, 82800, 300), (82800, 88800, 600)], "start int, end int, headway int")
    return service.rail_trips(t("line_pattern"), platforms, measured, lines, periods)


@query(f"""{_SERVED},
run AS (SELECT ps.pattern_id, s.dir, ps.pos, ps.node, lag(ps.node) OVER (PARTITION BY ps.pattern_id ORDER BY ps.pos) AS prev FROM ps JOIN served s USING (pattern_id)),
ehop AS (SELECT node AS x, lead(node) OVER (PARTITION BY pattern_id ORDER BY pos) AS y FROM ps WHERE express),
measured AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, (500 + least(x, y) * 7 + greatest(x, y) * 3)::double AS meters FROM ehop WHERE y IS NOT NULL),
hop AS (SELECT run.*, CASE WHEN prev IS NULL THEN NULL ELSE coalesce(m.meters, {_meters('x.', 'z.')}) END AS m FROM run
  LEFT JOIN measured m ON m.a = least(node, prev) AND m.b = greatest(node, prev) JOIN {{stop}} x ON x.stop_id = node LEFT JOIN {{stop}} z ON z.stop_id = prev)
SELECT pattern_id, dir, pos, node, CAST(sum(CASE WHEN m IS NULL THEN 0 ELSE greatest(30, floor(m / (CASE WHEN m < 1500 THEN 32.0::double ELSE 50.0::double END / 3.6::double))) + 10 END) OVER (PARTITION BY pattern_id ORDER BY pos) AS bigint) AS "at" FROM hop""")
def rail_stop_times(t):
    return _rail(t)[0]


@query(f"""{_SERVED},
visit AS (SELECT pattern_id, dir, node FROM ps JOIN served USING (pattern_id)), shared AS (SELECT node, dir, count(*) AS k FROM visit GROUP BY node, dir),
scaled AS (SELECT pattern_id, list_sort(list(k))[count(*) // 2 + 1] AS scale FROM visit JOIN shared USING (node, dir) GROUP BY pattern_id),
p AS (SELECT * FROM (VALUES (19800, 25200, 360), (25200, 32400, 180), (32400, 61200, 360), (61200, 72000, 240), (72000, 82800, 300), (82800, 88800, 600)) x("start", "end", headway))
SELECT pattern_id, "start", "end", CAST(greatest(60, floor(headway * CASE WHEN line % 5 = 0 THEN 1 + line % 4 / 2.0::double ELSE 1 END * scale)) AS int) AS headway FROM served JOIN scaled USING (pattern_id) CROSS JOIN p""")
def rail_windows(t):
    return _rail(t)[1]
