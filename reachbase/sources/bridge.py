"""Domain tables (stops, trips, contracts, observations) derived from the star-schema tables.

Every view is one SELECT that Spark and DuckDB read alike; ``{name}`` stands for a table or
another view. Spark plans them as parts of the query, DuckDB gets them as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from reachbase.operators.ranges import dealt, parts_for

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

VIEWS = {
    "stop": "SELECT s_suppkey AS stop_id, 3.75e1 + ((s_suppkey * 37) % 101) / 2.5e3 AS lat, 1.27e2 + ((s_suppkey * 61) % 103) / 2.5e3 AS lon FROM {supplier}",
    "trip_leg": """
SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, CAST(60 + floor(l_quantity) * 6 AS bigint) AS leg,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS pos
FROM {lineitem}""",
    "pattern_stop": """
SELECT trip_id, pos, stop_id, CAST(sum(leg) OVER (PARTITION BY trip_id ORDER BY pos) - first_value(leg) OVER (PARTITION BY trip_id ORDER BY pos) AS bigint) AS off
FROM {trip_leg}""",
    "pattern_window": """
SELECT o_orderkey AS trip_id, 18000 + (o_orderkey % 7) * 3600 AS first_start, 18000 + (o_orderkey % 7) * 3600 + 14400 AS last_start, 300 + (o_orderkey % 5) * 300 AS headway
FROM {orders}""",
    "trip": """
SELECT o_orderkey AS trip_id, o_orderkey % 20 AS route_id, o_orderpriority AS route_type,
       CASE o_orderstatus WHEN 'F' THEN 'WD' WHEN 'O' THEN 'SA' ELSE 'DAILY' END AS service
FROM {orders}""",
    # A line's patterns: each trip's stops, and for some trips the way back.
    "line_pattern": """
SELECT trip_id * 2 AS pattern_id, trip_id % 1500 AS line, trip_id % 4 = 0 AS express, pos, stop_id AS node FROM {pattern_stop}
UNION ALL
SELECT trip_id * 2 + 1, trip_id % 1500, trip_id % 4 = 0, 1 + count(*) OVER (PARTITION BY trip_id) - pos, stop_id FROM {pattern_stop} WHERE trip_id % 3 > 0""",
    "deal": """
SELECT l_partkey AS seq, CAST(l_suppkey % 25 AS int) AS sgg, l_suppkey AS umd, l_quantity * 1.5e0 AS area, CAST(floor(l_extendedprice / 1e1) AS int) AS amount,
       CASE WHEN l_returnflag = 'A' THEN 0 ELSE 20 + CAST(floor(l_discount * 1e3 + 5e-1) AS int) END AS monthly,
       l_returnflag AS kind, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS int) AS ym, CAST(l_linenumber % 3 AS int) AS file_no, l_orderkey AS ord, l_linenumber AS line_no,
       CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 'SALE' ELSE 'RENT' END AS trade
FROM {lineitem}""",
    "dong": "SELECT s_suppkey AS dong_id, s_name AS name, n_name AS gu, lat, lon FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {stop} ON s_suppkey = stop_id",
    "speed_obs": "SELECT user_id AS route, CAST(event_id % 40 AS int) AS ord, CAST((event_id * 37) % 12000 AS int) AS meters, CAST(floor(value) AS int) % 115 AS kmh, event_type AS type, CAST(ts AS date) AS snapshot FROM {events}",
    "fleet": "SELECT event_type AS type, CAST(1 + event_id % 20 AS int) AS n, CAST(hour(ts) * 60 + minute(ts) AS int) AS at_minute FROM {events}",
    "place": "SELECT c_custkey AS place_id, c_mktsegment AS category, 3.75e1 + ((c_custkey * 53) % 101) / 2.5e3 AS lat, 1.27e2 + ((c_custkey * 29) % 103) / 2.5e3 AS lon FROM {customer}",
    "elevation": "SELECT s_suppkey AS stop_id, s_acctbal / 1e2 AS metres FROM {supplier}",
    "od": """
SELECT o_orderkey AS od_id, CAST(10 + floor(o_totalprice / 1e4) AS int) AS ours, CAST(12 + (floor(o_totalprice / 1e4) * 7 + o_orderkey) % 60 AS int) AS ext,
       o_orderstatus AS band, o_orderkey % 5 = 0 AS frozen
FROM {orders}""",
    "leg_obs": """
SELECT l_orderkey AS od_id, CAST(1 + floor(l_quantity / 5) AS int) AS stops, l_extendedprice / 1e1 AS ours_m, l_extendedprice / 1e1 * (1 + l_discount) AS ext_m,
       CAST(floor(l_extendedprice / 1e2) + 30 * floor(l_quantity / 5) AS int) AS ours_sec, CAST(floor(l_extendedprice / 9e1) + 41 * floor(l_quantity / 5) AS int) AS ext_sec,
       l_linestatus AS type, l_linenumber AS line_no, l_partkey AS part
FROM {lineitem}""",
    # What reaches a neighbourhood: a stand-in for the routed matrix where a query is about searching it.
    "reach": """
SELECT l_partkey % 50 AS origin, CAST(l_orderkey % 20 AS int) AS slot, l_suppkey AS dong_id, CAST(min(l_orderkey * 7 % 150) AS int) AS minutes, CAST(min(l_partkey * 3 % 20) AS int) AS walk
FROM {lineitem} GROUP BY l_partkey % 50, l_orderkey % 20, l_suppkey""",
    "amenity": """
SELECT s_suppkey AS dong_id, code, CAST(sum(k) AS int) AS n
FROM (SELECT c_nationkey, c_mktsegment AS code, c_custkey % 3 AS r, count(*) AS k FROM {customer} GROUP BY c_nationkey, c_mktsegment, c_custkey % 3) c
JOIN {supplier} ON s_nationkey = c_nationkey WHERE (r + s_suppkey) % 3 > 0 GROUP BY s_suppkey, code""",
}
#: The table that a view's windows sort, and their key: long ones are dealt in more parts than the session has.
DEALT = {"trip_leg": ("lineitem", "l_orderkey")}
_NAME = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = VIEWS[name]
    tables = {n: load(spark, sf_dir, n) for n in set(_NAME.findall(body))}
    if name in DEALT:
        table, key = DEALT[name]
        tables[table] = dealt(tables[table], parts_for(tables[table]), key)
    return spark.sql(body, **tables)


def oracle(body: str) -> str:
    """DuckDB SQL with the views that the body names, and those that they name, in front."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in _NAME.findall(VIEWS[name]):
                need(n)
            order.append(name)

    for n in _NAME.findall(body):
        need(n)
    plain = _NAME.sub(r"\1", body).strip()
    if not order:
        return plain
    views = ",\n".join(f"{n} AS ({_NAME.sub(chr(92) + '1', VIEWS[n])})" for n in order)
    if plain.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{plain[14:]}"
    return f"WITH {views},\n{plain[4:]}" if plain.upper().startswith("WITH") else f"WITH {views}\n{plain}"
