import re

from pyspark.sql import functions as F

from reachbase.operators import access


def test_walkable_tags(spark):
    rows = [({"highway": "footway"}, True), ({"highway": "motorway"}, False), ({"highway": "trunk", "foot": "yes"}, False), ({"highway": "trunk"}, False), ({"highway": "service", "access": "private"}, False), ({"highway": "primary_link"}, True), ({"highway": "path", "foot": "no"}, False), ({"building": "yes"}, False)]
    df = spark.createDataFrame(rows, "tags map<string, string>, ok boolean")
    assert df.where(access.is_walkable(F.col("tags")) != F.col("ok")).count() == 0


def test_access_by_ways_and_straight(spark):
    nodes = spark.createDataFrame([(i, 37.5, 127 + i * 0.002) for i in range(5)] + [(99, 37.9, 127.9)], "id long, lat double, lon double")
    ways = spark.createDataFrame([(1, {"highway": "path"}, [0, 1, 2, 3, 4]), (2, {"highway": "motorway"}, [4, 99])], "id long, tags map<string, string>, refs array<long>")
    edges = access.walk_edges(ways, nodes)
    assert edges.count() == 8
    good = access.walkable_nodes(nodes, edges, 3)
    assert good.count() == 5
    stops = spark.createDataFrame([(7, 37.5001, 127.004), (8, 37.7, 127.0)], "stop_id long, lat double, lon double")
    points = spark.createDataFrame([("near", 37.5, 127.0), ("off", 37.7005, 127.0)], "a string, a_lat double, a_lon double")
    got = {(r["a"], r["stop_id"]): r["sec"] for r in access.access_stops(points, stops, good, edges).collect()}
    assert set(got) == {("near", 7), ("off", 8)} and 320 < got["near", 7] < 345 and 65 < got["off", 8] < 75


def test_heights_take_the_lowest_probe(spark):
    heights = spark.createDataFrame([(i, j, float(i + j)) for i in range(370, 376) for j in range(1268, 1274)], "row long, col long, metres double")
    points = spark.createDataFrame([("p", 37.2, 127.0)], "a string, a_lat double, a_lon double")
    assert access.ground_heights(points, heights, 0.1).first()["metres"] == 371 + 1269


def test_the_servers_filter_agrees_with_the_predicate(spark):
    """Each clause of the filter, applied to tags as a server would, lets the same ways through."""
    clauses = re.findall(r'\["(\w+)"(~|!=|!~)"([^"]*)"\]', access.walkable_filter())
    rules = {"~": lambda v, x: v is not None and re.search(x, v), "!=": lambda v, x: v != x, "!~": lambda v, x: v is None or not re.search(x, v)}
    tags = [{"highway": h} | ({"foot": f} if f else {}) | ({"access": a} if a else {}) for h in ("footway", "motorway", "primary_link", "primary_links") for f in (None, "no", "yes") for a in (None, "no", "private", "yes")]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, tags map<string, string>").where(access.is_walkable(F.col("tags"))).collect()
    assert {r["i"] for r in got} == {i for i, t in enumerate(tags) if all(rules[op](t.get(key), x) for key, op, x in clauses)}
