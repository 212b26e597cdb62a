"""What keeps tasks small on long tables: rows dealt in parts by number, and few sorts."""

import re

import pytest

from reachbase.operators import checks, feeds, network, ordered, ranges, routing
from reachbase.plans import QUERIES, registry
from reachbase.sources import bridge
from tests.conftest import SF_DIR
from tests.test_oracle import duck, plain  # noqa: F401

PARTS = 7


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def in_parts(monkeypatch):
    """As if tables were long: seven parts, where the session has three."""
    for module in (bridge, *[__import__(f"reachbase.plans.{m}", fromlist=["x"]) for m in ("feed_queries", "network_queries", "rule_queries", "transit_queries")]):
        monkeypatch.setattr(module, "parts_for", lambda base: PARTS, raising=False)


def test_parts(spark):
    assert [ranges.parts_for(spark.range(n), 3) for n in (0, 3, 10)] == [0, 1, 4]
    rows = spark.range(10)
    assert ranges.dealt(rows, 3, "id") is rows and ranges.dealt(rows, None, "id") is rows
    assert ranges.dealt(rows, PARTS, "id").rdd.getNumPartitions() == PARTS


def equal_to_sql(spark, duck, name):  # noqa: F811
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    known = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in known.description]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in known.fetchall())
    return plan_of(got)


def test_service_windows_stay_in_their_row(spark):
    """pieces of a day aren't dealt or sorted."""
    routes = spark.createDataFrame([(1, "x", 300, 1300, 300), (2, "y", 500, 500, 60), (3, None, 330, 340, 900)], "route_id long, type string, start_min long, end_min long, headway long")
    factors = spark.createDataFrame([("x", 0, 2.0), ("x", 1, 2.0), ("x", 4, 0.1)], "type string, period int, factor double")
    got = ordered.service_windows(routes, factors)
    assert "Window" not in plan_of(got) and "Sort " not in plan_of(got).replace("SortAggregate", "")
    assert sorted(map(tuple, got.collect())) == [(1, 300, 330, 300), (1, 330, 540, 600), (1, 540, 1200, 300), (1, 1200, 1300, 60), (2, 500, 500, 60), (3, 330, 340, 900)]


@pytest.mark.parametrize("name", ["gtfs_plausibility", "implied_speed_check", "gtfs_ref_errors", "run_scale", "timetable_patterns", "clean_feed"])
def test_long_tables_are_dealt_in_more_parts(spark, duck, in_parts, name):  # noqa: F811
    """same rows, and every sort for a window is of one of the seven parts."""
    plan = equal_to_sql(spark, duck, name).split("== Initial Plan ==")[-1]
    assert f", {PARTS})" in plan
    windowed = re.findall(r"Exchange hashpartitioning\((?:trip_id|l_orderkey|run_id|line)\S*,.*?(\d+)\), (\w+)", plan)
    assert windowed and all(n == str(PARTS) for n, why in windowed if why == "REPARTITION_BY_NUM")


def test_trains_are_sorted_once(spark):
    """gaps, runs and hops come from one order."""
    rows = spark.createDataFrame([("L", "t", "d", "A", 18_000, 37.5, 127.0)], "line string, train string, dir string, station string, at int, lat double, lon double")
    assert plan_of(network.train_runs(rows)).count("Sort [line") <= 1


def test_times_meet_stops_and_trips_as_distinct_ids(spark):
    """a stop's times don't meet it one by one."""
    times = spark.createDataFrame([(1, 1, 5, 0), (1, 2, 6, 60), (2, 1, 5, 0), (3, 1, 9, 50), (3, 2, 5, 0)], "trip_id long, pos int, stop_id long, off long")
    stops = spark.createDataFrame([(5, 37.5, 127.0), (6, 37.5, 127.0), (7, 37.5, 127.0)], "stop_id long, lat double, lon double")
    trips = spark.createDataFrame([(1,), (2,), (4,)], "trip_id long")
    windows = spark.createDataFrame([(1, 0, 10, 60), (2, 0, 10, 60), (4, 5, 0, 60)], "trip_id long, first_start int, last_start int, headway int")
    for parts in (None, PARTS):
        got = checks.timetable_errors(stops, trips, times, windows, parts)
        assert sorted((r["rule"], r["key"]) for r in got.collect()) == [("bad window", "4"), ("single stop", "2"), ("time goes backwards", "3"), ("trip without times", "4"), ("unknown stop", "9"), ("unknown trip", "3"), ("unused stop", "7")]
        assert [r["n"] for r in feeds.clean_feed(stops.selectExpr("*", "0 AS location_type"), times, windows, parts)[1].groupBy().count().withColumnRenamed("count", "n").collect()] == [2]


def test_dense_departures_are_few(spark):
    """of an hour's departures those stay that no later one overtakes; nothing that is asked finds another arrival."""
    trains = [(1, 2, 7200 + 10 * k, 7200 + 10 * k + 300 + (k * 37 % 360) * 20) for k in range(720)]
    table = spark.createDataFrame(trains, "origin int, dest int, dep long, arr long")
    rows = {r["hour"]: r for r in routing._hourly(table).collect()}
    assert sorted(rows) == [2, 3] and all(len(r["departures"]) < 90 for r in rows.values())
    for t in range(7200, 14_400, 7):
        r = rows[t // 3600]
        found = [d["arr"] for d in r["departures"] if d["dep"] >= t] + [x for x in (r["later"],) if x is not None]
        assert min(found, default=None) == min((arr for _, _, dep, arr in trains if dep >= t), default=None)
