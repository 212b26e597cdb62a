import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from reachbase.functions import exprs
from reachbase.functions.medians import at_share, lower_middle, upper_middle
from reachbase.operators import calibration, checks, graph, housing, network, ordered, ranges, reach, service, spatial


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_middles(spark):
    for n in range(1, 12):
        df = spark.createDataFrame([(random.Random(n).random() + i,) for i in range(n)], "v double")
        s = sorted(r["v"] for r in df.collect())
        got = df.agg(upper_middle("v").alias("u"), lower_middle("v").alias("l"), *[at_share("v", q).alias(f"q{q}".replace(".", "_")) for q in (0.05, 0.4, 0.6, 0.95)]).first()
        assert (got["u"], got["l"]) == (s[n // 2], s[(n - 1) // 2])
        assert [got[i] for i in range(2, 6)] == [s[min(n - 1, int(n * q))] for q in (0.05, 0.4, 0.6, 0.95)]


def hashed(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return (h ^ h >> 15) & 0x3FFFFFF


def test_scalar_rules(spark):
    for s in ("", "a", "bus:1234_x", "Z" * 50):
        assert one(spark, exprs.phase_hash(F.lit(s))) == hashed(s)
    assert one(spark, exprs.java_round(F.lit(-2.5))) == -2
    assert [one(spark, exprs.seconds_of(F.lit(t))) for t in ("25:30:00", "7:00:01", "x", "1:70:00")] == [91800, 25201, None, None]
    assert one(spark, exprs.clock(F.lit(91800))) == "25:30:00"
    assert [one(spark, exprs.strip_parenthetical(F.lit(t))) for t in ("Seoul (Line 1)", "(x) y", "plain")] == ["Seoul", "(x) y", "plain"]
    assert [one(spark, exprs.station_name_key(F.lit(t))) for t in ("홍대입구역(2)", "역", "서 울·역")] == ["홍대입구", "역", "서울"]
    assert [one(spark, exprs.price_label(F.lit(v))) for v in (9500, 10000, 12345, 20049)] == ["9,500만", "1억", "1.2억", "2억"]
    assert [one(spark, exprs.money(F.lit(v))) for v in ("1,200", " 5 ", "x")] == [1200, 5, 0]
    assert [one(spark, exprs.period_of(F.lit(m))) for m in (10, 300, 430, 1379, 1439)] == [5, None, 1, 4, 5]
    assert [one(spark, exprs.clock_or(F.lit(t), "0500")) for t in ("2710", "2800", "12", None)] == ["2710", "0500", "0500", "0500"]
    assert [one(spark, exprs.minutes_or_null(F.lit(s), 120)) for s in (29, 30, 7169, 7170)] == [0, 1, 119, None]
    assert one(spark, exprs.band_breaks(F.lit(60))) == [0, 15, 30, 45, 60] and one(spark, exprs.band_breaks(F.lit(50)))[-1] == 50
    assert one(spark, exprs.unescape_xml(F.lit("&amp;lt; &lt;&#39;"))) == "&lt; <'"
    assert one(spark, network.is_express(F.lit("수도권 광역급행철도"))) is False and one(spark, network.is_express(F.lit("경의중앙선 급행"))) is True
    assert one(spark, exprs.haversine(F.lit(37.5), F.lit(127.0), F.lit(37.5), F.lit(127.0))) == 0
    assert one(spark, exprs.segment_meters(F.lit(100), F.lit(200.0), 1.076)) == pytest.approx(215.2)
    assert [one(spark, exprs.line_factor(F.lit(n))) for n in ("수인분당선", "GTX-A", "2호선")] == [1.6, 3.5, 1.0]
    assert [one(spark, exprs.type_speed(F.lit(n))) for n in ("마을버스", "x")] == [14.0, None]
    assert one(spark, exprs.is_pass_through(F.lit("a(미정차)"))) and one(spark, exprs.slot_floor(F.lit(59))) == 30
    assert one(spark, exprs.period_label(F.lit(5))) == "23:00~00:40" and one(spark, exprs.coordinate_key(F.lit(37.5), F.lit(127.1234567))) == "37.50000,127.12346"
    assert one(spark, exprs.recent_months(F.lit("2026-02-15").cast("date"), 3)) == ["202601", "202512", "202511"]
    assert [one(spark, exprs.headway_of(F.lit(t))) for t in ("10~15", "10, 13", "-", "999")] == [12, 12, None, None]
    assert one(spark, exprs.building_key(F.lit(" "), F.lit("11"), F.lit("a"), F.lit(None).cast("string"))) == "11|a|DONG"
    assert [one(spark, exprs.road_address(F.lit("r"), F.lit("00012"), F.lit(s))) for s in ("00000", "00003")] == ["r 12", "r 12-3"]
    assert one(spark, exprs.slot_label(F.lit(True), F.lit(90000))) == "도착 01:00"


def meters(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * exprs.EARTH_M * math.asin(math.sqrt(h))


def test_distance_joins_miss_nothing(spark):
    rng = random.Random(4)
    left = [(i, 37.5 + rng.random() / 50, 127 + rng.random() / 50) for i in range(80)]
    right = [(i, 37.5 + rng.random() / 50, 127 + rng.random() / 50) for i in range(60)]
    a, b = spark.createDataFrame(left, "a int, a_lat double, a_lon double"), spark.createDataFrame(right, "b int, b_lat double, b_lon double")
    plain = {(x[0], y[0]) for x, y in itertools.product(left, right) if meters(x[1:], y[1:]) <= 400}
    assert {(r["a"], r["b"]) for r in spatial.within(a, b, 400).collect()} == plain
    nearest = {x[0]: min(right, key=lambda y: meters(x[1:], y[1:]))[0] for x in left}
    assert {r["a"]: r["b"] for r in spatial.nearest_any(a, b).collect()} == nearest
    assert {r["a"]: r["b"] for r in spatial.nearest_any(a, b, first=50.0).collect()} == nearest
    counts = {r["a"]: r["n"] for r in spatial.count_within(a, b, 400).collect()}
    assert counts == {x[0]: sum(p[0] == x[0] for p in plain) for x in left}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and {got[i] for i in (100, 101, 103)} == {100}


def test_bag_union_keeps_repeats_of_one_file(spark):
    rows = [(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (2, 1, "d"), (2, 1, "e"), (2, 2, "f")]
    got = housing.bag_union(spark.createDataFrame(rows, "id int, file_no int, x string"), ["id"])
    assert sorted(r["x"] for r in got.collect()) == ["a", "b", "d", "e"]


def test_islands_share_their_border(spark):
    rows = [(1, i, d) for i, d in enumerate("aabbbac")]
    got = ordered.islands(spark.createDataFrame(rows, "k int, o int, d string"), "k", "o", "d").collect()
    parts = {}
    for r in sorted(got, key=lambda r: (r["island"], r["place"])):
        parts.setdefault(r["island"], []).append(r["o"])
    assert list(parts.values()) == [[0, 1], [1, 2, 3, 4], [4, 5], [5, 6]]


def test_turnaround(spark):
    there = [(1, i + 1, 37.5 + i * 0.01, 127.0) for i in range(6)]
    back = [(1, 6 + i, 37.55 - i * 0.01, 127.0005) for i in range(1, 6)]
    ring = [(2, i + 1, 37.5 + 0.05 * math.sin(i * math.pi / 5), 127 + 0.05 * math.cos(i * math.pi / 5)) for i in range(11)]
    got = {r["trip_id"]: (r["far"], r["split"]) for r in ordered.turnarounds(spark.createDataFrame(there + back + ring, "trip_id int, pos int, lat double, lon double")).collect()}
    assert got[1] == (5, True) and got[2][1] is False


def test_chains(spark):
    edges = spark.createDataFrame([("L", a, b) for a, b in ((1, 2), (2, 3), (3, 4), (3, 9))], "line string, a long, b long")
    got = {}
    for r in network.chains(edges).orderBy("chain", "seq").collect():
        got.setdefault(r["chain"], []).append(r["node"])
    assert sum(len(c) - 1 for c in got.values()) == 4 and got[0] == [1, 2, 3, 4]


def plain_service_set(patterns):
    """The rules walked pattern by pattern; patterns: pattern_id -> stops of one line and kind."""
    out, left = {}, dict(patterns)
    while left:
        component, grown = {min(left)}, True
        while grown:
            nodes = {n for p in component for n in left[p]}
            more = {p for p in left if nodes & set(left[p])} | component
            grown, component = more != component, more
        ordered = sorted(component, key=lambda p: (-len(left[p]), p))
        place = {}
        for i, n in enumerate(left[ordered[0]]):
            place.setdefault(n, i)
        placed = []
        for p in ordered:
            stops = left[p]
            twin = next((d for q, d in placed if left[q] == stops[::-1]), None)
            known = [place[n] for n in stops if n in place]
            steps = [(b > a) - (b < a) for a, b in zip(known, known[1:], strict=False)]
            placed.append((p, 1 - twin if twin is not None else int(steps.count(-1) > steps.count(1))))
        kept = {}
        for side in (0, 1):
            covered = set()
            for p, d in placed:
                if d == side and not set(left[p]) <= covered:
                    covered |= set(left[p])
                    kept[p] = d
        for side in (0, 1):
            for p, d in placed:
                if d == side and p not in kept and any(e != d and left[q] == left[p][::-1] for q, e in kept.items()):
                    kept[p] = d
        out |= kept
        left = {p: s for p, s in left.items() if p not in component}
    return out


def pattern_rows(spark, patterns, line="L", express=False):
    rows = [(line, express, p, i + 1, n) for p, stops in patterns.items() for i, n in enumerate(stops)]
    return spark.createDataFrame(rows, "line string, express boolean, pattern_id long, pos int, node long")


def test_service_set(spark):
    # One line in two parts; b2 turns b round, and skip adds nothing.
    patterns = {1: [1, 2, 3, 4, 5], 2: [5, 4, 3, 2, 1], 3: [7, 8, 9], 4: [9, 8, 7], 5: [1, 3, 5]}
    got = {r["pattern_id"]: r["dir"] for r in service.service_set(pattern_rows(spark, patterns)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1} == plain_service_set(patterns)
    rng = random.Random(17)
    rows, want = None, {}
    for line in range(12):
        some = {}
        for p in range(rng.randint(1, 9)):
            stops = [rng.randrange(line % 4 * 3 + 6) for _ in range(rng.randint(1, 6))]
            some[line * 100 + p] = stops
            if rng.random() < 0.5:
                some[line * 100 + 50 + p] = rng.choice([stops[::-1], stops, stops[1:] or stops])
        own = pattern_rows(spark, some, f"L{line}", line % 2 == 0)
        rows = own if rows is None else rows.union(own)
        want |= plain_service_set(some)
    assert {r["pattern_id"]: r["dir"] for r in service.service_set(rows).collect()} == want


@pytest.mark.parametrize("rows", [5, 40])
def test_lines_between_tasks_are_joined(spark, monkeypatch, rows):
    """few rows are linked at once, so lines and what links them lie in several batches."""
    monkeypatch.setattr(service, "LINK_ROWS", rows)
    rng = random.Random(rows)
    table, want = None, {}
    for line in range(4):
        some = {line * 100 + p: [rng.randrange(30) for _ in range(rng.randint(1, 4))] for p in range(20)}
        own = pattern_rows(spark, some, f"L{line}", line % 2 == 0)
        table = own if table is None else table.union(own)
        want |= some_components(some)
    assert dict(map(tuple, service.pattern_components(table).collect())) == want


def some_components(patterns):
    label = {p: p for p in patterns}
    while True:
        now = {p: min(label[q] for q in patterns if set(patterns[p]) & set(patterns[q])) for p in patterns}
        if now == label:
            return label
        label = now


def test_a_lines_patterns_are_linked_in_a_task(spark, monkeypatch):
    """however long a chain of patterns is, no rounds over all patterns follow it."""
    monkeypatch.setattr(service, "connected", None)
    chain = {p: [p, p + 1] for p in range(60)}
    rows = pattern_rows(spark, chain).union(pattern_rows(spark, {p + 100: s for p, s in chain.items()}, "M"))
    assert {(r["pattern_id"], r["component"]) for r in service.pattern_components(rows).collect()} == {(p + k, k) for p in chain for k in (0, 100)}


def test_rail_trips(spark):
    patterns = {1: [1, 2, 3], 2: [3, 2, 1], 3: [2, 3], 4: [1, 2, 4]}
    platforms = spark.createDataFrame([(i, 37.5 + i / 100, 127.0) for i in range(1, 5)], "node long, lat double, lon double")
    measured = spark.createDataFrame([(1, 2, 1000.0)], "a long, b long, meters double")
    lines = spark.createDataFrame([("L", 2.0)], "line string, factor double")
    periods = spark.createDataFrame([(0, 3600, 100), (3600, 7200, 20)], "start int, end int, headway int")
    times, windows = service.rail_trips(pattern_rows(spark, patterns), platforms, measured, lines, periods)
    got = {(r["pattern_id"], r["pos"]): r["at"] for r in times.collect()}
    first = 10 + int(1000 / (32 / 3.6))
    straight = 6_371_000 * math.radians(0.01)
    second = 10 + int(straight / (32 / 3.6))
    assert set(got) == {(p, i) for p in (1, 2, 4) for i in (1, 2, 3)}
    assert got[1, 1] == 0 and got[1, 2] == first and got[1, 3] == pytest.approx(first + second, abs=2)
    assert got[2, 3] - got[2, 2] == first
    # Stops 1 and 2 have two patterns in direction 0, the others one; the middle of (2, 2, 1) is 2.
    assert sorted((r["pattern_id"], r["start"], r["headway"]) for r in windows.collect()) == [(1, 0, 400), (1, 3600, 80), (2, 0, 200), (2, 3600, 60), (4, 0, 400), (4, 3600, 80)]


def test_train_runs(spark):
    day = [("L", "K1", "UP", s, t, 37.5 + i * 0.01, 127.0) for i, (s, t) in enumerate((("a", 23 * 3600), ("b", 23 * 3600 + 300), ("c", 120)))]
    again = [("L", "K1", "UP", s, t, 37.5 + i * 0.01, 127.0) for i, (s, t) in enumerate((("a", 8 * 3600), ("b", 8 * 3600 + 300)))]
    fast = [("L", "K9", "UP", "a", 5 * 3600, 37.5, 127.0), ("L", "K9", "UP", "z", 5 * 3600 + 10, 38.5, 127.0)]
    rows = network.train_runs(spark.createDataFrame(day + again + fast, "line string, train string, dir string, station string, at int, lat double, lon double")).orderBy("signature", "pos").collect()
    runs = {}
    for r in rows:
        runs.setdefault(r["signature"], ([], r["starts"]))[0].append((r["station"], r["off"]))
    assert sorted(runs.values()) == [([("a", 0), ("b", 300)], [28800]), ([("a", 0), ("b", 300), ("c", 3720)], [82800])]


def test_thinning(spark):
    rows = [(1, i, float(i % 5), float(i // 5), -i) for i in range(25)]
    got = [r["key"] for r in network.thinned(spark.createDataFrame(rows, "view int, key int, x double, y double, priority int"), 2, 2, 100).collect()]
    assert sorted(got) == [0, 2, 4, 10, 12, 14, 20, 22, 24]


def test_holdout_is_every_second_key(spark):
    rows = calibration.split_holdout(spark.createDataFrame([(k, i) for k in (9, 4, 7, 1, 30) for i in range(2)], "od_id int, i int")).collect()
    assert {r["od_id"] for r in rows if r["train"]} == {1, 7, 30} and len(rows) == 10


def test_search(spark):
    near = spark.createDataFrame([(1, 20), (2, 30), (3, 10), (4, 5)], "dong_id int, minutes int")
    prices = [(1, "ONE", 9000, 1000, 60, 20), (2, "ONE", 5000, None, None, 15), (3, "ONE", None, 1000, 40, 12), (4, "ONE", 4000, 1000, 50, 9), (5, "ONE", 1, 1000, 30, 99), (6, "ONE", None, None, 30, 99)]
    rooms = spark.createDataFrame(prices, "dong_id int, room string, jeonse int, deposit int, rent int, n int")
    near = near.union(spark.createDataFrame([(5, 61), (6, None)], "dong_id int, minutes int"))
    assert [r["dong_id"] for r in reach.first_five(reach.affordable(near, rooms, "ONE", "JEONSE", 0, 60), [F.col("price")]).collect()] == [2, 1]
    assert {r["dong_id"] for r in reach.affordable(near, rooms, "ONE", "WOLSE", 50, 60).collect()} == {3}


def test_only_known_flat_neighbourhoods(spark):
    near = spark.createDataFrame([(1, 20), (2, 20), (3, 20)], "dong_id int, minutes int")
    rooms = spark.createDataFrame([(i, "ONE", 10, 1000, 40, 12) for i in (1, 2, 3)], "dong_id int, room string, jeonse int, deposit int, rent int, n int")
    climbs = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "dong_id int, climb int")
    assert [(r["dong_id"], r["deposit"]) for r in reach.affordable(near, rooms, "ONE", "WOLSE", 0, 60, climbs).collect()] == [(1, 1000)]


def test_building_summary_rules(spark):
    """Equal months take the first contract, sales aren't long leases, and a rent is compared at the base deposit."""
    rows = [("a", 1, 202401, 1, 30.0, 5000, 0, "RENT"), ("a", 2, 202402, 2, 0.0, 3000, 50, "RENT"), ("a", 3, 202402, 3, 40.0, 90000, 0, "SALE"), ("a", 4, 202401, 4, 35.0, 1000, 40, "RENT"), ("b", 5, 202301, 5, 20.0, 0, 0, "RENT")]
    deals = spark.createDataFrame(rows, "seq string, umd int, ym int, ord int, area double, amount int, monthly int, trade string")
    got = {r["seq"]: r.asDict() for r in housing.building_summary(deals, ["ord"]).collect()}
    assert got["a"] == {"seq": "a", "umd": 2, "ym": 202402, "sale": 90000, "jeonse": 5000, "deposit": 1000, "monthly": 59, "area_min": 30.0, "area_max": 40.0, "deals": 4}
    assert (got["b"]["jeonse"], got["b"]["deposit"], got["b"]["monthly"]) == (None, None, None)


def test_nobody_dwells_at_a_shape_point(spark):
    rows = [(1, 1, 0.0, 36.0, False), (1, 2, 100.0, 36.0, True), (1, 3, 100.0, 36.0, False)]
    timed = ordered.running_seconds(spark.createDataFrame(rows, "trip_id int, pos int, meters double, kmh double, pass_through boolean"), 30)
    assert [(r["place"], r["at"]) for r in ordered.served_stops(timed).orderBy("place").collect()] == [(1, 0), (2, 50)]


def test_pairs_at_high_latitudes(spark):
    """Near the pole a degree of longitude is a few metres."""
    a = spark.createDataFrame([(1, 89.5, 10.0), (2, 70.0, 20.0)], "a int, a_lat double, a_lon double")
    b = spark.createDataFrame([(1, 89.5, 60.0), (2, 70.0, 20.02), (3, 70.009, 20.0)], "b int, b_lat double, b_lon double")
    plain = {(x["a"], y["b"]) for x in a.collect() for y in b.collect() if 2 * 6_371_008.8 * math.asin(math.sqrt(math.sin(math.radians(y["b_lat"] - x["a_lat"]) / 2) ** 2 + math.cos(math.radians(x["a_lat"])) * math.cos(math.radians(y["b_lat"])) * math.sin(math.radians(y["b_lon"] - x["a_lon"]) / 2) ** 2)) <= 50_000}
    assert {(r["a"], r["b"]) for r in spatial.within(a, b, 50_000).collect()} == plain and (1, 1) in plain


def test_places_by_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 50, "x" if i % 3 else "y") for i in range(200)], "v int, kind string")
    for within in (None, "kind"):
        got = ranges.places(rows, ["v"], within).collect()
        for key in ({r["kind"] for r in got} if within else [None]):
            mine = sorted((r["place"], r["v"]) for r in got if key is None or r["kind"] == key)
            assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)


def test_refit_needs_rows_on_both_sides(spark):
    rows = spark.createDataFrame([(i, 3, 500, 420, 900.0) for i in range(60)], "od_id int, stops int, ours_sec int, ext_sec int, ext_m double")
    got = calibration.refit(rows, 58, 1.25).first()
    assert not got["fitted"] and (got["dwell"], got["factor"]) == (58, 1.25)
    more = calibration.refit(rows.union(rows.withColumn("od_id", F.col("od_id") + 100)), 58, 1.25).first()
    assert more["fitted"] and more["dwell"] == 18 and more["mae"] == 0


def test_required_files():
    assert checks.missing_files(["stops.txt", "routes.txt", "trips.txt", "stop_times.txt", "calendar.txt"]) == ["agency.txt", "frequencies.txt"]


def test_counting_meets_each_position_once(spark, monkeypatch):
    places = [(37.5 + i / 1000, 127.0) for i in range(3)]
    a = spark.createDataFrame([(i, *places[i % 3]) for i in range(60)] + [(60, None, None)], "a int, a_lat double, a_lon double")
    b = spark.createDataFrame([(i, *places[i % 2]) for i in range(50)], "b int, b_lat double, b_lon double")
    sizes, inner = [], spatial.within

    def counted(*args, **more):
        found = inner(*args, **more)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(spatial, "within", counted)
    got = {r["a"]: r["n"] for r in spatial.count_within(a, b, 120).collect()}
    assert got == {i: (50 if i % 3 < 2 else 25) for i in range(60)} | {60: 0}
    assert sizes == [5]


def test_equally_near_rows_tie_to_the_smallest(spark):
    # In line with the point, on both sides: the distances differ in their last bits only.
    a = spark.createDataFrame([(i, 37.5 + i * 0.0007, 127.0 + i * 0.0011) for i in range(40)], "a int, a_lat double, a_lon double")
    b = a.selectExpr("100 - a AS b", "a_lat - 0.0004 AS b_lat", "a_lon AS b_lon").union(a.selectExpr("200 - a", "a_lat + 0.0004", "a_lon"))
    got = {r["a"]: (r["b"], round(r["meters"], 3)) for r in spatial.nearest(a, b, 60).collect()}
    assert got == {i: (100 - i, 44.478) for i in range(40)}


def test_nearest_at_any_distance_meets_each_position_once(spark, monkeypatch):
    a = spark.createDataFrame([(i, 37.5, 127.0) for i in range(40)], "a int, a_lat double, a_lon double")
    b = spark.createDataFrame([(i, 37.501 + i % 2, 127.0) for i in range(30)], "b int, b_lat double, b_lon double")
    sizes, inner = [], spatial.within

    def counted(*args, **more):
        found = inner(*args, **more)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(spatial, "within", counted)
    assert {r["a"]: r["b"] for r in spatial.nearest_any(a, b).collect()} == {i: 0 for i in range(40)}
    assert sizes == [1]


def test_clusters_meet_each_place_of_a_name_once(spark, monkeypatch):
    where = [(37.5, 127.0), (37.501, 127.0), (37.6, 127.0)]
    rows = [(i, "xy"[i % 2], *where[i % 3]) for i in range(60)] + [(60, None, 37.5, 127.0), (61, "x", None, None), (62, "x", None, None)]
    nodes = spark.createDataFrame(rows, "id int, name string, lat double, lon double")
    sizes, inner = [], spatial.within

    def counted(*args, **more):
        found = inner(*args, **more)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(spatial, "within", counted)
    got = {r["id"]: r["cluster"] for r in spatial.clusters_by_name(nodes, 200).collect()}
    first = {("x", True): 0, ("y", True): 1, ("x", False): 2, ("y", False): 5}
    assert got == {i: first["xy"[i % 2], i % 3 < 2] for i in range(60)} | {60: 60, 61: 61, 62: 62}
    assert sizes == [10]


def test_service_set_sends_no_patterns_through_the_driver(spark):
    rows = [(1, False, 10 * p + d, k, k if d == 0 else 9 - k) for p in (1, 2) for d in (0, 1) for k in range(10)]
    chosen = service.service_set(spark.createDataFrame(rows, "line int, express boolean, pattern_id int, pos int, node int"))
    assert "Broadcast" not in chosen._jdf.queryExecution().executedPlan().toString()
    assert {(r["pattern_id"], r["dir"]) for r in chosen.collect()} == {(10, 0), (11, 1), (20, 0), (21, 1)}
