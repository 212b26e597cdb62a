"""Rounds of joins against a scalar search on random networks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from reachbase.operators import build, matrix, routing, spatial

INF = 10**9


def random_network(seed):
    rng = random.Random(seed)
    n = rng.randint(4, 9)
    stops, windows = [], []
    for trip in range(rng.randint(2, 7)):
        off = 0
        for pos in range(1, rng.randint(3, 7)):
            stops.append((trip, pos, rng.randrange(n), off))
            off += rng.randint(30, 400)
        for _ in range(rng.randint(1, 2)):
            first = rng.randint(0, 2500)
            windows.append((trip, first, first + rng.randint(0, 1500), rng.choice([60, 300, 700])))
    transfers = [(a, b, rng.randint(30, 500)) for a, b in itertools.permutations(range(n), 2) if rng.random() < 0.15]
    return n, stops, windows, transfers


def scalar(stops, windows, transfers, seeds, cutoff, rounds, board, arrive):
    best = dict(seeds)

    def walk(marked):
        now = dict(best)
        for s in marked:
            for a, b, sec in transfers:
                if a == s and now[s] + sec <= cutoff and now[s] + sec < best.get(b, INF):
                    best[b] = now[s] + sec

    walk(list(best))
    patterns = {t: sorted((p, s, o) for x, p, s, o in stops if x == t) for t in {r[0] for r in stops}}
    for _ in range(rounds):
        before, improved = dict(best), set()
        for trip, visits in patterns.items():
            start = INF
            for _, stop, off in visits:
                if start < INF and start + off + arrive <= cutoff and start + off + arrive < best.get(stop, INF):
                    best[stop] = start + off + arrive
                    improved.add(stop)
                if stop in before:
                    for t, first, last, head in windows:
                        if t == trip:
                            need = before[stop] + board - off - first
                            at = first + max(0, -(-need // head)) * head
                            if at <= last:
                                start = min(start, at)
        if not improved:
            break
        walk(improved)
    return best


@pytest.mark.parametrize(("seed", "mirror"), [(1, False), (2, False), (3, True), (4, True)])
def test_rounds_equal_a_scalar_search(spark, seed, mirror):
    n, stops, windows, transfers = random_network(seed)
    s = spark.createDataFrame(stops, "trip_id long, pos long, stop_id long, off long")
    w = spark.createDataFrame(windows, "trip_id long, first_start long, last_start long, headway long")
    if mirror:
        s, w = routing.mirrored(s, w)
        stops, windows = [tuple(r) for r in s.select("trip_id", "pos", "stop_id", "off").collect()], [tuple(r) for r in w.select("trip_id", "first_start", "last_start", "headway").collect()]
    t = spark.createDataFrame(transfers or [(0, 0, 0)], "from_stop long, to_stop long, sec long")
    start = -4000 if mirror else 100
    seeds = {q: {q: start, (q + 1) % n: start + 90} for q in range(n)}
    rows = spark.createDataFrame([(q, x, at) for q, own in seeds.items() for x, at in own.items()], "query long, stop_id long, t long")
    cutoffs = spark.createDataFrame([(q, start + 3000) for q in seeds], "query long, cutoff long")
    got = {}
    for r in routing.earliest_arrivals(rows, s, w, t, cutoffs, 3, mirror=mirror).collect():
        got.setdefault(r["query"], {})[r["stop_id"]] = r["t"]
    for q, own in seeds.items():
        assert got[q] == scalar(stops, windows, transfers, own, start + 3000, 3, 0 if mirror else 20, 20 if mirror else 0)


def test_windows(spark):
    w = spark.createDataFrame([("t1", 18000, 32400, 600), ("t2", 18000, 18100, 900)], "trip_id string, first_start long, last_start long, headway long")
    for r in routing.baked(w, F.col("trip_id")).collect():
        assert r["last_start"] >= r["first_start"] and (r["last_start"] - r["first_start"]) % r["headway"] == 0
    starts = [r["start"] for r in routing.expanded(w.where("trip_id = 't1'")).collect()]
    assert sorted(starts) == list(range(18000, 32401, 600))


def test_sample_middle(spark):
    rows = [("o", 0, i, 1, s, 60 * i) for i, s in enumerate((900, 300, 600))] + [("o", 0, 0, 2, 100, 5), ("o", 0, 1, 2, 200, 5)] + [("o", 0, i, 3, 7200, 30) for i in range(5)]
    got = {r["dong_id"]: (r["minutes"], r["walk"]) for r in routing.sample_middle(spark.createDataFrame(rows, "origin string, slot int, sample int, dong_id int, sec int, walk int"), 5, 120).collect()}
    assert got == {1: (15, 0), 3: (None, None)}


def test_rail(spark):
    c = spark.createDataFrame([(1, 2, 100, 200), (2, 3, 190, 250), (2, 3, 210, 300), (3, 1, 320, 400), (1, 2, 50, 90)], "origin int, dest int, dep int, arr int")
    seeds = spark.createDataFrame([("q", 1, 60)], "query string, node int, t int")
    walks = spark.createDataFrame([(3, 4, 15)], "from_node int, to_node int, sec int")
    assert {r["node"]: r["t"] for r in routing.rail_arrivals(seeds, c, walks).collect()} == {1: 60, 2: 200, 3: 300, 4: 315}


def test_matrix_of_a_small_network(spark):
    stops = spark.createDataFrame([(1, 1, 10, 0), (1, 2, 20, 600), (2, 1, 20, 0), (2, 2, 10, 600)], "trip_id long, pos long, stop_id long, off long")
    windows = spark.createDataFrame([(1, 18000, 90000, 300), (2, 18000, 90000, 300)], "trip_id long, first_start long, last_start long, headway long")
    none = spark.createDataFrame([], "from_stop long, to_stop long, sec long")
    access = spark.createDataFrame([("a", 10, 60)], "origin string, stop_id long, sec long")
    egress = spark.createDataFrame([(7, 20, 120), (8, 10, 30)], "dong_id long, stop_id long, sec long")
    slots = spark.createDataFrame([(0, True, 30000), (1, False, 61200)], "slot int, arrive boolean, seconds int")
    got = {(r["slot"], r["dong_id"]): (r["minutes"], r["walk"]) for r in matrix.dong_matrix(access, egress, stops, windows, none, slots, 60, rounds=2).collect()}
    assert set(got) == {(0, 7), (0, 8), (1, 7), (1, 8)}
    assert got[0, 8] == got[1, 8] == (2, 1) and all(13 <= got[s, 7][0] <= 19 and got[s, 7][1] == 2 for s in (0, 1))
    assert matrix.default_slots(spark).count() == 20
    assert matrix.triangle_findings(spark.createDataFrame([(1, 2, 100), (2, 3, 100), (1, 3, 600)], "a int, b int, sec int")).count() == 1


def scalar_rail(connections, walks, start, t):
    best, open_ = {start: t}, {start}
    while open_:
        at = open_.pop()
        steps = [(b, arr) for a, b, dep, arr in connections if a == at and dep >= best[at]] + [(b, best[at] + sec) for a, b, sec in walks if a == at]
        for to, when in steps:
            if when < best.get(to, INF):
                best[to] = when
                open_.add(to)
    return best


def test_rail_matrix_matches_a_scalar_search(spark):
    """Later trains that arrive before earlier ones, and both ways in time."""
    rng = random.Random(4)
    c = sorted({(a, b, dep, dep + rng.randint(20, 900)) for a, b, dep in ((rng.randrange(8), rng.randrange(8), rng.randint(0, 4000)) for _ in range(150)) if a != b})
    walks = [(1, 2, 70), (5, 1, 40)]
    table = spark.createDataFrame(c, "origin int, dest int, dep int, arr int")
    slots = spark.createDataFrame([(0, False, 500), (1, True, 3000)], "slot int, arrive boolean, seconds int")
    got = {(r["station"], r["slot"], r["node"]): r["sec"] for r in routing.rail_matrix(spark.range(8).selectExpr("CAST(id AS int) AS node"), slots, table, spark.createDataFrame(walks, "from_node int, to_node int, sec int")).collect()}
    plain = {(s, 0, n): t - 500 for s in range(8) for n, t in scalar_rail(c, walks, s, 500).items()}
    turned = [(b, a, -arr, -dep) for a, b, dep, arr in c]
    plain |= {(s, 1, n): t + 3000 for s in range(8) for n, t in scalar_rail(turned, [(b, a, sec) for a, b, sec in walks], s, -3000).items()}
    assert got == plain


def test_paths_lead_back_to_the_seed(spark):
    for seed in range(3):
        _, stops, windows, transfers = random_network(seed)
        tables = [spark.createDataFrame(stops, "trip_id long, pos long, stop_id long, off long"), spark.createDataFrame(windows, "trip_id long, first_start long, last_start long, headway long"), spark.createDataFrame(transfers or [(0, 0, 1)], "from_stop long, to_stop long, sec long")]
        seeds = spark.createDataFrame([(1, 0, 100)], "query long, stop_id long, t long")
        labels = routing.earliest_arrivals(seeds, *tables, spark.createDataFrame([(1, 9000)], "query long, cutoff long"), rounds=20)
        parents = routing.explained(labels, seeds, *tables)
        rows = {r["stop_id"]: r for r in parents.collect()}
        assert all(r["parent"] is not None or s == 0 for s, r in rows.items()) and len(rows) == labels.count()
        ways = {r["stop_id"]: [(x["stop_id"], x["t"]) for x in r["legs"]] for r in routing.paths(parents).collect()}
        assert set(ways) == set(rows)
        for s, path in ways.items():
            assert path[0] == (0, 100) and path[-1] == (s, rows[s]["t"]) and [t for _, t in path] == sorted(t for _, t in path)
            for (a, ta), (b, tb) in zip(path, path[1:]):
                trip = rows[b]["trip_id"]
                if trip is None:
                    assert any((x, y, tb - ta) == (a, b, sec) for x, y, sec in transfers)
                else:
                    assert any(t == trip and s2 == b for t, _, s2, _ in stops) and any(t == trip and s2 == a for t, _, s2, _ in stops)


def test_ways_between_ends(spark):
    edges = [("y", 1, 2), ("y", 2, 3), ("y", 2, 4), ("i", 1, 2), ("i", 2, 3), ("o", 1, 2), ("o", 2, 3), ("o", 3, 1)]
    runs: dict = {}
    for r in build.terminal_runs(spark.createDataFrame(edges, "line string, a long, b long")).orderBy("pos").collect():
        runs.setdefault((r["line"], r["run_id"]), []).append(r["node"])
    assert runs == {("y", "1-3"): [1, 2, 3], ("y", "1-4"): [1, 2, 4], ("y", "3-4"): [3, 2, 4]}


def test_nearest_transfers_of_crowded_places(spark, monkeypatch):
    rng = random.Random(8)
    places = [(37.5 + rng.random() / 400, 127.0 + rng.random() / 400) for _ in range(12)]
    where = {i: rng.choice(places) for i in range(150)}
    stops = spark.createDataFrame([(i, *p) for i, p in where.items()], "stop_id int, lat double, lon double")
    sizes, inner = [], routing.nearest_k

    def counted(pairs, k):
        sizes.append(pairs.count())
        return inner(pairs, k)

    monkeypatch.setattr(routing, "nearest_k", counted)
    got = {}
    for r in routing.walking_transfers(stops, 200, 5).collect():
        got.setdefault(r["from_stop"], set()).add(r["to_stop"])
    monkeypatch.undo()
    near = {(r["a"], r["b"]): r["meters"] for r in spatial.within(spatial.points(stops, "stop_id", "a"), spatial.points(stops, "stop_id", "b"), 200).collect()}
    assert got == {i: set(sorted((j for a, j in near if a == i and j != i), key=lambda j: (near[i, j], j))[:5]) for i in where}
    assert sizes[0] < len(near) / 10


def test_walks_between_places_equal_those_between_stops(spark):
    rng = random.Random(9)
    places = [(37.5 + rng.random() / 200, 127.0 + rng.random() / 200) for _ in range(10)]
    stops = spark.createDataFrame([(i, *rng.choice(places)) for i in range(60)], "stop_id int, lat double, lon double")
    labels = spark.createDataFrame([(q, i, rng.randint(0, 300)) for q in (1, 2) for i in rng.sample(range(60), 20)], "query int, stop_id int, t int")
    cutoffs = spark.createDataFrame([(1, 400), (2, 700)], "query int, cutoff int")
    by_place = routing.walks(stops)
    rows = lambda transfers: {tuple(r) for r in routing._least(labels, routing.walked(labels, transfers, cutoffs)).select("query", "stop_id", "t").collect()}
    assert rows(by_place) == rows(routing.walking_transfers(stops, most=1000))
    assert by_place.hops.count() <= 100


def joined_rows(df) -> int:
    """Rows that all joins of a query give."""
    df.collect()
    plans, n = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
        n += plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    return n


def test_parents_are_sought_from_where_they_lead(spark):
    """a row for each departure that arrives just then, not for each boarding and later stop."""
    rng = random.Random(7)
    stops = spark.createDataFrame([(trip, pos, pos, 90 * pos) for trip in range(40) for pos in range(30)], "trip_id int, pos int, stop_id int, off int")
    windows = spark.createDataFrame([(trip, 37 * trip, 37 * trip + 9000, 900) for trip in range(40)], "trip_id int, first_start int, last_start int, headway int")
    labels = [(0, s, rng.randint(0, 9000)) for s in range(1, 30)] + [(0, 0, 0), (0, 40, 37 * 3)]
    stops = stops.union(spark.createDataFrame([(3, 30, 40, 0)], stops.schema))
    tables = spark.createDataFrame(labels, "query int, stop_id int, t int"), spark.createDataFrame([(0, 0, 0)], "query int, stop_id int, t int"), stops, windows, spark.createDataFrame([], "from_stop int, to_stop int, sec int")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert joined_rows(routing.explained(*tables)) < 4000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    found = {r["stop_id"]: (r["parent"], r["trip_id"]) for r in routing.explained(*tables).collect()}
    assert found[40] == (0, 3) and found[0] == (None, None)
