"""Networks from a written extract, outlines of bands, and caches that are flushed by micro-batches."""

import json
import struct
import zlib
from collections import Counter

import pytest

from reachbase.operators import feeds, outline
from reachbase.sources import rail_extract
from reachbase.sources.osm_pbf import Extract
from reachbase.streaming import snapshots
from tests.test_sources import _field, _zig


def extract_of(path, nodes, relations):
    """An extract with nodes (id, lat, lon, tags) in one block and relations (id, tags, members) in another."""

    def block(strings, group):
        return _field(1, b"".join(_field(1, s.encode()) for s in strings)) + _field(2, group)

    def tagged(own, tags, strings):
        for k in (*tags, *tags.values()):
            if k not in strings:
                strings.append(k)
        return own + _field(2, bytes(strings.index(k) for k in tags)) + _field(3, bytes(strings.index(v) for v in tags.values()))

    strings, group = [""], b""
    for i, lat, lon, tags in nodes:
        zig = lambda v: v << 1 if v >= 0 else -2 * v - 1
        group += _field(1, tagged(_field(1, zig(i)) + _field(8, zig(round(lat * 1e7))) + _field(9, zig(round(lon * 1e7))), tags, strings))
    first = block(strings, group)
    strings, group = ["", "stop", "stop_entry_only", "platform"], b""
    for i, tags, members in relations:
        steps = [b - a for a, b in zip([0] + [m[1] for m in members], [m[1] for m in members], strict=False)]
        own = tagged(_field(1, i), tags, strings)
        group += _field(4, own + _field(8, bytes(strings.index(m[2]) for m in members)) + _field(9, _zig(steps)) + _field(10, bytes(m[0] for m in members)))
    raw = b""
    for kind, body in ((b"OSMHeader", b""), (b"OSMData", first), (b"OSMData", block(strings, group))):
        blob = _field(2, len(body)) + _field(3, zlib.compress(body))
        header = _field(1, kind) + _field(3, len(blob))
        raw += struct.pack(">I", len(header)) + header + blob
    path.write_bytes(raw)


def test_rail_network_from_an_extract(spark, tmp_path):
    nodes = [
        (1, 37.50, 127.00, {"name": "Alpha (1)"}), (2, 37.51, 127.00, {"name": "x", "name:ko": "베타"}), (3, 37.52, 127.00, {"name": "Gamma"}), (4, 37.53, 127.00, {"name": "Delta"}),
        (12, 37.511, 127.001, {"name": "베타"}), (13, 37.60, 127.10, {"name": "Gamma"}), (20, 35.0, 129.0, {"name": "Far"}), (21, 35.1, 129.0, {"name": "Farther"}), (30, 37.5, 127.0, {}), (31, 37.5, 127.0, {"name": "Alpha"}),
    ]
    stop = lambda *ids: [(0, i, "stop") for i in ids]
    route = lambda name, ref, kind="subway": {"type": "route", "route": kind, "name": name, "ref": ref}
    relations = [
        (100, route("Line 1: up", "1"), [(0, 1, "stop_entry_only"), (1, 77, "platform"), *stop(31, 2, 3), (0, 30, "stop")]),
        (101, route("Line 1 급행", "1"), stop(1, 3, 4)),
        (102, route("Line 2", "2", "train"), stop(12, 13)),
        (103, route("Line 9", "9"), stop(1, 2)),
        (104, route("Far", "1"), stop(20, 21)),
        (105, route("Bus", "1", "bus"), stop(1, 2)),
        (106, route("Short", "1"), [(0, 1, "stop"), (0, 2, "platform")]),
    ]
    extract_of(tmp_path / "x.osm.pbf", nodes, relations)
    spark.dataSource.register(Extract)
    lines = spark.createDataFrame([("1", "L1"), ("2", "L2")], "ref string, line string")
    net = rail_extract.rail_network(spark, str(tmp_path / "x.osm.pbf"), lines, (37.4, 126.7, 37.75, 127.25))
    # The two Alphas are one station, the Gammas stand apart, what has no name is left out, and the far line isn't in the box.
    assert {r["id"]: r["station"] for r in net.stations.collect()} == {1: 1, 31: 1, 2: 2, 12: 2, 3: 3, 4: 4, 13: 13}
    assert sorted((r["station"], r["line"]) for r in net.platforms.collect()) == [(1, "L1"), (2, "L1"), (2, "L2"), (3, "L1"), (4, "L1"), (13, "L2")]
    at = {(r["station"], r["line"]): (r["lat"], r["lon"]) for r in net.platforms.collect()}
    assert at[2, "L2"] == pytest.approx((37.511, 127.001)) and at[2, "L1"] == pytest.approx((37.51, 127.0))
    got = {}
    for r in net.patterns.orderBy("pattern_id", "pos").collect():
        got.setdefault((r["pattern_id"], r["line"], r["express"]), []).append((r["pos"], r["node"]))
    assert got == {(100, "L1", False): [(1, 1), (2, 2), (3, 3)], (101, "L1", True): [(1, 1), (2, 3), (3, 4)], (102, "L2", False): [(1, 2), (2, 13)]}
    assert sorted((r["line"], r["a"], r["b"]) for r in net.tracks.collect()) == [("L1", 1, 2), ("L1", 2, 3), ("L2", 2, 13)]
    moves = {(r["station"], r["from_line"], r["to_line"]): r["sec"] for r in net.transfers.collect()}
    assert set(moves) == {(2, "L1", "L2"), (2, "L2", "L1")} and 90 + 100 < moves[2, "L1", "L2"] < 90 + 140


def test_outlines_by_hand(spark):
    """A square with a hole, a cell in the hole, two cells that touch at a corner, and an L."""
    square = [(0, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    cells = square + [(1, 1, 1), (2, 10, 10), (2, 11, 11), (3, -2, -2), (3, -1, -2), (3, -2, -1)]
    got = {}
    for r in outline.rings(spark.createDataFrame(cells, "band int, row int, col int")).orderBy("band", "ring", "seq").collect():
        got.setdefault((r["band"], r["ring"]), []).append((r["x"], r["y"]))
    assert got == {
        (0, "0,0,0"): [(0, 0), (3, 0), (3, 3), (0, 3)], (0, "1,1,1"): [(1, 1), (1, 2), (2, 2), (2, 1)], (1, "1,1,0"): [(1, 1), (2, 1), (2, 2), (1, 2)],
        (2, "10,10,0"): [(10, 10), (11, 10), (11, 11), (10, 11)], (2, "11,11,0"): [(11, 11), (12, 11), (12, 12), (11, 12)],
        (3, "-2,-2,0"): [(-2, -2), (0, -2), (0, -1), (-1, -1), (-1, 0), (-2, 0)],
    }
    areas = Counter()
    for r in outline.ring_areas(outline.rings(spark.createDataFrame(cells, "band int, row int, col int"))).collect():
        areas[r["band"]] += r["area"]
    assert areas == Counter(band for band, _, _ in cells)
    assert outline.rings(spark.createDataFrame([], "band int, row int, col int")).count() == 0


def test_a_cache_is_flushed_batch_by_batch(spark, tmp_path):
    """A run that stops after its second flush, and one that stops within a flush, lose and double nothing."""
    landed = tmp_path / "replies"
    landed.mkdir()
    want = {}
    for i in range(5):
        rows = [{"key": f"k{(i * 3 + j) % 8}", "at": i * 10 + j, "lat": 37.0 + i + j / 10} for j in range(4)]
        (landed / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        want |= {r["key"]: (r["at"], r["lat"]) for r in rows}
    cache, seen = str(tmp_path / "cache"), []

    def run(stop_after=None):
        def hook(number):
            seen.append(number)
            if number == stop_after:
                raise RuntimeError("stopped")

        replies = spark.readStream.schema("key string, at long, lat double").option("maxFilesPerTrigger", 1).json(str(landed))
        snapshots.flushed_cache(replies, cache, ["key"], "at", str(tmp_path / "cursor"), hook).awaitTermination()

    for stop in (1, 3):
        with pytest.raises(Exception, match="stopped"):
            run(stop)
    partial = snapshots.read_cache(spark, cache, ["key"], "at")
    assert partial.count() == partial.select("key").distinct().count()
    run()
    assert seen == [0, 1, 1, 2, 3, 3, 4]
    got = snapshots.read_cache(spark, cache, ["key"], "at").collect()
    assert {r["key"]: (r["at"], r["lat"]) for r in got} == want and len(got) == len(want)
    run()
    assert seen[-1] == 4 and len(seen) == 7
    # The cache answers for what it knows; of several entries the newest counts.
    asked = spark.createDataFrame([("k0",), ("new",)], "key string")
    raw = spark.read.parquet(cache).drop("batch")
    assert {(r["key"], r["cached"], r["at"]) for r in feeds.from_cache(asked, raw, ["key"], "at").collect()} == {("k0", True, want["k0"][0]), ("new", False, None)}
