import json
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from reachbase.sources import files, landed, matrix, sinks
from reachbase.sources.osm_pbf import Extract
from reachbase.sources.xlsx import Workbook
from reachbase.streaming import snapshots


def test_gtfs_archives(spark, tmp_path):
    stops = spark.createDataFrame([("s2", 'A "quoted", name', 37.5, 127.0), ("s1", "역", 37.6, None)], "stop_id string, stop_name string, stop_lat double, stop_lon double")
    trips = spark.createDataFrame([("r", "WD", "t1", 0)], "route_id string, service_id string, trip_id string, direction_id int")
    for name in ("a.zip", "b.zip"):
        files.pack_gtfs({"stops": (stops.repartition(3), ["stop_id"]), "trips": (trips, ["trip_id"])}, str(tmp_path / name))
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()
    back = files.read_gtfs(spark, str(tmp_path / "a.zip"), "stops", tag="x").orderBy("stop_id").collect()
    assert [(r["stop_id"], r["stop_name"], r["stop_lon"], r["location_type"]) for r in back] == [("x:s1", "역", None, None), ("x:s2", 'A "quoted", name', 127.0, None)]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("trips.txt", "﻿trip_id,route_id\n\nt9,r9\n")
    assert files.read_gtfs(spark, str(tmp_path / "c.zip"), "trips").first()["trip_id"] == "t9"
    assert files.read_gtfs(spark, str(tmp_path / "c.zip"), "stops").count() == 0


def test_gml(spark, tmp_path):
    (tmp_path / "g.gml").write_text('graph [\n  node [\n    id 0\n    label "19"\n    line_no "1"\n    station_name "&#49548;A&#50836;"\n    pos 127.5\n    pos 37.25\n  ]\n  node [\n    id 1\n    label "20"\n    line_no "1"\n    station_name "b"\n    pos 127.0\n    pos 37.0\n  ]\n  edge [\n    source 0\n    target 1\n    line_no ""\n  ]\n]\n')
    nodes, edges = files.read_gml(spark, str(tmp_path / "g.gml"))
    assert [tuple(r) for r in nodes.orderBy("id").collect()] == [(0, "19", "1", "소A요", 37.25, 127.5), (1, "20", "1", "b", 37.0, 127.0)]
    assert [tuple(r) for r in edges.collect()] == [(0, 1, "")]


def test_legacy_csv_and_missing_files(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("id,name\n1,서울\n2,부산\n".encode("cp949"))
    assert [tuple(r) for r in files.read_legacy_csv(spark, str(tmp_path / "t.csv"), "id string, name string").collect()] == [("1", "서울"), ("2", "부산")]
    assert files.read_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_xml_and_requests(spark):
    raw = spark.createDataFrame([("<r><item><a> x &amp; y </a><b>1</b></item><item><a>z</a></item></r>",)], "body string")
    assert [tuple(r) for r in files.xml_items(raw, "body", "item", ["a", "b"]).collect()] == [("x & y", "1"), ("z", "")]
    plan = spark.range(5).toDF("k")
    assert {r["k"] for r in files.missing_requests(plan, spark.range(3).toDF("k"), ["k"]).collect()} == {3, 4}
    grid = files.tiles(spark, 37.0, 126.0, 37.2, 126.1, 0.05)
    assert grid.count() == 8 and max(r["north"] for r in grid.collect()) == 37.2


def test_content_hash(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "a int, b string")
    assert files.content_hash(df) == files.content_hash(df.repartition(3)) != files.content_hash(df.distinct())


def test_matrix_files(spark, tmp_path):
    reach = spark.createDataFrame([("a", 0, 1, 30, 5), ("a", 1, 0, 254, None), ("b", 0, 0, None, None)], "origin string, slot int, dong_idx int, minutes int, walk int")
    for r in matrix.matrix_files(reach, 2, 3).collect():
        (tmp_path / f"{r['origin']}.bin").write_bytes(r["content"])
        assert len(r["content"]) == 10 + 2 * 6 and r["content"][:4] == b"TRMX"
    got = sorted(tuple(r) for r in matrix.read_matrices(spark, str(tmp_path)).collect())
    assert got == [("a.bin", 0, 1, 30, 5), ("a.bin", 1, 0, 254, 0)]
    points = spark.createDataFrame([(37.123456, 127.0, 12)], "lat double, lon double, minutes int")
    assert '"coordinates":[127.0,37.12346]' in matrix.features(points, ["minutes"]).first()["value"]
    assert "circle" in matrix.svg_dots(points, (37.0, 126.0, 38.0, 128.0), 800).first()["value"]
    slots = spark.createDataFrame([(1, "x"), (0, "y")], "slot int, label string")
    got = matrix.manifest(slots, slots.toDF("station_idx", "name"), slots.toDF("dong_idx", "name"), 120).first()["value"]
    assert got.startswith('{"version":2,"capMinutes":120,"slots":[{"slot":0,')


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        for i in (2, 10):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>{i}</v></c></row><row><c r="B2" t="inlineStr"><is><t>in</t></is></c><c r="AA2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    spark.dataSource.register(Workbook)
    rows = spark.read.format("workbook").load(f"file://{tmp_path}/b.xlsx").orderBy("sheet", "row").collect()
    assert [(r["sheet"], r["row"]) for r in rows] == [(2, 0), (2, 1), (10, 0), (10, 1)]
    assert rows[2]["cells"] == ["name", "", "10"] and rows[1]["cells"][1] == "in" and rows[1]["cells"][26] == "ab"
    one_each = spark.read.format("workbook").option("sheetsPerPartition", "1").load(f"file://{tmp_path}/b.xlsx")
    assert one_each.rdd.getNumPartitions() == 2 and one_each.orderBy("sheet", "row").collect() == rows


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _zig(values):
    return b"".join(_varint((v << 1) ^ (v >> 63) & (1 << 64) - 1) if v >= 0 else _varint(-2 * v - 1) for v in values)


def test_osm_extract(spark, tmp_path):
    strings = b"".join(_field(1, s) for s in (b"", b"highway", b"steps", b"stop"))
    dense = _field(1, _zig([100, 5])) + _field(8, _zig([375_000_000, 10])) + _field(9, _zig([1_270_000_000, -20])) + _field(10, b"\x01\x02\x00\x00")
    way = _field(1, 7) + _field(2, b"\x01") + _field(3, b"\x02") + _field(8, _zig([100, 5]))
    relation = _field(1, 9) + _field(8, b"\x03") + _field(9, _zig([7])) + _field(10, b"\x01")
    block = _field(1, strings) + _field(2, _field(2, dense)) + _field(2, _field(3, way) + _field(4, relation))
    raw = b""
    for kind, body in ((b"OSMHeader", b""), (b"OSMData", block), (b"OSMData", block)):
        blob = _field(2, len(body)) + _field(3, zlib.compress(body))
        header = _field(1, kind) + _field(3, len(blob))
        raw += struct.pack(">I", len(header)) + header + blob
    (tmp_path / "x.osm.pbf").write_bytes(raw)
    spark.dataSource.register(Extract)
    read = spark.read.format("osm_extract").option("blobsPerPartition", "1")
    rows = read.load(str(tmp_path / "x.osm.pbf")).collect()
    assert len(rows) == 8
    a, b = [r for r in rows if r["kind"] == "node"][:2]
    assert (a["id"], a["tags"], b["id"], b["tags"]) == (100, {"highway": "steps"}, 105, {}) and np.isclose(b["lat"], 37.500001) and np.isclose(b["lon"], 126.999998)
    ways = read.option("kinds", "way,relation").load(str(tmp_path / "x.osm.pbf")).collect()
    assert [w["refs"] for w in ways if w["kind"] == "way"] == [[100, 105]] * 2 and [tuple(w["members"][0]) for w in ways if w["kind"] == "relation"] == [("way", 7, "stop")] * 2


def test_snapshots_are_taken_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        rows = snapshots.speed_rows(snapshots.stream(spark, str(folder), snapshots.SPEED_SCHEMA))
        snapshots.keep_history(rows, str(tmp_path / "history"), str(tmp_path / "checkpoint"), snapshots.speed_refresh, str(tmp_path / "out")).awaitTermination()
        return {(r["route"], r["ord"]): (r["kmh"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    (folder / "20260901-0700.jsonl").write_text('{"id":"r1","s":[[1,300,20],[2,300,4]]}\n')
    (folder / "notes.jsonl").write_text('{"id":"r1","s":[[1,300,50]]}\n')
    assert run() == {("r1", 1): (20, 1)}
    (folder / "20260901-0900.jsonl").write_text('{"id":"r1","s":[[1,300,30]]}\n')
    assert run() == run() == {("r1", 1): (30, 2)}


def test_json_csv_and_metrics_are_added(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    sinks.append_json(rows.limit(0), str(tmp_path / "j"))
    assert not (tmp_path / "j").exists()
    for _ in range(2):
        sinks.append_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().asDict() == {"k": "1", "v": "a"}
    for day in ("2024-01-01", "2024-02-01"):
        sinks.append_metrics(rows, str(tmp_path / "m"), day)
    assert sinks.recent_metrics(spark, str(tmp_path / "m"), "2024-01-15").count() == 1


def test_cursors_move_with_what_came(spark):
    cursors = spark.createDataFrame([("a", 5), ("b", 7)], "feed string, at int")
    received = spark.createDataFrame([("a", 9), ("a", 6), ("c", 1), ("b", 3)], "feed string, at int")
    assert {r["feed"]: r["at"] for r in sinks.advance_cursor(received, cursors, "feed", "at").collect()} == {"a": 9, "b": 7, "c": 1}
    assert {r["feed"]: r["at"] for r in sinks.advance_cursor(received.limit(0), cursors, "feed", "at").collect()} == {"a": 5, "b": 7}


def test_builds_when_the_content_changed(spark, tmp_path):
    built = []
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    state = str(tmp_path / "state")
    assert sinks.when_changed(spark, rows, state, built.append) and not sinks.when_changed(spark, rows.orderBy(F.desc("k")), state, built.append)
    assert sinks.when_changed(spark, rows.union(rows), state, built.append) and len(built) == 2


def test_enriched_rows(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, elev int")
    more = spark.createDataFrame([(1, 10, 5.0)], "id int, elev int, climb double")
    assert [tuple(r) for r in sinks.enriched(rows, more, "id").orderBy("id").collect()] == [(1, "a", 10, 5.0), (2, "b", 2, None)]


def test_gml_is_read_back(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "x", "2", "강남", 37.5, 127.0), (2, "y", "2", 'a "b"', 37.6, 127.1)], "id int, label string, line_no string, station_name string, lat double, lon double")
    edges = spark.createDataFrame([(1, 2, "2")], "source int, target int, line_no string")
    text = "\n".join(r["value"] for r in sinks.gml_lines(nodes, edges).orderBy("place").collect())
    (tmp_path / "g.gml").write_text(text)
    got, links = files.read_gml(spark, str(tmp_path / "g.gml"))
    assert {r["id"]: (r["station_name"], r["lat"], r["lon"]) for r in got.collect()} == {1: ("강남", 37.5, 127.0), 2: ('a "b"', 37.6, 127.1)} and links.count() == 1


def test_publish_findings(spark):
    axis = spark.createDataFrame([(0,), (1,), (3,)], "idx int")
    sizes = spark.createDataFrame([(10,), (10,), (12,)], "bytes long")
    assert sinks.publish_findings({"stations": 3, "dongs": 0}, axis, sizes, 1.0, 2.0) == ["dongs is empty", "the axis has gaps", "matrices differ in size", "the manifest is older than the matrices"]
    assert sinks.publish_findings({"stations": 3}, axis.where("idx < 2"), sizes.limit(1), 2.0, 1.0) == []


def test_walk_graph_file(spark, tmp_path):
    content = sinks.encode_walk_graph(np.zeros((3, 2)), np.array([0, 2, 2, 3]), np.array([1, 2, 0]), np.array([5, 6, 7]))
    (tmp_path / "w.bin").write_bytes(content)
    assert sorted(map(tuple, sinks.read_walk_graph(spark, str(tmp_path / "w.bin")).collect())) == [(0, 1, 5), (0, 2, 6), (2, 0, 7)]


def test_band_features(spark):
    cells = spark.createDataFrame([(37.5, 127.0, 15)], "lat double, lon double, band int")
    got = json.loads(matrix.band_features(cells, 0.01).first()["value"])
    assert got["properties"] == {"minutes": 15} and got["geometry"]["coordinates"][0][2] == [127.01, 37.51]


def test_landed_json(spark, tmp_path):
    (tmp_path / "stops.jsonl").write_text('{"id": "r1", "stops": [{"stop": "s", "ord": 1, "lat": 37.5}]}\nnot json\n')
    rows = landed.read_rows(spark, str(tmp_path / "stops.jsonl"), "city_stops").collect()
    assert len(rows) == 1 and rows[0]["stops"][0]["lat"] == 37.5 and rows[0]["stops"][0]["dir"] is None
    assert landed.read_rows(spark, str(tmp_path / "none.jsonl"), "fleet").count() == 0
    (tmp_path / "od.json").write_text('{"slot": "출발 08:30",\n "ods": [{"origin": "a", "ours": 5}, {"origin": "b"}]}')
    assert {r["origin"]: r["ours"] for r in landed.read_document(spark, str(tmp_path / "od.json"), "ods", "ods").collect()} == {"a": 5, "b": None}
    (tmp_path / "cal.json").write_text('{"dwellSec": 61}')
    got = landed.with_defaults(landed.read_document(spark, str(tmp_path / "cal.json"), "calibration"), landed.CALIBRATION).first()
    assert (got["dwellSec"], got["detour"]) == (61, 1.07)
    assert landed.with_defaults(landed.read_document(spark, str(tmp_path / "gone.json"), "calibration"), landed.CALIBRATION).first()["dwellSec"] == 58


def test_complexes_document(spark):
    rows = spark.createDataFrame([("b", 37.1234567, 127.0, 5), ("a", 37.0, 127.0, None)], "seq string, lat double, lon double, jeonse int")
    got = json.loads(landed.complexes_json(rows).first()["value"])["complexes"]
    assert [x["seq"] for x in got] == ["a", "b"] and got[1]["lat"] == 37.12346 and got[1]["jeonse"] == 5


def test_period_counts_of_a_stream(spark, tmp_path):
    """The extension on a stream of files: counts by day and period equal a batch's."""
    rows = spark.createDataFrame([("2024-01-01 06:00:00", "view"), ("2024-01-01 06:30:00", "view"), ("2024-01-01 08:00:00", "click"), ("2024-01-02 06:00:00", "view")], "at string, event_type string").select(F.to_timestamp("at").alias("ts"), "event_type")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    counted = snapshots.period_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    counted.writeStream.format("memory").queryName("periods").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = snapshots.period_counts(rows)
    assert sorted(map(str, spark.table("periods").collect())) == sorted(map(str, batch.collect())) and batch.count() == 3


def test_fleets_are_refreshed_from_history(spark):
    """Twice the vehicles in the morning's peak halve its headway; a type with few values has none."""
    many = [("a", 20 if 420 <= minute < 540 else 10, minute) for minute in range(340, 1440, 2)]
    got = snapshots.fleet_refresh(spark.createDataFrame([*many, ("b", 4, 500)], "type string, n int, at_minute int")).collect()
    assert {r["period"]: r["factor"] for r in got if r["type"] == "a"} == {0: 1.0, 1: 0.5, 2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0} and {r["type"] for r in got} == {"a"}
