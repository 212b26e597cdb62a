"""Building networks: chains and runs of lines, timetables of trains, choices among candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions.exprs import haversine
from reachbase.functions.medians import upper_middle
from reachbase.operators.ranges import dealt, places, running_sums


def chains(edges: DataFrame) -> DataFrame:
    """line, chain, seq, node: the undirected edges (line, a, b) of each line, traced once.

    A chain starts at a node of the least degree (ties: the smallest) and goes on to the
    smallest neighbour over an unused edge. A group is one line's edges, some hundreds.
    """

    def trace(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(rows.a, rows.b, strict=True):
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        out, chain = [], 0
        while any(near.values()):
            at = min((n for n in near if near[n]), key=lambda n: (len(near[n]), n))
            path = [at]
            while near[at]:
                to = min(near[at])
                near[at].discard(to)
                near[to].discard(at)
                path.append(to)
                at = to
            out += [(rows.line.iloc[0], chain, i, n) for i, n in enumerate(path)]
            chain += 1
        return pd.DataFrame(out, columns=["line", "chain", "seq", "node"])

    kind = dict(edges.dtypes)
    return edges.select("line", "a", "b").groupBy("line").applyInPandas(trace, f"line {kind['line']}, chain int, seq int, node {kind['a']}")


def overlap_scale(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """run_id, scale of runs (run_id, pos, node): the most runs that share one of its edges.

    parts: in how many parts rows are dealt by run, then by edge.
    """
    along = Window.partitionBy("run_id").orderBy("pos")
    hop = dealt(runs, parts, "run_id").withColumn("_to", F.lead("node").over(along)).where("_to IS NOT NULL").select("run_id", F.least("node", "_to").alias("_a"), F.greatest("node", "_to").alias("_b")).distinct()
    hop = dealt(hop, parts, "_a", "_b")
    shared = hop.groupBy("_a", "_b").agg(F.count("*").alias("_n"))
    return dealt(hop.join(shared, ["_a", "_b"]).select("run_id", "_n"), parts, "run_id").groupBy("run_id").agg(F.max("_n").alias("scale"))


def is_express(name: Column) -> Column:
    return (F.contains(name, F.lit("급행")) | F.contains(name, F.lit("특급"))) & ~F.contains(name, F.lit("광역급행철도"))


def train_runs(rows: DataFrame, max_gap: int = 3600, top_kmh: float = 150.0, parts: int | None = None) -> DataFrame:
    """Patterns of a timetable (line, train, dir, station, at in s, lat, lon): run_id, pos, station, off and their departures.

    An inference from a description: rows of one train in one direction, times before 04:00 on
    the next day, sorted by time and cut where more than max_gap passes; runs faster than
    top_kmh go; equal stations with equal offsets make one pattern with a window for each start.
    Returns line, signature, pos, station, off, starts. A train's rows are sorted once, and those
    after a run's first hop that is too fast aren't collected. parts: in how many parts rows are dealt by train.
    """
    at = F.when(F.col("at") < 4 * 3600, F.col("at") + 86_400).otherwise(F.col("at"))
    train = Window.partitionBy("line", "train", "dir").orderBy("at", "station")
    timed = dealt(rows.withColumn("at", at), parts, "line", "train", "dir")
    seconds = F.col("at") - F.lag("at").over(train)
    hop = haversine(F.lag("lat").over(train), F.lag("lon").over(train), F.col("lat"), F.col("lon"))
    # A run's first row comes after a gap, or has none before it: no hop leads to it.
    fast = F.coalesce((seconds <= max_gap) & (hop > seconds * (top_kmh / 3.6)), F.lit(False))
    checked = timed.select("line", "train", "dir", "at", "station", F.coalesce((seconds > max_gap).cast("int"), F.lit(0)).alias("_gap"), fast.alias("_fast")).withColumn("_run", F.sum("_gap").over(train))
    last_fast = F.max(F.when(F.col("_fast"), F.col("_run"))).over(train)
    sound = checked.withColumn("_bad", F.coalesce(last_fast == F.col("_run"), F.lit(False))).where("NOT _bad OR _fast")
    stop = F.when(~F.col("_bad"), F.struct("at", "station"))
    whole = sound.groupBy("line", "train", "dir", "_run").agg(F.array_sort(F.collect_list(stop)).alias("_s"), F.max("_bad").alias("_b")).where("NOT _b AND size(_s) > 1")
    start = F.col("_s")[0]["at"]
    stops = F.transform("_s", lambda s: F.struct(s["station"].alias("station"), (s["at"] - F.col("_s")[0]["at"]).alias("off")))
    patterns = whole.select("line", start.alias("_start"), stops.alias("_stops")).groupBy("line", "_stops").agg(F.array_sort(F.collect_set("_start")).alias("starts"))
    signature = F.sha2(F.concat_ws("|", F.col("line").cast("string"), F.to_json("_stops")), 256)
    return patterns.withColumn("signature", signature).select("line", "signature", "starts", F.posexplode("_stops").alias("pos", "_p")).select("line", "signature", F.col("pos").alias("pos"), "_p.station", "_p.off", "starts")


def _prefixes(full: DataFrame, name: str, least: int) -> DataFrame:
    """A row for each start of a name of at least ``least`` characters, so that a prefix match is an equi-join."""
    lengths = F.explode(F.when(F.length(name) >= least, F.sequence(F.lit(least), F.length(name))).otherwise(F.array().cast("array<int>"))).alias("_n")
    return full.select("*", lengths).withColumn("_start", F.substring(name, F.lit(1), F.col("_n"))).drop("_n")


def unique_prefix(short: DataFrame, full: DataFrame, least: int = 5, aliases: DataFrame | None = None) -> DataFrame:
    """name, station_id of short names (name) that start exactly one full name (station_id, full_name).

    aliases (name, station_id) say whose a name is, whatever it starts.
    """
    if aliases is not None:
        listed = short.join(aliases.select("name", "station_id"), "name")
        return listed.select("name", "station_id").unionByName(unique_prefix(short.join(aliases, "name", "left_anti"), full, least))
    starts = _prefixes(full.select("station_id", "full_name"), "full_name", least).groupBy("_start").agg(F.count("*").alias("_n"), F.min("station_id").alias("station_id")).where("_n = 1")
    return short.join(starts, F.col("name") == F.col("_start")).select("name", "station_id")


def resolve_origin(asked: DataFrame, stations: DataFrame) -> DataFrame:
    """ask, station_idx: by display label, else by name, else the first whose name starts so. stations: station_idx, name, label."""
    labels = stations.groupBy(F.col("label").alias("ask")).agg(F.min("station_idx").alias("_label"))
    names = stations.groupBy(F.col("name").alias("ask")).agg(F.min("station_idx").alias("_name"))
    starts = _prefixes(stations.select("station_idx", "name"), "name", 1).groupBy(F.col("_start").alias("ask")).agg(F.min("station_idx").alias("_prefix"))
    found = asked.join(labels, "ask", "left").join(names, "ask", "left").join(starts, "ask", "left")
    return found.select("ask", F.coalesce("_label", "_name", "_prefix").alias("station_idx")).where("station_idx IS NOT NULL")


def first_candidates(rows: DataFrame, key: str, ranks: list[str], found: DataFrame) -> DataFrame:
    """key, value: of several lookup columns the first, in order, that found (name, value) knows."""
    each = rows.select(key, F.posexplode(F.array(*ranks)).alias("_i", "name")).where("name IS NOT NULL")
    best = F.min(F.struct("_i", "value"))
    return each.join(found, "name").groupBy(key).agg(best["value"].alias("value"))


def without_repeats(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before along the order."""
    along = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_last", F.lag(value).over(along)).where(F.col("_last").isNull() | (F.col("_last") != F.col(value))).drop("_last")


def first_wins(rows: DataFrame, keys: list[str], ordinal: str, last: bool = False) -> DataFrame:
    """One row for each key, the first (or last) by ordinal."""
    order = Window.partitionBy(*keys).orderBy(F.desc(ordinal) if last else F.asc(ordinal))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def csr_offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, degree, first: how many edges (src) a node has and how many stand before them, over ranges of nodes."""
    degree = nodes.join(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    return running_sums(degree, ["node"], {"first": "degree"}).select("node", "degree", "first")


def least_recent(pool: DataFrame, seen: DataFrame, limit: int) -> DataFrame:
    """The keys of pool (key) that were sampled longest ago, or never, by seen (key, at)."""
    last = seen.groupBy("key").agg(F.max("at").alias("last"))
    return pool.join(last, "key", "left").orderBy(F.col("last").asc_nulls_first(), "key").limit(limit)


def turn_quota(rows: DataFrame, kind: str, order: str, quota: int, cursor: int) -> DataFrame:
    """The next ``quota`` rows of each kind from its cursor on, around its end."""
    sizes = rows.groupBy(F.col(kind).alias("_kind")).agg(F.count("*").alias("_n"))
    placed = places(rows, [order], kind, "_p").join(sizes, F.col(kind) == F.col("_kind"))
    return placed.where(F.pmod(F.col("_p") - cursor, F.col("_n")) < quota).select(*rows.columns)


def thinned(features: DataFrame, width: float, height: float, most: int) -> DataFrame:
    """view, key of features (view, key, x, y, priority): by priority, those with no kept one within a cell on both axes.

    A group is what one view shows; the order of choice matters, so it is walked once.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in rows.sort_values(["priority", "key"], ascending=[False, True]).itertuples():
            if len(kept) < most and all(abs(r.x - x) >= width or abs(r.y - y) >= height for _, x, y in kept):
                kept.append((r.key, r.x, r.y))
        return pd.DataFrame({"view": rows.view.iloc[0], "key": [k for k, _, _ in kept]})

    kind = dict(features.dtypes)
    return features.groupBy("view").applyInPandas(walk, f"view {kind['view']}, key {kind['key']}")


def inferred_lines(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """a, b, line of edges (a, b) whose ends share exactly one line by lines (node, line)."""
    known = lines.select("node", "line").distinct()
    of_a, of_b = known.withColumnRenamed("node", "a"), known.withColumnRenamed("node", "b")
    shared = edges.select("a", "b").distinct().join(of_a, "a").join(of_b, ["b", "line"])
    return shared.groupBy("a", "b").agg(F.count("*").alias("_n"), F.min("line").alias("line")).where("_n = 1").drop("_n")


def pattern_scale(stops: DataFrame) -> DataFrame:
    """pattern_id, scale of patterns (pattern_id, dir, node): the upper middle of how many patterns of its direction share each of its nodes."""
    visits = stops.select("pattern_id", "dir", "node").distinct()
    shared = visits.groupBy("node", "dir").agg(F.count("*").alias("_n"))
    return visits.join(shared, ["node", "dir"]).groupBy("pattern_id").agg(upper_middle("_n").alias("scale"))


def interchanges(stops: DataFrame, limit: int = 12) -> DataFrame:
    """The stops (stop_id, route_id) that most routes share."""
    return stops.groupBy("stop_id").agg(F.count_distinct("route_id").alias("routes")).orderBy(F.desc("routes"), "stop_id").limit(limit)
