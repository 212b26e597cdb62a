"""Which patterns of a line run, in which direction, and their trips with times and headways.

Sides that grow with the patterns carry a merge hint: Spark takes their size from packed files, a
fraction of what their rows take, and would send them whole through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions.exprs import haversine, rail_seconds
from reachbase.functions.medians import upper_middle
from reachbase.operators.graph import connected, cut_lineage


#: Rows that a task links at once.
LINK_ROWS = 1_000_000


def _ranks(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct ones in their order, and these."""
    coded = column.combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(order)


def _linked(table: pa.Table) -> pa.Table:
    """Of rows sorted by line and kind each pattern with the smallest that it is joined with here, and each stop of the first and the last line, which others may have rows of."""
    pattern, ids = _ranks(table.column("pattern_id"))
    (line, _), (kind, _), (stop, _) = (_ranks(table.column(c)) for c in ("line", "express", "node"))
    line = line * 2 + kind
    _, first, node = np.unique(line * (stop.max() + 1) + stop, return_index=True, return_inverse=True)
    label, before = np.arange(len(ids)), None
    while before is None or (label != before).any():
        before, least = label, np.full(len(first), len(ids))
        np.minimum.at(least, node, label[pattern])
        label = label.copy()
        np.minimum.at(label, pattern, least[node])
        label = label[label]
    ends = first[np.isin(line[first], line[[0, -1]])]
    own = pa.table({"pattern_id": ids, "b": ids.take(pa.array(label))})
    shared = table.select(["line", "express", "node"]).take(pa.array(ends)).append_column("b", ids.take(pa.array(label[pattern[ends]])))
    return pa.concat_tables([own, shared], promote_options="default").select(["pattern_id", "line", "express", "node", "b"])


def _linking(rows: int) -> Callable:
    """For mapInArrow: what _linked makes of so many rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from _linked(pa.Table.from_batches(held)).to_batches(65_536)
                held, n = [], 0
        if n:
            yield from _linked(pa.Table.from_batches(held)).to_batches(65_536)

    return run


def pattern_components(stops: DataFrame) -> DataFrame:
    """pattern_id, component (its smallest pattern): the patterns of a line and kind that stops (line, express, pattern_id, node) join.

    Tasks link the patterns of the lines dealt to them by ranges, LINK_ROWS rows at a time, so rounds over
    all are left for lines of which several have rows. There a stop links its patterns, and a
    pattern what it was linked with, with the smallest of them, so a stop of many patterns makes no pairs.
    Up to LINK_ROWS such links are followed in one task.
    """
    at = stops.select("line", "express", "pattern_id", "node").dropna()
    types = dict(at.dtypes) | {"b": dict(at.dtypes)["pattern_id"]}
    count = int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = at.repartitionByRange(count, "line", "express", "pattern_id").sortWithinPartitions("line", "express", "pattern_id")
    parts = cut_lineage(ranged.mapInArrow(_linking(LINK_ROWS), ", ".join(f"{c} {types[c]}" for c in ("pattern_id", "line", "express", "node", "b"))))
    own = parts.where("pattern_id IS NOT NULL").groupBy("pattern_id").agg(F.min("b").alias("b"), F.collect_set("b").alias("_all"))
    between = parts.where("pattern_id IS NULL").groupBy("line", "express", "node").agg(F.min("b").alias("b"), F.collect_set("b").alias("_all"))
    edges = own.select("b", "_all").union(between.select("b", "_all")).where(F.size("_all") > 1).select(F.explode("_all").alias("a"), "b").distinct()
    edges = cut_lineage(edges)
    if edges.count() <= LINK_ROWS:
        one = edges.select(F.col("a").alias("pattern_id"), F.lit(0).alias("line"), F.lit(False).alias("express"), F.col("b").alias("node")).coalesce(1)
        joined = one.mapInArrow(_linking(LINK_ROWS + 1), f"pattern_id {types['b']}, line int, express boolean, node {types['b']}, b {types['b']}").where("pattern_id IS NOT NULL")
        joined = joined.select(F.col("pattern_id").alias("b"), F.col("b").alias("_joined"))
    else:
        joined = connected(edges).select(F.col("node").alias("b"), F.col("component").alias("_joined"))
    return own.join(joined.hint("merge"), "b", "left").select("pattern_id", F.coalesce("_joined", "b").alias("component"))


def service_set(stops: DataFrame) -> DataFrame:
    """line, express, pattern_id, dir of the patterns that a line needs; stops: line, express, pattern_id, pos, node.

    The patterns of a line and kind fall into components that share stops, and each has its
    longest pattern (ties: the smallest id) as its reference. dir is 1 where more of the steps
    between the reference's stops go against its order than along it, and 0 otherwise, but exact
    reverses of each other have opposite ones: the first of them, longest patterns first, tells.
    Of a direction's patterns, in that order, those stay that have a stop which none before has,
    and the exact reverses of those that stay in the other direction.
    """
    along = Window.partitionBy("pattern_id").orderBy("pos")
    stops = cut_lineage(stops.select("line", "express", "pattern_id", "pos", "node"))
    rows = cut_lineage(stops.join(pattern_components(stops).hint("merge"), "pattern_id"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda s: s["node"])
    patterns = rows.groupBy("line", "express", "component", "pattern_id").agg(F.count("*").alias("_n"), ids.alias("_stops"))
    text = lambda stops: F.array_join(F.transform(stops, lambda x: x.cast("string")), " ")
    patterns = patterns.withColumn("_seq", text(F.col("_stops"))).withColumn("_back", text(F.reverse("_stops"))).drop("_stops").withColumn("_rank", F.struct(-F.col("_n"), F.col("pattern_id")))

    reference = patterns.groupBy("component").agg(F.min("_rank").alias("_first")).select("component", F.col("_first.pattern_id").alias("pattern_id"))
    places = rows.join(reference.hint("merge"), ["component", "pattern_id"]).groupBy("component", "node").agg(F.min("pos").alias("_at"))
    steps = rows.join(places.hint("merge"), ["component", "node"]).withColumn("_step", F.signum(F.col("_at") - F.lag("_at").over(along)))
    votes = steps.groupBy("pattern_id").agg((F.coalesce(F.sum("_step"), F.lit(0)) < 0).alias("_against"))
    voted = patterns.join(votes.hint("merge"), "pattern_id", "left").withColumn("_pair", F.least("_seq", "_back"))

    leader = F.min(F.struct("_rank", "_seq", F.coalesce("_against", F.lit(False)).alias("_against"))).alias("_lead")
    led = voted.join(voted.groupBy("component", "_pair").agg(leader).hint("merge"), ["component", "_pair"])
    same = (F.col("pattern_id") == F.col("_lead._rank.pattern_id")) | ((F.col("_seq") == F.col("_lead._seq")) & (F.col("_seq") != F.col("_back")))
    placed = cut_lineage(led.select("line", "express", "component", "pattern_id", "_seq", "_back", "_rank", (F.col("_lead._against") == same).cast("int").alias("dir")))

    at = rows.select("pattern_id", "node").join(placed.select("component", "pattern_id", "dir", "_rank").hint("merge"), "pattern_id")
    covering = cut_lineage(at.groupBy("component", "dir", "node").agg(F.min("_rank").alias("_first")).select(F.col("_first.pattern_id").alias("pattern_id")).distinct())
    kept = placed.join(covering.hint("merge"), "pattern_id", "left_semi")
    for side in (0, 1):  # what the first round adds can have reverses in the second
        others = kept.where(F.col("dir") != side).select("component", F.col("_seq").alias("_back")).distinct()
        kept = kept.unionByName(placed.where(F.col("dir") == side).join(kept.select("pattern_id").hint("merge"), "pattern_id", "left_anti").join(others.hint("merge"), ["component", "_back"], "left_semi").select(*kept.columns))
    return kept.select("line", "express", "pattern_id", "dir")


def rail_stop_times(served: DataFrame, platforms: DataFrame, measured: DataFrame) -> DataFrame:
    """pattern_id, dir, pos, node, at: whole seconds from a trip's first stop to each stop of the served patterns.

    served: pattern_id, dir, pos, node; platforms: node, lat, lon; measured: a, b (a < b) and
    meters of the edges whose length is known. Other edges are as long as the straight line.
    """
    along = Window.partitionBy("pattern_id").orderBy("pos")
    placed = served.select("pattern_id", "dir", "pos", "node").join(platforms.select("node", "lat", "lon"), "node")
    hops = placed.withColumns({f"_{c}": F.lag(c).over(along) for c in ("node", "lat", "lon")})
    edge = measured.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "meters")
    known = hops.withColumn("_a", F.least("node", "_node")).withColumn("_b", F.greatest("node", "_node")).join(edge.hint("merge"), ["_a", "_b"], "left")
    straight = haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    seconds = F.when(F.col("_node").isNull(), 0).otherwise(rail_seconds(F.coalesce("meters", straight)))
    return known.withColumn("_s", seconds).select("pattern_id", "dir", "pos", "node", F.sum("_s").over(along).cast("long").alias("at"))


def service_scale(served: DataFrame) -> DataFrame:
    """pattern_id, scale: the upper middle, over a pattern's stops, of how often its direction's patterns (pattern_id, dir, node) stop there.

    Repeated stops of a pattern count each time.
    """
    shared = served.groupBy("node", "dir").agg(F.count("*").alias("_n"))
    return served.join(shared.hint("merge"), ["node", "dir"]).groupBy("pattern_id").agg(upper_middle("_n").alias("scale"))


def rail_windows(served: DataFrame, lines: DataFrame, periods: DataFrame) -> DataFrame:
    """pattern_id, start, end, headway: the periods (start, end, headway) of a day for each served pattern (line, pattern_id, dir, node).

    A headway grows by the line's factor (lines: line, factor; 1 without one) and by the pattern's
    scale, since the line's trains are dealt to its patterns; it is a minute at least.
    """
    of_line = served.select("line", "pattern_id").distinct().join(lines, "line", "left")
    services = of_line.join(service_scale(served).hint("merge"), "pattern_id").select("pattern_id", F.coalesce("factor", F.lit(1.0)).alias("factor"), "scale")
    each = services.crossJoin(F.broadcast(periods))  # half a dozen periods
    return each.select("pattern_id", "start", "end", F.greatest(F.lit(60), F.floor(F.col("headway") * F.col("factor") * F.col("scale"))).cast("int").alias("headway"))


def rail_trips(stops: DataFrame, platforms: DataFrame, measured: DataFrame, lines: DataFrame, periods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stop times and windows of the trips that lines' patterns (line, express, pattern_id, pos, node) need, by service_set()."""
    chosen = cut_lineage(service_set(stops))
    served = cut_lineage(stops.join(chosen.select("pattern_id", "dir").hint("merge"), "pattern_id"))
    return rail_stop_times(served, platforms, measured), rail_windows(served, lines, periods)
