"""Earliest arrivals from many origins at once, by rounds of set operations.

A query is an origin with a slot and a departure sample; its labels (query, stop_id, t) are rows.
A round boards every trip pattern at the stops reached so far, takes the least departure along
each pattern, alights downstream, and walks one hop from the stops that riding improved.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions.exprs import bake, earliest_start, phase_hash, walk_seconds
from reachbase.operators.graph import cut_lineage, packed
from reachbase.operators.spatial import nearest_k, placed, spots_within

BOARD_SLACK = 20
ROUNDS = 6


def baked(windows: DataFrame, key: Column) -> DataFrame:
    """Windows (trip_id, first_start, last_start, headway) after each trip's phase, a hash of key."""
    phased = windows.withColumn("phase", phase_hash(key))
    first, last = bake(F.col("first_start"), F.col("last_start"), F.col("headway"), F.col("phase"))
    return phased.select("trip_id", first.alias("first_start"), F.when(F.col("last_start") < first, first).otherwise(last).alias("last_start"), "headway", "phase")


def expanded(windows: DataFrame) -> DataFrame:
    """One row for each departure: trip_id, n (from 0, on across a trip's windows), start."""
    each = windows.select("trip_id", "first_start", F.explode(F.sequence("first_start", "last_start", "headway")).alias("start"))
    order = Window.partitionBy("trip_id").orderBy("first_start", "start")
    return each.select("trip_id", (F.row_number().over(order) - 1).alias("n"), "start")


def mirrored(stops: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The network with time running backwards: arriving by a time is departing at its negative."""
    trip = Window.partitionBy("trip_id")
    last = F.max("off").over(trip)
    turned = stops.select("trip_id", (F.max("pos").over(trip) + F.min("pos").over(trip) - F.col("pos")).alias("pos"), "stop_id", (last - F.col("off")).alias("off"))
    total = stops.groupBy("trip_id").agg(F.max("off").alias("_last"))
    back = windows.join(total, "trip_id").select("trip_id", (-(F.col("last_start") + F.col("_last"))).alias("first_start"), (-(F.col("first_start") + F.col("_last"))).alias("last_start"), "headway")
    return turned, back


class Walks(NamedTuple):
    """Walks between places: at holds stop_id and spot; hops from_spot, to_spot and sec, a spot's own among them.

    All stops of a place walk alike, so hops don't grow with the square of how many stand there.
    """

    at: DataFrame
    hops: DataFrame


def walks(stops: DataFrame, radius: float = 400) -> Walks:
    """All walks up to radius between stops (stop_id, lat, lon)."""
    at = cut_lineage(placed(stops))
    hops = spots_within(at, at, radius).select(F.col("a").alias("from_spot"), F.col("b").alias("to_spot"), walk_seconds("meters").alias("sec"))
    return Walks(at.select("stop_id", "spot"), cut_lineage(hops))


def walking_transfers(stops: DataFrame, radius: float = 400, most: int = 64) -> DataFrame:
    """from_stop, to_stop, sec: the nearest stops (stop_id, lat, lon) of each, both ways; ties by to_stop.

    The nearest are sought for each place: one more than ``most``, of which a stop leaves out itself.
    Of a place's stops the smallest alone can be among them, and no place counts that has enough nearer ones before it.
    """
    at = placed(stops)
    lists = at.groupBy(F.col("spot").alias("b")).agg(F.slice(F.array_sort(F.collect_list("stop_id")), 1, most + 1).alias("_stops"))
    upto = F.sum("_n").over(Window.partitionBy("a").orderBy("meters").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum("_n").over(Window.partitionBy("a", "meters"))
    sized = spots_within(at, at, radius).join(lists.select("b", F.size("_stops").alias("_n")), "b")
    near = sized.withColumn("_nearer", upto - equal).where(F.col("_nearer") <= most).select("a", "b", "meters")
    each = nearest_k(near.join(lists, "b").select("a", "meters", F.explode("_stops").alias("b")), most + 1)
    ranked = each.groupBy(F.col("a").alias("spot")).agg(F.array_sort(F.collect_list(F.struct("meters", "b"))).alias("_near"))
    others = F.slice(F.filter("_near", lambda x: x["b"] != F.col("stop_id")), 1, most)
    found = at.join(ranked, "spot").select(F.col("stop_id").alias("from_stop"), F.explode(others).alias("_x"))
    return found.select("from_stop", F.col("_x.b").alias("to_stop"), walk_seconds("_x.meters").alias("sec"))


def _least(*labels: DataFrame) -> DataFrame:
    out = labels[0]
    for x in labels[1:]:
        out = out.unionByName(x)
    return out.groupBy("query", "stop_id").agg(F.min("t").alias("t"))


def walked(improved: DataFrame, transfers: DataFrame | Walks, cutoffs: DataFrame) -> DataFrame:
    """One hop on foot from the given labels; by Walks, a label may also be offered to its own stop, later."""
    if isinstance(transfers, Walks):
        soonest = improved.join(transfers.at, "stop_id").groupBy("query", F.col("spot").alias("from_spot")).agg(F.min("t").alias("t"))
        reached = soonest.join(transfers.hops, "from_spot").groupBy("query", F.col("to_spot").alias("spot")).agg(F.min(F.col("t") + F.col("sec")).alias("t"))
        return reached.join(cutoffs, "query").where("t <= cutoff").join(transfers.at, "spot").select("query", "stop_id", "t")
    step = improved.join(transfers, F.col("stop_id") == F.col("from_stop")).select("query", F.col("to_stop").alias("stop_id"), (F.col("t") + F.col("sec")).alias("t"))
    return step.join(cutoffs, "query").where("t <= cutoff").select("query", "stop_id", "t")


def boardable(stops: DataFrame, windows: DataFrame) -> DataFrame:
    """stop_id, trip_id, pos, off and the trip's windows: where and when each pattern can be boarded."""
    return stops.join(windows.select("trip_id", "first_start", "last_start", "headway"), "trip_id").select("stop_id", "trip_id", "pos", "off", "first_start", "last_start", "headway")


def _falling(boards: Column) -> Column:
    """Of boardings (pos, start) by pos those that catch an earlier departure than all before them: few, however long the trip."""
    none = F.filter(boards, lambda b: F.lit(False))
    later = lambda kept, b: F.when((F.size(kept) == 0) | (b["start"] < F.element_at(kept, -1)["start"]), F.concat(kept, F.array(b))).otherwise(kept)
    return F.aggregate(F.array_sort(boards), none, later)


def ridden(labels: DataFrame, visits: DataFrame, stops: DataFrame, cutoffs: DataFrame, board_slack: int, arrive_slack: int) -> DataFrame:
    """The least arrival of one ride more at each stop: query, stop_id, t. visits: boardable() of the stops.

    Only the positions of patterns that a query has reached are boarded; every later position
    sees the least departure of those before it.
    """
    boards = labels.join(visits, "stop_id")
    start = earliest_start(F.col("first_start"), F.col("last_start"), F.col("headway"), F.col("t") + board_slack, F.col("off"))
    boards = boards.join(cutoffs, "query").select("query", "trip_id", "pos", "off", "cutoff", start.alias("start"))
    # Whoever boards after the cutoff arrives after it too. A ride holds a place for each stop of its trip at most.
    boards = boards.where("start IS NOT NULL AND start + off <= cutoff")
    # Few bytes but much work: dealt by trip once, for the grouping and for the join with the trip's stops, in as many parts as there are.
    count = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rides = boards.repartition(count, "trip_id").groupBy("query", "trip_id").agg(F.collect_list(F.struct("pos", "start")).alias("_all"), F.max("cutoff").alias("cutoff"))
    rides = rides.withColumn("_boards", _falling(F.col("_all"))).drop("_all")
    before = F.try_element_at(F.filter("_boards", lambda b: b["pos"] < F.col("pos")), F.lit(-1))["start"]
    arrive = rides.join(stops, "trip_id").select("query", "stop_id", "cutoff", (before + F.col("off") + arrive_slack).alias("t"))
    return arrive.where("t <= cutoff").groupBy("query", "stop_id").agg(F.min("t").alias("t"))


def earliest_arrivals(seeds: DataFrame, stops: DataFrame, windows: DataFrame, transfers: DataFrame | Walks, cutoffs: DataFrame, rounds: int = ROUNDS, mirror: bool = False, checkpoint: bool = True) -> DataFrame:
    """query, stop_id, t after up to ``rounds`` rides from the seeds (query, stop_id, t), t up to each query's cutoff.

    windows: baked, last departure included. With mirror, the tables are mirrored ones, times
    are negative and the slack stands at alighting. A round boards only where the round before
    improved a label: what was boarded earlier has been ridden. It ends early when no ride
    improves anything. Queries are independent; all steps are keyed by query first. What a
    round's rides improve is written before the walks from there, which read it twice.
    """
    board, arrive = (0, BOARD_SLACK) if mirror else (BOARD_SLACK, 0)
    settle = cut_lineage if checkpoint else lambda df: df
    visits = packed(boardable(stops, windows)) if checkpoint else boardable(stops, windows)
    start = _least(seeds.select("query", "stop_id", "t"))
    labels = fresh = settle(_least(start, walked(start, transfers, cutoffs)))
    for _ in range(rounds):
        ride = ridden(fresh, visits, stops, cutoffs, board, arrive)
        known = labels.withColumnRenamed("t", "_t")
        improved = settle(ride.join(known, ["query", "stop_id"], "left").where("_t IS NULL OR t < _t").select("query", "stop_id", "t"))
        if checkpoint and not improved.limit(1).count():
            break
        offer = _least(improved, walked(improved, transfers, cutoffs)).withColumnRenamed("t", "_offer")
        both = labels.join(offer, ["query", "stop_id"], "full")
        settled = settle(both.select("query", "stop_id", F.least("t", "_offer").alias("t"), (F.col("t").isNull() | (F.col("_offer") < F.col("t"))).alias("_new")))
        labels, fresh = settled.select("query", "stop_id", "t"), settled.where("_new").select("query", "stop_id", "t")
    return labels


def explained(labels: DataFrame, seeds: DataFrame, stops: DataFrame, windows: DataFrame, transfers: DataFrame | Walks, board_slack: int = BOARD_SLACK) -> DataFrame:
    """query, stop_id, t, parent, trip_id: from which stop each label was reached, on foot (null trip_id) or by a trip.

    Derived from the labels themselves: a label's parent is the smallest stop, on foot first,
    from which a walk or the next departure arrives exactly then. Seeds have no parent; nor has
    a label whose parent was improved by the search's last round.
    """
    goals = labels.select("query", F.col("stop_id").alias("_goal"), F.col("t").alias("_t"))
    rest = goals.join(seeds.select("query", F.col("stop_id").alias("_goal"), F.col("t").alias("_t")).distinct(), ["query", "_goal", "_t"], "left_anti")
    on_foot = F.lit(None).cast("long").alias("trip_id")
    if isinstance(transfers, Walks):  # a goal isn't its own parent, as it would be reached later than it is
        first = labels.join(transfers.at, "stop_id").groupBy("query", F.col("spot").alias("from_spot"), "t").agg(F.min("stop_id").alias("parent"))
        step = first.join(transfers.hops, "from_spot").groupBy("query", F.col("to_spot").alias("spot"), (F.col("t") + F.col("sec")).alias("_t")).agg(F.min("parent").alias("parent"))
        step = rest.join(transfers.at, F.col("_goal") == F.col("stop_id")).join(step, ["query", "spot", "_t"]).select("query", "_goal", "_t", "parent", on_foot)
    else:
        step = labels.join(transfers, F.col("stop_id") == F.col("from_stop")).select("query", F.col("to_stop").alias("_goal"), (F.col("t") + F.col("sec")).alias("_t"), F.col("stop_id").alias("parent"), on_foot)
        step = step.join(rest, ["query", "_goal", "_t"])
    # From the goal's end: few departures of the trips that stop there arrive exactly then, so few rows are sought at earlier stops.
    calls = stops.join(windows.select("trip_id", "first_start", "last_start", "headway"), "trip_id").select("trip_id", F.col("stop_id").alias("_goal"), F.col("pos").alias("_until"), "off", "first_start", "last_start", "headway")
    due = rest.join(calls, "_goal").withColumn("_start", F.col("_t") - F.col("off")).where("_start BETWEEN first_start AND last_start AND pmod(_start - first_start, headway) = 0").drop("off")
    earlier = stops.select("trip_id", F.col("stop_id").alias("parent"), "pos", "off")
    boards = due.join(earlier, "trip_id").where("pos < _until").join(labels.select("query", F.col("stop_id").alias("parent"), "t"), ["query", "parent"])
    start = earliest_start(F.col("first_start"), F.col("last_start"), F.col("headway"), F.col("t") + board_slack, F.col("off"))
    ride = boards.where(start == F.col("_start")).select("query", "_goal", "_t", "parent", "trip_id")
    ways = step.unionByName(ride)
    best = ways.groupBy("query", "_goal", "_t").agg(F.min(F.struct(F.col("trip_id").isNotNull().alias("rides"), "parent", "trip_id")).alias("_w"))
    return goals.join(best, ["query", "_goal", "_t"], "left").select("query", F.col("_goal").alias("stop_id"), F.col("_t").alias("t"), "_w.parent", "_w.trip_id")


def paths(parents: DataFrame) -> DataFrame:
    """query, stop_id, legs: the whole way to every label of parents (query, stop_id, t, parent, trip_id), as explained() gives them.

    legs are structs of stop_id, t and trip_id (null on foot), the seed first. Each round doubles
    the ways: a label takes over the way and the parent of where its own way starts, so the
    number of rounds is the logarithm of the longest way's legs.
    """
    kinds = dict(parents.dtypes)
    own = F.array(F.struct("stop_id", "t", "trip_id"))
    ways = cut_lineage(parents.select("query", "stop_id", own.alias("legs"), F.col("parent").alias("_from")))
    while ways.where("_from IS NOT NULL").limit(1).count():
        before = ways.select("query", F.col("stop_id").alias("_from"), F.col("legs").alias("_legs"), F.col("_from").alias("_next"))
        none = F.array().cast(f"array<struct<stop_id: {kinds['stop_id']}, t: {kinds['t']}, trip_id: {kinds['trip_id']}>>")
        joined = ways.join(before, ["query", "_from"], "left")
        ways = cut_lineage(joined.select("query", "stop_id", F.concat(F.coalesce("_legs", none), "legs").alias("legs"), F.col("_next").alias("_from")))
    return ways.select("query", "stop_id", "legs")


def mirrored_connections(connections: DataFrame) -> DataFrame:
    """Connections (origin, dest, dep, arr) with time running backwards, for arriving by a time."""
    return connections.select(F.col("dest").alias("origin"), F.col("origin").alias("dest"), (-F.col("arr")).alias("dep"), (-F.col("dep")).alias("arr"))


def rail_matrix(stations: DataFrame, slots: DataFrame, connections: DataFrame, transfers: DataFrame) -> DataFrame:
    """station, slot, node, sec: the rail time from all stations (node) at all slots (slot, arrive, seconds), both directions of time."""
    out = None
    for arrive in (False, True):
        own = slots.where(F.col("arrive") == arrive)
        sign = -1 if arrive else 1
        # Slots are a timetable's, a few hundred.
        seeds = stations.join(F.broadcast(own), F.lit(True)).select(F.struct(F.col("node").alias("station"), "slot", "seconds").alias("query"), "node", (sign * F.col("seconds")).alias("t"))
        used = mirrored_connections(connections) if arrive else connections
        walks = transfers if not arrive else transfers.select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), "sec")
        best = rail_arrivals(seeds, used, walks).select("query.station", "query.slot", "node", (F.col("t") - sign * F.col("query.seconds")).alias("sec"))
        out = best if out is None else out.unionByName(best)
    return out


def next_departures(asks: DataFrame, connections: DataFrame) -> DataFrame:
    """ask_id, dest, dep, arr: of asks (ask_id, origin, ready) the first connection (origin, dest, dep, arr) to each destination.

    Asks and connections of an origin and destination are laid on one time axis and walked once
    backwards, so the rows are asks x destinations and connections, never their product.
    """
    each = connections.groupBy("origin", "dest", "dep").agg(F.min("arr").alias("arr"))
    wanted = asks.join(each.select("origin", "dest").distinct(), "origin").select("origin", "dest", F.col("ready").cast("long").alias("at"), F.lit(1).alias("_ask"), "ask_id", F.lit(None).cast("struct<dep: bigint, arr: bigint>").alias("_next"))
    offered = each.select("origin", "dest", F.col("dep").cast("long").alias("at"), F.lit(0).alias("_ask"), F.lit(None).cast(dict(asks.dtypes)["ask_id"]).alias("ask_id"), F.struct(F.col("dep").cast("long").alias("dep"), F.col("arr").cast("long").alias("arr")).alias("_next"))
    later = Window.partitionBy("origin", "dest").orderBy(F.desc("at"), "_ask").rowsBetween(Window.unboundedPreceding, 0)
    found = wanted.unionByName(offered).withColumn("_next", F.last("_next", ignorenulls=True).over(later)).where("_ask = 1 AND _next IS NOT NULL")
    return found.select("ask_id", "dest", "_next.dep", "_next.arr")


def _hourly(connections: DataFrame) -> DataFrame:
    """origin, dest, hour, departures and later: of each hour its departures (dep, arr) and the least arrival of all later hours' ones.

    Of an hour's departures those stay that arrive before all later ones of the hour: whoever
    catches another can take a later one and arrive as soon. So a dense timetable has few of them.
    Hours without departures up to the last one with some have a row too, so a time finds its
    first arrival in one row: among the hour's departures from then on, and later. A later
    train may arrive before an earlier one.
    """
    each = connections.groupBy("origin", "dest", "dep").agg(F.min("arr").alias("arr"))
    following = Window.partitionBy("origin", "dest", "hour").orderBy(F.desc("dep")).rowsBetween(Window.unboundedPreceding, -1)
    useful = each.withColumn("hour", F.floor(F.col("dep") / 3600)).withColumn("_next", F.min("arr").over(following)).where("_next IS NULL OR arr < _next")
    hours = useful.groupBy("origin", "dest", "hour").agg(F.array_sort(F.collect_list(F.struct("dep", "arr"))).alias("departures"), F.min("arr").alias("_least"))
    pair = Window.partitionBy("origin", "dest").orderBy("hour")
    after = Window.partitionBy("origin", "dest").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    low = connections.agg(F.min(F.floor(F.col("dep") / 3600)).alias("_low"))  # one row
    spans = hours.withColumn("later", F.min("_least").over(after)).withColumn("_before", F.lag("hour").over(pair)).crossJoin(F.broadcast(low))
    filled = spans.withColumn("_h", F.explode(F.sequence(F.coalesce(F.col("_before") + 1, "_low"), "hour")))
    own = F.col("_h") == F.col("hour")
    none = F.filter("departures", lambda x: F.lit(False))
    return filled.select("origin", "dest", F.col("_h").alias("hour"), F.when(own, F.col("departures")).otherwise(none).alias("departures"), F.when(own, F.col("later")).otherwise(F.least("later", "_least")).alias("later"))


def rail_arrivals(seeds: DataFrame, connections: DataFrame, transfers: DataFrame) -> DataFrame:
    """query, node, t: the least time at every node, riding connections and walking transfers until nothing improves.

    The departures between two nodes stand in a row for each hour, so a frontier row meets each
    destination once, and of its departures those of an hour.
    """
    best = cut_lineage(seeds.groupBy("query", "node").agg(F.min("t").alias("t")))
    hourly = cut_lineage(_hourly(connections))
    low = hourly.agg(F.min("hour")).first()[0]
    frontier = best
    while frontier.limit(1).count():
        at = frontier.withColumn("hour", F.greatest(F.floor(F.col("t") / 3600), F.lit(low).cast("long")))
        soon = F.array_min(F.transform(F.filter("departures", lambda x: x["dep"] >= F.col("t")), lambda x: x["arr"]))
        ride = at.withColumnRenamed("node", "origin").join(hourly, ["origin", "hour"]).select("query", F.col("dest").alias("node"), F.least(soon, "later").alias("t")).where("t IS NOT NULL")
        walk = frontier.join(transfers, F.col("node") == F.col("from_node")).select("query", F.col("to_node").alias("node"), (F.col("t") + F.col("sec")).alias("t"))
        offer = ride.unionByName(walk).groupBy("query", "node").agg(F.min("t").alias("_offer"))
        both = cut_lineage(best.join(offer, ["query", "node"], "full").select("query", "node", F.least("t", "_offer").alias("t"), (F.col("t").isNull() | (F.col("_offer") < F.col("t"))).alias("_new")))
        best, frontier = both.select("query", "node", "t"), both.where("_new").select("query", "node", "t")
    return best


def synthetic_connections(segments: DataFrame, periods: DataFrame) -> DataFrame:
    """Departures of chain segments (chain, seq, origin, dest, seconds) over periods (start, end, headway): a train leaves the chain's head every headway."""
    order = Window.partitionBy("chain").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    timed = segments.withColumn("_before", F.coalesce(F.sum("seconds").over(order), F.lit(0)))
    each = timed.crossJoin(F.broadcast(periods))  # half a dozen periods
    first = F.col("start") + F.pmod(F.col("_before") - F.col("start"), F.col("headway"))
    dep = F.explode(F.when(first < F.col("end"), F.sequence(first, F.col("end") - 1, F.col("headway"))).otherwise(F.array().cast("array<bigint>"))).alias("dep")
    return each.select("chain", "origin", "dest", "seconds", dep).select("chain", "origin", "dest", "dep", (F.col("dep") + F.col("seconds")).alias("arr"))


def egress(labels: DataFrame, access: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """query, dong_id, t, walk: the least arrival plus walk (dong_id, stop_id, sec) to each neighbourhood, and that walk."""
    total = labels.join(access, "stop_id").select("query", "dong_id", (F.col("t") + F.col("sec")).alias("t"), F.col("sec").alias("walk"), "stop_id")
    best = F.min(F.struct("t", "walk", "stop_id"))
    return total.join(cutoffs, "query").where("t <= cutoff").groupBy("query", "dong_id").agg(best["t"].alias("t"), best["walk"].alias("walk"))


def sample_middle(rows: DataFrame, samples: int, cap: int) -> DataFrame:
    """origin, slot, dong_id, minutes, walk of samples (origin, slot, sample, dong_id, sec, walk).

    Out of reach if at most half of the samples reach; else the lower middle of all samples, the
    missing ones last, with its own walk. Minutes at the cap are null, and then so is the walk.
    """
    order = Window.partitionBy("origin", "slot", "dong_id").orderBy("sec", "sample")
    group = Window.partitionBy("origin", "slot", "dong_id")
    ranked = rows.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(group))
    middle = ranked.where((F.col("_n") * 2 > samples) & (F.col("_r") == F.least(F.lit((samples - 1) // 2 + 1), F.col("_n"))))
    return middle.select("origin", "slot", "dong_id", *rounded_middle(cap))


def rounded_middle(cap: int) -> list[Column]:
    """minutes and walk from seconds (sec, walk); both null at the cap."""
    minutes = F.floor((F.col("sec") + 30) / 60).cast("int")
    walk = F.least(F.lit(254), F.greatest(F.lit(0), F.floor((F.col("walk") + 30) / 60))).cast("int")
    return [F.when(minutes < cap, minutes).alias("minutes"), F.when(minutes < cap, walk).alias("walk")]
