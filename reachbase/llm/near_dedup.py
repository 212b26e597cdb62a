"""Near duplicates by SetSketch registers: band, estimate, verify on full sets, and connect.

Registers follow Ertl, "SetSketch: Filling the Gap between MinHash and HyperLogLog" (2021):
register i is floor(1 - log_b x_i) for the smallest x_i of the set's exponential variables, so
registers of parts merge by maximum, and two sets agree in a register with a probability near
their resemblance. Registers are banded for candidates; the joint likelihood of a pair's
registers estimates its resemblance; what may reach the threshold is compared on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.llm.cluster import by_small_batches, durable
from reachbase.llm.textblock import TextBlock, blocks, mix
from reachbase.operators.graph import connected

#: Bands are as many as it takes for a pair at the threshold to share none with this probability.
MISS = 3e-6
#: Near 1, so that registers of unlike sets seldom agree by their coarseness.
SPACING = 1.001
TOP_REGISTER = 65_535
#: Standard deviations by which the estimate may fall short before a candidate is dropped.
MARGIN = 6
#: Documents that meet in one block of a bucket.
BLOCK = 256
#: Ids that a broadcast may hold; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


class Banding(NamedTuple):
    """How registers make bands. Longer bands keep unlike sets apart and take more registers."""

    bands: int
    rows: int

    @classmethod
    def at(cls, percent: int) -> Banding:
        rows = 8 if percent >= 85 else 6 if percent >= 75 else 4
        return cls(math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows))), rows)

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def registers(hashes: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """A row of registers for each set; an empty set has zeros. Repeated elements don't matter."""
    rng = np.random.default_rng(7)
    multiply, add = rng.integers(0, 1 << 32, (2, count), dtype=np.uint32)
    multiply |= np.uint32(1)
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, count), np.uint16)
    if not len(full):
        return out
    first = bounds[:-1][full]
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((count, len(full)), np.uint32)
    for i in range(count):
        least[i] = np.minimum.reduceat(high * multiply[i] + add[i], first)
    uniform = (least.astype(np.float64) + 1) / (2.0**32 + 1)
    # Scaled so that registers of sets of one to about 10**9 elements lie between the ends. The least values have 32 bits,
    # so registers of sets far above 10**6 elements agree more often than their sets; verification sorts that out.
    value = np.floor(1 - np.log(-np.log1p(-uniform)) / math.log(SPACING)) + 30_000
    out[full] = np.clip(value, 0, TOP_REGISTER).astype(np.uint16).T
    return out


def band_keys(rows: np.ndarray, banding: Banding) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    parts = rows.reshape(len(rows), *banding).astype(np.uint64)
    key = np.broadcast_to(np.arange(banding.bands, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(banding.rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def likely_resemblance(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The resemblance that makes the pairs' register comparisons most likely, for known set sizes."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u = size_a / (size_a + size_b)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (SPACING - 1) / SPACING) / math.log(SPACING), 1e-12, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        return above * np.log(more) + below * np.log(less) + equal * np.log(np.clip(1 - more - less, 1e-12, 1))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(30):  # the likelihood has one peak
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        better = likelihood(left) >= likelihood(right)
        high, low = np.where(better, right, high), np.where(better, low, left)
    return (low + high) / 2


def _sets(block: TextBlock, k: int, count: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Registers and the sorted distinct shingle hashes of each document."""
    hashes, bounds = block.shingles(k)
    return registers(hashes, bounds, count), [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(len(block))]


def _sketch(k: int, banding: Banding) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for part, block in blocks(batch.column("text"), lower=True):
                rows, sets = _sets(block, k, banding.registers)
                sizes = np.array([len(s) for s in sets], np.int64)
                one = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64)
                two = np.array([np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(s) else 0 for s in sets], np.uint64)
                keys = pa.array(band_keys(rows, banding).ravel())
                offsets = pa.array(np.arange(len(block) + 1, dtype=np.int32) * banding.bands)
                columns = [*(c.slice(part.start, part.stop - part.start) for c in (ids, batch.column("_text"))), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.ListArray.from_arrays(offsets, keys)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_text", "n_shingles", "set_1", "set_2", "bands"])

    return run


def _full_sets(k: int, banding: Banding) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for part, block in blocks(batch.column("text"), lower=True):
                rows, sets = _sets(block, k, banding.registers)
                columns = [ids.slice(part.start, part.stop - part.start), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "registers", "elements"])

    return run


def alike(common: int, size_a: int, size_b: int, percent: int) -> bool:
    return 100 * common >= percent * (size_a + size_b - common)


def _verify(percent: int, count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), count) for c in ("registers_a", "registers_b")]
                sets = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("elements_a", "elements_b")]
                sizes = [np.array([len(s) for s in side], np.float64) for side in sets]
                goal = percent / 100
                short = MARGIN * math.sqrt(goal * (1 - goal) / count)
                keep = likely_resemblance(*regs, *sizes) >= goal - short
                keep &= 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
                found = [i for i in np.flatnonzero(keep) if alike(len(np.intersect1d(sets[0][i], sets[1][i], assume_unique=True)), len(sets[0][i]), len(sets[1][i]), percent)]
                yield batch.select(["a", "b"]).take(pa.array(found, pa.int64()))

    return run


def _compare_blocks(percent: int) -> Callable[[pa.Table], pa.Table]:
    """All pairs between two blocks of a bucket that are in different components, on full sets."""

    def run(table: pa.Table) -> pa.Table:
        sides = [(np.array(t.column("doc_id")), np.array(t.column("component")), [np.frombuffer(x, np.uint64) for x in t.column("elements").to_pylist()]) for t in (table.filter(pc.equal(table.column("side"), s)) for s in (0, 1))]
        if not len(sides[1][0]):  # a block meets itself
            sides[1] = sides[0]
        (ids_a, of_a, sets_a), (ids_b, of_b, sets_b) = sides
        out: list[tuple[int, int]] = []
        if len(ids_a) and len(ids_b):
            size_a, size_b = (np.array([len(s) for s in side]) for side in (sets_a, sets_b))
            every = np.concatenate(sets_a + sets_b)
            values, place, times = np.unique(every, return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(sets_a) + len(sets_b)), np.concatenate([size_a, size_b]))
            shared = times > 1  # what one set alone has is common to no two
            owner, place = owner[shared[place]], (np.cumsum(shared) - 1)[place[shared[place]]]
            values = values[shared]
            common = np.zeros((len(ids_a), len(ids_b)), np.float32)
            for low in range(0, len(values), 16_384):  # incidence of a slice of the elements
                here = (place >= low) & (place < low + 16_384)
                grid = np.zeros((len(sets_a) + len(sets_b), min(16_384, len(values) - low)), np.float32)
                grid[owner[here], place[here] - low] = 1
                common += grid[: len(sets_a)] @ grid[len(sets_a) :].T
            near = (100 * common >= percent * (size_a[:, None] + size_b[None, :] - common)) & (of_a[:, None] != of_b[None, :])
            out = [(int(ids_a[i]), int(ids_b[j])) for i, j in zip(*np.nonzero(near), strict=True)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _open_buckets(rest: DataFrame) -> DataFrame:
    """The bands of rest (band, node, component) that hold several components, one for all with the same members.

    Returns band, n (rows), core (the smallest component), n_core (its rows), and further columns.
    Sums of hashes are decimals: 64-bit ones overflow in buckets of some ten thousand members.
    """
    mark = F.xxhash64("node", "component")
    by_part = rest.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("s"), F.bit_xor(mark).alias("x"))
    shape = by_part.groupBy("band").agg(F.sum("n").alias("n"), F.min("component").alias("core"), F.min_by("n", "component").alias("n_core"), F.count("*").alias("parts"), F.sum("s").alias("s"), F.bit_xor("x").alias("x")).where("parts > 1")
    return shape.groupBy("n", "n_core", "core", "s", "x").agg(F.min("band").alias("band"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each element of the sets: node, component, size, element."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("elements").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = pa.array(np.repeat(np.arange(len(sets)), sizes))
        columns = [batch.column("node").take(owner), batch.column("component").take(owner), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "component", "size", "element"])


def _may_link(sets: DataFrame, percent: int) -> DataFrame:
    """The nodes of sets (node, component, elements) that can still have a link to another component.

    In one order of all elements, the rarest first, two sets that are alike share an element among the first
    size - ceil(percent / 100 * size) + 1 of each. A page that is a common frame around text of
    its own has these for itself alone, and needs no comparison however many share its frame.
    """
    elements = sets.select("node", "component", "elements").mapInArrow(_unpacked, "node long, component long, size long, element long")
    shared = elements.groupBy("element").agg(F.count("*").alias("f")).where("f > 1")
    own = F.array_sort(F.collect_list(F.struct("f", "element")))
    each = elements.join(shared, "element").groupBy("node", "component", "size").agg(own.alias("_e"))
    # Elements that no other set has come first.
    first = (F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - (F.col("size") - F.size("_e"))).cast("int")
    first_own = each.withColumn("_n", first).where("_n > 0").select("node", "component", F.explode(F.slice("_e", 1, F.col("_n"))).alias("_x")).select("node", "component", F.col("_x.element").alias("element"))
    first_own = durable(first_own)
    met = first_own.groupBy("element").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("element")
    return first_own.join(met, "element", "left_semi").select("node").distinct()


def _text_key() -> Column:
    return F.xxhash64(F.col("text").isNull(), "text").alias("_text")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Groups documents whose sets of k-word shingles have a resemblance of percent / 100 or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer than k words is one
    shingle. Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach) and
    kept (doc_id = component_id). Empty texts are linked with nothing. Links:

    1. Documents with equal sets share a component; one of them stands for all from here on.
    2. In each bucket of a band every set meets the bucket's smallest id (likelihood estimate
       first, then the full sets), which is one pair for each member.
    3. Buckets whose members are still in different components are compared in blocks of
       members on full sets, so no link inside a bucket is lost, and no group's pairs are rows.
       Members that by their rarest elements can't be alike to any in another component
       (_may_link) don't take part.

    docs: doc_id and text are used; texts are read whole, however long. Rows that share a doc_id count as one document with several
    texts; a null doc_id gets the component of an equal set, or null, and then kept is true. An
    empty table gives an empty result.
    """
    return _grouped(docs, k, percent).drop("_text")


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """near_duplicates() with a hash of each row's text."""
    banding = Banding.at(percent)
    texts = by_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(), "text")
    sketched = durable(texts.mapInArrow(_sketch(k, banding), "doc_id long, _text long, n_shingles long, set_1 long, set_2 long, bands array<long>"))
    sets = durable(sketched.where("n_shingles > 0").groupBy("set_1", "set_2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    banded = sets.where("node is not null").select("node", F.explode("bands").alias("band")).groupBy("band", "node").agg(F.lit(1).alias("_")).drop("_")
    buckets = durable(banded.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("hub")).where("members > 1"))
    inside = durable(sets.where("node is not null").select("node", F.explode("bands").alias("band")).join(buckets, "band").select("band", "node", "hub", "members"))
    pairs = durable(inside.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())

    ids = durable(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct())
    few = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    chosen = texts.join(few, texts["doc_id"] == F.col("_id"), "left_semi")
    full = durable(chosen.mapInArrow(_full_sets(k, banding), "doc_id long, registers binary, elements binary"))
    sides = [full.select(F.col("doc_id").alias(s), F.col("registers").alias(f"registers_{s}"), F.col("elements").alias(f"elements_{s}")) for s in ("a", "b")]
    links = durable(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_verify(percent, banding.registers), "a long, b long"))
    labels = connected(links)

    # What the hubs left apart. A hub has met all others of its bucket.
    part = F.coalesce("component", "node").alias("component")
    rest = inside.where("members > 2 and node <> hub").join(labels, "node", "left").select("band", inside["node"], part)
    opened = rest.join(_open_buckets(rest).select("band"), "band", "left_semi").select("node", "component").distinct()
    may_link = durable(_may_link(opened.join(full.select(F.col("doc_id").alias("node"), "elements"), "node"), percent))
    rest = durable(rest.join(may_link, "node", "left_semi"))
    shape = _open_buckets(rest)
    open_rows = rest.join(shape.select("band", "n", "n_core", "core"), "band")
    # The component that the bucket's smallest ids have in common has its own blocks, which don't meet each other.
    core_blocks = F.ceil(F.col("n_core") / BLOCK).cast("int")
    rest_blocks = F.ceil((F.col("n") - F.col("n_core")) / BLOCK).cast("int")
    in_core = F.col("component") == F.col("core")
    mine = F.when(in_core, F.pmod(F.xxhash64("node"), core_blocks)).otherwise(core_blocks + F.pmod(F.xxhash64("node"), rest_blocks)).cast("int")
    placed = open_rows.withColumn("_block", mine)
    other = F.explode(F.sequence(F.when(in_core, core_blocks).otherwise(0), core_blocks + rest_blocks - 1)).alias("_other")
    met = placed.select("band", "node", "component", "_block", other).select("band", "node", "component", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), (F.col("_block") > F.col("_other")).cast("int").alias("side"))
    elements = full.select("doc_id", "elements")
    grouped = met.join(elements, met["node"] == elements["doc_id"]).select("band", "_i", "_j", "side", "doc_id", "component", "elements")
    more = grouped.groupBy("band", "_i", "_j").applyInArrow(_compare_blocks(percent), "a long, b long")
    more = durable(more)
    if more.limit(1).count():
        joined = more.join(labels, more["a"] == labels["node"], "left").select(F.coalesce("component", "a").alias("a"), "b")
        joined = joined.join(labels, joined["b"] == labels["node"], "left").select("a", F.coalesce("component", "b").alias("b"))
        upper = connected(joined).select(F.col("node").alias("_node"), F.col("component").alias("_upper"))
        known = labels.union(upper.select("_node", "_node")).distinct()
        labels = durable(known.join(upper, known["component"] == upper["_node"], "left").groupBy("node").agg(F.min(F.coalesce("_upper", "component")).alias("component")))
    named = sets.join(labels, "node", "left").select("set_1", "set_2", F.coalesce("component", "node").alias("component"))
    joined = sketched.select("doc_id", "_text", "n_shingles", "set_1", "set_2").join(named, ["set_1", "set_2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    found = joined.select("doc_id", "_text", "n_shingles", own.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs' rows without those of a group's other documents. Columns are unchanged, whatever their names.

    Of rows with one doc_id each is kept or goes by its own text; equal rows share their fate.
    Rows with a null doc_id, and null and empty texts, stay. An empty table gives an empty one.
    """
    gone = durable(_grouped(docs, k, percent).where("not kept").select("doc_id", "_text").distinct())
    few = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(few, ["doc_id", "_text"], "left_anti").select("_row.*")
