"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.llm.cluster import durable, partitions
from reachbase.operators.ranges import running_sums

WORD = r"[^\x20\x09-\x0D]+"
#: Sources that a broadcast may hold; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Each source's demand: source, _rank, source_size and target.

    Sources by code point, null last, get the weights in turn. ``share`` times all sizes is
    dealt out by weight; no source gets more than ``most`` times its size, and what exceeds that
    is dealt out again by weight. That ends where target = min(cap, level * weight) for one
    level, found here by running sums over the sources sorted by cap / weight; any number of
    sources is spread over tasks.
    sizes: source, size. It needs share <= most; sources without words get 0; no sources give
    an empty result.
    """
    totals = durable(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    named = totals.withColumn("_none", F.col("source").isNull()).withColumn("_one", F.lit(1).cast("long"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = running_sums(named, ["_none", "source"], {"_rank": "_one"}).withColumn("_weight", turn).withColumn("_cap", most * F.col("source_size"))
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    tried = durable(running_sums(ranked, ["_ratio", "_rank"], {"_caps": "_cap", "_weights": "_weight"}))
    whole = tried.agg(F.sum("source_size").alias("words"), F.sum("_weight").alias("weight")).first()
    if whole["words"] is None:
        return tried.select("source", "_rank", "source_size", F.lit(0.0).alias("target"))
    level = (F.lit(whole["words"]) * share - F.col("_caps")) / (F.lit(whole["weight"]) - F.col("_weights"))
    holds = tried.withColumn("_level", level).where(F.col("_level") * F.col("_weight") <= F.col("_cap"))
    found = holds.agg(F.min(F.struct("_ratio", "_rank", "_level"))["_level"].alias("level")).first()["level"] or 0.0
    return tried.select("source", "_rank", "source_size", F.least(F.col("_cap").cast("double"), F.lit(found) * F.col("_weight")).alias("target"))


def row_hashes(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns, ``_h1`` and ``_h2``: only rows that are equal in every column share both."""
    kinds = dict(docs.dtypes)
    own = [F.map_entries(F.col(f"`{c}`")) if kinds[c].startswith("map<") else F.col(f"`{c}`") for c in docs.columns]
    nulls = [c.isNull() for c in own]  # a null doesn't change a hash by itself
    return [F.xxhash64(F.lit(seed), *nulls, *own).alias(f"_h{seed}") for seed in (1, 2)]


def curriculum(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, slopes: Sequence[float] = (0.5, 0.0, -0.5)) -> DataFrame:
    """Places every document on the training timeline, from 0 to 1.

    A source's weight at time t is its target times 1 + slope * (2t - 1): with a positive slope
    it grows, with a negative one it fades. Its integral up to t is the source's demand,
    target * (t + slope * (t^2 - t)). The source's documents wait in the order of
    md5(doc_id), again and again; a document comes up when the demand reaches the words before
    it, so inverting the integral there gives its position.

    Returns doc_id, source, size, source_size, target, taken and passes, an array of
    (pass, start, words, position) with one entry for each time that the document comes up.
    ``words`` is less than the size where the source's demand ends inside the document.
    docs: any columns, of which doc_id, source and text are used. Null and blank texts have
    size 0 and are never taken; a null source is a source; repeated rows are separate documents;
    an empty table gives an empty result. A hot source is split over many tasks.
    """
    sizes = durable(docs.select("doc_id", "source", word_count().alias("size"), *row_hashes(docs)))
    targets = durable(source_targets(sizes, weights, share, most))
    side = F.broadcast(targets) if targets.count() <= MAX_BROADCAST_SOURCES else targets
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (F.col("_rank") % len(slopes) + 1).cast("int"))
    rows = sizes.join(side.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_slope", slope)
    rows = rows.withColumn("_turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    placed = running_sums(rows, ["_turn", "_h1", "_h2"], {"_before": "size"}, within="_rank")

    def one(p: int) -> Column:
        start = F.col("_before") + p * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target")) - start)).cast("long")
        y, a = start / F.col("target"), F.col("_slope")
        position = 2 * y / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * y))
        return F.when(words > 0, F.struct(F.lit(p).alias("pass"), start.alias("start"), words.alias("words"), position.alias("position")))

    passes = F.array_compact(F.array(*[one(p) for p in range(most)]))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return placed.withColumn("passes", passes).withColumn("taken", taken).select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "_h1", "_h2")


def training_order(docs: DataFrame, **schedule) -> DataFrame:
    """The mix itself: docs' own rows, each as often as it comes up, sorted by position over the partitions.

    A document comes up whole where the demand covers at least half of its words, or not at all.
    The columns are docs' own, whatever their names. Rows that differ in any column are separate
    documents, also with null or equal doc_ids; of n rows that are equal in all columns each has
    its own positions. Null and empty texts never come up; very long texts are moved whole; an
    empty table gives an empty result. See curriculum() for ties.
    """
    passes = curriculum(docs, **schedule).select("_h1", "_h2", "size", "doc_id", F.explode("passes").alias("_p")).where(2 * F.col("_p.words") >= F.col("size"))
    passes = passes.select("_h1", "_h2", F.col("doc_id").alias("_id"), F.col("_p.position").alias("_position"))
    # One row for all that are equal: their positions are separate rows of passes.
    rows = docs.select(*row_hashes(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).dropDuplicates(["_h1", "_h2"])
    joined = rows.join(passes, ["_h1", "_h2"])
    ordered = joined.repartitionByRange(partitions(docs.sparkSession), "_position", "_id").sortWithinPartitions("_position", "_id", "_h1")
    return ordered.select("_row.*")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and the document's first position (null: not taken), in training order."""
    plan = curriculum(docs)
    first = F.round(F.try_element_at("passes", F.lit(1))["position"], 6)
    out = plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"))
    return out.repartitionByRange(partitions(docs.sparkSession), "position", "doc_id").sortWithinPartitions("position", "doc_id")
