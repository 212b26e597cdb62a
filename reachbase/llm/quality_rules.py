"""Quality rules: histograms of a document against those of its language, by Jensen-Shannon distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.llm.cluster import by_small_batches, durable
from reachbase.llm.textblock import TextBlock, blocks, mix, windows

#: Classes of code points: all above 127 make one.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "wide")
SYMBOLS = "#*$%&|<>"
#: Words of a language's histogram, its most frequent ones; the others share one more bin.
COMMON_WORDS = 20
#: A histogram of fewer code points or words is too rough to be judged.
MIN_CHARS, MIN_WORDS = 200, 50
#: Class distance (0 to 1) above which a document is rejected.
MAX_CLASS_DISTANCE = 0.2
#: A document's word distance may exceed the median of its language's sound documents of like length by so many times the
#: way from their median to their upper quartile (about four standard deviations; rejects among them hardly move it), where
#: there are MIN_REFERENCES of these, else that of all the language's sound documents, where there are so many.
WORD_SPREADS, MIN_REFERENCES = 6, 100
#: Numbers of words from which documents count as longer: short texts' histograms are rougher.
LENGTHS = (100, 200, 400, 800, 1600)
#: Share of symbols among its words' code points up to which a document counts for its language's reference.
MAX_REFERENCE_SYMBOLS = 0.01
#: Rows of references or limits that a broadcast may hold; more are joined by a shuffle.
MAX_BROADCAST_LANGUAGES = 10_000
#: Distinct words that a task counts before it hands them on.
WORDS_HELD = 200_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_REFERENCE = "_classes array<double>, _common array<string>, _shares array<double>"


def _class_table() -> np.ndarray:
    out = np.full(256, CLASSES.index("other"), np.int64)
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", [32, *range(9, 14)]), ("stop", b".,;:!?'\"-()"), ("symbol", SYMBOLS.encode()), ("wide", range(128, 256))):
        out[list(chars)] = CLASSES.index(name)
    return out


def _per_document(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return prefix[ends] - prefix[starts]


def _running(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def measure(block: TextBlock, classes: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document of a block."""
    n, docs = len(block), np.arange(len(block))
    start, end, bounds = block.words()
    n_words = np.diff(bounds)
    points = block.code_points()
    chars = _running(points[end] - points[start])
    lead = (block.data & 0xC0) != 0x80
    doc_of = np.repeat(docs, block.doc_end - block.doc_start)
    by_class = np.bincount((doc_of * len(CLASSES) + classes[block.data])[lead], minlength=n * len(CLASSES)).reshape(n, -1)
    of_word = np.repeat(docs, n_words)

    begin, stop, of_line = block.lines()
    has_word = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop, of_line = begin[has_word], stop[has_word], of_line[has_word]
    again = ~_first_of(mix(block.hashes(begin, stop) ^ mix(of_line.astype(np.uint64))))
    dup_lines = np.bincount(of_line[again], minlength=n)

    repeat = np.zeros(n, np.int64)
    made, at = windows(block.hashes(start, end), bounds, 3)
    of_window = np.repeat(docs, np.diff(at))
    place = np.arange(len(made)) + np.repeat(bounds[:-1] - at[:-1], np.diff(at))
    whole = (n_words >= 3)[of_window]
    made, of_window, place = made[whole], of_window[whole], place[whole]
    if len(made):
        twice = place[_repeated(mix(made ^ mix(of_window.astype(np.uint64))))]
        covered = np.zeros(len(start), bool)
        for j in range(3):
            covered[twice + j] = True
        repeat = np.bincount(of_word[covered], minlength=n)
    symbols = by_class[:, CLASSES.index("symbol")]
    return {"n_words": n_words, "word_chars": _per_document(chars, bounds[:-1], bounds[1:]), "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat, "classes": by_class}


def _first_of(keys: np.ndarray) -> np.ndarray:
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def _repeated(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _is_sound(n_words, n_repeat_words, n_symbols, word_chars):
    return ~_failed(n_words, n_repeat_words) & (n_symbols <= MAX_REFERENCE_SYMBOLS * word_chars)


def _lowered(block: TextBlock) -> tuple[TextBlock, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block in lower case, its words' starts, ends and hashes, and the document of each."""
    low = TextBlock(block.data, block.doc_start, block.doc_end, lower=True)
    start, end, bounds = low.words()
    return low, start, end, low.hashes(start, end), np.repeat(np.arange(len(block)), np.diff(bounds))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each class (kind 0) and word (kind 1) stands in the sound documents of a language."""
    classes = _class_table()
    held: dict[tuple[str | None, int, bytes], int] = {}

    def handed_on() -> pa.RecordBatch:
        langs, kinds, names = zip(*held, strict=True)
        columns = [pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array([x.decode() for x in names], pa.string()), pa.array(list(held.values()), pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["lang", "kind", "name", "n"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for part, block in blocks(batch.column("text")):
            got = measure(block, classes)
            sound = _is_sound(*(got[k] for k in ("n_words", "n_repeat_words", "n_symbols", "word_chars")))
            own = langs[part]
            low, start, end, hashes, of_word = _lowered(block)
            for lang in {x for x, ok in zip(own, sound, strict=True) if ok}:
                mine = sound & np.array([x == lang for x in own])
                for name, n in zip(CLASSES, got["classes"][mine].sum(0).tolist(), strict=True):
                    key = (lang, 0, name.encode())
                    held[key] = held.get(key, 0) + n
                words = np.flatnonzero(mine[of_word])
                _, first, times = np.unique(hashes[words], return_index=True, return_counts=True)
                at = words[first]
                for a, b, n in zip(start[at].tolist(), end[at].tolist(), times.tolist(), strict=True):
                    key = (lang, 1, low.data[a:b].tobytes())
                    held[key] = held.get(key, 0) + n
            if len(held) >= WORDS_HELD:
                yield handed_on()
    if held:
        yield handed_on()


def references(docs: DataFrame) -> DataFrame:
    """_lang, and the shares of classes, the most frequent words and their shares (the last of all others) in its sound documents.

    Words are counted over all documents; ties go to the first by code point.
    """
    counts = by_small_batches(docs).select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(_count_batches, "lang string, kind int, name string, n long")
    summed = durable(counts.groupBy("lang", "kind", "name").agg(F.sum("n").alias("n")))
    # The filter on the rank keeps a few rows of each task before they move.
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "name")
    top = summed.where("kind = 1").withColumn("place", F.row_number().over(by_count)).where(F.col("place") <= COMMON_WORDS)
    common = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "name", "n"))).alias("top"))
    totals = summed.groupBy("lang").agg(*[F.sum(F.when((F.col("kind") == 0) & (F.col("name") == c), F.col("n")).otherwise(0)).alias(c) for c in CLASSES], F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("words"))
    joined = totals.withColumnRenamed("lang", "_lang").join(common, F.col("_lang").eqNullSafe(F.col("lang")))
    points = sum(F.col(c) for c in CLASSES)
    counted = F.transform("top", lambda t: t["n"])
    rest = F.col("words") - F.aggregate(counted, F.lit(0).cast("long"), lambda s, x: s + x)
    shares = F.transform(F.concat(counted, F.array(rest)), lambda x: x / F.col("words"))
    return joined.select("_lang", F.array(*[F.col(c) / points for c in CLASSES]).alias("_classes"), F.transform("top", lambda t: t["name"]).alias("_common"), shares.alias("_shares"))


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of each row of counts from the shares q."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / middle), 0) + np.where(q > 0, q * np.log2(q / middle), 0)
    return np.sqrt(np.maximum(0.0, parts.sum(1) / 2))


def _rate_batches(kept: list[str]):
    """For mapInArrow over _row and a reference: the row's fields, its counts and its distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _class_table()
        for batch in batches:
            rows = batch.column("_row")
            fields = [rows.field(rows.type.get_field_index(c)) for c in kept]
            langs = rows.field(rows.type.get_field_index("lang")).cast(pa.string()).to_pylist()
            refs = [batch.column(c) for c in ("_classes", "_common", "_shares")]
            for part, block in blocks(rows.field(rows.type.get_field_index("text"))):
                got = measure(block, classes)
                by_class = got.pop("classes")
                class_distance, word_distance = np.full(len(block), np.nan), np.full(len(block), np.nan)
                own = langs[part]
                _, _, _, hashes, of_word = _lowered(block)
                for lang in set(own):
                    mine = np.array([x == lang for x in own])
                    at = part.start + int(np.argmax(mine))
                    if not refs[0][at].is_valid:
                        continue
                    of_classes, common, of_words = (np.array(c[at].as_py()) for c in refs)
                    class_distance[mine] = _distances(by_class[mine], of_classes)
                    lexicon = np.array([_hash_word(w) for w in common], np.uint64)
                    rank = np.argsort(lexicon)
                    words = np.flatnonzero(mine[of_word])
                    found = np.minimum(np.searchsorted(lexicon[rank], hashes[words]), len(lexicon) - 1)
                    bins = np.where(lexicon[rank][found] == hashes[words], rank[found], len(lexicon))
                    width = len(lexicon) + 1
                    grid = np.bincount(of_word[words] * width + bins, minlength=len(block) * width).reshape(-1, width)
                    word_distance[mine] = _distances(grid[mine], of_words)
                class_distance[by_class.sum(1) < MIN_CHARS] = np.nan
                word_distance[got["n_words"] < MIN_WORDS] = np.nan
                size = part.stop - part.start
                columns = [*(f.slice(part.start, size) for f in fields), *(pa.array(got[k].astype(np.int64)) for k in _COUNTS), *(pa.array(np.round(d, 6), from_pandas=True) for d in (class_distance, word_distance))]
                row = pa.StructArray.from_arrays(columns[: len(kept)], names=kept)
                yield pa.RecordBatch.from_arrays([row, *columns[len(kept) :]], ["_row", *_COUNTS, "class_distance", "word_distance"])

    return run


def _hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    block = TextBlock(raw, np.array([0]), np.array([len(raw)]))
    return block.hashes(block.doc_start, block.doc_end)[0]


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_LANGUAGES else table


def _rated(docs: DataFrame, refs: DataFrame, kept: list[str]) -> DataFrame:
    """_row (the columns of docs named in kept), counts and distances of every row; refs hold a row for each language."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rows = by_small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = rows.join(refs, F.col("_row.lang").cast("string").eqNullSafe(F.col("_lang")), "left")
    fields = ", ".join(f"`{c}`: {kinds[c]}" for c in kept)
    schema = f"_row struct<{fields}>, {', '.join(f'{c} long' for c in _COUNTS)}, class_distance double, word_distance double"
    return joined.select("_row", "_classes", "_common", "_shares").mapInArrow(_rate_batches(kept), schema)


def _length() -> Column:
    return sum((F.col("n_words") >= n).cast("int") for n in LENGTHS)


def limits(rated: DataFrame) -> DataFrame:
    """_of, _length and word_limit: for each language and length from its sound documents, and with a null length from all."""
    sound = rated.where(_is_sound(*(F.col(c) for c in ("n_words", "n_repeat_words", "n_symbols", "word_chars")))).where("word_distance is not null")
    each = sound.select("lang", F.explode(F.array(_length(), F.lit(None).cast("int"))).alias("_length"), "word_distance")
    # Distances have six decimals, so exact quantiles count a bounded number of values.
    quantiles = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY word_distance)").alias(c) for q, c in ((0.5, "middle"), (0.75, "upper"))]
    found = each.groupBy("lang", "_length").agg(F.count("*").alias("n"), *quantiles).where(F.col("n") >= MIN_REFERENCES)
    limit = F.round(F.col("middle") + WORD_SPREADS * (F.col("upper") - F.col("middle")), 6)
    return found.select(F.col("lang").alias("_of"), "_length", limit.alias("word_limit"))


def _decided(rated: DataFrame, found: DataFrame) -> DataFrame:
    """rated (with lang) and its word_limit, base_failed and kept."""
    of_length = _small(found.where("_length is not null"))
    of_all = _small(found.where("_length is null").select(F.col("_of").alias("_of_all"), F.col("word_limit").alias("_limit_of_all")))
    with_length = rated.withColumn("_own", _length())
    joined = with_length.join(of_length, F.col("lang").eqNullSafe(F.col("_of")) & (F.col("_own") == F.col("_length")), "left").join(of_all, F.col("lang").eqNullSafe(F.col("_of_all")), "left")
    limit = F.coalesce("word_limit", "_limit_of_all")
    near = F.coalesce(F.col("class_distance") <= MAX_CLASS_DISTANCE, F.lit(True)) & F.coalesce(F.col("word_distance") <= limit, F.lit(True))
    failed = _failed(F.col("n_words"), F.col("n_repeat_words"))
    return joined.withColumn("word_limit", limit).withColumn("base_failed", failed).withColumn("kept", ~failed & near)


def _studied(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The references, the ratings of all documents with doc_id and lang, and the limits."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    refs = _small(durable(references(narrow)))
    rated = durable(_rated(narrow, refs, ["doc_id", "lang"]).select("_row.*", *_COUNTS, "class_distance", "word_distance"))
    return refs, rated, durable(limits(rated))


def judge(docs: DataFrame) -> DataFrame:
    """Judges every document by fixed rules and by its distance from its language.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, class_distance, word_distance and word_limit. A document fails the base rules with
    under 50 words or more than half of its words in repeated 3-word windows. A language's
    references are counted in its sound documents (all that pass the base rules with few
    symbols): code points by class, and its COMMON_WORDS most frequent words against all others.
    A language without such documents has no reference, and its documents no distances. A
    document is kept if it passes the base rules and neither distance is above its limit:
    MAX_CLASS_DISTANCE, and word_limit, which limits() takes from the language's sound
    documents; a histogram under MIN_CHARS or MIN_WORDS isn't judged, and its distance is null;
    word_limit is null where too few documents tell.

    docs: doc_id, text, lang; other columns are ignored. Null texts count as empty (not kept); a
    null lang is one more language; repeated rows get a row each; very long texts are counted
    whole; an empty table gives an empty result.
    """
    _, rated, found = _studied(docs)
    return _decided(rated, found).select("doc_id", *_COUNTS, "base_failed", "kept", "class_distance", "word_distance", "word_limit")


def keep(docs: DataFrame) -> DataFrame:
    """docs' rows that judge() keeps, with their columns, whatever their names; each row is judged by itself.

    Null and equal doc_ids don't matter. Null and empty texts go; an empty table gives an empty one.
    """
    refs, _, found = _studied(docs)
    rated = _rated(docs, refs, docs.columns).withColumn("lang", F.col("_row.lang").cast("string"))
    return _decided(rated, found).where("kept").select("_row.*")
