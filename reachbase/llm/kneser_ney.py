"""Quality by perplexity: an interpolated modified Kneser-Ney trigram model, counted and met in passes.

The model follows Chen and Goodman, "An Empirical Study of Smoothing Techniques for Language
Modeling" (1998). N-grams are 64-bit hashes. A text's log probability is a sum with a term for
each n-gram and each history that the model knows: what the n-gram adds to the estimate of its
shorter form, and the weight that its history leaves to that form.

There are two models, one for each half of the trusted documents: a key's lowest bit says whose
it is. Each document is scored by the half that it isn't in, so no text meets a model that has
learned it, and perplexities of all documents mean the same.

A trigram, its shorter form and both histories hold its middle word, so a pass takes the
trigrams of a share of the middle words: it counts them, makes their terms, and brings these
terms and the documents' n-grams together. The whole model never stands on disk. Between tasks
n-grams move as packed arrays: a row holds what one task has for one part of the keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.llm.cluster import by_small_batches, durable, folder, partitions, removed, stored
from reachbase.llm.key_filter import MIN_BITS, KeyFilter, bits_for
from reachbase.llm.textblock import TextBlock, blocks, mix
from reachbase.operators.graph import shuffles_dropped

#: Rows of a table up to which it is broadcast; a larger one is joined by a shuffle.
MAX_BROADCAST_ROWS = 3_000_000
#: Words, the most frequent ones, whose terms all tasks hold; terms of other words are dealt out with the n-grams.
MAX_COMMON_WORDS = 200_000
#: Most passes, and words for each, over all texts (scores) and over the trusted ones (counts).
PASSES, COUNT_PASSES, WORDS_PER_PASS = 12, 4, 3_000_000
#: Words of a pass whose terms all tasks hold as histories; for more words there are more passes.
MAX_HISTORIES = 4_000_000
#: Quantile of a language's trusted perplexities up to which documents are kept.
HIGH = 0.995
#: Documents with fewer words aren't judged.
MIN_WORDS = 10

_U = np.uint64
_START = _U(0x5851F42D4C957F2D)
_FOLD = _U(0xD6E8FEB86659FD93)
#: What tells a word's whole term, its term without that as a history, and a history of two words from other keys.
_WORD, _LAST, _LEFT = _U(0x2545F4914F6CDD1D), _U(0x9FB21C651E98DF25), _U(0xA0761D6478BD642F)
_BLOCK_BYTES = 1 << 18
#: Entries and documents that a task gathers before it deals them out.
_GATHERED, _MAX_DOCS = 2_000_000, 60_000
#: A packed row: for which part, what it holds, of which batch of documents, and its arrays.
_PACKED = "part int, kind int, batch long, keys binary, more binary"
_PACKED_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])
_RARE, _TERMS, _GRAMS, _DOCS = range(4)
_COUNTS = ("n", "followed", "n1", "n2", "n3")


def _of_half(keys: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Keys of one of the two models: its number stands in the lowest bit."""
    return (keys & _U(0xFFFFFFFFFFFFFFFE)) | (half & _U(1))


#: The key of a text's start in either model.
_STARTS = _of_half(mix(np.array([_START, _START ^ _FOLD])), np.arange(2, dtype=_U))


def _then(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams by what stands before the last word, and that word."""
    return _of_half(mix(first * _FOLD + word), word)


def _share(keys: np.ndarray, n: int, bits: int = 32) -> np.ndarray:
    """Of each key one of n shares, by its bits from ``bits`` on."""
    return ((keys >> _U(bits) & _U(0x7FFFFFFF)) * _U(n) >> _U(31)).astype(np.int64)


def _trigrams(block: TextBlock, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's document, the two words before it and itself, as keys for each document's model; and the last word of each text that has words."""
    start, end, bounds = block.words()
    counts = np.diff(bounds)
    of_word = np.repeat(half.astype(_U), counts)
    word = _of_half(mix(block.hashes(start, end) ^ of_word * _FOLD), of_word)
    place = np.arange(len(word)) - np.repeat(bounds[:-1], counts)
    starts = _STARTS[of_word.astype(np.int64)]
    one, two = (np.where(place >= back, np.roll(word, back), starts) for back in (1, 2))
    return np.repeat(np.arange(len(block)), counts), two, one, word, bounds[1:][counts > 0] - 1


def _packed(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED_SCHEMA, strict=True)], schema=_PACKED_SCHEMA)


def _dealt(by: np.ndarray, parts: int, kind: int, batch: int, keys: Sequence[np.ndarray], more: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Packed rows of the arrays, dealt to parts by a key; each row's entries are in the order of that key."""
    order = np.argsort(by)
    keys, more = [x[order] for x in keys], [x[order] for x in more]
    cuts = np.searchsorted(_share(by[order], parts, 33), np.arange(parts + 1))
    for part in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[part], cuts[part + 1])
        yield _packed([(int(part), kind, batch, b"".join(x[own].tobytes() for x in keys), b"".join(x[own].tobytes() for x in more))])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(f.name).to_pylist() for f in _PACKED_SCHEMA), strict=True)


def _joined(rows: list[tuple[bytes, bytes]], n_keys: int, kinds: Sequence[type]) -> list[np.ndarray]:
    """The arrays of packed rows, put together: n_keys of keys, then one of each kind."""
    out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in [*[_U] * n_keys, *kinds]]
    for keys, more in rows:
        n, at = len(keys) // 8 // n_keys, 0
        for i, x in enumerate(np.frombuffer(keys, _U).reshape(n_keys, n)):
            out[i].append(x)
        for i, kind in enumerate(kinds):
            out[n_keys + i].append(np.frombuffer(more, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) for x in out]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _find(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key whether it is among sorted ones, and its place there."""
    if not len(among):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys, at


def half_of(doc_id: Column) -> Column:
    """0 or 1 by a hash of the id; a null id is in half 0."""
    return F.coalesce(F.crc32(F.concat(F.lit("train"), doc_id.cast("string")).cast("binary")).bitwiseAND(F.lit(1)).cast("int"), F.lit(0))


def _rows(docs: DataFrame) -> DataFrame:
    """row (a hash of the next three), doc_id, lang, text, and the model that scores it, of which its half is no part."""
    doc_id, lang = F.col("doc_id").cast("long"), F.col("lang").cast("string")
    row = F.xxhash64(doc_id.isNull(), lang.isNull(), F.col("text").isNull(), doc_id, lang, "text")
    return by_small_batches(docs).select(row.alias("row"), doc_id.alias("doc_id"), lang.alias("lang"), "text", (1 - half_of(doc_id)).alias("model"))


def _small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """The table, broadcast if it has up to MAX_BROADCAST_ROWS rows (counted unless a bound is given)."""
    return F.broadcast(table) if (table.count() if rows is None else rows) <= MAX_BROADCAST_ROWS else table


Discounts = list[tuple[float, float, float]]


class Model(NamedTuple):
    """The trusted rows (text, model), what all passes share, and words by key.

    words: n, how many words it continues; p_uni; as a history followed, and the share left to
    shorter forms (null if it is none); and its term. common: those that continue most, by key.
    unseen: what either half's model gives a word that it doesn't know; null for a half without words.
    """

    rows: DataFrame
    words: DataFrame
    n_words: int
    common: tuple[np.ndarray, np.ndarray, np.ndarray]
    discounts: tuple[Discounts, Discounts]
    unseen: tuple[float | None, float | None]


def _half(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit(1)).cast("int")


def discounts(counts: dict[int, Sequence[int]]) -> Discounts:
    """For either half the discounts of n-grams seen once, twice and more often, from the counts of counts."""

    def of(half: int) -> tuple[float, float, float]:
        n1, n2, n3, n4 = counts.get(half, (0, 0, 0, 0))
        if not (n1 and n2 and n3):
            return 0.5, 0.75, 0.9  # too little text for the estimate
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))

    return [of(0), of(1)]


def _by_half(key: str | Column, values: Sequence[float | None]) -> Column:
    half = _half(key) if isinstance(key, str) else key
    return F.when(half == 0, F.lit(values[0])).otherwise(F.lit(values[1])).cast("double")


def _freed_of(key: str, n: str, d: Discounts) -> Column:
    one, two, more = (_by_half(key, [half[i] for half in d]) for i in range(3))
    return F.when(F.col(n) == 1, one).when(F.col(n) == 2, two).otherwise(more)


def _discount(n: np.ndarray, keys: np.ndarray, d: Discounts) -> np.ndarray:
    """What is taken from each count."""
    return np.array(d)[(keys & _U(1)).astype(np.int64), np.minimum(n, 3).astype(np.int64) - 1]


def _deal_trigrams(passes: int, at: int, parts: int, common: np.ndarray | None):
    """For mapInArrow: the pass's trigrams and their counts, by their last two words, or by the last one where it isn't common."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            a, b, c = (np.concatenate(x) for x in zip(*held, strict=True))
            _, first, counts = np.unique(_then(_then(a, b), c), return_index=True, return_counts=True)
            a, b, c = a[first], b[first], c[first]
            by = _then(b, c) if common is None else np.where(_find(c, common)[0], _then(b, c), mix(c))
            yield from _dealt(by, parts, _GRAMS, 0, [a, b, c], [counts.astype(np.int32)])

        for batch in batches:
            halves = batch.column("model").to_numpy(zero_copy_only=False)
            for part, block in blocks(batch.column("text"), True, _BLOCK_BYTES):
                _, a, b, c, _ = _trigrams(block, halves[part])
                own = _share(b, passes, 1) == at
                held.append((a[own], b[own], c[own]))
                n += len(held[-1][0])
                if n >= _GATHERED:
                    yield from out()
                    held, n = [], 0
        if n:
            yield from out()

    return deal


def _counted(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, ...]:
    """Distinct trigrams of packed rows (a, b, c, n), and of each bigram its first trigram and its count: words that it continues, or how often it starts texts."""
    a, b, c, n = _joined(rows, 3, [np.int32])
    order = np.lexsort((a, c, b))
    a, b, c, n = a[order], b[order], c[order], n[order].astype(np.int64)
    first = _firsts(a, b, c)
    a, b, c, n = a[first], b[first], c[first], _sums(n, first)
    pairs = _firsts(b, c)
    return a, b, c, n, pairs, _sums(np.where(np.isin(b, _STARTS), n, 1), pairs)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: what dealt trigrams say of words (kind 0), and how many trigrams (3) and bigrams (2) of either half have each count up to four."""
    a, b, c, n, pairs, cont = _counted([(k, m) for _, _, _, k, m in _unpacked(batches)])
    if not len(a):
        return
    b, last = b[pairs], c[pairs]
    key = np.concatenate([b, last])
    one = np.ones(len(b), np.int64)
    values = [np.concatenate([0 * one, one]), *(np.concatenate([x.astype(np.int64), 0 * one]) for x in (cont, cont == 1, cont == 2, cont > 2))]
    order = np.argsort(key)
    first = _firsts(key[order])
    columns = [np.zeros(len(first), np.int32), key[order][first].view(np.int64), *(_sums(v[order], first) for v in values)]
    for kind, counts, of in ((3, n, c), (2, cont, b)):
        for half in (0, 1):
            seen = [int(((of & _U(1) == half) & (counts == i)).sum()) for i in (1, 2, 3, 4)]
            columns = [np.append(x, v).astype(x.dtype) for x, v in zip(columns, (kind, half, *seen, 0), strict=True)]
    names = ["kind", "key", *_COUNTS]
    for at in range(0, len(columns[0]), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65_536]) for x in columns], names)


def _met(packed: DataFrame) -> DataFrame:
    """Packed rows in the partitions of their parts, what is looked up before what looks it up."""
    return packed.repartitionById(partitions(packed.sparkSession), "part").sortWithinPartitions("kind")


def _n_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: n_words instead of the text, which comes last."""
    for batch in batches:
        n = [np.diff(block.words()[2]) for _, block in blocks(batch.column("text"), True, _BLOCK_BYTES)]
        count = pa.array(np.concatenate(n) if n else np.zeros(0), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], count], [*batch.schema.names[:-1], "n_words"])


def train(docs: DataFrame) -> Model | None:
    """The models of docs' texts, each document for its own half; n-grams' terms are made in each pass anew.

    Trigrams are counted; bigrams and words by the words that they continue, but a bigram that
    starts a text continues none and keeps its count.
    """
    rows = by_small_batches(docs).select(half_of(F.col("doc_id")).alias("model"), "text")
    spark = docs.sparkSession
    n = rows.mapInArrow(_n_words, "model int, n_words long").agg(F.sum("n_words")).first()[0]
    if not n:
        return None
    passes = min(COUNT_PASSES, -(-n // WORDS_PER_PASS))
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    path = folder(spark, "words")
    for at in range(passes):
        dealt = _met(rows.mapInArrow(_deal_trigrams(passes, at, partitions(spark), None), _PACKED))
        said = dealt.mapInArrow(_count_words, "kind int, key long, " + ", ".join(f"{c} long" for c in _COUNTS))
        with shuffles_dropped(spark):
            said.groupBy("kind", "key").agg(*sums).write.parquet(f"{path}/pass={at}")
    counts = stored(spark.read.parquet(path).groupBy("kind", "key").agg(*sums))
    removed(spark, path)
    of = {(r["kind"], r["key"]): r[2:6] for r in counts.where("kind > 0").collect()}
    d3, d2 = (discounts({h: of[k, h] for h in (0, 1) if (k, h) in of}) for k in (3, 2))
    words = counts.where("kind = 0")
    uni = words.where("n > 0").groupBy(_half("key").alias("half"))
    totals = {r["half"]: r for r in uni.agg(F.count("*").alias("words"), F.sum("n").alias("total"), *[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()}
    d1 = discounts({h: [r[f"n{i}"] for i in (1, 2, 3, 4)] for h, r in totals.items()})
    # Words seen three times or more, by subtraction.
    freed = {h: d1[h][0] * r["n1"] + d1[h][1] * r["n2"] + d1[h][2] * (r["words"] - r["n1"] - r["n2"]) for h, r in totals.items()}
    unseen = tuple(freed[h] / totals[h]["total"] / (totals[h]["words"] + 1) if h in totals else None for h in (0, 1))
    total = _by_half("key", [float(totals[h]["total"]) if h in totals else None for h in (0, 1)])
    p_uni = F.when(F.col("n") > 0, (F.col("n") - _freed_of("key", "n", d1)) / total + _by_half("key", unseen))
    left = F.when(F.col("followed") > 0, sum(F.col(f"n{i + 1}") * _by_half("key", [half[i] for half in d2]) for i in range(3)) / F.col("followed"))
    gain = F.coalesce(F.log(F.col("p_uni") / _by_half("key", unseen)), F.lit(0.0))
    # The columns follow from the counts, so they are made where they are read.
    table = words.select("key", "n", p_uni.alias("p_uni"), "followed", left.alias("left")).select("*", gain.alias("gain"), (gain + F.coalesce(F.log("left"), F.lit(0.0))).alias("term"))
    limit, least = min(MAX_COMMON_WORDS, MAX_BROADCAST_ROWS), None
    sizes, taken = table.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect(), 0
    for r in sizes:
        taken += r["words"]
        if taken > limit:
            break
        least = r["n"]
    table = table.withColumn("common", F.lit(False) if least is None else F.col("n") >= least)
    got = table.where("common").select("key", F.coalesce("p_uni", F.lit(0.0)).alias("p_uni"), "term").toArrow()
    return Model(rows, table, sum(r["words"] for r in sizes), _sorted_by_key(got), (d2, d3), unseen)


def _sorted_by_key(table: pa.Table) -> tuple[np.ndarray, ...]:
    key, *rest = (c.to_numpy() for c in table.columns)
    order = np.argsort(key.view(_U))
    return key.view(_U)[order], *(x[order] for x in rest)


def _of_pass(key: str, passes: int, at: int) -> Column:
    """As _share(key, passes, 1) == at."""
    return F.shiftright(F.shiftrightunsigned(key, 1).bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(passes).cast("long"), 31) == at


def _deal_words(parts: int, kind: int, *tags: int | None):
    """For mapInArrow: rows of key and a value for each tag, packed under the tagged key; without a tag under the word's own."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for tag, value in zip(tags, values, strict=True):
                name = key.view(_U) if tag is None else mix(key.view(_U) ^ _U(tag))
                yield from _dealt(mix(name) if tag is None else name, parts, kind, 0, [name], [value])

    return deal


def _bigram_terms(common, histories, d2: Discounts, parts: int):
    """For mapInArrow: bigrams' terms, and the trigrams with their bigrams' probabilities, dealt by the trigrams' histories."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, grams = [], []
        for _, kind, _, keys, more in _unpacked(batches):
            (rare if kind == _RARE else grams).append((keys, more))
        a, b, c, n, pairs, cont = _counted(grams)
        if not len(a):
            return
        word, p_rare = _joined(rare, 1, [np.float64])
        order = np.argsort(word)
        word, p_rare = word[order], p_rare[order]
        first, last = b[pairs], c[pairs]
        (known, p_known, _), (history, followed, left) = common.value, histories.value
        is_known, at = _find(last, known)
        p_uni = np.empty(len(last))
        p_uni[is_known] = p_known[at[is_known]]
        found, at = _find(last[~is_known], word)
        p_uni[~is_known] = p_rare[at]
        there, at = _find(first, history)
        if not (found.all() and there.all()):
            raise ValueError("the trusted documents have other words than when they were counted")
        shorter = left[at] * p_uni
        p_bi = (cont - _discount(cont, last, d2)) / followed[at] + shorter
        pair = _then(first, last)
        yield from _dealt(pair, parts, _TERMS, 0, [pair], [np.log(p_bi / shorter)])
        before = _then(a, b)
        p_bi = np.repeat(p_bi, np.diff(np.append(pairs, len(a))))
        yield from _dealt(before, parts, _GRAMS, 0, [before, _then(before, c)], [n.astype(np.int32), p_bi])

    return terms


def _trigram_terms(d3: Discounts, parts: int):
    """For mapInArrow: terms of dealt trigrams and of their histories; bigrams' terms go on as they are."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = []
        for row in _unpacked(batches):
            if row[1] == _TERMS:
                yield _packed([row])
            else:
                grams.append(row[3:])
        before, tri, n, p_bi = _joined(grams, 2, [np.int32, np.float64])
        if not len(tri):
            return
        order = np.argsort(before)
        before, tri, n, p_bi = before[order], tri[order], n[order].astype(np.int64), p_bi[order]
        first, less = _firsts(before), _discount(n, before, d3)
        followed = _sums(n, first)
        left = _sums(less, first) / followed
        each = np.diff(np.append(first, len(tri)))
        own = (n - less) / np.repeat(followed, each)
        key = np.concatenate([mix(before[first] ^ _LEFT), tri])
        yield from _dealt(key, parts, _TERMS, 0, [key], [np.concatenate([np.log(left), np.log(own / (np.repeat(left, each) * p_bi) + 1)])])

    return terms


#: Bytes of a filter that go to the driver in one row.
_FILTER_SLICE = 1 << 20


def _filter_bits(bits: int):
    """For mapInArrow: slices of the filter of packed keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for _, _, _, keys, _ in _unpacked(batches):
            for half in (np.frombuffer(keys, _U), np.frombuffer(keys, _U) >> _U(32)):
                place = half & _U(bits - 1)
                np.bitwise_or.at(out, (place >> _U(3)).astype(np.int64), _U(1).astype(np.uint8) << (place & _U(7)).astype(np.uint8))
        for at in range(0, len(out), _FILTER_SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([at // _FILTER_SLICE], pa.int32()), pa.array([out[at : at + _FILTER_SLICE].tobytes()], pa.binary())], ["at", "bits"])

    return rows


def _any_of(table: pa.Table) -> pa.Table:
    held = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
    return pa.table({"at": table.column("at").slice(0, 1).cast(pa.int32()), "bits": pa.array([held.tobytes()], pa.binary())})


def _filter(terms: DataFrame) -> KeyFilter:
    """Which keys have terms; it lets a few others pass."""
    bits = bits_for(terms.agg(F.sum(F.length("keys"))).first()[0] // 8)
    with shuffles_dropped(terms.sparkSession):
        slices = terms.mapInArrow(_filter_bits(bits), "at int, bits binary").groupBy("at").applyInArrow(_any_of, "at int, bits binary").collect()
    return KeyFilter(np.frombuffer(b"".join(bytes(r["bits"]) for r in sorted(slices)), _U))


def _deal_documents(passes: int, at: int, parts: int, common, known):
    """For mapInArrow: the pass's n-grams of documents, where they may have a term, and a row for each batch with its documents and what common words give them."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, _, terms = common.value
        number = TaskContext.get().partitionId() << 32
        ids, sums, keys, refs, n, docs = [], [], [], [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            key = np.concatenate(keys) if keys else np.zeros(0, _U)
            yield _packed([(number % parts, _DOCS, number, np.concatenate(ids).tobytes(), np.concatenate(sums).tobytes())])
            yield from _dealt(key, parts, _GRAMS, number, [key], [np.concatenate(refs) if refs else np.zeros(0, np.uint16)])

        for batch in batches:
            halves = batch.column("model").to_numpy(zero_copy_only=False)
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            for part, block in blocks(batch.column("text"), True, _BLOCK_BYTES):
                if docs and (n >= _GATHERED or docs + len(block) > _MAX_DOCS):
                    yield from out()
                    number, ids, sums, keys, refs, n, docs = number + 1, [], [], [], [], 0, 0
                doc, a, b, c, last = _trigrams(block, halves[part])
                ends, of_end = c[last], doc[last]
                own = _share(b, passes, 1) == at
                doc, a, b, c = doc[own], a[own], b[own], c[own]
                own = _share(ends, passes, 1) == at
                ends, of_end = ends[own], of_end[own]
                is_common, where = _find(b, words)
                ids.append(rows[part].astype(np.int64))
                sums.append(np.bincount(doc[is_common], terms[where[is_common]], len(block)))
                before = _then(a, b)
                key = np.concatenate([mix(b[~is_common] ^ _WORD), mix(before ^ _LEFT), _then(b, c), _then(before, c), mix(ends ^ _LAST)])
                ref = np.concatenate([doc[~is_common], doc, doc, doc, of_end])
                may = known.value.has(key)
                keys.append(key[may])
                refs.append((docs + ref[may]).astype(np.uint16))
                n, docs = n + len(keys[-1]), docs + len(block)
        if docs:
            yield from out()

    return deal


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: sums of terms by a batch's documents; a batch's own row goes on as it is."""
    terms, table = [], None
    for row in _unpacked(batches):
        _, kind, batch, keys, more = row
        if kind == _TERMS:
            terms.append((keys, more))
        elif kind == _DOCS:
            yield _packed([row])
        else:
            if table is None:
                key, value = _joined(terms, 1, [np.float64])
                order = np.argsort(key)
                table, terms = (key[order], value[order]), []
            there, at = _find(np.frombuffer(keys, _U), table[0])
            if there.any():
                refs = np.frombuffer(more, np.uint16)[there]
                yield _packed([(0, kind, batch, b"", np.bincount(refs, table[1][at[there]]).tobytes())])


def _add(table: pa.Table) -> pa.Table:
    """A batch's documents and the sums of their terms."""
    rows, out = None, None
    sums = []
    for kind, keys, more in zip(*(table.column(c).to_pylist() for c in ("kind", "keys", "more")), strict=True):
        if kind == _DOCS:
            rows, out = np.frombuffer(keys, np.int64), np.frombuffer(more, np.float64).copy()
        else:
            sums.append(np.frombuffer(more, np.float64))
    for x in sums:
        out[: len(x)] += x
    return pa.table({"row": pa.array(rows), "_log": pa.array(out)})


def _pass(rows: DataFrame, model: Model, common, rare: DataFrame, passes: int, at: int) -> DataFrame:
    """row and _log, the sum of the terms that one pass has for it."""
    spark, parts, (d2, d3) = rows.sparkSession, partitions(rows.sparkSession), model.discounts
    own = model.words.where(_of_pass("key", passes, at))
    context = spark.sparkContext
    histories = context.broadcast(_sorted_by_key(own.where("followed > 0").select("key", F.col("followed").cast("double"), "left").toArrow()))
    path = folder(spark, "terms")
    words = own.select("key", "term", "gain").mapInArrow(_deal_words(parts, _TERMS, int(_WORD), int(_LAST)), _PACKED)
    trigrams = model.rows.mapInArrow(_deal_trigrams(passes, at, parts, model.common[0]), _PACKED)
    bigrams = _met(rare.union(trigrams)).mapInArrow(_bigram_terms(common, histories, d2, parts), _PACKED)
    with shuffles_dropped(spark):
        _met(bigrams).mapInArrow(_trigram_terms(d3, parts), _PACKED).union(words).write.parquet(path)
    terms = spark.read.schema(_PACKED).parquet(path)
    known = context.broadcast(_filter(terms))
    grams = rows.select("row", "model", "text").mapInArrow(_deal_documents(passes, at, parts, common, known), _PACKED)
    summed = _met(terms.union(grams)).mapInArrow(_score, _PACKED)
    out = durable(summed.groupBy("batch").applyInArrow(_add, "row long, _log double"))
    removed(spark, path)
    histories.destroy()
    known.destroy()
    return out


def perplexities(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang, n_words and perplexity (null without words or model) of every row of docs, by the half that it isn't in.

    Each pass reads all texts and looks up the n-grams whose middle word is in its share, so
    what stands on disk at a time is a share of the n-grams. Rows that are equal in doc_id, lang
    and text are added up and divided again by how many they are.
    """
    rows = _rows(docs)
    sizes = durable(rows.select("row", "doc_id", "lang", "model", "text").mapInArrow(_n_words, "row long, doc_id long, lang string, model int, n_words long"))
    every = sizes.select("*", F.lit(1).cast("long").alias("_copies"), F.lit(0.0).alias("_log"))
    if model is not None:
        n = sizes.agg(F.sum("n_words")).first()[0] or 0
        passes = max(1, min(PASSES, -(-n // WORDS_PER_PASS)), -(-model.n_words // MAX_HISTORIES))
        common = docs.sparkSession.sparkContext.broadcast(model.common)
        rare = stored(model.words.where("n > 0 AND NOT common").select("key", "p_uni").mapInArrow(_deal_words(partitions(docs.sparkSession), _RARE, None), _PACKED))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("lang", "string"), ("model", "int"))]
        for at in range(passes):
            every = every.union(_pass(rows, model, common, rare, passes, at).select("row", *none, F.lit(0).cast("long"), F.lit(0).cast("long"), "_log"))
        common.destroy()
    sums = every.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "lang", "model")], *[F.sum(c).alias(c) for c in ("_copies", "n_words", "_log")])
    # Without a model of a half the logarithm is null.
    base = F.log(_by_half(F.col("model"), model.unseen)) if model else F.lit(None).cast("double")
    mean = F.when(F.col("n_words") > 0, F.col("_log") / F.col("n_words") + base)
    each = sums.select("doc_id", "lang", F.expr("n_words div _copies").alias("n_words"), F.round(F.exp(-mean), 4).alias("perplexity"), "_copies")
    return each.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).drop("_", "_copies")


def trusted_documents(labels: DataFrame) -> DataFrame:
    """doc_id of trusted labels (quality 1)."""
    return labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, perplexity, limit and kept for each row of docs.

    Two models learn from the halves of the trusted documents (labels with quality 1), so their
    counts grow with the labels, and each document is scored by the half that it isn't in. The
    trusted documents' perplexities give each language its limit, their quantile HIGH. A
    document is kept up to its language's limit (that of all languages where the language has no
    trusted document), or if it has under MIN_WORDS words, or if nothing is trusted at all.

    docs: doc_id, text, lang. Null texts count as empty; very long ones are read whole; a null
    lang is one more language; a null doc_id belongs to half 0 and is trusted by none; repeated
    rows get a row each; extra columns are ignored; an empty table gives an empty result.
    """
    trusted = durable(trusted_documents(labels))
    own = F.col("doc_id").cast("long") == F.col("_id")
    model = train(docs.select("doc_id", "text").join(_small(trusted.withColumnRenamed("doc_id", "_id")), own, "left_semi"))
    rated = durable(perplexities(docs, model))
    held = rated.where(f"n_words >= {MIN_WORDS} AND perplexity IS NOT NULL").join(_small(trusted), "doc_id", "left_semi")
    limit = F.percentile_approx("perplexity", HIGH, 1_000_000).alias("limit")
    by_lang = held.groupBy(F.col("lang").alias("_lang")).agg(limit)
    overall = held.agg(limit).first()["limit"]
    joined = rated.join(by_lang, rated["lang"].eqNullSafe(by_lang["_lang"]), "left").withColumn("limit", F.coalesce("limit", F.lit(overall).cast("double")))
    kept = F.coalesce((F.col("n_words") < MIN_WORDS) | (F.col("perplexity") <= F.col("limit")), F.lit(True))
    return joined.select("doc_id", rated["lang"], "n_words", "perplexity", "limit", kept.alias("kept"))
