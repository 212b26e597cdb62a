"""Collocations by sampling: a sample proposes frequent phrases, a full pass counts these and their border exactly.

The scheme is Toivonen's, "Sampling Large Databases for Association Rules" (1996), for runs of
words. What is frequent in the sample, at a lowered threshold, is proposed. The negative border
holds what isn't proposed although all its shorter parts are: all other words, and longer
phrases whose first words and whose last words are both proposed. One pass over all texts counts
both. A border phrase that turns out to be frequent may have frequent extensions that weren't
counted, so it is proposed too, and another pass counts what that brings in, until none fails.
That pass takes phrases that weren't counted for frequent until they are, so it also counts the
extensions of what it counts, and no third one is needed.

Tasks know the proposals by a bitset of bounded size (key_filter). A phrase that it wrongly
takes for proposed is counted in vain; counts are of the phrases themselves, never of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachbase.llm import key_filter
from reachbase.llm.cluster import by_small_batches, durable
from reachbase.llm.key_filter import KeyFilter
from reachbase.llm.textblock import NumberedWords, TextBlock, blocks, mix
from reachbase.operators.ranges import places

#: Longest phrase in words, least count of a phrase, results for each language.
LONGEST, LEAST, TOP = 4, 30, 2000
#: Share in percent of a phrase's count from which a longer phrase stands for it.
ABSORBED = 80
#: One in so many documents is in the sample; the threshold there is lowered to this share of what a frequent phrase should have.
SAMPLE_ONE_IN, LOWERED = 8, 0.8
#: Bytes of text that are counted together before their phrases are handed on.
COUNTED_BYTES = 2 << 20

_SCHEMA = "lang string, k int, phrase string, n long"
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True


class _Phrases:
    """The words of a lower-cased block. Phrases of a length have numbers by block; equal phrases of a language have one number."""

    def __init__(self, block: TextBlock, langs: pa.Array):
        """langs: the language of each document."""
        words = NumberedWords(block, _APART)
        self.word, self.distinct = words.ids, words.distinct
        self.count = len(self.word)
        of_doc = np.repeat(np.arange(len(block), dtype=np.int32), np.diff(words.bounds))
        broken = np.zeros(len(block.data) + 1, np.int32)
        np.cumsum(_BREAK[block.data], out=broken[1:])
        piece = broken[words.start]
        #: Whether the next word stands in the same piece.
        self.linked = np.zeros(self.count, bool)
        self.linked[:-1] = (piece[1:] == piece[:-1]) & (of_doc[1:] == of_doc[:-1])
        found = langs.dictionary_encode()
        self.langs, self.lang_of = found.dictionary, found.indices.to_numpy()[of_doc]
        width = max(len(self.distinct), 1)
        #: Where phrases of the present length stand and the number of each; the distinct ones' keys.
        self.at = np.arange(self.count, dtype=np.int32)
        self.ids, keys = _dense(self.lang_of.astype(np.int64) * width + self.word)
        self.word_hash = _hashes(self.distinct)
        self.keys = mix(self.word_hash[keys % width] ^ mix(_hashes(self.langs.cast(pa.large_binary()))[keys // width]))

    def firsts(self) -> np.ndarray:
        """The first position of each distinct phrase of the present length."""
        out = np.zeros(len(self.keys), np.int32)
        out[self.ids[::-1]] = self.at[::-1]
        return out

    def lengthened(self, k: int, passed: np.ndarray) -> None:
        """Goes from k to k + 1 words where both parts passed; passed is by number of phrase."""
        of = np.full(self.count + 1, -1, np.int32)
        ok = passed[self.ids]
        of[self.at[ok]] = self.ids[ok]
        start = self.at[ok]
        longer = start[(of[start + 1] >= 0) & self.linked[np.minimum(start + (k - 1), self.count - 1)]]
        width = max(len(self.keys), 1)
        before, self.at = self.keys, longer
        self.ids, pairs = _dense(of[longer].astype(np.int64) * width + of[longer + 1])
        self.keys = before[pairs // width]  # those of the first words, for firsts()
        self.keys = mix(self.keys * _FOLD + self.word_hash[self.word[self.firsts() + k]])

    def rows(self, k: int, chosen: np.ndarray) -> pa.RecordBatch:
        """lang, k, phrase and count of the chosen distinct phrases."""
        first = self.firsts()[chosen]
        words = [self.distinct.take(pa.array(self.word[first + j])) for j in range(k)]
        phrases = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if k > 1 else words[0]
        counts = np.bincount(self.ids, minlength=len(self.keys))[chosen]
        return _rows(self.langs.take(pa.array(self.lang_of[first])), k, phrases, counts)

    def totals(self) -> pa.RecordBatch:
        """The number of words of each language, as the count of the phrase without words."""
        counts = np.bincount(self.lang_of, minlength=len(self.langs))
        return _rows(self.langs, 0, pa.array([b""] * len(self.langs), pa.large_binary()), counts)


def _rows(langs: pa.Array, k: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(counts), k, np.int32)), phrases.cast(pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "k", "phrase", "n"])


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 for equal keys, and the distinct keys."""
    found = pa.array(keys).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_numpy()


def _hashes(texts: pa.Array) -> np.ndarray:
    """64-bit hashes of whole values; they only ask the filter."""
    if not len(texts):
        return np.zeros(0, np.uint64)
    (_, block), *rest = blocks(texts.cast(pa.large_binary()), block_bytes=1 << 62)
    assert not rest
    return block.hashes(block.doc_start, block.doc_end)


def _count_batches(longest: int, new: Broadcast | None, old: Broadcast | None):
    """For mapInArrow over lang and text: how often phrases of up to longest words stand in each few MB of text.

    Without filters all are counted; with new alone, all words and the phrases whose two parts
    new has. With old as well, only phrases are counted that old kept from being counted, and
    only if each of the two parts is in new or is itself one of them: nothing is left to count then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch.column("text"), lower=True, block_bytes=COUNTED_BYTES):
                phrases = _Phrases(block, batch.column("lang").slice(part.start, part.stop - part.start))
                if not phrases.count:
                    continue
                if old is None:
                    yield phrases.totals()
                known = np.full(len(phrases.keys), old is not None)
                for k in range(1, longest + 1):
                    if not known.all():
                        yield phrases.rows(k, np.flatnonzero(~known))
                    if k == longest:
                        break
                    passed = np.ones(len(phrases.keys), bool) if new is None else new.value.has(phrases.keys)
                    if old is not None:
                        passed |= ~known
                    before = np.zeros(len(passed), bool) if old is None else known & old.value.has(phrases.keys)
                    # A longer phrase was counted if both its parts had been, and were proposed.
                    spread = np.zeros(phrases.count + 1, bool)
                    spread[phrases.at] = before[phrases.ids]
                    phrases.lengthened(k, passed)
                    first = phrases.firsts()
                    known = spread[first] & spread[first + 1]
                    if not len(first):
                        break

    return run


def _outside(filter_: Broadcast):
    """For mapInArrow over phrases: those that the filter doesn't have, with their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch)
            out = ~filter_.value.has(keys) if filter_ is not None else np.ones(len(keys), bool)
            yield pa.RecordBatch.from_arrays([pa.array(keys[out].view(np.int64))], ["key"])

    return run


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """The key of each row's whole phrase; the same as _Phrases' keys."""
    out = np.zeros(len(batch), np.uint64)
    langs = _hashes(batch.column("lang").cast(pa.large_binary()))
    for part, block in blocks(batch.column("phrase")):
        start, end, bounds = block.words(_APART)
        word = block.hashes(start, end)
        length = np.diff(bounds)
        key = mix(word[bounds[:-1]] ^ mix(langs[part]))
        for j in range(1, int(length.max(initial=0))):
            more = length > j
            key[more] = mix(key[more] * _FOLD + word[bounds[:-1][more] + j])
        out[part] = key
    return out


def _counted(docs: DataFrame, longest: int, new: Broadcast | None = None, old: Broadcast | None = None) -> DataFrame:
    return docs.mapInArrow(_count_batches(longest, new, old), _SCHEMA).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def _missed(found: DataFrame, longest: int, known: Broadcast | None) -> DataFrame:
    """Keys of the found phrases that may have extensions and that the filter doesn't have."""
    return found.where(F.col("k").between(1, longest - 1)).select("lang", "phrase").mapInArrow(_outside(known), "key long")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, k, phrase and n of all phrases of 1 to longest words that stand least times or more in the texts of a language.

    k is the number of words; a language's row with k = 0 and an empty phrase has all its words.
    A null lang is ``und``; null and empty texts have no words; repeated rows count each time;
    long texts count whole; an empty table gives an empty one.
    """
    context = docs.sparkSession.sparkContext
    texts = by_small_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_ONE_IN)) == 0)
    lowered = max(2, int(LOWERED * least / SAMPLE_ONE_IN))
    proposed = durable(_missed(_counted(sample.select("lang", "text"), longest - 1).where(F.col("n") >= lowered), longest, None))
    bits = key_filter.bits_for(proposed.count())
    known = key_filter.of_keys(proposed, "key", bits)
    texts = texts.select("lang", "text")
    first = context.broadcast(known)
    found = durable(_counted(texts, longest, first).where((F.col("n") >= least) | (F.col("k") == 0)))
    failed = durable(_missed(found, longest, first))
    if not failed.limit(1).count():
        return found
    second = context.broadcast(known.joined(key_filter.of_keys(failed, "key", bits)))
    return found.unionAll(durable(_counted(texts, longest, second, first).where(F.col("n") >= least)))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The phrases of 2 to longest words that stick together best, for each language.

    Returns lang, rank (from 1), phrase (words lower-cased in ASCII, joined by one space), a (its
    count), l and r (the counts of its two parts at the cut where it holds least), n (all words
    of the language) and score: floor(2000000 a / (l + r)). Phrases don't cross ``.,;:!?`` and
    line ends. A phrase goes if a longer frequent one around it has ABSORBED percent of its
    count. Ties in score go to the larger a, then to the phrase that comes first by its bytes.
    Texts that are null, empty or long, null languages, repeated rows and empty tables are as in
    frequent_phrases(); columns beside doc_id, lang and text are ignored.
    """
    found = frequent_phrases(docs, longest, least)
    counts = found.where("k > 0").select("lang", "phrase", "n")
    candidates = found.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda at, size: F.array_join(F.slice("words", at, size), " ")
    cuts = candidates.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).withColumn("_left", part(F.lit(1), F.col("cut"))).withColumn("_right", part(F.col("cut") + 1, F.col("k") - F.col("cut")))
    left = counts.select("lang", F.col("phrase").alias("_left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("_right"), F.col("n").alias("r"))
    score = F.expr("(cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    weakest = F.min(F.struct("score", "cut", "l", "r"))
    scored = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).withColumn("score", score).groupBy("lang", "phrase", "a").agg(weakest.alias("w"))
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    around = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < ABSORBED * F.col("a").cast("decimal(20,0)")))
    ordered = kept.select("lang", "phrase", "a", "w.l", "w.r", "w.score", (-F.col("w.score")).alias("_score"), (-F.col("a")).alias("_a"))
    # By ranges, as one language may have a third of all phrases.
    ranked = places(ordered, ["_score", "_a", "phrase"], within="lang").where(F.col("place") < top)
    totals = found.where("k = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
