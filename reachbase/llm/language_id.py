"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The vector of an n-gram binds its letters' vectors
(element-wise product) after permuting each by its distance from the n-gram's end; a document
bundles (adds) the vectors of its n-grams; a language's prototype bundles its documents. A
document's language is the prototype with the greatest cosine.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachbase.llm.cluster import by_small_batches, durable
from reachbase.llm.textblock import blocks

DIMENSIONS, SEED = 1024, 4711
#: Documents of a language that its prototype is learned from, about, and code points of all texts of one step.
MAX_TRAINING_DOCUMENTS = 10_000
STEP_CHARS = 1 << 19
#: Languages whose prototypes are compared at once, and whose sums a task holds. More come in further blocks.
BLOCK_LANGUAGES = 1_000
#: Rows up to which the table of languages' sizes is broadcast.
MAX_BROADCAST_ROWS = 100_000
#: Places of a step whose trigrams are counted at once, distinct trigrams whose vectors are made at once, letters whose vectors are remembered.
PLACES_AT_ONCE, VECTORS_AT_ONCE, LETTERS_HELD = 1 << 19, 4_096, 40_000
#: Distinct letters of a step up to which trigrams are counted in a dense table.
DENSE_LETTERS = 128
_GAP = 0  # what isn't a letter, in any number


class Codebook:
    """Vectors of letters and trigrams, made when they are first seen."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self._letters: dict[int, np.ndarray] = {}
        self._folded = np.full(0x110000, -1, np.int32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self._letters:
            self._letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self._letters[code]

    def folded(self, codes: np.ndarray) -> np.ndarray:
        """Letters in lower case; anything else is a gap."""
        out = self._folded[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]).tolist():
                low = chr(code).lower()
                self._folded[code] = ord(low[0]) if chr(code).isalpha() else _GAP
            out = self._folded[codes]
        return out

    def trigrams(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """One row for each trigram: the first letter permuted twice, the second once."""
        letters = np.unique(np.concatenate([a, b, c]))
        if len(self._letters) > LETTERS_HELD:
            self._letters.clear()
        table = np.stack([self.letter(int(x)) for x in letters])
        at = [np.searchsorted(letters, x) for x in (a, b, c)]
        return (np.roll(table, 2, axis=1)[at[0]] * np.roll(table, 1, axis=1)[at[1]] * table[at[2]]).astype(np.float32)


def bundles(texts: list[str], book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bundle of trigram vectors, and whether it has a letter.

    A bundle is a sum, so places are taken in windows and distinct trigrams in runs: of any
    alphabet and length, memory grows only by some 40 bytes a character.
    """
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    letter = book.folded(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    first = np.zeros(len(letter), bool)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    first[starts] = True
    # A run of gaps counts as one, at the end of each text too.
    keep = letter != _GAP
    gap_before = np.ones(len(letter), bool)
    gap_before[1:] = ~keep[:-1]
    use = keep | (~keep & (~gap_before | first))
    letter, doc = letter[use], doc[use]
    some = np.bincount(doc[letter != _GAP], minlength=n) > 0
    out = np.zeros((n, book.dimensions), np.float32)
    if not len(letter):
        return out, some
    # Each text between two gaps.
    counts = np.bincount(doc, minlength=n)
    padded = np.zeros(len(letter) + 2 * n, np.int32)
    padded[np.arange(len(letter)) + 2 * doc.astype(np.int64) + 1] = letter
    owner = np.repeat(np.arange(n, dtype=np.int32), counts + 2)
    for at in range(0, len(padded), PLACES_AT_ONCE):
        _bundle(padded[at : at + PLACES_AT_ONCE + 2], owner[at : at + PLACES_AT_ONCE + 2], book, out)
    return out, some


def _bundle(padded: np.ndarray, owner: np.ndarray, book: Codebook, out: np.ndarray) -> None:
    """Adds the vectors of all trigrams of letters with one owner to its row of out."""
    ok = owner[2:] == owner[:-2]
    of = owner[2:][ok].astype(np.int64)
    if not len(of):
        return
    alphabet = np.unique(padded) if len(padded) < 1000 else np.flatnonzero(np.bincount(padded, minlength=1))
    small = np.searchsorted(alphabet, padded)
    size = len(alphabet)
    key = ((small[:-2] * size + small[1:-1]) * size + small[2:])[ok]
    if size <= DENSE_LETTERS:
        present = np.bincount(key, minlength=size**3) > 0
        used = np.flatnonzero(present)
        place = (np.cumsum(present) - 1)[key]
    else:
        used, place = np.unique(key, return_inverse=True)
    low_doc, docs = int(of[0]), int(of[-1] - of[0]) + 1
    order = np.argsort(place // VECTORS_AT_ONCE, kind="stable") if len(used) > VECTORS_AT_ONCE else np.arange(len(place))
    place, of = place[order], of[order] - low_doc
    bounds = np.searchsorted(place // VECTORS_AT_ONCE, np.arange(-(-len(used) // VECTORS_AT_ONCE) + 1))
    for run, (begin, stop) in enumerate(zip(bounds, bounds[1:], strict=False)):
        of_run = used[run * VECTORS_AT_ONCE : (run + 1) * VECTORS_AT_ONCE]
        vectors = book.trigrams(alphabet[of_run // size**2], alphabet[of_run // size % size], alphabet[of_run % size])
        own, here = of[begin:stop], place[begin:stop] - run * VECTORS_AT_ONCE
        for low in range(0, docs, 64):  # dense counts of a few texts at a time
            high = min(docs, low + 64)
            part = slice(np.searchsorted(own, low), np.searchsorted(own, high))
            grid = np.bincount((own[part] - low) * len(of_run) + here[part], minlength=(high - low) * len(of_run)).reshape(high - low, -1)
            seen = np.flatnonzero(grid.any(0))
            out[low_doc + low : low_doc + high] += grid[:, seen].astype(np.float32) @ vectors[seen]


def _steps(column: pa.Array) -> Iterator[tuple[slice, list[str]]]:
    for part, _ in blocks(column, block_bytes=STEP_CHARS):
        yield part, [t or "" for t in column.slice(part.start, part.stop - part.start).to_pylist()]


def learn(labelled: DataFrame, max_documents: int = MAX_TRAINING_DOCUMENTS) -> DataFrame:
    """lang and prototype (an array of whole numbers) of each language, from text and lang; rows without a lang are ignored.

    Of a language with more than max_documents rows about so many are taken, by a hash of their
    texts, so repeated rows go together. Each document's bundle is scaled to length 1. All
    values of lang are learned, however many there are. Very long texts count whole; null texts
    and those without letters teach nothing; an empty table gives an empty one.
    """
    rows = labelled.where("lang is not null").select("lang", "text")
    sizes = durable(rows.groupBy("lang").agg(F.count("*").alias("_n")))
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST_ROWS else sizes
    share = F.least(F.lit(1.0), F.lit(float(max_documents)) / F.col("_n"))
    draw = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(1_000_003)) / 1_000_003
    chosen = rows.where("text is not null").join(sizes, "lang").where(draw < share).select("lang", "text")

    def handed_on(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(total)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.round(total * 2**30).astype(np.int64))], ["lang", "dimension", "value"])
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, sums = Codebook(), {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            for part, texts in _steps(batch.column("text")):
                made, some = bundles(texts, book)
                made = made[some] / np.linalg.norm(made[some], axis=1, keepdims=True).clip(1e-9)
                for lang in np.unique(own := langs[part][some]):
                    sums[lang] = sums.get(lang, 0) + made[own == lang].sum(0, dtype=np.float64)
                if len(sums) > BLOCK_LANGUAGES:
                    yield from handed_on(sums)
        yield from handed_on(sums)

    parts = by_small_batches(chosen).mapInArrow(run, "lang string, dimension int, value long")
    summed = parts.groupBy("lang", "dimension").agg(F.sum("value").alias("value"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("dimension", "value"))), lambda x: x["value"])  # DIMENSIONS values
    return summed.groupBy("lang").agg(vector.alias("prototype"))


def _blocks_of(prototypes: DataFrame) -> list[Broadcast]:
    """Names and unit vectors of the languages by name, BLOCK_LANGUAGES in a broadcast. The driver holds one block at a time."""
    context, out = prototypes.sparkSession.sparkContext, []
    rows = durable(prototypes.orderBy("lang")).toLocalIterator(prefetchPartitions=False)
    while block := list(itertools.islice(rows, BLOCK_LANGUAGES)):
        vectors = np.array([r["prototype"] for r in block], np.float64)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True).clip(1e-9)
        out.append(context.broadcast((np.array([r["lang"] for r in block], object), vectors.astype(np.float32))))
    return out


def identify(docs: DataFrame, prototypes: DataFrame) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 to 1) of every whole text.

    A null text, one without a letter, and any text when nothing was learned, is ``und`` with
    score 0; equal cosines go to the first language by name. Only text is used; very long texts
    are read whole; repeated rows get a row each; an empty table gives an empty result. A task
    holds the prototypes of one block of languages at a time.
    """
    known = _blocks_of(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook()
        for batch in batches:
            ids = batch.column("doc_id")
            for part, texts in _steps(batch.column("text")):
                made, some = bundles(texts, book)
                made = made[some] / np.linalg.norm(made[some], axis=1, keepdims=True).clip(1e-9)
                lang, score = np.full(len(texts), "und", object), np.full(len(texts), -np.inf)
                for block in known if some.any() else ():
                    names, matrix = block.value
                    cosine = made @ matrix.T
                    best = cosine.argmax(1)
                    most = cosine[np.arange(len(best)), best]
                    better = np.zeros(len(texts), bool)
                    better[some] = most > score[some]
                    lang[better], score[better] = names[best[better[some]]], most[better[some]]
                    if len(known) > 1:
                        del block._value  # it is read again from its file
                yield pa.RecordBatch.from_arrays([ids.slice(part.start, part.stop - part.start), pa.array(lang, pa.string()), pa.array(np.round(np.clip(score, 0, 1), 5))], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return by_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the doc_id as text is 2 modulo 4; a null doc_id isn't."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learns from the documents that aren't held out and predicts all: doc_id, held_out, lang_pred, score.

    Repeated rows get a row each; an empty table gives an empty result; extra columns are ignored.
    """
    prototypes = learn(docs.where(~held_out()).select("lang", "text"))
    return identify(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
