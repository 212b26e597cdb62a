"""Whole texts as flat byte arrays: words, lines and shingles of many documents at once.

The helpers here run inside Spark tasks. A block holds the UTF-8 bytes of some rows of an
Arrow batch; words and lines are index ranges into it, and their 64-bit hashes come from one
prefix sum over the block, so no Python string is built for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one block holds, unless a single text is longer.
BLOCK_BYTES = 1 << 20
#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        out = np.full(max(n + 1, BLOCK_BYTES + 1), base, U64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have


class TextBlock:
    """Some rows' texts. ``doc_start`` and ``doc_end`` are byte positions in ``data``."""

    def __init__(self, data: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.doc_start, self.doc_end = doc_start, doc_end
        self._prefix: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.doc_start)

    def words(self, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each run of ``[^\\x20\\x09-\\x0D]``, and the first word of each document (one more at the end).

        apart: of each byte value, whether it stands between words; only ASCII may.
        """
        word = ~apart[self.data]
        full = self.doc_end > self.doc_start
        first, last = self.doc_start[full], self.doc_end[full] - 1
        at = word.copy()
        at[1:] &= ~word[:-1]
        at[first] = word[first]
        start = np.flatnonzero(at)
        at = word
        ends = at.copy()
        ends[:-1] &= ~at[1:]
        ends[last] = at[last]
        end = np.flatnonzero(ends) + 1
        bounds = np.append(np.searchsorted(start, self.doc_start), len(start))
        bounds[:-1][~full] = np.searchsorted(start, self.doc_start[~full])
        return start, end, bounds

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each ``\\n``-split line, and its document."""
        breaks = np.flatnonzero(self.data == 10)
        breaks = breaks[(breaks >= self.doc_start[0]) & (breaks < self.doc_end[-1])] if len(self) else breaks
        doc = np.concatenate([np.searchsorted(self.doc_end, breaks, side="right"), np.arange(len(self))])
        end = np.concatenate([breaks, self.doc_end])
        order = np.lexsort((end, doc))
        doc, end = doc[order], end[order]
        start = np.empty_like(end)
        start[1:] = end[:-1] + 1
        new = np.ones(len(doc), bool)
        new[1:] = doc[1:] != doc[:-1]
        start[new] = self.doc_start[doc[new]]
        return start, end, doc

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
        if self._prefix is None:
            n = len(self.data)
            self._prefix = np.zeros(n + 1, U64)
            values = self._prefix[1:]
            np.take(_BYTE_VALUES, self.data, out=values)
            values *= _power(_BASE, n)[:n]
            np.cumsum(values, out=values)
        inverse = _power(_BASE_INV, len(self.data))
        out = self._prefix[end] - self._prefix[start]
        out *= inverse[start]
        out += (end - start).astype(U64)
        return mix(out)

    def code_points(self) -> np.ndarray:
        """Prefix counts of code points: those in [a, b) are out[b] - out[a]."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words, and the first of each document (one more at the end).

        A document with fewer words has one window of all of them; one without words has none.
        """
        start, end, bounds = self.words()
        return windows(self.hashes(start, end), bounds, k)


class NumberedWords:
    """A block's words, with a number for each distinct one. No hash stands for a word."""

    def __init__(self, block: TextBlock, apart: np.ndarray):
        """apart: as for TextBlock.words()."""
        self.start, self.end, self.bounds = block.words(apart)
        offsets = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        joined = block.data[~apart[block.data]]  # words are all that isn't apart
        found = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        #: Each word's number, and the distinct words by number.
        self.ids, self.distinct = found.indices.to_numpy(), found.dictionary


def windows(word: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(bounds)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], made)
    length = np.repeat(np.minimum(count, k), made)
    short = bool(len(length)) and int(length.min()) < k
    h = word[at]
    for j in range(1, k):
        if short:
            use = length > j
            h[use] = mix(h[use] * U64(0xD6E8FEB86659FD93) + word[at[use] + j])
        else:
            h = mix(h * U64(0xD6E8FEB86659FD93) + word[at + j])
    return h, out


def blocks(column: pa.Array | pa.ChunkedArray, lower: bool = False, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[slice, TextBlock]]:
    """The texts of a column by runs of rows of up to block_bytes. A null text counts as empty."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if chunk.null_count:
            chunk = chunk.fill_null("")
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        n = len(chunk)
        if not n:
            continue
        offsets = np.frombuffer(chunk.buffers()[1], np.int64 if wide else np.int32)[chunk.offset : chunk.offset + n + 1].astype(np.int64)
        data = np.frombuffer(chunk.buffers()[2], np.uint8) if chunk.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1)
            part = offsets[at : to + 1] - offsets[at]
            yield slice(at, to), TextBlock(data[offsets[at] : offsets[to]], part[:-1], part[1:], lower)
            at = to
