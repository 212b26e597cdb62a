"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

Three tables are compiled from a model and composed with each input:

* the normaliser: an arc for each entry of the model's character map (the longest that matches,
  else the character itself), spaces collapsed where the model says so, and a leading space;
* the pieces: an arc for each piece that matches between two positions;
* the byte fallback: an arc that spells a character which has no piece of its own.

That gives a lattice for each word, in which (cost, back) is relaxed position by position in the
tropical semiring; the encoding is the path of the least cost. An arc of a unigram model weighs
its negated score. In a BPE model it weighs nothing after a piece with which it can stand, and
infinity where merging would have crossed the border between the two, so the merges' result is
the one finite path. Lattices of many words are relaxed together.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from reachbase.llm.cluster import by_small_batches
from reachbase.llm.textblock import TextBlock, blocks, mix

SPACE = 0x20  # stands for the symbol of a space in pieces and texts
MARK = "▁".encode()
#: Words with more bytes are relaxed one at a time.
LONG_WORD = 32
#: What a task remembers: words (with up to MEMO_PIECES pieces each) and pairs of pieces. Both tables have a fixed size.
MEMO_WORDS, MEMO_PIECES, MEMO_PAIRS = 1 << 17, 8, 1 << 18
#: Bytes of text whose words are encoded together, and words whose lattices are relaxed together.
STEP_BYTES, STEP_WORDS = 1 << 20, 1 << 13
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.int64(1) << 60
_START, _FREE = -2, -3

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: How far below the lowest score a unigram model puts a character without a piece.
_UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """The entries of a model's character map: a double-array trie of what is replaced, and the replacements."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
    texts = blob[4 + size :]

    def offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    labels = np.arange(1, 256)
    out: dict[bytes, bytes] = {}
    open_ = [(0, b"")]
    while open_:
        at, key = open_.pop()
        children = at ^ offset(int(units[at])) ^ labels
        inside = children < len(units)
        found = inside & ((units[np.where(inside, children, 0)] & 0x800000FF) == labels)
        for child, label in zip(children[found].tolist(), labels[found].tolist(), strict=True):
            unit, longer = int(units[child]), key + bytes([label])
            if unit >> 8 & 1:
                place = int(units[child ^ offset(unit)]) & 0x7FFFFFFF
                out[longer] = texts[place : texts.index(b"\0", place)]
            open_.append((child, longer))
    return out


class Vocabulary(NamedTuple):
    """What a model file holds."""

    pieces: list[bytes]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    leading_space: bool
    collapse_spaces: bool
    characters: dict[bytes, bytes] = {}

    @classmethod
    def parse(cls, model: bytes) -> Vocabulary:
        pieces, scores, kinds = [], [], []
        bpe, leading, collapse, characters = False, True, True, {}
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").replace(MARK, b" "))
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, _NORMAL))
            elif number == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                characters = character_map(spec.get(2, b""))
                leading, collapse = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if _USER in kinds:
            raise ValueError("models with pieces that their users defined aren't compiled")
        return cls(pieces, scores, kinds, bpe, leading, collapse, characters)


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _utf8_size(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normaliser:
    """The first transducer: characters to characters and spaces to single spaces."""

    def __init__(self, vocabulary: Vocabulary):
        self.characters, self.collapse = vocabulary.characters, vocabulary.collapse_spaces
        starts: dict[int, set[int]] = {}
        for key in self.characters:
            starts.setdefault(key[0], set()).add(len(key))
        self.lengths = {b: sorted(sizes, reverse=True) for b, sizes in starts.items()}
        self.first = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in sorted(starts)) + b"]") if starts else None

    def text(self, raw: bytes) -> bytes:
        if self.first:
            raw = self._mapped(raw)
        if self.collapse:
            raw = re.sub(b"  +", b" ", raw.strip(b" "))
        raw = raw.replace(MARK, b" ")  # a model can't tell its space symbol from a space
        return raw.rstrip(b" ") if self.collapse else raw

    def _mapped(self, raw: bytes) -> bytes:
        out, at = [], 0
        while found := self.first.search(raw, at):
            here = found.start()
            out.append(raw[at:here])
            size = next((n for n in self.lengths[raw[here]] if raw[here : here + n] in self.characters), 0)
            at = here + (size or _utf8_size(raw[here]))
            out.append(self.characters[raw[here:at]] if size else raw[here:at])
        out.append(raw[at:])
        return b"".join(out)

    def block(self, block: TextBlock) -> tuple[TextBlock, np.ndarray]:
        """The normalised texts (the block itself where none changes), and which of them have a leading space."""
        raw = block.data.tobytes()
        begun = block.doc_end > block.doc_start
        if not self.first and MARK not in raw and not self.collapse:
            return block, begun
        texts = [self.text(raw[a:b]) for a, b in zip(block.doc_start.tolist(), block.doc_end.tolist(), strict=True)]
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        out = TextBlock(np.frombuffer(b"".join(texts), np.uint8), np.append(0, ends[:-1])[: len(texts)], ends)
        return out, out.doc_end > out.doc_start if self.collapse else begun


def _merge(symbols: list[bytes], order: dict[bytes, int]) -> list[tuple[bytes, tuple]]:
    """Merges by order, leftmost first; each result with the tree of its merges."""
    nodes: list[tuple[bytes, tuple]] = [(s, ()) for s in symbols]
    while len(nodes) > 1:
        found = [(order.get(a[0] + b[0], 1 << 40), i) for i, (a, b) in enumerate(zip(nodes, nodes[1:], strict=False))]
        rank, i = min(found)
        if rank == 1 << 40:
            break
        nodes[i : i + 2] = [(nodes[i][0] + nodes[i + 1][0], (nodes[i], nodes[i + 1]))]
    return nodes


class Transducer:
    """The compiled tables; small (tens of thousands of pieces), made once and broadcast."""

    def __init__(self, vocabulary: Vocabulary):
        self.normaliser = Normaliser(vocabulary)
        self.bpe, self.leading = vocabulary.bpe, vocabulary.leading_space
        text, kinds = vocabulary.pieces, vocabulary.kinds
        n = len(text)
        usable = [i for i in range(n) if kinds[i] == _NORMAL and text[i]]
        self.ids = {text[i]: i for i in usable}
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if kinds[i] == _BYTE:
                self.byte_ids[int(text[i][3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        #: Weights of pieces, of a spelled character, and the least that any arc may weigh.
        self.weights = np.zeros(n) if self.bpe else -np.array(vocabulary.scores)
        lowest = min((vocabulary.scores[i] for i in usable), default=0.0)
        self.spelling, self.least = (0.0, 0.0) if self.bpe else (_UNKNOWN_PENALTY - lowest, -np.inf)
        self.longest = max(map(len, self.ids), default=1)
        self.lengths = np.array([len(t) for t in text], np.int32)
        self.raw = np.zeros(n, np.uint64)
        self.power = _powers(2 * max(self.longest, LONG_WORD) + 2)
        for t, i in self.ids.items():
            self.raw[i] = (np.frombuffer(t, np.uint8).astype(np.uint64) + np.uint64(1)) @ self.power[: len(t)]
        self._table(usable)
        self.reachable = np.zeros(n, bool)
        self.reachable[usable] = True
        if self.bpe:
            self._spines(text, vocabulary.scores, usable)
        # Characters on their own: no piece of two or more characters holds them.
        inside = {b for t in self.ids if len(t) > 1 for b in t}
        self.alone = np.zeros(256, bool)
        self.alone[[b for b in range(128) if b not in inside]] = True
        made = [bytes([int(t[3:5], 16)]) if kinds[i] == _BYTE else t if kinds[i] == _NORMAL else b"" for i, t in enumerate(text)]
        self.spelled = np.frombuffer(b"".join(made), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int64)

    def _table(self, usable: list[int]) -> None:
        """Open addressing from hashes to ids; at most a quarter of it is full."""
        self.bits = max(4, int(np.ceil(np.log2(4 * len(usable) + 4))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        at = (mix(self.raw) >> np.uint64(64 - self.bits)).astype(np.int64)
        for i in usable:
            j = int(at[i])
            while self.slots[j] >= 0:
                j = (j + 1) & ((1 << self.bits) - 1)
            self.slots[j] = i

    def find(self, raw: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash; -1 for no piece."""
        at = (mix(raw) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.raw[out] != raw))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.slots[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.raw[out[open_]] != raw[open_])]
        return out

    def _spines(self, text: list[bytes], scores: list[float], usable: list[int]) -> None:
        """The pieces at each piece's two ends while it is merged, and when each gives way to the next.

        A moment is (the latest rank so far, own rank), as one number: a merge that becomes
        possible late is made at once, though its rank be earlier.
        """
        n = len(text)
        if any(c.encode() not in self.ids for i in usable for c in text[i].decode()):
            raise ValueError("a character of a merged piece has no piece of its own")
        ranked = sorted((i for i in usable if len(text[i].decode()) > 1), key=lambda i: (-scores[i], i))
        self.rank = np.zeros(n, np.int64)
        for r, i in enumerate(ranked):
            self.rank[i] = r + 1
        order = {text[i]: int(self.rank[i]) for i in ranked}
        chains: list[tuple[list, list]] = []
        for i in range(n):
            chains.append(([], []))
            if not self.reachable[i]:
                continue
            top = _merge([c.encode() for c in text[i].decode()], order)
            if len(top) > 1:
                self.reachable[i] = False
                continue
            late: dict[int, int] = {}

            def latest(node: tuple, late: dict[int, int] = late) -> int:
                if id(node) not in late:
                    late[id(node)] = max([order.get(node[0], 0), *(latest(x, late) for x in node[1])])
                return late[id(node)]

            for side in (0, 1):
                node, chain = top[0], []
                while True:
                    chain.append((self.ids[node[0]], latest(node) << 20 | order.get(node[0], 0)))
                    if not node[1]:
                        break
                    node = node[1][side]
                chains[i][side].extend(reversed(chain))
        depth = max((len(c) for pair in chains for c in pair), default=1)
        self.ends = [np.full((n, depth), -1, np.int32) for _ in range(2)]  # left, right
        self.moments = [np.full((n, depth + 1), _NEVER, np.int64) for _ in range(2)]
        for i, pair in enumerate(chains):
            for side, chain in enumerate(pair):
                for d, (piece, moment) in enumerate(chain):
                    self.ends[side][i, d] = piece
                    self.moments[side][i, d] = moment

    def __getstate__(self) -> dict:
        """Without what a task remembers."""
        return {k: v for k, v in self.__dict__.items() if k not in ("_pairs", "_words", "_known")}

    def arc_weights(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """What each arc weighs after the arc before it (a piece, or below 0 the start or a spelled character)."""
        out = self.weights[ids]
        if self.bpe:
            follows = np.flatnonzero(before >= 0)
            out[follows[~self.can_follow(before[follows], ids[follows])]] = np.inf
        return out

    def can_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the two pieces' characters together would still leave a and b; remembered for recent pairs."""
        if "_pairs" not in self.__dict__:
            self._pairs = np.full(MEMO_PAIRS, -1, np.int64), np.zeros(MEMO_PAIRS, bool)
        keys, answers = self._pairs
        pair = a.astype(np.int64) << 32 | b
        at = (mix(pair.view(np.uint64)) & np.uint64(MEMO_PAIRS - 1)).astype(np.int64)
        out = answers[at]
        new = np.flatnonzero(keys[at] != pair)
        if len(new):
            out[new] = self._compare(a[new], b[new])
            keys[at[new]], answers[at[new]] = pair[new], out[new]
        return out

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        rows = np.arange(len(a))
        i = np.zeros(len(a), np.int64)
        j = np.zeros(len(a), np.int64)
        while len(rows):
            x, y = self.ends[1][a[rows], i[rows]], self.ends[0][b[rows], j[rows]]
            mine, theirs = self.moments[1][a[rows], i[rows]], self.moments[0][b[rows], j[rows]]
            left, right = self.moments[1][a[rows], i[rows] + 1], self.moments[0][b[rows], j[rows] + 1]
            met = self.find(self.raw[x] + self.power[self.lengths[x]] * self.raw[y])
            rank = self.rank[met]
            cross = np.maximum(np.maximum(mine, theirs) >> 20, rank) << 20 | rank
            broken = (met >= 0) & (cross < left) & (cross <= right)
            out[rows[broken]] = False
            go = ~broken & ((left < _NEVER) | (right < _NEVER))
            up = left[go] <= right[go]
            rows = rows[go]
            i[rows[up]] += 1
            j[rows[~up]] += 1
        return out

    def paths(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of words (a row of bytes each, the longest first), one word after the other, and how many each has."""
        n, width = words.shape
        prefix = np.zeros((n, width + 1), np.uint64)
        np.cumsum((words.astype(np.uint64) + np.uint64(1)) * self.power[:width], axis=1, out=prefix[:, 1:])
        inverse = _powers(width + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        border = np.ones((n, width + 1), bool)
        border[:, :width] = (words & 0xC0) != 0x80
        piece = np.full((n, width + 1), _START, np.int32)
        back = np.zeros((n, width + 1), np.int32)
        cost = np.full((n, width + 1), np.inf)
        cost[:, 0] = 0
        before = np.zeros((n, width + 1), np.int32)  # where the character that ends here begins
        before[:, 1:] = np.maximum.accumulate(np.where(border, np.arange(width + 1, dtype=np.int32), 0), axis=1)[:, :-1]
        longer = np.searchsorted(-sizes, -np.arange(width + 1), side="right")  # words with at least so many bytes
        for end in range(1, width + 1):
            todo = np.flatnonzero(border[: longer[end], end])
            own = before[todo, end]
            for start in range(max(0, end - self.longest), end):
                rows = todo[border[todo, start] & (cost[todo, end] > self.least)]
                if not len(rows):
                    continue
                ids = self.find((prefix[rows, end] - prefix[rows, start]) * inverse[start])
                hit = ids >= 0
                hit[hit] = self.reachable[ids[hit]]
                rows, ids = rows[hit], ids[hit]
                total = cost[rows, start] + self.arc_weights(piece[rows, start], ids)
                better = total < cost[rows, end]
                rows = rows[better]
                cost[rows, end], piece[rows, end], back[rows, end] = total[better], ids[better], start
            rest = cost[todo, end] > self.least
            rows, own = todo[rest], own[rest]
            single = self.find((prefix[rows, end] - prefix[rows, own]) * inverse[own]) < 0
            rows, own = rows[single], own[single]
            total = cost[rows, own] + self.spelling
            better = total < cost[rows, end]
            rows, own = rows[better], own[better]
            cost[rows, end] = total[better]
            for at in range(end, max(0, end - 4), -1):  # one step back for each of its bytes
                mine = rows[own < at]
                piece[mine, at], back[mine, at] = _FREE, at - 1
        return self._unwound(words, sizes, piece, back)

    def _unwound(self, words: np.ndarray, sizes: np.ndarray, piece: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = words.shape
        out = np.zeros((n, width), np.int32)
        count = np.zeros(n, np.int64)
        at = sizes.astype(np.int64)
        rows = np.flatnonzero(at > 0)
        while len(rows):
            ids = piece[rows, at[rows]]
            free = ids == _FREE
            ids[free] = self.byte_ids[words[rows[free], at[rows[free]] - 1]]
            out[rows, width - 1 - count[rows]] = ids
            count[rows] += 1
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return out[np.arange(width)[None, :] >= width - count[:, None]], count

    def _arc_weight(self, before: int, i: int) -> float:
        """arc_weights for one arc; remembered as often as tables of that size are filled."""
        known = self.__dict__.setdefault("_known", {})
        if (before, i) not in known:
            if len(known) >= MEMO_PAIRS:
                known.clear()
            known[before, i] = float(self.arc_weights(np.array([before]), np.array([i]))[0])
        return known[before, i]

    def long_path(self, word: bytes) -> list[int]:
        """One word's pieces by the same relaxation, in memory that grows with its length alone."""
        size = len(word)
        piece, back, cost = np.full(size + 1, _START, np.int32), np.zeros(size + 1, np.int32), np.full(size + 1, np.inf)
        cost[0] = 0
        own = 0
        for end in range(1, size + 1):
            if end < size and (word[end] & 0xC0) == 0x80:
                continue
            best, through, start_of = np.inf, _START, 0
            for start in range(max(0, end - self.longest), end):
                i = self.ids.get(word[start:end], -1)
                if i < 0 or not self.reachable[i] or (word[start] & 0xC0) == 0x80:
                    continue
                total = cost[start] + self._arc_weight(int(piece[start]), i)
                if total < best:
                    best, through, start_of = total, i, start
                    if best <= self.least:
                        break
            if best > self.least and word[own:end] not in self.ids and cost[own] + self.spelling < best:
                best, through, start_of = cost[own] + self.spelling, _FREE, end - 1
                for at in range(own + 1, end):
                    piece[at], back[at] = _FREE, at - 1
            cost[end], piece[end], back[end] = best, through, start_of
            own = end
        out, at = [], size
        while at > 0:
            out.append(int(piece[at]) if piece[at] >= 0 else int(self.byte_ids[word[at - 1]]))
            at = int(back[at])
        return out[::-1]

    def encode(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts, and the first of each text (one more at the end)."""
        block, begun = self.normaliser.block(block)
        lead = begun.astype(np.int64) if self.leading else np.zeros(len(block), np.int64)
        full = block.doc_end - block.doc_start + lead > 0
        shift = np.cumsum(lead)
        data = np.full(len(block.data) + int(shift[-1]), SPACE, np.uint8)
        first = block.doc_start + shift - lead
        own = np.ones(len(data), bool)
        own[first[lead > 0]] = False
        data[own] = block.data
        start = np.zeros(len(data), bool)
        gap = data == SPACE
        start[1:] = gap[1:] & ~gap[:-1]
        single = self.alone[data] & ~gap
        start |= single
        start[1:] |= single[:-1]
        start[first[full]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data))
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(begin):  # a long text's words by steps
            to = max(at + 1, int(np.searchsorted(end, begin[at] + STEP_BYTES, side="right")))
            base, stop = begin[at], end[to - 1]
            ids, own = self._encode_words(data[base:stop], begin[at:to] - base, end[at:to] - base)
            parts.append(ids)
            counts.append(own)
            at = to
        words_of = np.searchsorted(begin, np.append(first, len(data)))
        return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(counts)))[words_of]

    def _encode_words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one word after the other, and how many each has; each distinct word is encoded once."""
        hashes = TextBlock(data, begin, end).hashes(begin, end)
        unique, some, which = np.unique(hashes, return_index=True, return_inverse=True)
        if "_words" not in self.__dict__:
            self._words = np.zeros(MEMO_WORDS, np.uint64), np.zeros(MEMO_WORDS, np.int8), np.zeros((MEMO_WORDS, MEMO_PIECES), np.int32)
        keys, sizes, pieces = self._words
        at = (unique >> np.uint64(64 - MEMO_WORDS.bit_length() + 1)).astype(np.int64)
        hit = (keys[at] == unique) & (sizes[at] > 0)
        fresh = np.flatnonzero(~hit)
        counts = np.where(hit, sizes[at], 0).astype(np.int64)
        known = np.flatnonzero(hit)
        old = pieces[at[known]][np.arange(MEMO_PIECES)[None, :] < counts[known][:, None]]
        new, counts[fresh] = self._lattices(data, begin[some[fresh]], end[some[fresh]])
        place = np.empty(len(unique), np.int64)
        place[known] = np.cumsum(counts[known]) - counts[known]
        place[fresh] = len(old) + np.cumsum(counts[fresh]) - counts[fresh]
        flat = np.concatenate([old, new])
        keep = fresh[counts[fresh] <= MEMO_PIECES]
        rows = np.minimum(place[keep][:, None] + np.arange(MEMO_PIECES), len(flat) - 1)
        keys[at[keep]], sizes[at[keep]], pieces[at[keep]] = unique[keep], counts[keep], flat[rows]
        own = counts[which]
        ends = np.cumsum(own)
        return flat[np.arange(int(ends[-1])) + np.repeat(place[which] - (ends - own), own)], own

    def _lattices(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of each word, one word after the other, and how many each has."""
        size = end - begin
        counts = np.zeros(len(begin), np.int64)
        parts: list[np.ndarray] = []
        order = np.argsort(-size, kind="stable")
        long = int(np.searchsorted(-size[order], -LONG_WORD, side="left"))
        for r in order[:long].tolist():
            parts.append(np.array(self.long_path(data[begin[r] : end[r]].tobytes()), np.int32))
            counts[r] = len(parts[-1])
        for at in range(long, len(order), STEP_WORDS):
            rows = order[at : at + STEP_WORDS]
            width = int(size[rows[0]])
            reach = np.minimum(begin[rows][:, None] + np.arange(width), len(data) - 1)
            found, counts[rows] = self.paths(np.where(np.arange(width) < size[rows][:, None], data[reach], 0).astype(np.uint8), size[rows])
            parts.append(found)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        # From the order of lengths back to that of the words.
        place = np.empty(len(begin), np.int64)
        place[order] = np.cumsum(counts[order]) - counts[order]
        ends = np.cumsum(counts)
        return flat[np.arange(len(flat)) + np.repeat(place - (ends - counts), counts)], counts

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes and the first of each; the leading space goes."""
        start, size = self.spelled_at[ids], self.spelled_at[ids + 1] - self.spelled_at[ids]
        ends = np.cumsum(size)
        data = self.spelled[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)]
        first = np.append(0, ends)[bounds]
        if self.leading:
            full = first[1:] > first[:-1]
            drop = first[:-1][full]
            drop = drop[data[drop] == SPACE]
            keep = np.ones(len(data), bool)
            keep[drop] = False
            first = first - np.searchsorted(drop, first)
            data = data[keep]
        return data, first


def _compiled(docs: DataFrame, model_path: str):
    """The transducer, read by the driver and broadcast: its size is the vocabulary's."""
    with open(model_path, "rb") as f:
        made = Transducer(Vocabulary.parse(f.read()))
    return docs.sparkSession.sparkContext.broadcast(made)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (decoding gives the text back) of every whole text.

    ids are those that the SentencePiece library gives for the model. A text that the normaliser
    changes has round_trip false, and so has one with the symbol U+2581, which can't be told from
    a space. A null or empty text has no ids and round_trip true. A very long text is encoded by
    steps of its words. Repeated rows get a row each; extra columns are ignored; an empty table
    gives an empty result.
    """
    shared = _compiled(docs, model_path)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst: Transducer = shared.value
        for batch in batches:
            for part, block in blocks(batch.column("text"), block_bytes=STEP_BYTES):
                ids, bounds = fst.encode(block)
                data, first = fst.decode(ids, bounds)
                same = np.diff(first) == block.doc_end - block.doc_start
                if len(data) == len(block.data):
                    wrong = np.flatnonzero(data != block.data)
                    same[np.searchsorted(block.doc_end, wrong, side="right")] = False
                else:
                    same = np.array([s and np.array_equal(data[a:b], block.data[c:d]) for s, a, b, c, d in zip(same, first, first[1:], block.doc_start, block.doc_end, strict=False)])
                columns = [
                    batch.column("doc_id").slice(part.start, part.stop - part.start),
                    pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                    pa.array(same),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "round_trip"])

    return by_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode_documents(rows: DataFrame, model_path: str) -> DataFrame:
    """rows (doc_id, ids) as doc_id and text.

    Bytes that aren't UTF-8 become U+FFFD; null ids give a null text, an empty list an empty one;
    ids outside the vocabulary are an error. Repeated rows get a row each; extra columns are
    ignored; an empty table gives an empty result.
    """
    shared = _compiled(rows, model_path)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst: Transducer = shared.value
        for batch in batches:
            column = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, first = fst.decode(ids, np.append(0, np.cumsum(counts)))
            raw = data.tobytes()
            texts = [raw[a:b].decode(errors="replace") for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
            columns = [batch.column("doc_id"), pa.array([None if none else t for none, t in zip(column.is_null().to_pylist(), texts, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text"])

    return by_small_batches(rows).select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
