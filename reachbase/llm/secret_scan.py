"""Secret scans: patterns for keys and assigned values, and guess costs for what stands in a credential's place.

The guess cost of a value is the decimal logarithm of the guesses that an attacker needs who
knows how people choose: the cheapest split into known words, dates, repeats, keyboard walks and
spans that must be tried out. Only a value that costs much is worth calling a secret. Words are
ranked by how often the corpus has them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachbase.llm.cluster import by_small_batches, durable
from reachbase.llm.textblock import TextBlock, blocks

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
#: Words that announce a credential, and its value: anything up to a space, quote, comma or semicolon.
CONTEXT = re.compile(r"""(?:password|passwd|passphrase|pass|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?id|credentials?|authorization|bearer)["']?\x20*(?::=|=>|[:=])\x20*["']?(?:(?:basic|bearer)\x20+)?([^\s"'`,;<>|]{8,})""", re.IGNORECASE | re.ASCII)
_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"client", b"credential", b"authorization", b"bearer")
#: Guesses, as a decimal logarithm, from which a value counts as a secret.
MIN_COST = 12.0
#: Characters of a unit that people repeat. A longer one counts each time.
MAX_UNIT = 32
#: Words of the corpus that are known besides the list below: the most frequent ones of WORD_LENGTHS letters. That bounds the broadcast.
MAX_WORDS, WORD_LENGTHS = 50_000, (4, 20)
#: Values whose costs a task remembers.
MEMO_VALUES = 65_536

# Words that people use in place of secrets, most frequent first.
WORDS = """password secret token example changeme test admin user root default welcome letmein qwerty
dragon master login guest hello monkey shadow sunshine princess football baseball iloveyou trustno
access key api pass your my the here insert value string none null true false todo xxx sample dummy
placeholder demo local host server database service account name email http https www com""".split()
# Rows of a keyboard, the alphabet and the digits.
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789", "qazwsxedcrfvtgbyhnujmik", "1q2w3e4r5t6y7u8i9o0p")
#: The rows, forwards and backwards, in which one key follows another.
_STEPS: dict[tuple[str, str], list[int]] = {}
for _i, _row in enumerate([way for row in _ROWS for way in (row, row[::-1])]):
    for _pair in zip(_row, _row[1:], strict=False):
        _STEPS.setdefault(_pair, []).append(_i)
_MONTH, _DAY, _YEAR = "(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"(?:19|20)\d\d"
_DATES = [re.compile(x, re.ASCII) for x in (_YEAR, f"{_YEAR}[-/.]?{_MONTH}", f"{_YEAR}[-/.]?{_MONTH}[-/.]?{_DAY}", f"{_DAY}[-/.]?{_MONTH}[-/.]?{_YEAR}", rf"{_DAY}[-/.]?{_MONTH}[-/.]?\d\d")]
# Classes of letters in the shapes that people give words: capital or camel case, without the numbers on either side.
_FIRST_SHAPE, _LATER_SHAPE, _AFTER_NUMBER = (re.compile(x + r"(?:Ull+)*") for x in ("(?:UU+|U?l*)", "(?:UU+|U?l+)", ""))
_LEET = str.maketrans("013457@$!", "oleastasi")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33)


class _ByCharacter(dict):
    """For str.translate: what a function says of each character, asked once for each."""

    def __init__(self, of: Callable[[str], str]):
        self.of = of

    def __missing__(self, code: int) -> str:
        self[code] = out = self.of(chr(code))
        return out


_SHAPES = _ByCharacter(lambda c: "d" if c.isdigit() else "U" if c.isupper() else "l" if c.isalpha() else "-" if c in "-_./:@" else "s")
_SMALL = _ByCharacter(lambda c: c.lower() if len(c.lower()) == 1 else c)


def _shape(value: str) -> str:
    return value.translate(_SHAPES)


def _is_plain(shape: str) -> bool:
    """Whether a value has a shape that people choose, in time that grows with its length.

    That is words and numbers, numbers on either side of words too, joined by single separators,
    between symbols. Any other order of classes is one of all characters of these classes.
    """
    first, *others = shape.strip("s-").split("-")
    if not _FIRST_SHAPE.fullmatch(first.strip("d")):
        return False
    return all(x and (_AFTER_NUMBER if x[0] == "d" else _LATER_SHAPE).fullmatch(x.strip("d")) for x in others)


def _class(c: str, kind: str) -> int:
    """A character's class as a bit: digits, small letters, capitals, anything else."""
    return 1 if c.isdigit() else 2 if c.isascii() and kind == "l" else 4 if c.isascii() and kind == "U" else 8


#: What a character costs that is tried out from all characters of some classes.
_TRIED = [math.log10(max(1, sum(n for bit, n in ((1, 10), (2, 26), (4, 26), (8, 33)) if classes & bit))) for classes in range(16)]
_LONGEST_WALK = max(map(len, _ROWS))


def _capitals_cost(piece: str) -> float:
    capitals = sum(c.isupper() for c in piece)
    return 0 if not capitals else 0.3 if capitals in (1, len(piece)) and piece[0].isupper() else 0.3 * capitals


def _repetitions(value: str) -> Iterator[tuple[int, int, int]]:
    """The longest stretches in which a unit of up to MAX_UNIT characters follows itself: start, end and the unit's length."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    for unit in range(1, min(MAX_UNIT, len(value) // 2) + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], codes[unit:] == codes[:-unit], [0]]).astype(np.int8)))
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if stop - start >= (unit if unit > 1 else 2):
                yield start, stop + unit, unit


class _Repeats:
    """Arcs over a stretch of repeated units: any number of them from any place.

    An arc's cost is the unit's and the logarithm of how often it stands there. Of two places to
    start from, the later one loses against the earlier as the arcs grow, so one that is worse
    once never comes back, and few are kept.
    """

    def __init__(self, start: int, end: int, unit: int):
        self.start, self.end, self.unit = start, end, unit
        self.least = 2 * unit if unit > 1 else 3
        self.open: dict[int, list[int]] = {}
        self.costs: dict[int, float] = {}

    def without(self, goal: float) -> tuple[int, int]:
        """The middle of a long stretch, from start to end, where a split that costs less than goal needs no borders.

        Such a split has few parts, as each costs log10(2) or more. What of them lies inside
        the stretch may as well lie near its start, where it reads the same, with two or three
        units for each but the longest repeat, which costs no more.
        """
        edge = math.ceil(goal / math.log10(2)) * 3 * MAX_UNIT
        return self.start + edge, self.end - edge

    def multiple_of(self, other: _Repeats, value: str, cost: Callable[[str], float]) -> bool:
        """Whether arcs of the other's shorter unit over the same stretch never cost more than this one's."""
        times, rest = divmod(self.unit, other.unit)
        if times < 2 or rest or self.start < other.start or self.end > other.end:
            return False
        units = ((value[s : s + self.unit], value[s : s + other.unit]) for s in range(self.start, min(self.start + self.unit, self.end - self.unit + 1)))
        return all(cost(long) >= cost(short) + math.log10(times) for long, short in units)

    def into(self, end: int, best: list[float], value: str, cost: Callable[[str], float]) -> float:
        """The least cost of an arc that ends here, to which all shorter ends have been asked for before."""
        start, place = end - self.least, end % self.unit
        if start < self.start:
            return math.inf
        if place not in self.costs:
            self.costs[place] = cost(value[start : start + self.unit])
        known, least = [], math.inf
        for s in [*self.open.get(place, ()), start]:
            if (own := best[s] + math.log10((end - s) // self.unit)) < least:
                known.append(s)
                least = own
        self.open[place] = known
        return least + self.costs[place]


class Guesser:
    """Guess costs by dynamic programming over a value's ends, with words by rank."""

    def __init__(self, words: Sequence[str] = WORDS):
        self.rank = {}
        for i, w in enumerate(words):
            self.rank.setdefault(w, i + 1)
        self.longest = max(map(len, self.rank), default=0)
        self._costs: dict[str, float] = {}

    def word_cost(self, piece: str) -> float | None:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in piece)
        plain = low if low in self.rank else low.translate(_LEET)
        if plain not in self.rank:
            return None
        changed = sum(a != b for a, b in zip(low, plain, strict=True))
        return math.log10(self.rank[plain] + 1) + _capitals_cost(piece) + 0.3 * changed

    def cost(self, value: str) -> float:
        """The least cost over all splits of a value; 0 for an empty one."""
        if value not in self._costs:
            if len(self._costs) >= MEMO_VALUES:
                self._costs.clear()
            self._costs[value] = self._least(value, math.inf)
        return self._costs[value]

    def reaches(self, value: str, goal: float) -> bool:
        """Whether cost(value) is goal or more. A long value is read only until no split can stay below."""
        return self._least(value, goal) >= goal

    def _least(self, value: str, goal: float) -> float:
        n = len(value)
        shape = _shape(value)
        plain = _is_plain(shape)
        low = value.translate(_SMALL)
        leet = low.translate(_LEET)
        repeats: list[_Repeats] = []
        for r in sorted((_Repeats(*x) for x in _repetitions(value)), key=lambda r: (r.start, r.unit)):
            if not any(r.multiple_of(other, value, self.cost) for other in repeats[-MAX_UNIT:]):
                repeats.append(r)
        middles = sorted(m for r in repeats if n > 2 * MAX_UNIT and goal < math.inf and (m := r.without(goal))[0] < m[1])
        waiting = iter([*repeats, None])
        upcoming = next(waiting)
        active: list[_Repeats] = []
        best = [0.0] + [math.inf] * n
        pieces: dict[int, list[tuple[int, float]]] = {}  # dates by end: start and cost
        tried = [math.inf] * 16  # by classes: the cost of a split that ends in a span that is tried out
        along: dict[int, int] = {}
        reach = max(self.longest, _LONGEST_WALK, 10, 3 * MAX_UNIT)
        last_known = 0.0  # the least cost of a split that ends here with something known
        end = seen_from = 0
        while end < n:
            end += 1
            while middles and middles[0][0] < end:
                if (to := middles.pop(0)[1]) > end:
                    end = seen_from = to
                    tried, along, last_known = [math.inf] * 16, {}, math.inf
            for date in _DATES:
                if m := date.match(value, end - 1):
                    pieces.setdefault(m.end(), []).append((end - 1, math.log10(200) if m.end() - end < 4 else math.log10(365 * 200)))
            known = math.inf
            for start in range(max(0, end - self.longest), end - 1):
                if (low[start:end] in self.rank or leet[start:end] in self.rank) and (own := self.word_cost(value[start:end])) is not None:
                    known = min(known, best[start] + own)
            steps = _STEPS.get((low[end - 2], low[end - 1]), ()) if end > 1 else ()
            along = {row: along.get(row, 1) + 1 for row in steps}
            for length in range(3, max(along.values(), default=1) + 1):
                known = min(known, best[end - length] + math.log10(50 * length) + _capitals_cost(value[end - length : end]))
            for start, own in pieces.pop(end, ()):
                known = min(known, best[start] + own)
            while upcoming and upcoming.start < end:
                active.append(upcoming)
                upcoming = next(waiting)
            active = [r for r in active if r.end >= end]
            for r in active:
                known = min(known, r.into(end, best, value, self.cost))
            if plain:  # each character from its own class
                best[end] = min(known, best[end - 1] + _brute(value[end - 1]))
            else:  # all characters of a span from all of its classes; it follows what is known
                own = _class(value[end - 1], shape[end - 1])
                for s in range(16):
                    tried[s] = min(tried[s], last_known) + _TRIED[s] if s & own else math.inf
                best[end] = min(known, *tried)
            last_known = known
            # An arc that is still to come starts within reach, or is a repeat that has cost as much one unit earlier.
            if best[end] >= goal and end - seen_from >= reach and min(best[end - reach : end + 1]) >= goal:
                return goal
        return best[n]


#: Knows the list alone.
LISTED = Guesser()


def corpus_words(docs: DataFrame, most: int = MAX_WORDS) -> list[str]:
    """The listed words, then up to ``most`` words of all texts by how often they stand there, ties by name.

    Words have WORD_LENGTHS ASCII letters, small but for the first, and stand neither beside
    letters, digits and underscores nor behind an equals sign or a colon, where values are. Counted
    in Spark over whole texts. How many words there are of each order of frequency tells which
    can be among the first ``most``; only these, hardly more, are sorted and come to the driver.
    """
    low, high = WORD_LENGTHS
    found = F.regexp_extract_all("text", F.lit(rf"(?<![A-Za-z0-9_=:])([A-Z]?[a-z]{{{low - 1},{high - 1}}})(?![A-Za-z0-9_])"), 1)
    counts = durable(docs.select(F.explode(found).alias("word")).where(F.length("word") >= low).groupBy(F.lower("word").alias("word")).count().where("count > 1"))
    level = F.floor(F.log2("count") * 4)
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    reached, least = 0, 0
    for least, n in sizes:
        reached += n
        if reached >= most:
            break
    top = counts.where(level >= least).orderBy(F.desc("count"), "word").limit(most).collect()
    return [*WORDS, *(r["word"] for r in top)]


def scan(text: str, guesser: Guesser = LISTED) -> list[Span]:
    """All spans of a text, by start and kind, in code points. Method spans are those whose value no base span covers whole; they may overlap base spans."""
    kinds = [
        [Span("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8],
        [Span("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16],
        [Span("hex", m.start(), m.end()) for m in HEX.finditer(text)],
    ]
    starts = [[s.start for s in spans] for spans in kinds]

    def covered(start: int, end: int) -> bool:
        """Spans of a kind don't overlap, so the last one that starts in time is the one to look at."""
        return any((at := bisect_right(own, start)) and end <= spans[at - 1].end for own, spans in zip(starts, kinds, strict=True))

    more = [Span("guess", m.start(), m.end()) for m in CONTEXT.finditer(text) if not covered(m.start(1), m.end(1)) and guesser.reaches(m[1], MIN_COST)]
    return sorted([*(s for spans in kinds for s in spans), *more], key=lambda s: (s.start, KINDS.index(s.kind)))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[[*range(48, 58), *range(97, 103)]] = True


def _suspects(block: TextBlock) -> np.ndarray:
    """Whether a text may hold any span; the others needn't be decoded."""
    out = np.zeros(len(block), bool)
    plain = np.flatnonzero(~_HEX_BYTES[block.data])
    edges = np.concatenate([[-1], plain, [len(block.data)]])
    long = edges[:-1][np.diff(edges) > 32]  # runs of hex digits over all texts
    for at in long:
        end = edges[np.searchsorted(edges, at, side="right")]
        first, last = np.searchsorted(block.doc_end, [at + 1, end - 1], side="right")
        out[first : last + 1] = True
    for i in range(len(block)):
        if not out[i]:
            raw = block.data[block.doc_start[i] : block.doc_end[i]].tobytes()
            if b"AKIA" in raw:
                out[i] = True
            elif b"=" in raw or b":" in raw:
                low = raw.lower()
                out[i] = any(hint in low for hint in _HINTS)
    return out


def _spans(block: TextBlock, guesser: Guesser) -> Iterator[tuple[str | None, list[Span]]]:
    for i, suspect in enumerate(_suspects(block)):
        text = block.data[block.doc_start[i] : block.doc_end[i]].tobytes().decode() if suspect else None
        yield text, scan(text, guesser) if suspect else []


def find_secrets(docs: DataFrame) -> DataFrame:
    """The spans of every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess.

    spans lists kind:start:end by start and kind, in code points, the end exclusive; base_sha256
    hashes those that the patterns found alone. ``guess`` spans are values in a credential's place
    with a guess cost of MIN_COST or more that no other span covers whole, at any length; known
    words are the list and the corpus's own (corpus_words). A null or empty text has none. Repeated
    rows get a row each; extra columns are ignored; an empty table gives none.
    """
    kind = dict(docs.dtypes)["doc_id"]
    words = docs.sparkSession.sparkContext.broadcast(corpus_words(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(words.value)
        for batch in batches:
            for part, block in blocks(batch.column("text")):
                found = [spans for _, spans in _spans(block, guesser)]
                counts = [pa.array([sum(s.kind == k for s in spans) for spans in found], pa.int64()) for k in KINDS]
                base = [hashlib.sha256(_joined([s for s in spans if s.kind != "guess"]).encode()).hexdigest() for spans in found]
                columns = [batch.column("doc_id").slice(part.start, part.stop - part.start), *counts[:3], pa.array(base, pa.string()), pa.array([_joined(s) for s in found], pa.string()), counts[3]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    return by_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by ``[kind]`` of its first."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text masked; n_chars, if there is such a column, follows. No row is dropped.

    Spans are those of find_secrets; of overlapping ones nothing stays. Null and empty texts, and
    texts without a secret, are as they were, n_chars too. Repeated rows stay; all other columns,
    whatever their names, are passed on; an empty table gives an empty one.
    """
    names = docs.columns
    words = docs.sparkSession.sparkContext.broadcast(corpus_words(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(words.value)
        for batch in batches:
            place = names.index("text")
            texts, changed = batch.column(place), {}
            for part, block in blocks(texts):
                for i, (text, spans) in enumerate(_spans(block, guesser)):
                    if spans:
                        changed[part.start + i] = mask(text, spans)
            columns = list(batch.columns)
            if changed:
                rows = pa.array(list(changed), pa.int64())
                flags = np.zeros(len(batch), bool)
                flags[rows.to_numpy()] = True
                columns[place] = pc.replace_with_mask(texts, pa.array(flags), pa.array([changed[i] for i in sorted(changed)], texts.type))
                if "n_chars" in names:
                    counts = columns[names.index("n_chars")]
                    lengths = pc.utf8_length(columns[place]).cast(counts.type)
                    columns[names.index("n_chars")] = pc.if_else(pa.array(flags), lengths, counts)
            yield pa.RecordBatch.from_arrays(columns, names)

    return by_small_batches(docs).mapInArrow(run, docs.schema)
