"""URL filters: allow and block entries in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that a broadcast trie may hold; more are joined by host (match_by_join).
MAX_TRIE_RULES = 200_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    """An entry for a host with its subdomains and all paths that start with path."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, entry: str) -> Rule:
        """``example.net/en/``: the host up to the first slash, then the path."""
        host, slash, rest = entry.partition("/")
        return cls(verdict, host.translate(_LOWER), slash + rest)

    def __str__(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:end]


class _Node:
    __slots__ = ("labels", "segments", "open")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}
        self.segments: dict[str, _Node] = {}
        #: Rules that end here, by the start that the next segment must have; longest first.
        self.open: list[tuple[str, Rule]] = []


class Trie:
    """Longest match: the most host labels first, then the longest path; of equal entries block wins."""

    def __init__(self, rules: Sequence[Rule]):
        self.root = _Node()
        for rule in sorted(rules, key=lambda r: r.verdict != "block"):
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.labels.setdefault(label, _Node())
            *whole, start = rule.path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            if all(start != s for s, _ in node.open):
                node.open.append((start, rule))
                node.open.sort(key=lambda x: -len(x[0]))

    def match(self, host: str, path: str) -> Rule | None:
        if not host:
            return None
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            best = self._by_path(node, segments) or best
        return best

    @staticmethod
    def _by_path(node: _Node, segments: list[str]) -> Rule | None:
        best: Rule | None = None
        for segment in segments:
            best = next((rule for start, rule in node.open if segment.startswith(start)), best)
            node = node.segments.get(segment)
            if node is None:
                break
        return best


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url).

    A rule fits its host and all subdomains where the path starts with the rule's path; the
    longest wins. rule is null where none fits, and the verdict then is default. A null url, or
    one without ``://``, has an empty host and path, which no rule fits. Repeated rows get a row
    each, extra columns are ignored, an empty table gives an empty result. The trie goes to
    every executor, up to MAX_TRIE_RULES entries; beyond that the entries are joined by host.
    """
    if len(rules) > MAX_TRIE_RULES:
        return match_by_join(pages, rules, default)
    shared = pages.sparkSession.sparkContext.broadcast(list(rules))
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            split = [split_url(u) for u in batch.column("url").to_pylist()]
            found = [trie.match(*x) for x in split]
            columns = [batch.column("page_id"), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array([r and str(r) for r in found], pa.string()), pa.array([r.verdict if r else default for r in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def match_by_join(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """judge_urls for any number of entries: each url meets the entries of its host's suffixes.

    Rows are numbered so that repeated ones stay apart; only the urls that have a fitting entry
    are grouped. A very common host meets the entries of that host alone.
    """
    spark = pages.sparkSession
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = pages.select("page_id", host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))
    table = spark.createDataFrame(list(rules), "verdict string, _host string, _path string")
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    urls = split.where("host <> ''").select("host", "path").distinct()
    fits = urls.withColumn("_host", suffix).join(table, "_host").where(F.col("path").startswith(F.col("_path")))
    rank = F.struct(F.size(F.split("_host", r"\.")).alias("labels"), F.length("_path").alias("length"), (F.col("verdict") == "block").cast("int").alias("block"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(rank.alias("rank"), F.concat("_host", "_path").alias("rule"), "verdict")).alias("_best"))
    joined = split.join(best, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
