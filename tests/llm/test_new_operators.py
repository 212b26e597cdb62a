"""Resampling, collocations and web archives on odd rows and against plain versions."""

import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reachbase.llm import collocations, key_filter, target_resampling, web_archive
from reachbase.llm.cluster import folder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


# the filter of keys


def test_filter_has_all_keys_and_few_others(spark):
    rng = np.random.default_rng(7)
    keys = rng.integers(-(1 << 63), 1 << 63, 20_000)
    df = spark.createDataFrame([(int(k),) for k in keys] + [(None,), (int(keys[0]),)], "key long")
    made = key_filter.of_keys(df, "key", key_filter.bits_for(len(keys)))
    assert made.has(keys.view(np.uint64)).all()
    assert made.has(rng.integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 0.03
    assert not key_filter.of_keys(df.limit(0), "key", key_filter.MIN_BITS).words.any()
    # As full as can be, it lets everything pass but loses nothing.
    full = key_filter.KeyFilter(np.full(key_filter.MIN_BITS // 64, (1 << 64) - 1, np.uint64))
    assert made.words.size > full.words.size and full.has(keys.view(np.uint64)).all()


def test_filter_sizes():
    assert key_filter.bits_for(0) == key_filter.MIN_BITS and key_filter.bits_for(1 << 40) == key_filter.MAX_BITS
    assert key_filter.bits_for(10_000) == 1 << 18


# 11


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_resample(docs, target, percent=10, least=20):
    """docs: (doc_id, text)."""
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = Counter(bucket(w) for _, x in docs for w in plain_words(x)), Counter(bucket(w) for x in target for w in plain_words(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (all_s + 10000)) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in docs:
        words = plain_words(text)
        weight = sum(gain[bucket(w)] for w in words) // len(words) if words else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    drawn = len(able) * percent // 100
    return [(*r, i + 1 if i < drawn else None) for i, r in enumerate(able)] + [(*r, None) for r in out if r[1] < least]


def sort_key(r):
    return tuple((x is not None, x) for x in r)


def test_resampling_equals_plain_sums(spark, odd_docs, no_docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ärger", "naïve", "日本", "A1b2", "ß"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 40, 200])))) for i in range(400)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (None, docs[8][1]), (None, None), (900, "x " * 70_000 + "y")]
    target = [" ".join(rng.choices(vocabulary[:60], k=30)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in docs], "doc_id long, text string, rank string, score long").repartition(5)
    got = target_resampling.resample(df, spark.createDataFrame([(x, "c") for x in target], "text string, doc_id string"))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert rows_of(got) == sorted(plain_resample(docs, target), key=sort_key)
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows_of(target_resampling.resample(odd_docs, df.select("text").limit(0), percent=50)) == sorted(plain_resample(odd, [], percent=50), key=sort_key)
    assert rows_of(target_resampling.resample(no_docs, df)) == []


def test_bit_planes_sum_exactly():
    rng = np.random.default_rng(5)
    gain = rng.integers(-9000, 9000, target_resampling.BUCKETS)
    gain[:100] = 0
    bounds = np.array([0, 0, 3, 5_000, 5_000, 400_000])
    bucket = rng.integers(0, target_resampling.BUCKETS, bounds[-1])
    bucket[6_000:300_000] = 17
    want = [int(gain[bucket[a:b]].sum()) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert target_resampling.weight_sums(bucket, bounds, target_resampling.signed_planes(gain)).tolist() == want
    assert target_resampling.signed_planes(np.zeros(target_resampling.BUCKETS, np.int64)) == []


# 12


def plain_counts(docs, longest):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return counts, totals


def plain_collocations(docs, longest=4, least=30, top=2000):
    counts, totals = plain_counts(docs, longest)
    found = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    longer = Counter()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], a)
    out = {}
    for (lang, w), a in found.items():
        if 100 * longer[lang, w] >= 80 * a and longer[lang, w]:
            continue
        score, _, x, y = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), x, y))
    return [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -score) for lang, rows in out.items() for i, (score, a, p, x, y) in enumerate(sorted(rows)[:top])]


def some_texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)] + ["É", "日本", "x.y"]
    phrases = [rng.choices(vocabulary, k=rng.choice([2, 3, 4, 5])) for _ in range(12)]
    out = []
    for i in range(n):
        words = []
        while len(words) < 40:
            words += rng.choice(phrases) if rng.random() < 0.4 else [rng.choice(vocabulary)]
            words[-1] += rng.choice(["", "", "", ",", ". ", "\n", "  \t"])
        out.append((i, " ".join(words), rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("one_in", [1, 8, 10**9])
def test_collocations_equal_plain_counts(spark, monkeypatch, one_in):
    """Whether the sample is all documents, some, or (but for chance) none, when every frequent phrase fails."""
    monkeypatch.setattr(collocations, "SAMPLE_ONE_IN", one_in)
    docs = some_texts(300) + [(None, "rare words " * 40, "fr"), (None, "rare words " * 40, "fr"), (5, None, "en"), (6, "", None), (7, " \t\n.,", "en"), (8, "long run " * 30_000, "xx")]
    df = spark.createDataFrame([(i, x, lang, "c", 1) for i, x, lang in docs], "doc_id long, text string, lang string, phrase string, n long").repartition(4)
    got = collocations.collocations(df, top=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations([(lang, x) for _, x, lang in docs], top=25)
    assert rows_of(got) == sorted(want) and len({r[0] for r in want}) > 3


def test_all_frequent_phrases_are_found(spark, odd_docs, no_docs):
    docs = some_texts(200, seed=9)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    counts, totals = plain_counts([(lang, x) for _, x, lang in docs], 3)
    want = [(lang, len(w), " ".join(w), a) for (lang, w), a in counts.items() if a >= 12] + [(lang, 0, "", n) for lang, n in totals.items()]
    assert rows_of(collocations.frequent_phrases(df, longest=3, least=12)) == sorted(want)
    odd = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert rows_of(collocations.collocations(odd_docs)) == sorted(plain_collocations(odd))
    assert rows_of(collocations.collocations(no_docs)) == []


def test_a_full_filter_only_counts_more(spark, monkeypatch):
    """All bits set: everything is counted, and the results are the same."""
    docs = some_texts(150, seed=4)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    monkeypatch.setattr(key_filter, "of_keys", lambda keys, column, bits: key_filter.KeyFilter(np.full(bits // 64, (1 << 64) - 1, np.uint64)))
    assert rows_of(collocations.collocations(df)) == sorted(plain_collocations([(lang, x) for _, x, lang in docs]))


# 13


def plain_archive(pages):
    out, first = [], {}
    digest = lambda html: hashlib.sha256((html or "").encode()).hexdigest()
    for page_id, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        d, size = digest(html), len((html or "").encode())
        again = size >= 100 and d in first
        first.setdefault(d, page_id)
        out.append((page_id, size, d, "revisit" if again else "response", first[d] if again else None))
    return out


def test_archived_pages_equal_plain_rules(spark):
    long = "<p>ä日本</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 30_000
    same = "<html>" + "same " * 40
    pages = [(1, "http://a/x y\n", same), (2, "http://a/", None), (3, None, ""), (4, "http://b/", long), (5, "ftp://c/", same), (6, "", long), (7, "https://d/?q#é", "x" * 99), (8, "https://d/", "x" * 99), (9, "http://e", "y" * 100), (0, "http://e", "y" * 100)]
    pages += [(None, "http://n/", same), (None, "http://n/", "only without a number " * 9), (None, "http://n/", "only without a number " * 9), (1, "http://a/", same), (1, "http://a/", same), (20, "http://z/", "HTTP/1.0 200 OK\r\n\r\nin a page"), (21, "http://z/", "\n\n" * 80), (22, "http://z/", "\n\n" * 80)]
    df = spark.createDataFrame([(i, u, h, "clash", 5) for i, u, h in pages], "page_id long, url string, html string, record_type string, payload_bytes int").repartition(4)
    got = web_archive.archived_pages(df)
    assert rows_of(got.drop("url", "date")) == sorted(plain_archive([(i, h) for i, _, h in pages]), key=sort_key)
    assert {r["url"] for r in got.where("page_id = 1").collect()} == {"http://a/x%20y%0A", "http://a/"}
    assert rows_of(web_archive.archived_pages(df.limit(0))) == []


ARC_1 = b"filedesc://old.arc 0.0.0.0 19970101120000 text/plain 70\n1 0 Some Archive\nURL IP-address Archive-date Content-type Archive-length\n"
ARC_2 = b"filedesc://new.arc 0.0.0.0 20010203 text/plain 200 - - 0 new.arc 122\n2 0 Some Archive\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


def arc_file(head, records):
    first, _, block = head.partition(b"\n")
    return first.rsplit(b" ", 1)[0] + b" %d\n" % len(block) + block + b"\n" + b"".join(h + b" %d\n" % len(c) + c + b"\n" for h, c in records)


def test_arc_headers_by_version():
    body = b"HTTP/1.1 200 OK\nA: b\n\npayload\nhttp://not/a 1.1.1.1 20000101000000 text/html 5\n"
    one = arc_file(ARC_1, [(b"http://h/with space 9.8.7.6 19990102030405 text/html", body), (b"dns:h 9.8.7.6 1999 text/dns", b"h. 60 IN A 1.2.3.4\n")])
    two = arc_file(ARC_2, [(b"http://h/ 9.8.7.6 20010203040506 text/html 404 abc - 99 new.arc", body)])
    for data in (one, gzip.compress(one), gzip.compress(one[:100]) + gzip.compress(one[100:])):
        version, page, name = web_archive.arc_records(web_archive.opened(data), "old.arc")
        assert (version.url, page.url, page.ip, page.date, page.mime, page.status, page.content) == ("filedesc://old.arc", "http://h/with space", "9.8.7.6", "19990102030405", "text/html", None, body)
        assert name.content == b"h. 60 IN A 1.2.3.4\n"
        made = [web_archive.converted(r, "old.arc") for r in (version, page, name)]
        assert [c.kind for c in made] == ["warcinfo", "response", "resource"]
        assert (made[1].payload[:7], made[1].date, made[2].date, made[2].mime) == (b"payload", "1999-01-02T03:04:05Z", "1999-01-01T00:00:00Z", "text/dns")
        assert len({c.record_id for c in made}) == 3
    _, page = web_archive.arc_records(io.BytesIO(two), "new.arc")
    assert (page.status, page.mime, page.url) == ("404", "text/html", "http://h/")
    _, cut = web_archive.arc_records(io.BytesIO(two[:-20]), "new.arc")
    assert cut.truncated and b"WARC-Truncated: unspecified" in web_archive.response_record(web_archive.converted(cut, "new.arc"))
    for bad in (b"http://h/ 1.1.1.1 2000 text/html 3\nabc\n", one.replace(b"1 0 Some", b"7 0 Some"), two.replace(b" 404 abc", b"")):
        with pytest.raises(ValueError, match="x.arc"):
            list(web_archive.arc_records(io.BytesIO(bad), "x.arc"))


def test_foreign_archives_become_warc(spark, tmp_path):
    payload = b"\x89PNG\x00\xff\xfe" * 40
    record = b"HTTP/1.0 200 OK\r\n\r\n" + payload
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(arc_file(ARC_1, [(b"http://h/1 9.8.7.6 20000102030405 image/png", record), (b"http://h/2 9.8.7.6 19990102030405 image/png", record)]))
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(arc_file(ARC_2, [(b"https://h/3 9.8.7.6 20010203040506 image/png 200 - - 99 new.arc", record), (b"dns:h 9.8.7.6 2001 text/dns 0 - - 9 new.arc", b"name")])))
    out = folder(spark, "warc")
    web_archive.convert(spark, str(tmp_path / "in"), out)
    got = web_archive.read_warc(spark, out)
    by_url = {r["url"]: r for r in got.where("record_type <> 'warcinfo'").collect()}
    assert {u: r["record_type"] for u, r in by_url.items()} == {"http://h/1": "revisit", "http://h/2": "response", "https://h/3": "revisit", "dns:h": "resource"}
    assert all(by_url[u]["refers_to_id"] == by_url["http://h/2"]["record_id"] for u in ("http://h/1", "https://h/3"))
    assert {by_url[u]["payload_digest"] for u in ("http://h/1", "http://h/2", "https://h/3")} == {hashlib.sha256(payload).hexdigest()}
    assert got.where("not sound").count() == 0 and got.where("record_type = 'warcinfo'").count() == 2
    text = b"".join(gzip.decompress(bytes(r["content"])) for r in spark.read.format("binaryFile").load(out).collect())
    assert len(re.findall(rb"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n", text)) == 2 and text.endswith(b"\r\n\r\n")


def test_a_full_filter_moves_more_and_writes_the_same(spark, monkeypatch):
    pages = [(i, "http://a/", f"page {i % 7} " * 30) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    monkeypatch.setattr(key_filter, "of_keys", lambda keys, column, bits: key_filter.KeyFilter(np.full(bits // 64, (1 << 64) - 1, np.uint64)))
    assert rows_of(web_archive.archived_pages(df).drop("url", "date")) == sorted(plain_archive([(i, h) for i, _, h in pages]), key=sort_key)


def test_broken_records_are_named(spark, tmp_path):
    good = web_archive.response_record(web_archive.converted(web_archive.ArcRecord(0, "http://h/", "-", "2000", "text/html", None, b"HTTP/1.0 200 OK\r\n\r\nabc", False), "n"))
    (tmp_path / "x.warc").write_bytes(good.replace(b"\r\nabc", b"\r\nabd") + b"\r\n\r\n")
    assert [r["sound"] for r in web_archive.read_warc(spark, str(tmp_path)).collect()] == [False]
