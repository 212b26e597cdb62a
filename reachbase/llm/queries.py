"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reachbase.llm import (
    collocations,
    fingerprint,
    kneser_ney,
    language_id,
    mixing,
    near_dedup,
    quality_rules,
    secret_scan,
    sentencepiece_fst,
    sharding,
    target_resampling,
    url_filter,
    web_archive,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The entries that op1 judges by.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), [url_filter.Rule.parse(*r) for r in URL_RULES])


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_with_following(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


#: The model that op5 and the pipeline encode with.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode_documents(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_archive.archived_pages(_table(spark, sf_dir, "pages")).drop("url", "date")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; it imports this package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_fingerprints": op2_fingerprints,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_secret_scans": op4_secret_scans,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_sharding": op6_sharding,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_target_resampling": op11_target_resampling,
    "op12_collocations": op12_collocations,
    "op13_web_archive": op13_web_archive,
    "pipeline": pipeline,
}
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _crc_table() -> str:
    """The table of CRC-32 from its polynomial, as a SQL list."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return "[" + ", ".join(map(str, out)) + "]"


def _resampling_sql() -> str:
    """Weights as plain sums of gains; checksums are taken once for each distinct word."""
    r = target_resampling
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda p: (strpos('0123456789ABCDEF', p[1]) - 1) * 16 + strpos('0123456789ABCDEF', p[2]) - 1)), lambda c, y: xor({_crc_table()}[(xor(c, y) & 255) + 1], c >> 8)))"
    split = rf"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {split} AS w FROM documents),
source_word AS (SELECT row, unnest(w) AS x FROM d),
target_word AS (SELECT unnest({split}) AS x FROM benchmark),
bucket_of AS (SELECT x, ({crc} % {r.BUCKETS})::bigint AS bucket FROM (SELECT x FROM source_word UNION SELECT x FROM target_word)),
s AS (SELECT bucket, count(*) AS s FROM source_word JOIN bucket_of USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_word JOIN bucket_of USING (x) GROUP BY bucket),
every AS (SELECT b AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t, (SELECT count(*) FROM source_word) AS all_s, (SELECT count(*) FROM target_word) AS all_t FROM range({r.BUCKETS}) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::double * (all_s + {r.BUCKETS})::double) / ((s + 1)::double * (all_t + {r.BUCKETS})::double)))::bigint AS gain FROM every),
summed AS (SELECT row, count(*) AS n, sum(gain)::bigint AS total FROM source_word JOIN bucket_of USING (x) JOIN gain USING (bucket) GROUP BY row),
weighed AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
         ('0x' || substr(sha256('{r.SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint AS h FROM d LEFT JOIN summed USING (row)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place, n_features, weight, score, count(*) OVER () AS able FROM scored WHERE n_features >= {r.MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= able * {r.PERCENT} // 100 THEN place END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < {r.MIN_WORDS}"""


def _collocations_sql() -> str:
    """All phrases counted at once."""
    c = collocations
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM piece, range(1, len(w) - {k - 2}) r(i)" for k in range(1, c.LONGEST + 1))
    return rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[.,;:!?
-
]')) AS piece FROM documents),
piece AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM texts),
found AS (SELECT lang, k, phrase, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {c.LEAST}),
totals AS (SELECT lang, sum(len(w))::bigint AS n FROM piece GROUP BY lang),
candidate AS (SELECT *, string_split(phrase, ' ') AS v FROM found WHERE k > 1),
cut AS (SELECT lang, k, phrase, a, c, array_to_string(v[1:c], ' ') AS x, array_to_string(v[c + 1:k], ' ') AS y FROM candidate, range(1, k) q(c)),
rated AS (
  SELECT cut.lang, cut.phrase, cut.a, l.a AS l, r.a AS r, c, (2000000::hugeint * cut.a // (l.a + r.a))::bigint AS score
  FROM cut JOIN found l ON l.lang = cut.lang AND l.phrase = x JOIN found r ON r.lang = cut.lang AND r.phrase = y),
weakest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_part AS (SELECT lang, array_to_string(v[i:i + m - 1], ' ') AS phrase, a FROM candidate, range(2, k) q(m), range(1, k - m + 2) p(i)),
kept AS (SELECT * FROM weakest w WHERE NOT EXISTS (SELECT 1 FROM inner_part i WHERE i.lang = w.lang AND i.phrase = w.phrase AND 100 * i.a >= {c.ABSORBED} * w.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {c.TOP}"""


def _quality_sql() -> str:
    """The rules in long form: a row for each document and bin of its histograms."""
    q = quality_rules
    classes = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "stop": """[.,:;!?\'\'"()-]""", "symbol": "[#*$%&|<>]", "wide": r"[^\x00-\x7F]"}
    counts = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {c}_" for c, p in classes.items())
    listed = ", ".join(f"('{c}', {c}_)" for c in classes) + ", ('other', length(text) - " + " - ".join(f"{c}_" for c in classes) + ")"
    middle, upper = (f"quantile_disc(word_distance, {x})" for x in (0.5, 0.75))
    limit = f"round({middle} + {q.WORD_SPREADS} * ({upper} - {middle}), 6)"
    length = " + ".join(f"(n_words >= {n})::int" for n in q.LENGTHS)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, lang, text, w, len(w) AS n_words, {counts} FROM d),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
gram AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM (SELECT doc_id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE z IS NOT NULL),
again AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM gram CROSS JOIN range(3) r(j) WHERE n > 1 GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
size AS (SELECT doc_id, sum(length(x))::bigint AS word_chars FROM word GROUP BY doc_id),
counted AS (
  SELECT c.doc_id, lang, n_words, coalesce(word_chars, 0) AS word_chars, symbol_ AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) AS chars,
         n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed, {length} AS of_length
  FROM c LEFT JOIN again USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN size USING (doc_id)),
base AS (SELECT *, NOT base_failed AND n_symbols <= {q.MAX_REFERENCE_SYMBOLS}::double * word_chars AS sound FROM counted),
lower_word AS (SELECT base.doc_id, lang, sound, translate(x, {_LETTERS}) AS y, count(*) AS n FROM word JOIN base USING (doc_id) GROUP BY ALL),
ranked AS (SELECT lang, y, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, y) AS place FROM lower_word WHERE sound GROUP BY lang, y),
common AS (SELECT lang, y FROM ranked WHERE place <= {q.COMMON_WORDS}),
histogram AS (
  SELECT doc_id, 'class' AS kind, v.bin, v.n FROM c, LATERAL (VALUES {listed}) v(bin, n)
  UNION ALL SELECT doc_id, 'word', coalesce(k.y, ''), sum(w.n) FROM lower_word w LEFT JOIN common k ON k.lang IS NOT DISTINCT FROM w.lang AND k.y = w.y GROUP BY ALL),
summed AS (SELECT lang, kind, bin, sum(n) AS n FROM histogram JOIN base USING (doc_id) WHERE sound GROUP BY ALL),
bins AS (SELECT lang, kind, bin FROM summed UNION SELECT lang, 'word', '' FROM summed),
reference AS (SELECT lang, kind, bin, n / sum(n) OVER (PARTITION BY lang, kind) AS q FROM summed),
grid AS (
  SELECT base.doc_id, bins.kind, coalesce(h.n, 0) / nullif(sum(h.n) OVER (PARTITION BY base.doc_id, bins.kind), 0) AS p, coalesce(r.q, 0) AS q
  FROM base JOIN bins ON bins.lang IS NOT DISTINCT FROM base.lang LEFT JOIN histogram h ON h.doc_id = base.doc_id AND h.kind = bins.kind AND h.bin = bins.bin
  LEFT JOIN reference r ON r.lang IS NOT DISTINCT FROM base.lang AND r.kind = bins.kind AND r.bin = bins.bin),
distance AS (
  SELECT doc_id, kind, round(sqrt(greatest(0.0::double, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)), 6) AS d FROM grid WHERE p IS NOT NULL GROUP BY doc_id, kind),
rated AS (
  SELECT base.*, CASE WHEN chars >= {q.MIN_CHARS} THEN a.d END AS class_distance, CASE WHEN n_words >= {q.MIN_WORDS} THEN b.d END AS word_distance
  FROM base LEFT JOIN distance a ON a.doc_id = base.doc_id AND a.kind = 'class' LEFT JOIN distance b ON b.doc_id = base.doc_id AND b.kind = 'word'),
of_lengths AS (SELECT lang, of_length, {limit} AS word_limit FROM rated WHERE sound AND word_distance IS NOT NULL GROUP BY lang, of_length HAVING count(*) >= {q.MIN_REFERENCES}),
of_langs AS (SELECT lang, {limit} AS word_limit FROM rated WHERE sound AND word_distance IS NOT NULL GROUP BY lang HAVING count(*) >= {q.MIN_REFERENCES}),
limited AS (
  SELECT r.*, coalesce(a.word_limit, b.word_limit) AS word_limit
  FROM rated r LEFT JOIN of_lengths a ON a.lang IS NOT DISTINCT FROM r.lang AND a.of_length = r.of_length LEFT JOIN of_langs b ON b.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(class_distance <= {q.MAX_CLASS_DISTANCE}::double, true) AND coalesce(word_distance <= word_limit, true) AS kept, class_distance, word_distance, word_limit
FROM limited"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": f"""
WITH rules(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), rest AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LETTERS}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), best AS (
  SELECT s.host, s.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM split) s
  JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  GROUP BY s.host, s.path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (host, path)
""",
    # The texts' bytes come from their hexadecimal form.
    "op6_sharding": f"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) + 1 AS size FROM documents
), bytes AS (
  SELECT doc_id, size, list_transform(regexp_extract_all(h, '..'), lambda p: (strpos('0123456789ABCDEF', p[1]) - 1) * 16 + strpos('0123456789ABCDEF', p[2]) - 1) AS b FROM raw
), sized AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor({_crc_table()}[(xor(c, x) & 255) + 1], c >> 8)))::bigint AS text_crc32 FROM bytes
), placed AS (
  SELECT *, sum(size) OVER () AS total, coalesce(sum(size) OVER w, 0) AS before, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS i
  FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT *, CAST(least(7, ((2 * before + size) * 8) // (2 * total)) AS int) AS shard FROM placed
)
SELECT doc_id, CAST(size AS bigint) AS size, text_crc32, 'bytes' AS law, shard, i - min(i) OVER (PARTITION BY shard) AS slot, CAST(NULL AS int) AS grown_shard FROM cut
""",
    "op8_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), totals AS (
  SELECT source, sum(size)::bigint AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM totals
), weighted AS (
  SELECT *, [5, 2, 1][r % 3 + 1] AS w, [0.5, 0.0, -0.5][r % 3 + 1]::double AS a, 2 * source_size AS cap FROM ranked
), tried AS (
  SELECT *, row_number() OVER (ORDER BY cap::double / w, r) AS place,
    (sum(source_size) OVER () * 1.5::double - coalesce(sum(cap) OVER e, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER e, 0)) AS level
  FROM weighted WINDOW e AS (ORDER BY cap::double / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT *, least(cap::double, (SELECT arg_min(level, place) FROM tried WHERE level * w <= cap) * w) AS target FROM tried
), placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.a, coalesce(sum(s.size) OVER (PARTITION BY g.r ORDER BY md5(coalesce(s.doc_id::varchar, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), mixed AS (
  SELECT *, greatest(0, least(size, floor(target)::bigint - before)) AS once, greatest(0, least(size, floor(target)::bigint - before - source_size)) AS twice, before / target AS y FROM placed
)
SELECT doc_id, size::bigint AS size, source_size, target, (once + twice)::bigint AS taken, CASE WHEN once > 0 THEN round(2 * y / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * y)), 6) END AS position FROM mixed
""",
    "op9_near_dedup": rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split
), sizes AS (
  SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN shingles USING (doc_id) GROUP BY d.doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reached AS (
  SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.seen = l.a
)
SELECT doc_id, n AS n_shingles, min(seen) AS component_id, min(seen) = doc_id AS kept FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n
""",
    "op10_quality_rules": _quality_sql(),
    "op11_target_resampling": _resampling_sql(),
    "op12_collocations": _collocations_sql(),
    "op13_web_archive": f"""
WITH payload AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
placed AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) > 1 AND payload_bytes >= {web_archive.MIN_SHARED_BYTES} AS again, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM payload)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM placed
""",
}
