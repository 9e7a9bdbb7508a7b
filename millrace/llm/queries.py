"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, jaccard_join, lexical_search, line_dedup, lm_scoring, oracles, packing, pii, quality_rules, secret_scans, shared, spelling, token_counts, url_filters, warc

#: Files of public tokenizers; read on every executor.
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, domains and first path segments of the pages, chosen by their MD5."""

    def draw(text: str | Column) -> Column:
        return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")

    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    first = F.regexp_extract("url", "^[a-z]+://([^/:?#]+/[^/?#]+)", 1)
    sites = pages.select(host.alias("host"), first.alias("first"))
    hosts = sites.select("host").distinct().withColumn("n", draw("host"))
    domains = hosts.select(F.substring_index("host", ".", -2).alias("key")).distinct().withColumn("n", draw("key"))
    prefixes = sites.where("first <> ''").select(F.col("first").alias("key")).distinct().withColumn("n", draw("key"))

    def entries(of: DataFrame, kind: str, key: str, chosen: str, action: str, day: str) -> DataFrame:
        return of.where(chosen).select(F.lit("derived").alias("list"), F.lit(kind).alias("kind"), F.col(key).alias("key"), F.lit(action).alias("action"), F.expr(f"date_add(DATE '2024-01-01', CAST({day} AS INT))").alias("day"))

    return (
        entries(hosts, "host", "host", "n % 3 = 0", "block", "n % 200")
        .union(entries(hosts, "host", "host", "n % 6 = 0", "remove", "n % 200 + 60"))
        .union(entries(hosts, "host", "host", "n % 12 = 0", "block", "n % 200 + 120"))
        .union(entries(hosts, "domain", "host", "n % 5 = 1", "allow", "n % 100"))
        .union(entries(domains, "domain", "key", "n % 2 = 0", "block", "150 + n % 50"))
        .union(entries(prefixes, "prefix", "key", "n % 4 = 0", "allow", "n % 300"))
        .union(entries(prefixes, "prefix", "key", "n % 8 = 0", "block", "n % 300 + 30"))
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(DATE '2024-01-01', CAST(page_id % 366 AS INT))").alias("fetched"))
    done = url_filters.decide(pages, derived_entries(pages))
    return done.select(F.col("row.page_id").alias("page_id"), F.col("row.fetched").alias("fetched"), "verdict", "kind", "key", "since")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "batch", "batch_row")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.marked(table(spark, sf_dir, "documents"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_deleted", F.sha2("rest", 256).alias("text_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.fresh(spark, "warc")
    records = warc.read(warc.write(table(spark, sf_dir, "pages"), folder), folder)
    return records.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.spans(table(spark, sf_dir, "documents"))
    counts = [pii.counted(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return done.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_context"), F.size(F.concat("base", "added")).cast("long").alias("n_spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return lm_scoring.scores(documents, lm_scoring.fit(documents))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.digest(secret_scans.spans(table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_warc": op5_warc,
    "op6_pii": op6_pii,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_secret_scans": op11_secret_scans,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lexical_search": op13_lexical_search,
}

OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM p),
v AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
h AS (SELECT v.doc_id, v.i, v.m, p.item_id FROM v JOIN p USING (m, phrase)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v WHERE r.c < e.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(c) AS component_id FROM r GROUP BY v) c USING (doc_id)
"""

#: Base32 of a SHA-1: five hexadecimal digits make four characters.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST(('0x' || substr(sha, CAST(5 * (k // 4) + 1 AS BIGINT), 5)) AS BIGINT) // (32 ** (3 - k % 4))::BIGINT) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM d
"""

OP1_SQL = r"""
WITH p AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
  regexp_extract(url, '^[a-z]+://([^/:?#]+/[^/?#]+)', 1) AS first, list_filter(string_split(regexp_extract(url, '^[^/]*//[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
h AS (SELECT DISTINCT host AS key, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS n FROM p),
d AS (SELECT DISTINCT array_to_string(list_slice(string_split(key, '.'), -2, -1), '.') AS key FROM h),
dn AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS n FROM d),
f AS (SELECT DISTINCT first AS key, CAST('0x' || substr(md5(first), 1, 6) AS BIGINT) AS n FROM p WHERE first <> ''),
e AS (SELECT 'host' AS kind, key, 2 AS rank, n % 200 AS day FROM h WHERE n % 3 = 0
  UNION ALL SELECT 'host', key, 0, n % 200 + 60 FROM h WHERE n % 6 = 0
  UNION ALL SELECT 'host', key, 2, n % 200 + 120 FROM h WHERE n % 12 = 0
  UNION ALL SELECT 'domain', key, 1, n % 100 FROM h WHERE n % 5 = 1
  UNION ALL SELECT 'domain', key, 2, 150 + n % 50 FROM dn WHERE n % 2 = 0
  UNION ALL SELECT 'prefix', key, 1, n % 300 FROM f WHERE n % 4 = 0
  UNION ALL SELECT 'prefix', key, 2, n % 300 + 30 FROM f WHERE n % 8 = 0),
u AS (SELECT kind, key, day, max(rank) AS rank FROM e GROUP BY kind, key, day),
v AS (SELECT *, lead(day) OVER (PARTITION BY kind, key ORDER BY day) AS until FROM u),
k AS (SELECT page_id, 'host' AS kind, host AS key, 1000000 AS weight FROM p
  UNION ALL SELECT page_id, 'domain', array_to_string(list_slice(l, i, len(l)), '.'), len(l) - i + 1 FROM (SELECT page_id, string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p)
  UNION ALL SELECT page_id, 'prefix', host || '/' || parts[1], 1000001 FROM p WHERE len(parts) > 0),
a AS (SELECT p.page_id, p.fetched, k.weight, v.rank, k.kind, k.key, CAST(DATE '2024-01-01' + CAST(v.day AS INTEGER) AS DATE) AS since FROM p JOIN k ON p.page_id = k.page_id
  JOIN v ON v.kind = k.kind AND v.key = k.key AND v.rank > 0 AND p.page_id % 366 >= v.day AND (v.until IS NULL OR p.page_id % 366 < v.until)),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, rank DESC, kind DESC, key DESC) AS r FROM a)
SELECT p.page_id, p.fetched, CASE b.rank WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS verdict, b.kind, b.key, b.since FROM p LEFT JOIN b ON p.page_id = b.page_id AND b.r = 1
"""

#: Runs of three lines are what every longer run consists of; a copy that overlaps the first one spares its lines.
OP3_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pos FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT *, lead(line, 1) OVER d AS l1, lead(line, 2) OVER d AS l2, row_number() OVER (PARTITION BY line ORDER BY doc_id, no) AS copy FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY no)),
f AS (SELECT *, first_value(doc_id) OVER g AS f_doc, first_value(pos) OVER g AS f_at FROM w WINDOW g AS (PARTITION BY line, l1, l2 ORDER BY doc_id, no)),
r AS (SELECT *, l2 IS NOT NULL AND (f_doc <> doc_id OR f_at <> pos) AS run, CASE WHEN f_doc = doc_id THEN pos - f_at ELSE 3 END AS far FROM f),
g AS (SELECT doc_id, no, (copy > 1 AND length(line) >= 60) OR (run AND far >= 3) OR coalesce(lag(run AND far >= 2, 1) OVER d, false) OR coalesce(lag(run AND far >= 1, 2) OVER d, false) AS gone
      FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY no)),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(gone, false)) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (NOT coalesce(gone, false)), '') AS rest
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted, sha256(rest) AS text_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""

#: A word lies in a repeat of at least eight words if it lies in an eight-word window found twice; a repeat is longer than
#: fifty words if a window of fifty-one is found twice.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, hash(unnest(w)) AS h1, len(w) AS n FROM d),
h2 AS (SELECT *, hash(h1, lead(h1, 1) OVER o) AS h2, lead(h1, 4) OVER o AS f, lead(h1, 50) OVER o AS z FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h4 AS (SELECT *, hash(h2, lead(h2, 2) OVER o) AS h4, lead(h2, 48) OVER o AS y FROM h2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h8 AS (SELECT *, hash(h4, f) AS h5, hash(h4, lead(h4, 4) OVER o) AS h8 FROM h4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h16 AS (SELECT *, hash(h8, lead(h8, 8) OVER o) AS h16 FROM h8 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h51 AS (SELECT *, hash(h16, lead(h16, 16) OVER o, lead(h16, 32) OVER o, y, z) AS h51 FROM h16 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, i + 4 <= n AND count(*) FILTER (i + 4 <= n) OVER (PARTITION BY doc_id, h5) > 1 AS t5, i + 7 <= n AND count(*) FILTER (i + 7 <= n) OVER (PARTITION BY doc_id, h8) > 1 AS t8,
        i + 50 <= n AND count(*) FILTER (i + 50 <= n) OVER (PARTITION BY doc_id, h51) > 1 AS t51 FROM h51),
c AS (SELECT doc_id, t51, bool_or(t5) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS twice, bool_or(t8) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM t),
r AS (SELECT doc_id, count(*) FILTER (twice) AS twice, count(*) FILTER (inside) AS inside, bool_or(t51) AS long FROM c GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
a AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(twice, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(inside, 0) AS BIGINT) AS n_covered_words, coalesce(long, false) AS long
      FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN l ON d.doc_id = l.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_covered_words > 12 * n_words OR long) AS kept
FROM a
"""

ORACLES: dict[str, str] = {
    "op1_url_filters": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op7_decontamination": OP7_SQL,
    "op9_quality_rules": OP9_SQL,
    "op11_secret_scans": oracles.OP11_SQL,
    "op12_spelling_variants": oracles.OP12_SQL,
    "op13_lexical_search": oracles.OP13_SQL,
}
