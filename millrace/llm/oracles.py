"""DuckDB SQL for the secret scans, the spelling variants and the lexical search."""

from __future__ import annotations

from millrace.llm import secret_scans

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: What precedes the value of an assignment.
BEFORE_VALUE = rf"(?:{secret_scans.KEYWORD})[\"'']?\x20*[:=]\x20*[\"'']?"
MATCHES = {"assign": BEFORE_VALUE + "[A-Za-z0-9+/_.=-]+", "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "run": "[A-Za-z0-9+/_=-]{20,}"}


def places(no: int, kind: str, pattern: str) -> str:
    """u, no, kind, s, e and v of each match; the texts between matches tell where they are."""
    found = f"regexp_extract_all(text, '{pattern}')"
    return (
        f"SELECT u, {no} AS no, '{kind}' AS kind, sum(length(gap)) OVER o + sum(length(v)) OVER o - length(v) AS s, sum(length(gap)) OVER o + sum(length(v)) OVER o AS e, v"
        f" FROM (SELECT u, unnest({found}) AS v, unnest(string_split_regex(text, '{pattern}')[1:len({found})]) AS gap, unnest(range(len({found}))) AS i FROM d) WINDOW o AS (PARTITION BY u ORDER BY i)"
    )


def share(c: str) -> str:
    """Probability of a pair by its count, smoothed by the second characters."""
    return f"({c} + {secret_scans.BACKOFF}::DOUBLE * ((sum({c}) OVER (PARTITION BY c))::DOUBLE + 1) / ((sum({c}) OVER ())::DOUBLE + 67)) / ((sum({c}) OVER (PARTITION BY a))::DOUBLE + {secret_scans.BACKOFF}::DOUBLE)"


#: Both models as tables of pairs; whole thousandths of a nat, as the operator has them.
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(places(k, kind, p) for k, (kind, p) in enumerate(MATCHES.items()))}),
b AS (SELECT * FROM (SELECT u, no, kind, s, e, CASE WHEN kind = 'assign' THEN regexp_replace(v, '^{BEFORE_VALUE}', '') ELSE v END AS v FROM m WHERE kind <> 'run') WHERE kind <> 'assign' OR length(v) >= 6),
r AS (SELECT * FROM m WHERE kind = 'run' AND regexp_matches(v, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.u = m.u AND b.s < m.e AND m.s < b.e)),
f AS (SELECT u, v, instr(text, v) - 1 AS s FROM (SELECT u, text, coalesce(list_filter(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{{secret_scans.ORDINARY},}}'), lambda x: NOT (regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]')))[1], '') AS v FROM d)),
ordinary AS (SELECT v FROM (SELECT DISTINCT v FROM f WHERE v <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.u = f.u AND b.s < f.s + length(f.v) AND f.s < b.e)) ORDER BY substr(md5(v), 1, 8), v LIMIT {secret_scans.SAMPLE}),
known AS (SELECT v FROM (SELECT DISTINCT v FROM b WHERE length(v) >= {secret_scans.KNOWN} AND regexp_matches(v, '[0-9]')) ORDER BY substr(md5(v), 1, 8), v LIMIT {secret_scans.SAMPLE}),
made AS (SELECT unnest([sha256(v)[1:32], upper(sha256(v)[1:32]), to_base64(unhex(sha256(v))), to_base64(unhex(sha256(v || '+'))), to_base64(unhex(sha256(v || '/')))]) AS v FROM (SELECT v FROM ordinary)),
strings AS (SELECT v, 0 AS random FROM ordinary UNION ALL SELECT v, 1 FROM known UNION ALL SELECT v, 1 FROM made),
p AS (SELECT random, substr(v, i, 1) AS a, substr(v, i + 1, 1) AS c FROM (SELECT random, v, unnest(range(1, length(v))) AS i FROM strings)),
l AS (SELECT unnest(string_split('{secret_scans.ALPHABET}', '')) AS c),
g AS (SELECT x.c AS a, y.c AS c, count(p.random) FILTER (random = 1) AS r, count(p.random) FILTER (random = 0) AS o FROM l x CROSS JOIN l y LEFT JOIN p ON p.a = x.c AND p.c = y.c GROUP BY 1, 2),
w AS (SELECT a || c AS pair, CAST(floor(1000 * ln(({share('r')}) / ({share('o')}))) AS BIGINT) AS w FROM g),
sc AS (SELECT u, s, e, v, sum(w) AS llr FROM (SELECT u, s, e, v, substr(v, i, 2) AS pair FROM (SELECT u, s, e, v, unnest(range(1, length(v))) AS i FROM r)) JOIN w USING (pair) GROUP BY u, s, e, v),
added AS (SELECT u, s, e FROM sc WHERE llr >= {secret_scans.MIN_LLR} AND len(list_distinct(string_split(v, ''))) >= {secret_scans.MIN_DISTINCT} AND (SELECT count(*) FROM ordinary) > 0),
base AS (SELECT u, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS listed, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM b GROUP BY u),
whole AS (SELECT u, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS listed, count(*) FILTER (kind = 'random') AS n_random FROM (SELECT u, no, kind, s, e FROM b UNION ALL SELECT u, 3, 'random', s, e FROM added) GROUP BY u)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base.listed, '')) AS base_sha256, coalesce(whole.listed, '') AS spans, coalesce(n_random, 0) AS n_random
FROM d LEFT JOIN base ON base.u = d.u LEFT JOIN whole ON whole.u = d.u
"""

#: CRC-32 by a table of 256 values, which eight steps make from their numbers.
OP12_SQL = r"""
WITH RECURSIVE step AS (SELECT i, 0 AS k, i AS x FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(x ORDER BY i) AS t FROM step WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL) GROUP BY doc_id, run),
bytes AS (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs),
sums AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM bytes, tab),
words AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, c FROM sums),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
g AS (SELECT word, left(word, i - 1) || '?' || substr(word, i + 1) AS gap, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT a.word AS x, b.word AS y FROM g a JOIN g b ON a.gap = b.gap AND a.word <> b.word UNION SELECT g.word, v.word FROM g JOIN v ON g.less = v.word UNION SELECT v.word, g.word FROM g JOIN v ON g.less = v.word),
f AS (SELECT x AS word, count(*) AS n_near, arg_min(y, (-n, y)) AS near, max(n) AS near_n FROM e JOIN v ON y = word GROUP BY x),
o AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN f USING (word)),
path AS (SELECT word, form AS target FROM o WHERE form IS NOT NULL UNION ALL SELECT path.word, o.form FROM path JOIN o ON o.word = path.target WHERE o.form IS NOT NULL),
ends AS (SELECT path.word, target FROM path JOIN o ON o.word = target WHERE o.form IS NULL)
SELECT o.word, o.n, n_near, form, form_n, coalesce(target, o.word) AS root FROM o LEFT JOIN ends USING (word)
"""

TERMS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, {TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
f AS (SELECT u, doc_id, n, t, count(*) AS tf FROM (SELECT u, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY u, doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s GROUP BY t, docs),
x AS (SELECT item_id, u, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l)))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN w USING (t), s GROUP BY item_id, u, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""
