"""DuckDB SQL of the operators that SQL can express, written apart from the Spark code."""

from __future__ import annotations

SPACES = r"[^\x20\x09-\x0D]+"

QUALITY_CTES = rf"""
d AS (SELECT row_number() OVER () AS r, *, coalesce(text, '') AS body FROM documents),
w AS (SELECT r, regexp_extract_all(body, '{SPACES}') AS ws, string_split(body, chr(10)) AS ls FROM d),
pos AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
tri AS (
  SELECT r, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM pos WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL)
  WHERE c >= 2),
reps AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r),
lines AS (SELECT r, unnest(ls) AS line FROM w),
linec AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines
  WHERE regexp_matches(line, '{SPACES}') GROUP BY r),
counts AS (
  SELECT d.r, len(ws) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
    coalesce(reps.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    len(list_filter(ws, lambda x: len(regexp_extract_all(x, '[A-Z]')) >= 2 AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words
  FROM d JOIN w USING (r) LEFT JOIN reps USING (r) LEFT JOIN linec USING (r)),
m AS (
  SELECT d.*, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbol_rate,
    CASE WHEN n_words > 0 THEN n_upper_words * 1000 // n_words ELSE 0 END AS upper_rate,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line_rate,
    CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_rate,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed
  FROM d JOIN counts USING (r)),
long AS (
  SELECT lang, source, measure, value - value % (1 << greatest(length(bin(value)) - 8, 0)) AS bin
  FROM (SELECT lang, source, unnest(['symbol_rate', 'upper_rate', 'dup_line_rate', 'repeat_rate']) AS measure,
               unnest([symbol_rate, upper_rate, dup_line_rate, repeat_rate]) AS value
        FROM m WHERE NOT base_failed)),
levels AS (
  SELECT 2 AS level, lang, source, measure, bin FROM long
  UNION ALL SELECT 1, lang, NULL, measure, bin FROM long
  UNION ALL SELECT 0, NULL, NULL, measure, bin FROM long),
fences AS (
  SELECT level, lang, source, measure, count(*) AS docs,
    list_sort(list(bin))[CAST(ceil(count(*) / 4.0) AS BIGINT)] AS q1,
    list_sort(list(bin))[CAST(ceil(count(*) * 3 / 4.0) AS BIGINT)] AS q3
  FROM levels GROUP BY ALL),
fence AS (
  SELECT level, lang, source, measure, docs, q3 + 3 * greatest(q3 - q1,
    CASE measure WHEN 'symbol_rate' THEN 50 WHEN 'upper_rate' THEN 50 WHEN 'dup_line_rate' THEN 120 ELSE 100 END) AS most
  FROM fences),
limits AS (
  SELECT g.lang, g.source, g.measure,
    CASE WHEN g.docs >= 100 THEN g.most WHEN l.docs >= 100 THEN l.most ELSE a.most END AS most
  FROM fence g JOIN fence l ON l.level = 1 AND l.measure = g.measure AND l.lang IS NOT DISTINCT FROM g.lang
    JOIN fence a ON a.level = 0 AND a.measure = g.measure WHERE g.level = 2),
broken AS (
  SELECT DISTINCT r FROM
    (SELECT r, lang, source, unnest(['symbol_rate', 'upper_rate', 'dup_line_rate', 'repeat_rate']) AS measure,
            unnest([symbol_rate, upper_rate, dup_line_rate, repeat_rate]) AS value FROM m) v
    JOIN limits t ON t.measure = v.measure AND t.lang IS NOT DISTINCT FROM v.lang
      AND t.source IS NOT DISTINCT FROM v.source
  WHERE value > most)
"""

NEAR_CTES = rf"""
p AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACES}') AS ws FROM documents),
sh AS (
  SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(ws) >= 2
    THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM p),
size AS (SELECT r, doc_id, count(*) AS n FROM sh GROUP BY ALL),
pair AS (SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.r < b.r GROUP BY ALL),
link AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM pair JOIN size x ON x.r = ra JOIN size y ON y.r = rb
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
step AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM step UNION SELECT reach.a, step.b FROM reach JOIN step ON reach.b = step.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
"""

LICENSE_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_sql() -> str:
    from .licenses import CONTAINMENT, PHRASES, TEMPLATES

    body = LOWER.format("coalesce(text, '')")
    phrases = ", ".join(f"('{label}', string_split('{p}', ' '))" for p, label in PHRASES.items())
    templates = ", ".join(f"('{n}', list_distinct(string_split('{t}', ' ')))" for n, t in TEMPLATES.items())
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {body} AS body FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(body, '{LICENSE_WORDS}') AS ws FROM d),
phrase(label, ps) AS (VALUES {phrases}),
template(name, ts) AS (VALUES {templates}),
pos AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
place AS (SELECT r, i - 1 AS i, label FROM pos JOIN phrase ON ws[i] = ps[1] AND ws[i:i + len(ps) - 1] = ps),
base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
  FROM place GROUP BY r),
line AS (SELECT r, list_distinct(regexp_extract_all(x, '{LICENSE_WORDS}')) AS ws
  FROM (SELECT r, unnest(string_split(body, chr(10))) AS x FROM d)),
held AS (SELECT r, name, len(list_intersect(ws, ts)) AS h, len(ts) AS n FROM line JOIN template ON list_has_any(ws, ts)),
matched AS (
  SELECT r, list(DISTINCT name) AS labels, max(h / n) AS score FROM held WHERE h * 100 >= {CONTAINMENT} * n GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(matched.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN matched USING (r)"""


def codes_sql() -> str:
    """The rounds of the codebooks, one after the other, every distance evaluated."""
    from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

    d = "sum((x - y) * (x - y))"
    rounds = []
    for r in range(ROUNDS + 1):
        # the least of (distance, entry): distance * ENTRIES + entry keeps both in one whole number
        rounds.append(f"""far{r} AS MATERIALIZED (SELECT r, p, min(m) AS m FROM (
  SELECT r, c.p, {d} * {ENTRIES} + e AS m FROM comp c JOIN book{r} b ON c.p = b.p AND c.i = b.i GROUP BY r, c.p, e) GROUP BY r, p)""")
        if r < ROUNDS:
            rounds.append(f"""moved{r} AS (SELECT c.p, f.m % {ENTRIES} AS e, c.i, sum(x) AS s, count(*) AS n
  FROM comp c JOIN far{r} f ON c.r = f.r AND c.p = f.p GROUP BY c.p, f.m % {ENTRIES}, c.i),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.i, CAST(CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS y
  FROM book{r} b LEFT JOIN moved{r} v ON b.p = v.p AND b.e = v.e AND b.i = v.i)""")
    last = f"far{ROUNDS}"
    return f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT CAST(ceil(max(len(q)) / {PARTS}) AS BIGINT) AS w FROM v),
comp AS MATERIALIZED (SELECT r, vec_id, j // w AS p, j % w AS i, coalesce(q[j + 1], 0) AS x
  FROM (SELECT r, vec_id, q, w, unnest(range(0, w * {PARTS})) AS j FROM v, width)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM v),
book0 AS MATERIALIZED (SELECT p, e, i, x AS y FROM comp JOIN first USING (r) WHERE e < {ENTRIES}),
{", ".join(rounds)},
coded AS (SELECT r, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM {last} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) FROM book{ROUNDS}) AS codebooks_sha256
FROM v JOIN coded USING (r)"""


LINKS_SQL = """WITH RECURSIVE u AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
    vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fit
  FROM embeddings),
n AS (SELECT r, vec_id, v, sqrt(list_inner_product(v, v)) AS size FROM u WHERE fit),
e AS MATERIALIZED (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM n a JOIN n b ON a.r <> b.r
  AND (a.v = b.v OR list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.9)),
reach AS (SELECT r, r AS at, vec_id AS id FROM n UNION SELECT reach.r, e.b, e.id FROM reach JOIN e ON reach.at = e.a),
least AS (SELECT r, min(id) AS component_id FROM reach GROUP BY r),
links AS (SELECT a AS r, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(vec_id = coalesce(component_id, vec_id), TRUE) AS kept, CAST(1 AS DOUBLE) AS audited_recall
FROM u LEFT JOIN least USING (r) LEFT JOIN links USING (r)"""


ORACLES = {
    "op11_near_vectors": LINKS_SQL,
    "op13_vector_codes": codes_sql(),
    "op6_licenses": license_sql(),
    "op9_exact_search": """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op3_near_duplicates": f"""WITH RECURSIVE {NEAR_CTES}
SELECT p.doc_id, coalesce(n, 0) AS n_shingles, least(p.doc_id, coalesce(m, p.doc_id)) AS component_id,
  p.doc_id = least(p.doc_id, coalesce(m, p.doc_id)) AS kept
FROM p LEFT JOIN size USING (r) LEFT JOIN least ON least.a = p.doc_id""",
    "op10_quality_rules": f"""WITH {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, symbol_rate, upper_rate, dup_line_rate,
  repeat_rate, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM broken) AS kept FROM m""",
}
