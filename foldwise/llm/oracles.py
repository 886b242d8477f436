"""DuckDB SQL of the queries that SQL can express."""
import string

from foldwise.llm import licenses
from foldwise.llm.license_rules import word_regex

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a text as a list.
_WORDS = f"list_filter(string_split_regex({_LOWER}, '{_GAP}'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licenses_sql() -> str:
    rules = [(r["label"], r["priority"], r["keyword"], r["regex"]) for r in licenses.rule_table()] + [(label, 0, f" {k} ", word_regex(p)) for (p, label), k in zip(licenses.BASE, licenses.BASE_KEYWORDS)]
    table = ", ".join(f"({_quoted(a)}, {b}, {_quoted(c)}, {_quoted(d)})" for a, b, c, d in rules)
    n = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    score = " ".join(f"WHEN max(priority) = {p} THEN {s}" for p, s in licenses.SCORES.items())
    return rf"""
WITH inner_words AS (SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace({_LOWER}, '{_GAP}', '  ', 'g')) AS t FROM documents),
w AS (SELECT r, doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS w FROM inner_words),
rules(label, priority, keyword, regex) AS (VALUES {table}),
hits AS (SELECT r, label, priority, string_split_regex(w, regex) AS gaps, regexp_extract_all(w, regex) AS found FROM w JOIN rules ON contains(w, keyword)),
each AS (SELECT r, label, priority, gaps, found, unnest(range(1, len(found) + 1)) AS i FROM hits WHERE len(found) > 0),
places AS (SELECT DISTINCT r, label, priority, coalesce(list_sum(list_transform(gaps[1:i], lambda x: {n('x')})), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: {n('x')})), 0) AS first, {n('found[i]')} AS n FROM each),
base AS (SELECT r, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places WHERE priority = 0 GROUP BY r),
kept AS (SELECT * FROM places d WHERE priority > 0 AND NOT EXISTS (SELECT 1 FROM places e WHERE e.r = d.r AND e.priority >= d.priority AND e.first <= d.first AND e.first + e.n >= d.first + d.n
  AND (e.first, -e.n, -e.priority, e.label) < (d.first, -d.n, -d.priority, d.label))),
scores AS (SELECT r, CASE {score} END AS score FROM kept GROUP BY r),
labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM kept UNION SELECT r, label FROM places WHERE priority = 0) GROUP BY r)
SELECT doc_id, CAST({n('w')} AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN scores USING (r) LEFT JOIN labels USING (r)"""


#: Five hexadecimal digits are four base-32 digits.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
d AS (SELECT page_id, strlen(html) AS n, html, list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * k)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS digest FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (html)"""

CONTAMINATION_SQL = f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM iw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n)),
found AS (SELECT r, i, n, item FROM grams JOIN windows USING (n, g)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hits USING (r) LEFT JOIN items USING (r)"""

TOPK_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT r, unnest(e) AS x, unnest(range(len(e))) AS i FROM v),
dots AS (SELECT a.r AS q, b.r AS r, sum(a.x * b.x) AS s FROM c a JOIN c b USING (i) WHERE a.r IN (SELECT r FROM v WHERE vec_id % 50 = 0) GROUP BY 1, 2),
ranked AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(s, 0) AS BIGINT) AS score, row_number() OVER (PARTITION BY a.r ORDER BY coalesce(s, 0) DESC, b.vec_id NULLS LAST) AS rank
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id LEFT JOIN dots ON dots.q = a.r AND dots.r = b.r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""

LEXICAL_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
sized AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n FROM d WHERE len(ws) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) GROUP BY r, t),
wanted AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(ws) AS t FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark))),
held AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals WHERE t IN (SELECT t FROM wanted) GROUP BY t, n_docs),
scores AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS score
  FROM wanted JOIN held USING (t) JOIN tf USING (t) JOIN sized USING (r), totals GROUP BY item_id, r),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores JOIN sized USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10"""

#: crc32 of a decimal's digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))))"""

TRIE_SQL = f"""
WITH t AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, k, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS first_id, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (SELECT c.conv_id, 0 AS part, p, k, bytes FROM c JOIN o ON o.conv_id = first_id AND p <= h UNION ALL SELECT c.conv_id, 1, p, k, bytes FROM c JOIN o ON o.conv_id = c.conv_id AND p > h),
placed AS (SELECT conv_id, k, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d FROM parts),
steps AS (SELECT conv_id, d, bytes, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS node FROM placed),
sizes AS (SELECT c.conv_id, coalesce(max(d), 0) AS n FROM c LEFT JOIN placed USING (conv_id) GROUP BY c.conv_id),
members AS (SELECT conv_id, d, bytes, node FROM steps UNION ALL SELECT conv_id, 0, 0, '' FROM c),
nodes AS (SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CASE WHEN d = n THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends FROM members JOIN sizes USING (conv_id) GROUP BY node),
children AS (SELECT left(node, 64 * (depth - 1)) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
above AS (SELECT left(node, 64 * a) AS node, n_children, (n_convs - 1) * bytes AS saved FROM (SELECT *, unnest(range(depth + 1)) AS a FROM own)),
sums AS (SELECT node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved FROM above GROUP BY node)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, y.conv_id AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs, CAST(x.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM own x JOIN sums USING (node) LEFT JOIN own y ON x.depth > 0 AND y.node = left(x.node, 64 * (x.depth - 1))"""
