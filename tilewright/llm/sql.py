"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT item_id, list_slice(w, i, i + 9) AS win
  FROM item, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
runs AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
  FROM doc, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i)
),
found AS (SELECT r.doc_id, r.i, r.n, x.item_id FROM runs r JOIN wins x ON r.win = x.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

OP5 = r"""
WITH given AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
),
turns AS (
  SELECT *, row_number() OVER w - 1 AS nth, coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    20 + length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '\\|<s>|</s>|\[INST\]|\[/INST\]')) AS chars
  FROM (SELECT *, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\x09-\x0D ]')) + 4 AS tokens FROM given)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
spanned AS (SELECT *, start // 384 AS span FROM turns),
system AS (SELECT conv_id, tokens AS system_tokens, chars AS system_chars FROM turns WHERE nth = 0 AND role = 'system'),
own AS (SELECT conv_id, span, sum(tokens) AS tokens, sum(chars) AS chars, min(start) AS first, min(nth) > 0 AS later FROM spanned GROUP BY conv_id, span),
win AS (
  SELECT o.*, later AND s.conv_id IS NOT NULL AS again, system_chars, least(128, 512 - o.tokens - CASE WHEN later THEN coalesce(system_tokens, 0) ELSE 0 END) AS room
  FROM own o LEFT JOIN system s USING (conv_id)
),
shown AS (
  SELECT w.conv_id, w.span, any_value(w.chars + CASE WHEN again THEN system_chars ELSE 0 END) + coalesce(sum(t.chars), 0) AS chars
  FROM win w LEFT JOIN spanned t ON t.conv_id = w.conv_id AND t.span = w.span - 1 AND w.first - t.start <= w.room AND NOT (again AND t.nth = 0)
  GROUP BY w.conv_id, w.span
),
formatted AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM shown GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
FROM turns JOIN formatted USING (conv_id) GROUP BY conv_id
"""

OP9 = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS s
  FROM doc WHERE len(w) > 0
),
node AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(doc_id)) AS node, s, len(s) AS n FROM sets GROUP BY s),
part AS (SELECT node, n, unnest(s) AS x FROM node),
pair AS (
  SELECT a.node AS a, b.node AS b FROM part a JOIN part b ON a.x = b.x AND a.node < b.node
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT node, node AS top FROM node UNION SELECT link.b, reach.top FROM reach JOIN link ON link.a = reach.node WHERE reach.top < link.b),
label AS (SELECT node, min(top) AS label FROM reach GROUP BY node),
degree AS (SELECT a AS node, count(*) AS n_links FROM link GROUP BY a),
member AS (SELECT doc_id, n, node, label FROM sets JOIN node USING (s) JOIN label USING (node)),
least_id AS (SELECT label, min(doc_id) AS component_id FROM member GROUP BY label)
SELECT d.doc_id, coalesce(m.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(g.n_links, 0) AS n_links
FROM doc d LEFT JOIN member m USING (doc_id) LEFT JOIN least_id l USING (label) LEFT JOIN degree g USING (node)
"""

OP10 = r"""
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
piece AS (
  SELECT doc_id, p, substr(t, p, 2798) AS x FROM (SELECT doc_id, t, unnest(generate_series(1, len(t) - 799, 2000)) AS p FROM doc WHERE len(t) >= 800)
),
start AS (SELECT doc_id, p, unnest(generate_series(1, len(x) - 799, 2)) AS k, x FROM piece),
cut AS MATERIALIZED (SELECT doc_id, p + k - 1 AS i, md5_number(substr(x, k, 800)) AS c FROM start),
often AS (SELECT c FROM cut GROUP BY c HAVING count(*) > 1),
gone AS (SELECT doc_id, (i - 1) // 2 AS i FROM cut SEMI JOIN often USING (c)),
step AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM gone),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM step),
span AS (SELECT doc_id, r, min(i) AS lo, max(i) + 400 AS hi FROM run GROUP BY doc_id, r),
spans AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed FROM span GROUP BY doc_id),
edge AS (
  SELECT doc_id, hi AS lo, lead(lo, 1) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM span
  UNION ALL SELECT doc_id, 0, min(lo) FROM span GROUP BY doc_id
),
kept AS (
  SELECT doc_id, string_agg(substr(t, 2 * lo + 1, 2 * (coalesce(hi, len(t) // 2) - lo)), '' ORDER BY lo) AS t
  FROM edge JOIN doc USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, len(d.t) // 2 AS n_bytes, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.t, d.t))) AS kept_sha256
FROM doc d LEFT JOIN spans s USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

OP12 = r"""
WITH doc AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS c
  FROM doc, LATERAL (SELECT unnest(generate_series(1, len(w) - 19)) AS i)
),
placed AS (SELECT doc_id, i, rank() OVER (PARTITION BY c ORDER BY doc_id NULLS FIRST, i) AS nth FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS k FROM placed WHERE nth > 1),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM doc),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_decontamination": OP2, "op5_chat_formatting": OP5, "op9_jaccard_join": OP9, "op10_suffix_dedup": OP10, "op12_substring_dedup": OP12}
