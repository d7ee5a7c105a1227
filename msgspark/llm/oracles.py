"""DuckDB SQL with the same results, for the operators that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op10_minhash_near_dedup"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) >= 5
         THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes n ON n.doc_id = x.doc_id JOIN sizes m ON m.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id
  HAVING 100 * count(*) >= 85 * (any_value(n.n) + any_value(m.n) - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, least.component_id,
       d.doc_id = least.component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

ORACLES["op3_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

ORACLES["op2_line_dedup"] = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
starts AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM l),
windows AS (
  SELECT doc_id, p, row_number() OVER (
    PARTITION BY array_to_string(ls[p:p + 2], chr(10)) ORDER BY doc_id, p) AS nth
  FROM starts),
covered AS (
  SELECT DISTINCT doc_id, p + k AS i FROM windows, (VALUES (0), (1), (2)) AS t(k) WHERE nth > 1),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
marked AS (
  SELECT n.doc_id, n.line, n.i, c.i IS NOT NULL AS gone,
         c.i IS NOT NULL AND b.i IS NULL AS opens
  FROM lines n LEFT JOIN covered c ON c.doc_id = n.doc_id AND c.i = n.i
  LEFT JOIN covered b ON b.doc_id = n.doc_id AND b.i = n.i - 1)
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_removed,
       sum(opens::INT)::BIGINT AS n_spans,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op4_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT *, least(len(w), 13) AS size FROM b WHERE len(w) > 0),
       LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM d, (SELECT DISTINCT size FROM windows),
       LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)),
found AS (
  SELECT doc_id, item_id, i, g.size FROM grams g JOIN windows USING (size, s)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_TERMS = (
    "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

ORACLES["op11_lexical_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
sizes AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY doc_id, t),
weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, whole GROUP BY t),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
scores AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weights USING (t) JOIN sizes USING (doc_id), whole
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

ORACLES["op13_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
failed AS (
  SELECT doc_id, part,
         [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
          regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails
  FROM d),
patterns AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad
  FROM failed LEFT JOIN labels USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest(range(1, 6)) AS i),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS seq
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, seq, unnest(range(1, 6)) AS step FROM orders),
met AS (
  SELECT part, filter_order, step, seq[step] AS i, n, good, bad, fails[seq[step]] AS hit,
         len(list_filter(seq[1:step - 1], lambda x: fails[x])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) = 1 AS single
  FROM patterns, steps),
counts AS (
  SELECT part, filter_order, step, i,
         sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND hit THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN hit AND single THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND hit THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, i)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, i)::BIGINT AS shapley
FROM counts
"""
