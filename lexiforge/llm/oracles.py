"""DuckDB SQL for those queries of this subpackage that SQL can express over whole tables (doc_id is unique there)."""

OP1_NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL
), grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM words WHERE len(w) > 0
), sets AS (
  SELECT min(doc_id) AS head, g, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM grams) GROUP BY g
), members AS (
  SELECT d.doc_id, s.head, s.n FROM (SELECT doc_id, list_sort(g) AS g FROM grams) d JOIN sets s ON d.g = s.g
), tokens AS (
  SELECT head, n, unnest(g) AS t FROM sets
), links AS (
  SELECT a.head AS x, b.head AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.head <> b.head
  GROUP BY a.head, b.head, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT head AS x, head AS y FROM sets
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), labels AS (
  SELECT x AS head, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(m.n, 0)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN members m ON d.doc_id = m.doc_id LEFT JOIN labels l ON m.head = l.head
"""

OP5_LINE_QUALITY = r"""
WITH texts AS (
  SELECT doc_id, coalesce('=' || source, '-') AS host, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM split
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS place, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS own FROM split
), often AS (
  SELECT doc_id, place FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, own) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT place + k) AS n FROM often, range(0, 3) r(k) GROUP BY doc_id
), raw_lines AS (
  SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS raw FROM texts
), lines AS (
  SELECT doc_id, host, text, raw, len(w) AS words, array_to_string(w, ' ') AS line FROM (
    SELECT *, regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM raw_lines) WHERE len(w) > 0
), duplicates AS (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM lines GROUP BY doc_id
), frequent AS (
  SELECT host, line, count(DISTINCT text) AS docs, arg_min(text, doc_id) AS first_text FROM lines GROUP BY host, line
), hosts AS (
  SELECT host, count(DISTINCT text) AS host_docs FROM texts GROUP BY host
), gone AS (
  SELECT l.doc_id, sum(l.words) AS n FROM lines l JOIN frequent f ON l.host = f.host AND l.line = f.line JOIN hosts h ON l.host = h.host
  WHERE f.docs > 20 AND f.docs * 100 > h.host_docs AND l.text <> f.first_text GROUP BY l.doc_id
), judged AS (
  SELECT b.*, coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS removed_words
  FROM base b LEFT JOIN duplicates d ON b.doc_id = d.doc_id LEFT JOIN repeated r ON b.doc_id = r.doc_id LEFT JOIN gone g ON b.doc_id = g.doc_id
), verdict AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM judged
)
SELECT *, NOT base_failed AND 100 * (n_words - removed_words) >= 50 * n_words AS kept FROM verdict
"""

ORACLES = {"op1_ngram_join": OP1_NGRAM_JOIN, "op5_line_quality": OP5_LINE_QUALITY}
