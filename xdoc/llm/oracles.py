"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from .linededup import MIN_SITES, MIN_WORDS

_SPACE = r"[\x20\x09-\x0D]"

_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLES = {
    "op2_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(v, l) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.l FROM reach r JOIN edges e ON e.a = r.v)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT v AS doc_id, min(l) AS component_id FROM reach GROUP BY 1) c USING (doc_id)""",
    "op9_quality": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, {_WORDS}) AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS ls FROM t
), grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM grams) WHERE k > 1
), covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1
), base AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines, len(list_distinct(ws)) AS n_distinct,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS letters
  FROM w LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > n_lines OR 5 * upper > 2 * letters OR 5 * letters < 3 * word_chars OR 5 * digits > word_chars OR 20 * n_distinct < n_words AS rejected
  FROM base
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged""",
    "op8_toolcalls": """
WITH RECURSIVE u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'
), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'
), levels AS (
  SELECT conv_id, turn, 0 AS level FROM u WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL SELECT u.conv_id, u.turn, l.level + 1 FROM levels l JOIN u ON u.conv_id = l.conv_id AND u.turn = l.turn + 2
), rows_ AS (
  SELECT u.conv_id, u.turn, u.conv_id || ':' || u.turn AS call_id, 'call' AS kind, CASE WHEN a.conv_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, l.level, CASE WHEN a.conv_id IS NULL THEN 0 ELSE 1 END AS n_results, '' AS errors,
    '{"arguments":{"text":' || to_json(u.text) || ',"turn":' || u.turn || '},"id":"' || u.conv_id || ':' || u.turn || '","name":"reply","result":' || coalesce(CAST(to_json(a.text) AS VARCHAR), 'null') || '}' AS canonical
  FROM u JOIN levels l USING (conv_id, turn) LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  UNION ALL SELECT a.conv_id, a.turn, a.conv_id || ':' || (a.turn - 1), 'orphan', 'orphan', NULL, 1, '', '{"id":"' || a.conv_id || ':' || (a.turn - 1) || '","result":' || to_json(a.text) || '}'
  FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = a.conv_id AND u.turn = a.turn - 1)
  UNION ALL SELECT conv_id, turn, NULL, 'message', 'message', NULL, 0, '', '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' FROM conversations WHERE role NOT IN ('user', 'assistant')
)
SELECT conv_id, turn, call_id, kind, status, CAST(level AS BIGINT) AS level, CAST(n_results AS BIGINT) AS n_results, errors, canonical FROM rows_""",
    "op10_lines": rf"""
WITH lines AS (
  SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents
), trimmed AS (
  SELECT doc_id, source, pos, raw, regexp_replace(raw, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS line FROM lines
), counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {MIN_WORDS} AS counts FROM trimmed
), spread AS (
  SELECT line, count(DISTINCT source) AS sites, min(doc_id) AS first_doc FROM counted WHERE counts GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT c.doc_id, c.pos, c.raw, s.line IS NOT NULL AND c.doc_id <> s.first_doc AS gone FROM counted c LEFT JOIN spread s ON c.counts AND c.line = s.line
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept_text FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, CAST(length(coalesce(k.kept_text, '')) AS BIGINT) AS kept_chars, sha256(coalesce(k.kept_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)""",
}
