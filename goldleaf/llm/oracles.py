"""DuckDB SQL with the results of those corpus queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
                      WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM words
), flat AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), arcs AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT reach.u, arcs.v FROM reach JOIN arcs ON reach.v = arcs.u
), least AS (
  SELECT u, min(v) AS component_id FROM reach GROUP BY u
)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON doc_id = u
"""

OP2 = r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id
"""

OP3 = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, line, n, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN often USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8 = """
WITH whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
grouped AS (SELECT *, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size FROM whole)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM grouped
"""

OP9 = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), weighted AS (
  SELECT *, 1 + (rank - 1) % 3 AS weight, 3 * source_size AS most FROM sources
), placed AS (
  SELECT *, row_number() OVER (ORDER BY CAST(most AS DOUBLE) / weight, rank) AS place FROM weighted
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM placed
), targets AS (
  SELECT source, source_size, weight, least(CAST(most AS DOUBLE), (SELECT arg_min(level, place) FROM levels WHERE level * weight <= most) * weight) AS target FROM levels
), axis AS (
  SELECT doc_id, size, source_size, target, weight,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized JOIN targets USING (source)
), copies AS (
  SELECT *, list_filter([start, source_size + start, 2 * source_size + start], lambda s: size > 0 AND 2 * s + size < 2 * target) AS starts FROM axis
)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(size * len(starts) AS BIGINT) AS taken,
  array_to_string(list_transform(starts, lambda s: CAST(floor(1000000 * CASE weight
    WHEN 1 THEN (sqrt(2.25::DOUBLE + (-2.0)::DOUBLE * (CAST(s AS DOUBLE) / target)) - 1.5::DOUBLE) / (-1.0)::DOUBLE
    WHEN 3 THEN (sqrt(0.25::DOUBLE + 2.0::DOUBLE * (CAST(s AS DOUBLE) / target)) - 0.5::DOUBLE) / 1.0::DOUBLE
    ELSE CAST(s AS DOUBLE) / target END) AS BIGINT)), ',') AS positions
FROM copies
"""

ORACLE_SQL = {
    "op1_minhash_near_dedup": OP1,
    "op2_chat_formatting": OP2,
    "op3_line_dedup": OP3,
    "op8_exact_dedup": OP8,
    "op9_source_mixing": OP9,
}
