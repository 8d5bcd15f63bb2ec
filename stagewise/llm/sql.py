"""DuckDB SQL for the queries of the same names."""

op8_curriculum_mix = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
i AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS idx, count(*) OVER () AS n_sources, sum(source_size) OVER () AS total FROM s),
w AS (SELECT *, idx % 3 + 1 AS weight, 3 * source_size AS cap FROM i),
f AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken_before,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_rest
      FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, idx)),
c AS (SELECT *, (total - taken_before) * weight > cap * weight_rest AS capped FROM f),
t AS (SELECT source, source_size,
             CASE WHEN capped THEN CAST(cap AS DOUBLE)
                  ELSE CAST(weight * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) AS DOUBLE) / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE) END AS target,
             CASE WHEN n_sources > 1 THEN CAST(0.8 AS DOUBLE) * (CAST(2.0 AS DOUBLE) * CAST(idx AS DOUBLE) / CAST(n_sources - 1 AS DOUBLE) - CAST(1.0 AS DOUBLE)) ELSE CAST(0.0 AS DOUBLE) END AS tilt
      FROM c),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.tilt, CAST(floor(t.target) AS BIGINT) AS goal,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS passes,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(passes * size + greatest(0, least(size, goal - passes * source_size - before)) AS BIGINT) AS taken FROM p)
SELECT doc_id, source, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CAST(2.0 AS DOUBLE) * (CAST(before AS DOUBLE) / target)
            / ((CAST(1.0 AS DOUBLE) - tilt) + sqrt((CAST(1.0 AS DOUBLE) - tilt) * (CAST(1.0 AS DOUBLE) - tilt) + CAST(4.0 AS DOUBLE) * tilt * (CAST(before AS DOUBLE) / target))) END AS position
FROM k
"""

op10_quality_cascade = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
pos AS (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3),
tri AS (SELECT r, i, words[i:i + 2] AS g FROM pos),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n >= 2),
cov AS (SELECT r, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT w.r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) AS n_lettered,
         len(regexp_extract_all(text, '\p{Lu}')) AS n_upper
  FROM w LEFT JOIN dup ON dup.r = w.r LEFT JOIN cov ON cov.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_lettered < 7 * n_words OR 2 * n_upper > word_chars) AS kept
FROM b
"""

op6_warc_bundles = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, unhex(sha1(payload)) AS h,
         max(page_id) OVER (PARTITION BY sha1(payload)) AS winner
  FROM p),
b AS (SELECT *, (SELECT string_agg(chr(CAST(CASE WHEN v < 26 THEN 65 + v ELSE 24 + v END AS INTEGER)), '' ORDER BY i)
                 FROM (SELECT i, CAST(('0b' || substr(bits, CAST(i * 5 + 1 AS BIGINT), 5)) AS INTEGER) AS v
                       FROM (SELECT unnest(generate_series(0, 31)) AS i, CAST(CAST(h AS BIT) AS VARCHAR) AS bits))) AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN winner IS NOT NULL AND page_id IS DISTINCT FROM winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN winner IS NOT NULL AND page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM b
"""

op1_chat_format = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(text) + 17
            + len(regexp_extract_all(role || chr(0) || text, '\\|<\||\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) + len(regexp_extract_all(role || chr(0) || text, '<\|>')) + len(regexp_extract_all(role, '\n')) AS size
  FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars, false AS rewrites_history
FROM e GROUP BY conv_id
"""

op2_line_dedup = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(0, len(string_split(coalesce(text, ''), chr(10))) - 1)) AS line_no FROM documents),
l AS (SELECT * FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT line, length(line) AS n, min(CAST(doc_id AS HUGEINT) * 1000000000000 + line_no) AS first FROM l GROUP BY line),
p AS (SELECT a.line AS u, a.first AS uf, b.line AS v, b.first AS vf
      FROM d a JOIN (SELECT d.*, n + k AS m FROM d, (VALUES (-2), (-1), (0), (1), (2)) AS o(k) WHERE n >= 20) b ON a.n = b.m
      WHERE a.n >= 20 AND a.first <> b.first AND levenshtein(a.line, b.line) <= 2),
e AS (SELECT vf AS first, min(uf) AS near_first FROM p WHERE uf < vf GROUP BY vf),
f AS (SELECT CAST(d.first // 1000000000000 AS BIGINT) AS doc_id, count(*) AS firsts, count(near_first) AS near, min(near_first) AS near_first
      FROM d LEFT JOIN e ON d.first = e.first GROUP BY 1),
c AS (SELECT doc_id, count(line) AS n_lines FROM (SELECT doc_id FROM documents) LEFT JOIN l USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_lines - coalesce(firsts, 0) AS BIGINT) AS n_equal, CAST(coalesce(near, 0) AS BIGINT) AS n_near,
       CAST(coalesce(firsts, 0) - coalesce(near, 0) AS BIGINT) AS n_kept, CAST(near_first // 1000000000000 AS BIGINT) AS near_doc
FROM c LEFT JOIN f USING (doc_id)
"""
