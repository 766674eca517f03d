"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"

OP2 = """
WITH last AS (
  SELECT conv_id, max(turn) AS branch FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations
  UNION ALL
  SELECT c.conv_id, 'rejected', c.turn, c.role, c.text
  FROM conversations c LEFT JOIN last l ON l.conv_id = c.conv_id WHERE l.branch IS NULL OR c.turn < l.branch
  UNION ALL
  SELECT l.conv_id, 'rejected', c.turn, c.role, c.text
  FROM conversations c JOIN last l ON c.conv_id = l.conv_id + 1 WHERE c.turn >= l.branch
), turns AS (
  SELECT pair_id, turn,
    max(CASE WHEN side = 'chosen' THEN role END) AS c_role, max(CASE WHEN side = 'chosen' THEN text END) AS c_text,
    max(CASE WHEN side = 'rejected' THEN role END) AS r_role, max(CASE WHEN side = 'rejected' THEN text END) AS r_text
  FROM sides GROUP BY pair_id, turn
), prefix AS (
  SELECT pair_id, coalesce(min(CASE WHEN c_role IS DISTINCT FROM r_role OR c_text IS DISTINCT FROM r_text THEN turn END),
    max(turn) + 1) AS n FROM turns GROUP BY pair_id
), parts AS (
  SELECT t.pair_id, 'prompt' AS part, turn, c_role AS role, c_text AS text FROM turns t JOIN prefix USING (pair_id)
  WHERE turn < n
  UNION ALL SELECT t.pair_id, 'chosen', turn, c_role, c_text FROM turns t JOIN prefix USING (pair_id)
  WHERE turn >= n AND c_role IS NOT NULL
  UNION ALL SELECT t.pair_id, 'rejected', turn, r_role, r_text FROM turns t JOIN prefix USING (pair_id)
  WHERE turn >= n AND r_role IS NOT NULL
), segments AS (
  SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment FROM parts
), placed AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY pair_id, part ORDER BY turn) AS upto FROM segments
), spans AS (
  SELECT *, CASE WHEN role = 'assistant' THEN CAST(upto - length(text) - 8 AS VARCHAR) || ':' || CAST(upto AS VARCHAR) END
    AS span FROM placed
)
SELECT pair_id, count(DISTINCT CASE WHEN part = 'prompt' THEN turn END) AS n_prompt_turns,
  coalesce(string_agg(CASE WHEN part = 'prompt' THEN segment END, '' ORDER BY turn), '') AS prompt,
  coalesce(string_agg(CASE WHEN part = 'chosen' THEN segment END, '' ORDER BY turn), '') AS chosen,
  coalesce(string_agg(CASE WHEN part = 'rejected' THEN segment END, '' ORDER BY turn), '') AS rejected,
  coalesce(string_agg(CASE WHEN part = 'chosen' THEN span END, ',' ORDER BY turn), '') AS chosen_spans,
  coalesce(string_agg(CASE WHEN part = 'rejected' THEN span END, ',' ORDER BY turn), '') AS rejected_spans
FROM spans GROUP BY pair_id
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), grams AS (
  SELECT doc_id, i, w[i:i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, l FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '{WORD}')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY doc_id
), normal AS (
  SELECT doc_id, source, regexp_replace(regexp_replace(lower(regexp_replace(l, '{EDGE}', '', 'g')), '[0-9]+', '0', 'g'),
    '[\x20\x09-\x0D]+', ' ', 'g') AS line, len(regexp_extract_all(l, '{WORD}')) AS n FROM lines
), hosts AS (
  SELECT source, count(DISTINCT coalesce('t' || text, 'n')) AS host_texts FROM documents GROUP BY source
), frequent AS (
  SELECT source, line FROM (
    SELECT source, line, count(DISTINCT coalesce('t' || text, 'n')) AS c FROM normal JOIN documents USING (doc_id, source)
    GROUP BY source, line)
  JOIN hosts USING (source) WHERE c >= 5 AND (c >= 0.05 * host_texts OR c > 200)
), removed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_frequent_words FROM normal JOIN frequent USING (source, line) GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_frequent_words, 0)::BIGINT AS n_frequent_words
  FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN removed USING (doc_id)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND n_words - n_frequent_words >= 50 AND n_words - n_frequent_words >= 0.3 * n_words AS kept
FROM based
"""

OP6 = rf"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), lines AS (
  SELECT doc_id, pos, regexp_replace(l[pos + 1], '{EDGE}', '', 'g') AS h,
    len(regexp_extract_all(l[pos + 1], '{WORD}'))::BIGINT AS n
  FROM split, unnest(range(len(l))) AS u(pos)
), filled AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS upto FROM lines WHERE n > 0
), marked AS (
  SELECT *, upto - n AS start, list({{'h': h, 'pos': pos}}) OVER (PARTITION BY doc_id ORDER BY upto
    RANGE BETWEEN 1 FOLLOWING AND 49 FOLLOWING) AS tail FROM filled
), windows AS (
  SELECT doc_id, pos, start, max(pos) OVER w AS e, max(upto) OVER w - start AS words, list(h) OVER w AS g,
    last(tail) OVER w AS tail
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), runs AS (
  SELECT doc_id, pos, CASE WHEN k = 0 THEN e ELSE tail[k].pos END AS e,
    md5(array_to_string(list_concat(g, list_transform(coalesce(tail, [])[1:k], lambda x: x.h)), chr(10))) AS k,
    k AS more
  FROM windows, unnest(range(coalesce(len(tail), 0) + 1)) AS u(k) WHERE words >= 50
), prints AS (
  SELECT *, row_number() OVER (PARTITION BY k, more ORDER BY doc_id, pos) AS nth FROM runs
), gone AS (
  SELECT DISTINCT p.doc_id,
    unnest(range(CASE WHEN p.doc_id = f.doc_id THEN greatest(p.pos, f.e + 1) ELSE p.pos END, p.e + 1)) AS pos
  FROM prints p JOIN prints f ON p.k = f.k AND p.more = f.more AND f.nth = 1 AND p.nth > 1
), kept AS (
  SELECT l.doc_id, count(g.pos) AS n_deleted FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
  GROUP BY l.doc_id
), texts AS (
  SELECT s.doc_id, string_agg(s.l[pos + 1], chr(10) ORDER BY pos) AS text
  FROM split s, unnest(range(len(s.l))) AS u(pos)
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = s.doc_id AND g.pos = u.pos) GROUP BY s.doc_id
)
SELECT d.doc_id, len(s.l)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted,
  coalesce(t.text, '') AS text
FROM documents d JOIN split s USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN texts t USING (doc_id)
"""

ORACLES = {"op2_preference": OP2, "op3_line_quality": OP3, "op6_line_dedup": OP6}

OP10 = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5('17:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sized GROUP BY source
), room AS (
  SELECT *, 3.0::DOUBLE * source_size AS capacity, sum(source_size) OVER ()::DOUBLE AS total,
    3.0::DOUBLE * source_size / weight AS r FROM sources
), shares AS (
  SELECT *, (total - coalesce(sum(capacity) OVER (ORDER BY r, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM room
), level AS (
  SELECT arg_min(share, r) AS level FROM shares WHERE r >= share
), targets AS (
  SELECT source, source_size, n_docs, least(capacity, level * weight) AS target FROM shares, level
), seats AS (
  SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS nth,
    floor(sum(CASE WHEN k = 0 THEN target ELSE 0 END) OVER () / 64) AS blocks
  FROM targets, unnest(range(source_size * 3 // 64)) AS u(k)
), quota AS (
  SELECT t.source, t.source_size, t.target, coalesce(q, 0) AS quota, ceil(n_docs / 5000.0)::BIGINT AS shards
  FROM targets t LEFT JOIN (SELECT source, count(*) AS q FROM seats WHERE nth <= blocks GROUP BY source) s
    ON s.source IS NOT DISTINCT FROM t.source
), dealt AS (
  SELECT s.*, q.source_size, q.target, q.quota, ('0x' || substr(place, 1, 12))::BIGINT % q.shards AS shard
  FROM sized s JOIN quota q ON q.source IS NOT DISTINCT FROM s.source
), rings AS (
  SELECT source, quota, shard, sum(size)::BIGINT AS ring FROM dealt GROUP BY ALL
), shard_seats AS (
  SELECT source, shard, quota,
    row_number() OVER (PARTITION BY source ORDER BY ring / (2 * k + 1) DESC, shard, k) AS nth
  FROM rings, unnest(range(ring * 3 // 64)) AS u(k)
), blocks AS (
  SELECT r.source, r.shard, r.ring, coalesce(b, 0) * 64 AS words,
    64 * (('0x' || substr(md5('17:' || r.shard::VARCHAR), 1, 12))::BIGINT % greatest(ring // 64, 1)) AS start
  FROM rings r LEFT JOIN (SELECT source, shard, count(*) AS b FROM shard_seats WHERE nth <= quota GROUP BY ALL) s
    ON s.source IS NOT DISTINCT FROM r.source AND s.shard = r.shard
), placed AS (
  SELECT d.*, b.ring, b.words, b.start,
    sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM dealt d JOIN blocks b ON b.source IS NOT DISTINCT FROM d.source AND b.shard = d.shard
)
SELECT doc_id, source, size, source_size, target, CASE WHEN ring = 0 THEN 0 ELSE
  (((start + words) // ring) * size + least(size, greatest(0, (start + words) % ring - upto + size)))
  - ((start // ring) * size + least(size, greatest(0, start % ring - upto + size))) END::BIGINT AS taken
FROM placed
"""
ORACLES["op10_mixing"] = OP10
