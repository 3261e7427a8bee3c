"""DuckDB SQL for the corpus queries that SQL can express."""

_WORDS = r"list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL = {
    "op4_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
grams AS (
  SELECT doc_id, i, 3 AS k, list_slice(w, i, i + 2) AS g FROM pos WHERE i + 2 <= len(w)
  UNION ALL SELECT doc_id, i, 10, list_slice(w, i, i + 9) FROM pos WHERE i + 9 <= len(w)
  UNION ALL SELECT doc_id, i, 151, list_slice(w, i, i + 150) FROM pos WHERE i + 150 <= len(w)),
hashed AS (SELECT doc_id, i, k, md5(array_to_string(g, ' ')) AS h FROM grams),
twice AS (SELECT doc_id, i, k FROM hashed QUALIFY count(*) OVER (PARTITION BY doc_id, k, h) > 1),
spans AS (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS p FROM twice WHERE k < 151),
covered AS (SELECT doc_id, count(*) FILTER (k = 3) AS tri, count(*) FILTER (k = 10) AS ten FROM spans GROUP BY doc_id),
long AS (SELECT DISTINCT doc_id FROM twice WHERE k = 151),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(tri, 0)::BIGINT AS n_repeat_words,
    coalesce(ten, 0)::BIGINT AS n_covered, long.doc_id IS NOT NULL AS longest_over
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN long USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_covered <= 0.3 * n_words AND NOT longest_over AS kept, n_covered, longest_over
FROM v""",
    "op6_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS h FROM pos),
gone AS (SELECT doc_id, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)),
spans AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM gone),
n AS (SELECT doc_id, count(*) AS n_removed, list(p) AS ps FROM spans GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN spans USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_near_dedup": rf"""
WITH RECURSIVE low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT doc_id, {_WORDS} AS w FROM low),
shingle AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)""",
    "op8_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
five AS (SELECT page_id, list_transform(range(0, 8), lambda k: ('0x' || substr(hex, (5 * k + 1)::INT, 5))::INT) AS v FROM p),
b32 AS (
  SELECT page_id, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '') AS digest FROM five)
SELECT p.page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN p.page_id = min(p.page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> min(p.page_id) OVER w THEN min(p.page_id) OVER w END AS refers_to
FROM p JOIN b32 USING (page_id) WINDOW w AS (PARTITION BY html)""",
    "op3_chat_repair": r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE lower(trim(role)) WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 0 END AS r,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
f AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS v0, 1000000000 AS v1, 1000000000 AS v2, 1000000000 AS v3, 0 AS b1, 0 AS b2, 0 AS b3 FROM t
  UNION ALL
  SELECT t.conv_id, t.k, 1000000000, least(v0, v1 + 1) + CASE WHEN r = 1 THEN 0 ELSE 2 END, least(v0, v1, v2 + 1, v3) + CASE WHEN r = 2 THEN 0 ELSE 2 END,
    least(v0 + 3, v1 + 3, v2, v3 + 1) + CASE WHEN r = 3 THEN 0 ELSE 2 END,
    CASE WHEN v0 <= v1 + 1 THEN 0 ELSE 1 END,
    CASE least(v0, v1, v2 + 1, v3) WHEN v0 THEN 0 WHEN v1 THEN 1 WHEN v2 + 1 THEN 2 ELSE 3 END,
    CASE least(v0 + 3, v1 + 3, v2, v3 + 1) WHEN v0 + 3 THEN 0 WHEN v1 + 3 THEN 1 WHEN v2 THEN 2 ELSE 3 END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1),
g AS (
  SELECT f.conv_id, f.k, CASE least(v1 + 3, v2, v3) WHEN v1 + 3 THEN 1 WHEN v2 THEN 2 ELSE 3 END AS e, b1, b2, b3 FROM f JOIN t USING (conv_id, k) WHERE f.k = t.n
  UNION ALL
  SELECT f.conv_id, f.k, CASE g.e WHEN 1 THEN g.b1 WHEN 2 THEN g.b2 ELSE g.b3 END, f.b1, f.b2, f.b3 FROM g JOIN f ON f.conv_id = g.conv_id AND f.k = g.k - 1 WHERE f.k > 0),
h AS (SELECT t.*, e, CASE e WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END AS s, ['system', 'user', 'assistant'][e] AS name FROM g JOIN t USING (conv_id, k))
SELECT conv_id, turn, role, name AS new_role, CASE WHEN r = e THEN 'keep' ELSE 'relabel' END || CASE WHEN s = e THEN '+merge' ELSE '' END AS action,
  ((s < 2 AND e = 3)::INT + (k = n AND e = 1)::INT)::INT AS n_inserted,
  CASE WHEN s = e THEN chr(10) ELSE CASE WHEN s > 0 THEN '<|im_end|>' || chr(10) ELSE '' END || CASE WHEN s < 2 AND e = 3 THEN '<|im_start|>user' || chr(10) || '<|im_end|>' || chr(10) ELSE '' END
    || '<|im_start|>' || name || chr(10) END || text
  || CASE WHEN k = n THEN '<|im_end|>' || chr(10) || CASE WHEN e = 1 THEN '<|im_start|>user' || chr(10) || '<|im_end|>' || chr(10) ELSE '' END ELSE '' END AS rendered
FROM h""",
}
