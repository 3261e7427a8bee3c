"""DuckDB SQL for the queries of the catalogue that SQL can express."""

from __future__ import annotations

import re

from ..functions import crf
from ..operators import prepare
from . import image_oracles

# Matches with byte offsets: the text is cut into (gap, match) pairs, whose lengths are summed.


def _matches(source: str, key: str, text: str, pattern: str) -> str:
    """A table m(key, n, s, a, b): the non-overlapping matches of a pattern with byte offsets."""
    whole = f"(?s)(.*?)({pattern})"
    return rf"""
cut AS (SELECT {key}, unnest(regexp_extract_all({text}, '{whole}', 1)) AS gap, unnest(regexp_extract_all({text}, '{whole}', 2)) AS s,
  unnest(range(len(regexp_extract_all({text}, '{whole}', 2)))) AS n FROM {source}),
ends AS (SELECT *, sum(strlen(gap) + strlen(s)) OVER (PARTITION BY {key} ORDER BY n) AS b FROM cut),
m AS (SELECT {key}, n, s, (b - strlen(s))::INT AS a, b::INT AS b FROM ends)"""


_LUHN = "list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(s, (length(s) - i + 1)::INT, 1)::INT WHEN substr(s, (length(s) - i + 1)::INT, 1)::INT > 4 THEN 2 * substr(s, (length(s) - i + 1)::INT, 1)::INT - 9 ELSE 2 * substr(s, (length(s) - i + 1)::INT, 1)::INT END)) % 10 = 0"
_CARD = rf"length(s) BETWEEN 13 AND 19 AND regexp_matches(s, '^(4|5[1-5]|3[4-8]|6011|644|65|30[0-5])') AND {_LUHN}"
_EMAIL_OK = r"strlen(text) - 5 > a + instr(s, '@') - 1 AND regexp_matches(s, '@[A-Za-z0-9.-]*[.][A-Za-z0-9.-]*$') AND regexp_matches(s, '[A-Za-z][A-Za-z]$') AND length(s) - instr(s, '@') >= 3"



def _renamed(sql: str, k: int) -> str:
    for name in ("cut", "ends", "m"):
        sql = re.sub(rf"\b{name}\b(?= AS \(|\)|$)", f"{name}{k}", sql)
    return sql


def _scan(source: str, key: str, text: str) -> str:
    """All hits of digits, addresses of mail and telephone numbers in the order of the scanners, and their fold. Hits after a marked word, expiry
    dates and account numbers aren't expressed."""
    base = f"{source}_t AS (SELECT {key}, {text} AS text FROM {source})"
    digits = _renamed(_matches(f"{source}_t", key, "text", "[0-9]+"), 1)
    mails = _renamed(_matches(f"{source}_t", key, "text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*"), 2)
    plus = _renamed(_matches(f"{source}_t", key, "text", "[+](?:[0-9 -]|[(][0-9 -]*[)])*"), 3)
    return rf"""
WITH {base}, {digits}, {mails}, {plus},
tail AS (SELECT {key}, any_value(substr(text, 1 + k)) AS rest FROM {source}_t JOIN (SELECT {key}, sum(length(gap) + length(s))::BIGINT AS k FROM cut1 GROUP BY {key}) USING ({key}) GROUP BY {key}),
d AS (SELECT m1.*, length(s) AS l, gap, lead(gap) OVER w AS after1, lead(s) OVER w AS s1, lead(m1.a) OVER w AS a1, lead(gap, 2) OVER w AS after2, lead(s, 2) OVER w AS s2, lead(m1.a, 2) OVER w AS a2, coalesce(lead(gap) OVER w, rest) AS following
  FROM m1 JOIN (SELECT {key}, n, gap FROM cut1) USING ({key}, n) JOIN tail USING ({key}) WINDOW w AS (PARTITION BY {key} ORDER BY n)),
pan AS (SELECT * FROM d WHERE {_CARD}),
raw AS (
  SELECT {key}, 0 AS o, 'EMAIL' AS kind, s AS text, a, b FROM m2 JOIN {source}_t USING ({key}) WHERE {_EMAIL_OK.replace("text", f"{source}_t.text")}
  UNION ALL SELECT x.{key}, 1, 'PHONE', '(' || x.s[1:3] || substr(x.s[4:] || x.following || y.s, 1, 2) || y.s[-3:] || '-' || y.s1[1:4], x.a - 1, y.a1 + 4 FROM d x JOIN d y ON x.{key} = y.{key} AND y.b = x.a + 8
    WHERE x.gap LIKE '%(' AND x.l >= 3 AND x.s[1] >= '2' AND y.l >= 3 AND y.s[-3] >= '2' AND y.after1 = '-' AND length(y.s1) >= 4
  UNION ALL SELECT {key}, 1, 'PHONE', s[-3:] || '-' || s1 || '-' || s2[1:4], b - 3, a2 + 4 FROM d WHERE l >= 3 AND s[-3] >= '2' AND after1 = '-' AND length(s1) = 3 AND s1 >= '2' AND after2 = '-' AND length(s2) >= 4
  UNION ALL SELECT {key}, 2, 'PHONE', s, a, b FROM d WHERE regexp_full_match(s, '1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}')
  UNION ALL SELECT {key}, 3, 'PHONE', s, a, b FROM m3 JOIN (SELECT {key}, strlen(text) AS size FROM {source}_t) USING ({key})
    WHERE a < size - 6 AND strlen(s) >= 8 AND regexp_matches(s, '[-( ]') AND length(regexp_replace(s, '[^0-9]', '', 'g')) BETWEEN 7 AND 15
  UNION ALL SELECT {key}, 4, 'SSN', s || '-' || s1 || '-' || s2, a, a2 + 4 FROM d WHERE l = 3 AND after1 = '-' AND length(s1) = 2 AND after2 = '-' AND length(s2) = 4 AND s BETWEEN '001' AND '899' AND s <> '666' AND s1 > '00' AND s2 > '0000'
  UNION ALL SELECT {key}, 5, 'SSN', s, a, b FROM d WHERE l = 9 AND s[1:3] BETWEEN '001' AND '899' AND s[1:3] <> '666' AND s[4:5] > '00' AND s[6:9] > '0000'
  UNION ALL SELECT {key}, 6, 'PAN', s, a, b FROM pan
  UNION ALL SELECT d.{key}, 6, 'CVV', d.s, d.a, d.b FROM pan JOIN d ON d.{key} = pan.{key} AND d.a >= pan.b AND d.b <= pan.b + 80 WHERE d.l IN (3, 4)
  UNION ALL SELECT {key}, 7, 'ZIP', s, a, b FROM d WHERE l = 5 AND NOT regexp_matches(gap, '[A-Za-z0-9]$') AND NOT regexp_matches(coalesce(following, ''), '^[A-Za-z0-9]')),
each AS (SELECT {key}, list([{{'kind': kind, 'text': text, 'start': a, 'end': b}}] ORDER BY a, o, b) AS hits FROM raw GROUP BY {key}),
kept AS (SELECT {key}, list_reduce(hits, lambda acc, x: CASE WHEN x[1].start >= acc[-1]."end" THEN list_concat(acc, x)
  WHEN x[1].kind = acc[-1].kind THEN CASE WHEN strlen(x[1].text) > strlen(acc[-1].text) THEN list_concat(acc[1:len(acc) - 1], x) ELSE acc END
  WHEN x[1].kind IN ('PAN', 'SSN') AND acc[-1].kind IN ('PAN', 'SSN') THEN CASE WHEN x[1].kind = 'PAN' THEN list_concat(acc[1:len(acc) - 1], x) ELSE acc END ELSE list_concat(acc, x) END) AS hits FROM each),
one AS (SELECT {key}, unnest(hits) AS h, unnest(range(len(hits)))::INT AS seq FROM kept)
SELECT {key}, seq, h.kind AS kind, h.text AS text, h.start AS start, h."end" AS "end" FROM one"""


_CUSTOMERS = r"""
t AS (SELECT c_custkey, printf('SSN: %03d-%02d-%04d or %03d%02d%04d; call %03d-%03d-%04d, (%03d) %03d-%04d or %03d%03d%04d. Zip %05d, A%05d. Name: %s, nr %d | Address: %d Main St' || chr(10) || 'Serial 4%015d',
  k % 1000, k % 100, k % 10000, (k * 7) % 1000, (k * 3) % 100, (k * 11) % 10000, (k * 13) % 1000, (k * 17) % 1000, k % 10000, (k * 19) % 1000, (k * 23) % 1000, k % 10000,
  (k * 29) % 1000, (k * 31) % 1000, k % 10000, k % 100000, k % 100000, c_name, k % 7, k, k * 7919) AS text, k
  FROM (SELECT *, c_custkey AS k FROM customer))"""

_PIXELS = image_oracles.PIXELS
_SLOPE = image_oracles.INNER + ", slope AS (SELECT id, y, x, m AS s FROM inn)"
_GRAY = f"""
WITH {_PIXELS}, hist AS (SELECT id, floor(v)::INT AS bin, count(*) AS n FROM px GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY id) AS total FROM hist),
s AS (SELECT id, min(bin) FILTER (upto >= total // 2) AS median, -sum(n / total * log2(n / total)) AS entropy FROM run GROUP BY id)
SELECT id, round(avg(v), 6) AS mean, round(any_value(median)::DOUBLE, 6) AS median, round(stddev_pop(v), 6) AS std, round(any_value(entropy), 6) AS entropy
FROM px JOIN s USING (id) GROUP BY id"""
_LAPLACE = f"""
WITH {_PIXELS}, {image_oracles.NINE}, l AS (SELECT id, 4 * v - l - e - n - s AS v FROM nine)
SELECT id, round(var_pop(v), 6) AS laplacian_variance FROM l GROUP BY id"""

_TREES = """
SELECT l_orderkey, l_linenumber,
  round(1 / (1 + exp(-((CASE WHEN l_quantity < 25 THEN -0.5 ELSE 0.5 END) + CASE WHEN l_discount < 0.05 THEN CASE WHEN l_extendedprice < 30000 THEN 0.25 ELSE -0.25 END ELSE 1.0 END)::DOUBLE)), 9) AS is_document,
  round(1 / (1 + exp(-(CASE WHEN l_tax < 0.04 THEN -1.0 WHEN l_quantity < 10 THEN 2.0 ELSE 0.125 END)::DOUBLE)), 9) AS is_paper
FROM lineitem"""

_LINES = "ll AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ln FROM lineitem)"
_BOXES = f"""
{_LINES}, box AS (SELECT l_orderkey AS doc_id, (ln - 1)::INT AS pos, ln, (ln * 10)::DOUBLE AS x0, (l_partkey % 3 * 4)::DOUBLE AS y0,
  (l_suppkey % 7)::DOUBLE AS dx, 4 + l_quantity / 4 AS w, trunc(l_discount * 1000)::DOUBLE AS ca, trunc(l_tax * 1000)::DOUBLE AS cb FROM ll),
pair AS (SELECT a.doc_id, b.pos AS gi, a.pos AS ti, a.ca, b.cb, least(a.x0 + 0 + 4 + (a.w - 4), b.x0 + b.dx + 4 + (b.w - 4)) - greatest(a.x0, b.x0 + b.dx) AS iw,
    least(a.y0 + 8, b.y0 + 8) - greatest(a.y0, b.y0) AS ih, a.w * 8 + b.w * 8 AS both_areas FROM box a JOIN box b USING (doc_id)),
scored AS (SELECT *, iw * ih / (both_areas - iw * ih) AS iou FROM pair WHERE iw > 0 AND ih > 0),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, gi ORDER BY iou DESC, ti) = 1),
matched AS (SELECT doc_id, gi, ti, iou, ca, cb, cb > ca AS won FROM best WHERE iou >= 0.5),
fate AS (SELECT doc_id, ti, max(gi) FILTER (won) AS winner, min(gi) FILTER (won) AS first_win, list(gi) AS gis FROM matched GROUP BY ALL)"""

_PREDICTED = """
p AS (SELECT l.doc_id, l.quality, l.toxic, (n_chars > 300)::INT AS pred_quality, contains(text, 'idiot')::INT AS pred_toxic, n_chars AS size FROM labels l JOIN documents USING (doc_id)),
lp AS (SELECT 'quality' AS label, quality AS actual, pred_quality AS predicted FROM p UNION ALL SELECT 'toxic', toxic, pred_toxic FROM p),
cm AS (SELECT label, count(*) FILTER (actual = 1 AND predicted = 1) AS tp, count(*) FILTER (actual <> 1 AND predicted = 1) AS fp,
  count(*) FILTER (actual = 1 AND predicted <> 1) AS fn, count(*) FILTER (actual <> 1 AND predicted <> 1) AS tn FROM lp GROUP BY label)"""


def _scores(source: str, label: str) -> str:
    p, r = "coalesce(tp / nullif(tp + fp, 0), 0.0)", "coalesce(tp / nullif(tp + fn, 0), 0.0)"
    f = lambda b: f"coalesce((1 + {b}) * {p} * {r} / nullif({b} * {p} + {r}, 0), 0.0)"
    return f"SELECT {label}, round({p}, 4) AS precision, round({r}, 4) AS recall, round({f(1)}, 4) AS f1, round({f(25)}, 4) AS f5, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, (tp + fn)::BIGINT AS support FROM {source}"


_TAGGED = """
tok AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS i, o_orderpriority AS token FROM orders),
tagged AS (SELECT *, (i // 2 % 3)::INT AS tag, coalesce(sum(length(token) + 1) OVER (PARTITION BY o_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM tok),
tt AS (SELECT *, (start + length(token))::INT AS "end" FROM tagged),
isl AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY i) - row_number() OVER (PARTITION BY o_custkey, tag ORDER BY i) AS k FROM tt),
runs AS (SELECT o_custkey, tag, min(i) AS first, max(i) AS last, min(start) AS start, max("end") AS "end" FROM isl WHERE tag <> 0 GROUP BY o_custkey, tag, k),
span AS (SELECT o_custkey, o_orderkey, (o_orderkey % 97)::INT AS start, (o_orderkey % 97 + 9)::INT AS "end" FROM orders)"""

_TOKENS = r"(?s)([ \t\n\f\r]*)([^ \t\n\f\r]+)"
_TOK = rf"""
cut AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKENS}', 1)) AS gap, unnest(regexp_extract_all(text, '{_TOKENS}', 2)) AS word, unnest(range(len(regexp_extract_all(text, '{_TOKENS}', 2))))::INT AS i FROM documents),
tk AS (SELECT *, sum(strlen(gap) + strlen(word)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM cut)"""
_SHAPE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(word, 1, 10), '[^\p{Lu}\p{Ll}0-9]', '-', 'g'), '\p{Lu}', 'A', 'g'), '\p{Ll}', 'a', 'g'), '[0-9]', '0', 'g')"
_NEIGHBOUR = rf"""
lo AS (SELECT *, CASE WHEN strlen(word) <= 20 THEN lower(word) ELSE '__LONG__' END AS low, {_SHAPE} AS shape FROM tk),
nei AS (SELECT *, coalesce(lag(low) OVER w, '__BOS__') AS before1, coalesce(lag(low, 2) OVER w, '__BOS__') AS before2, coalesce(lead(low) OVER w, '__EOS__') AS after1, coalesce(lead(low, 2) OVER w, '__EOS__') AS after2
  FROM lo WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""

_SET = lambda words: "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"
_CORE = "regexp_replace({0}, '[,.]+$', '')"
#: A token's weights for the labels of the catalogue's tagger, summed in single precision in the order of the features.
_WEIGHTS = (("strlen(word) = 8", (0, 0, 0, 1.5)), ("digits", (0, -2, 1.2, 0.8)), ("suffix", (0, -3, 3, -3)), ("name_word", (0, 1.5, 0.5, -3)), ("i > 0 AND i < n - 1", (1, 0, 0, 0)))
_MOVES = ((0.5, 0, 0, 0), (0, 0.6, 0.2, -1), (0, -0.5, 1.0, -1), (0.2, -1, -1, 0))
_EMIT = [" + ".join(f"(CASE WHEN {when} THEN {w[j]} ELSE 0 END)::FLOAT" for when, w in _WEIGHTS) for j in range(4)]
_WAYS = [f"[{', '.join(f'v.s[{k + 1}] + {_MOVES[k][j]}::FLOAT + e.e[{j + 1}]' for k in range(4))}]" for j in range(4)]
_VITERBI = rf"""
txt AS (SELECT row_number() OVER () AS r, concat_ws('-', conv_id, turn) AS id, regexp_extract_all(text, '[^ \t\n\f\r]+') AS ws FROM conversations),
tok AS (SELECT r, id, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws)))::INT AS i FROM txt),
flag AS (SELECT *, regexp_full_match(word, '[0-9]+') AS digits, lower({_CORE.format("word")}) IN {_SET(crf.SUFFIXES)} AS suffix,
  regexp_full_match(word, '\p{{Lu}}\p{{L}}*') AND strlen(word) BETWEEN 2 AND 20 AND NOT (length(word) = 2 AND word IN {_SET(crf.STATES)})
  AND lower({_CORE.format("word")}) NOT IN {_SET(crf.SUFFIXES | crf.DIRECTIONS | crf.TITLES | crf.BOXES)} AS name_word FROM tok),
em AS MATERIALIZED (SELECT r, i, [{", ".join(_EMIT)}] AS e FROM flag),
v(r, i, s, p) AS (SELECT r, i, e, [[0], [1], [2], [3]] FROM em WHERE i = 0 UNION ALL
  SELECT r, i, [{", ".join(f"list_max(w{j})" for j in range(4))}], [{", ".join(f"list_append(p[list_position(w{j}, list_max(w{j}))], {j})" for j in range(4))}]
  FROM (SELECT v.r, e.i, v.p, {", ".join(f"{w} AS w{j}" for j, w in enumerate(_WAYS))} FROM v JOIN em e ON e.r = v.r AND e.i = v.i + 1)),
best AS (SELECT v.r, p[list_position(s, list_max(s))] AS path FROM v JOIN (SELECT r, max(i) AS i FROM em GROUP BY r) USING (r, i))"""


SQL = {
    "pii_email": f"""
WITH {_matches("documents", "doc_id", "text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*")}
SELECT doc_id, 'EMAIL' AS kind, s AS text, a AS start, b AS "end" FROM m JOIN (SELECT doc_id, text FROM documents) USING (doc_id) WHERE {_EMAIL_OK}""",
    "pii_pan": f"""
WITH {_matches("documents", "doc_id", "text", "[0-9]+")} SELECT doc_id, 'PAN' AS kind, s AS text, a AS start, b AS "end" FROM m WHERE {_CARD}""",
    "pii_pan_expressions": f"""
WITH {_matches("documents", "doc_id", "text", "[0-9]+")} SELECT doc_id, s AS text, a AS start, b AS "end" FROM m WHERE {_CARD}""",
    "pii_phone_international": f"""
WITH {_matches("documents", "doc_id", "text", "[+](?:[0-9 -]|[(][0-9 -]*[)])*")}
SELECT doc_id, 'PHONE' AS kind, s AS text, a AS start, b AS "end" FROM m JOIN (SELECT doc_id, strlen(text) AS size FROM documents) USING (doc_id)
WHERE a < size - 6 AND strlen(s) >= 8 AND regexp_matches(s, '[-( ]') AND length(regexp_replace(s, '[^0-9]', '', 'g')) BETWEEN 7 AND 15""",
    "pii_counts_by_kind": f"""
WITH {_matches("documents", "doc_id", "text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*")},
e AS (SELECT 'EMAIL' AS kind, doc_id FROM m JOIN (SELECT doc_id, text FROM documents) USING (doc_id) WHERE {_EMAIL_OK}),
{_matches("documents", "doc_id", "text", "[0-9]+").replace("cut AS", "cut2 AS").replace("FROM cut)", "FROM cut2)").replace("ends AS", "ends2 AS").replace("FROM ends)", "FROM ends2)").replace("m AS", "m2 AS")},
h AS (FROM e UNION ALL SELECT 'PAN', doc_id FROM m2 WHERE {_CARD})
SELECT kind, count(*) AS hits, count(DISTINCT doc_id) AS docs, round(count(*) / (SELECT count(*) FROM documents), 6) AS per_doc FROM h GROUP BY kind""",
    "pii_ssn": rf"""
WITH {_CUSTOMERS}, s AS (
  SELECT c_custkey, k % 1000 AS a, k % 100 AS g, k % 10000 AS n, printf('%03d-%02d-%04d', k % 1000, k % 100, k % 10000) AS s, text FROM t
  UNION ALL SELECT c_custkey, (k * 7) % 1000, (k * 3) % 100, (k * 11) % 10000, printf('%03d%02d%04d', (k * 7) % 1000, (k * 3) % 100, (k * 11) % 10000), text FROM t)
SELECT c_custkey, 'SSN' AS kind, s AS text, (CASE WHEN contains(s, '-') THEN 5 ELSE 20 END)::INT AS start, (CASE WHEN contains(s, '-') THEN 16 ELSE 29 END)::INT AS "end"
FROM s WHERE a BETWEEN 1 AND 899 AND a <> 666 AND g > 0 AND n > 0""",
    "pii_phone_domestic": rf"""
WITH {_CUSTOMERS}, p AS (
  SELECT c_custkey, (k * 13) % 1000 AS a, (k * 17) % 1000 AS e, printf('%03d-%03d-%04d', (k * 13) % 1000, (k * 17) % 1000, k % 10000) AS s, 36 AS p FROM t
  UNION ALL SELECT c_custkey, (k * 19) % 1000, (k * 23) % 1000, printf('(%03d) %03d-%04d', (k * 19) % 1000, (k * 23) % 1000, k % 10000), 50 FROM t
  UNION ALL SELECT c_custkey, (k * 29) % 1000, (k * 31) % 1000, printf('%03d%03d%04d', (k * 29) % 1000, (k * 31) % 1000, k % 10000), 68 FROM t)
SELECT c_custkey, 'PHONE' AS kind, s AS text, p::INT AS start, (p + length(s))::INT AS "end" FROM p WHERE a >= 200 AND e >= 200""",
    "pii_zip": rf"""
WITH {_CUSTOMERS}, {_matches("t", "c_custkey", "text", "[0-9]+")}
SELECT c_custkey, 'ZIP' AS kind, s AS text, a AS start, b AS "end" FROM m JOIN (SELECT c_custkey, text AS full_text FROM t) USING (c_custkey)
WHERE length(s) = 5 AND NOT regexp_matches(substr(full_text, a, 1), '[A-Za-z0-9]') AND NOT regexp_matches(substr(full_text, b + 1, 1), '[A-Za-z0-9]')""",
    "pii_name_and_address": rf"""
WITH {_CUSTOMERS}, pl AS (SELECT *, instr(text, 'Name: ') - 1 AS p, instr(text, 'Address: ') - 1 AS q FROM t),
n AS (SELECT c_custkey, substr(text, p + 6) AS rest, p + 5 AS a, text FROM pl)
SELECT c_custkey, 'ADDRESS' AS kind, substr(text, q + 1, 100) AS text, q::INT AS start, (least(q + 100, strlen(text)))::INT AS "end" FROM pl
UNION ALL SELECT c_custkey, 'NAME', trim(substr(rest, 1, instr(rest, chr(10)) - 1)), a::INT, (a + instr(rest, chr(10)) - 1)::INT FROM n""",
    "pii_card_details": r"""
WITH o AS (SELECT o_orderkey, o_orderkey % 15 AS mm, printf('%02d/%02d', o_orderkey % 15, o_orderkey % 100) AS d, printf('%03d', o_orderkey % 1000) AS c, o_orderkey::VARCHAR AS r FROM orders)
SELECT o_orderkey, 'EXPIRY' AS kind, d AS text, 26 AS start, 31 AS "end" FROM o WHERE mm BETWEEN 1 AND 12
UNION ALL SELECT o_orderkey, 'CVV', c, 36, 39 FROM o
UNION ALL SELECT o_orderkey, 'CVV', r, 44, (44 + length(r))::INT FROM o WHERE length(r) IN (3, 4)""",
    "pii_account": r"""
SELECT o_orderkey, 'ACCOUNT' AS kind, (10000000 + o_orderkey)::VARCHAR AS text, 20 AS start, (20 + length((10000000 + o_orderkey)::VARCHAR))::INT AS "end" FROM orders""",
    "tokens": f'WITH {_TOK} SELECT doc_id, i, word, (b - strlen(word))::INT AS start, b::INT AS "end" FROM tk',
    "token_shapes": f"WITH {_TOK} SELECT {_SHAPE} AS shape, count(*) AS n FROM tk GROUP BY 1",
    "token_neighbours": f"WITH {_TOK}, {_NEIGHBOUR} SELECT doc_id, i, low, before1, before2, after1, after2 FROM nei",
    "crf_emissions": f"""
WITH {_TOK}, {_NEIGHBOUR}, f AS (
  SELECT doc_id, i, 'w:' || low AS feature FROM nei UNION ALL SELECT doc_id, i, 'w_shape:' || shape FROM nei
  UNION ALL SELECT doc_id, i, 'w+1:' || after1 FROM nei UNION ALL SELECT doc_id, i, 'w-1:' || before1 FROM nei),
k(feature, label, w) AS (VALUES ('w:the', 'O', 1.0::DOUBLE), ('w:the', 'NAME', -0.5), ('w_shape:Aaaa', 'NAME', 0.75), ('w_shape:aaaa', 'O', 0.25), ('w+1:of', 'NAME', 0.5), ('w-1:the', 'ADDRESS', 0.125), ('w_shape:aa', 'O', 0.5)),
e AS (SELECT doc_id, i, label, sum(w) AS score FROM f JOIN k USING (feature) GROUP BY ALL)
SELECT label, count(*) AS tokens, round(sum(score), 3) AS total FROM e GROUP BY label""",
    "img_channel_stats": f"""
WITH {_PIXELS} SELECT id, round(avg(r), 6) AS r_mean, round(stddev_pop(r), 6) AS r_std, round(avg(g), 6) AS g_mean, round(stddev_pop(g), 6) AS g_std, round(avg(b), 6) AS b_mean, round(stddev_pop(b), 6) AS b_std FROM px GROUP BY id""",
    "img_gray_stats": _GRAY,
    "img_gray_stats_relational": _GRAY,
    "img_color": f"""
WITH {_PIXELS}, s AS (SELECT *, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS sat FROM px)
SELECT id, round(stddev_pop(r - g) + stddev_pop(0.5::DOUBLE * (r + g) - b), 6) AS colorfulness, round(avg(sat), 6) AS saturation_mean, round(var_pop(sat), 6) AS saturation_var FROM s GROUP BY id""",
    "img_laplacian": _LAPLACE,
    "img_laplacian_relational": _LAPLACE,
    "img_sobel": f"""
WITH {image_oracles.SOBEL}, k AS (SELECT id, len AS m, row_number() OVER (PARTITION BY id ORDER BY len) AS n FROM so)
SELECT id, round(avg(m), 6) AS sobel_mean, round(stddev_pop(m), 6) AS sobel_std, round(max(m) FILTER (n = 922), 6) AS sobel_p90 FROM k GROUP BY id""",
    "img_fractal": f"""
WITH {_SLOPE}, e AS (SELECT id, y, x FROM slope WHERE s > 10),
c AS (SELECT id, z, count(DISTINCT (y // z, x // z)) AS n FROM e, (VALUES (2), (4), (8), (16), (32)) k(z) GROUP BY id, z)
SELECT id, round(regr_slope(log2(n), -log2(z)), 6) AS fractal FROM c GROUP BY id""",
    "img_blockiness": f"""
WITH {_PIXELS}, d AS (
  SELECT a.id, 'r' AS k, a.y % 8 = 7 AS edge, abs(a.v - b.v) AS d FROM px a JOIN px b ON b.id = a.id AND b.x = a.x AND b.y = a.y + 1
  UNION ALL SELECT a.id, 'c', a.x % 8 = 7, abs(a.v - b.v) FROM px a JOIN px b ON b.id = a.id AND b.y = a.y AND b.x = a.x + 1),
m AS (SELECT id, k, avg(d) FILTER (edge) AS e, avg(d) FILTER (NOT edge) AS i FROM d GROUP BY id, k)
SELECT id, round(max(greatest(e - i, 0) / i) FILTER (k = 'r'), 6) AS rows_blockiness, round(max(greatest(e - i, 0) / i) FILTER (k = 'c'), 6) AS columns_blockiness FROM m GROUP BY id""",
    "img_cell_density": f"""
WITH {_SLOPE}, c AS (SELECT px.id, px.y // 4 AS cy, px.x // 4 AS cx, avg((coalesce(s, 0) > 20)::INT) AS share FROM px LEFT JOIN slope USING (id, y, x) GROUP BY ALL)
SELECT id, round(stddev_pop(share), 6) AS cell_std FROM c GROUP BY id""",
    "img_tile_entropy": f"""
WITH {_PIXELS}, h AS (SELECT id, y // 4 AS ty, x // 4 AS tx, floor(v) AS bin, count(*) / 16 AS p FROM px GROUP BY ALL),
e AS (SELECT id, ty, tx, -sum(p * log2(p)) AS e FROM h GROUP BY ALL) SELECT id, round(max(e) / greatest(min(e), 0.001), 6) AS peak FROM e GROUP BY id""",
    "img_anisotropy": f"""
WITH {_PIXELS}, q AS (SELECT id, y, x, floor((v - min(v) OVER (PARTITION BY id)) / (max(v) OVER (PARTITION BY id) - min(v) OVER (PARTITION BY id)) * 15) AS q FROM px),
h AS (SELECT a.id, avg(power(a.q - b.q, 2)) AS c FROM q a JOIN q b ON a.id = b.id AND a.y = b.y AND b.x = a.x + 5 GROUP BY a.id),
v AS (SELECT a.id, avg(power(a.q - b.q, 2)) AS c FROM q a JOIN q b ON a.id = b.id AND a.x = b.x AND b.y = a.y + 5 GROUP BY a.id)
SELECT h.id, round(v.c / h.c, 6) AS anisotropy FROM h JOIN v USING (id)""",
    "img_runs": f"""
WITH {_PIXELS}, i AS (SELECT id, y, x, x - row_number() OVER (PARTITION BY id, y ORDER BY x) AS k FROM px WHERE v <= 100),
r AS (SELECT id, y, k, count(*) AS n FROM i GROUP BY ALL) SELECT id, count(*) AS runs, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std FROM r GROUP BY id""",
    "gbdt_scores": _TREES,
    "gbdt_scores_batched": _TREES,
    "region_best_overlaps": f"WITH {_BOXES} SELECT doc_id, gi, ti, round(iou, 9) AS iou FROM matched",
    "region_merge": f"""
WITH {_BOXES}, r AS (
  SELECT b.doc_id, 0 AS part, b.pos AS k, CASE WHEN winner IS NULL THEN 'a' ELSE 'b' END AS source, CASE WHEN winner IS NULL THEN 'a' || b.ln ELSE 'b' || g.ln END AS text,
    CASE WHEN winner IS NULL THEN b.ca ELSE g.cb END AS confidence, CASE WHEN winner IS NULL THEN b.x0 ELSE g.x0 + g.dx END AS x0
  FROM box b LEFT JOIN fate f ON f.doc_id = b.doc_id AND f.ti = b.pos LEFT JOIN box g ON g.doc_id = b.doc_id AND g.pos = f.winner
  UNION ALL SELECT b.doc_id, 1, b.pos, 'b', 'b' || b.ln, b.cb, b.x0 + b.dx FROM box b ANTI JOIN matched m ON m.doc_id = b.doc_id AND m.gi = b.pos)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, k) - 1)::INT AS pos, source, text, confidence, x0 FROM r""",
    "region_merge_stats": f"""
WITH {_BOXES}, s AS (SELECT doc_id, sum(CASE WHEN first_win IS NULL THEN len(gis) ELSE len(list_filter(gis, lambda g: g <= first_win)) END) AS merged_pairs, count(winner) AS replaced, sum(len(gis)) AS matched FROM fate GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM box GROUP BY doc_id)
SELECT doc_id, n AS first_regions, n AS second_regions, coalesce(merged_pairs, 0)::BIGINT AS merged_pairs, coalesce(replaced, 0)::BIGINT AS replaced, (n - coalesce(matched, 0))::BIGINT AS novel FROM n LEFT JOIN s USING (doc_id)""",
    "region_text": f"""WITH {_LINES} SELECT l_orderkey AS doc_id, string_agg('a' || ln, chr(10) ORDER BY ln) AS text FROM ll GROUP BY 1""",
    "region_lines": f"""
WITH {_LINES} SELECT l_orderkey AS doc_id, CASE WHEN ln > 1 THEN 'p' || (ln - 1) % 2 ELSE 'r0' END AS line, string_agg('a' || ln, ' ' ORDER BY ln) AS text,
  round(avg(trunc(l_discount * 1000)::DOUBLE), 6) AS confidence FROM ll GROUP BY 1, 2""",
    "region_flatten": f"""
WITH {_LINES}, b AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS bi, dense_rank() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linestatus) - 1 AS pi,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY ln) - 1 AS li FROM ll),
w AS (SELECT *, 0 AS wi, l_returnflag AS t FROM b UNION ALL SELECT *, 2, l_linestatus FROM b)
SELECT l_orderkey AS doc_id, printf('tess-b%d-p%d-l%d-w%d', bi, pi, li, wi) AS id, t AS text, round(least(greatest(l_discount * 2000, 0), 100), 6) AS confidence,
  CASE WHEN l_returnflag = 'A' THEN 'PT_TABLE' ELSE 'PT_UNKNOWN' END AS block_type, printf('tess-b%d-p%d-l%d', bi, pi, li) AS parent_id FROM w""",
    "doc_redactions": r"""SELECT DISTINCT o_orderkey::VARCHAR AS id, 'r0' AS region, 'a1' AS text FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey""",
    "doc_fields": r"""SELECT o_orderkey::VARCHAR AS id, 'f2' AS field, 'date' AS type, 0.5::DOUBLE AS confidence FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey""",
    "doc_violations": r"""
SELECT o_orderkey::VARCHAR AS id, 'image size' AS problem FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 50 = 0""",
    "doc_json_round_trip": r"""
SELECT o_orderkey::VARCHAR AS id, count(*)::INT AS regions, 1 AS hits, (o_orderkey % 50)::INT AS height FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    "eval_confusion": f"WITH {_PREDICTED} SELECT label, tp, fp, fn, tn FROM cm",
    "eval_scores": f"WITH {_PREDICTED} {_scores('cm', 'label')}",
    "eval_macro_micro": f"""
WITH {_PREDICTED}, s AS ({_scores("cm", "label")}), t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM cm), u AS ({_scores("t", "'micro' AS average")})
SELECT 'macro' AS average, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM s UNION ALL SELECT average, precision, recall, f1 FROM u""",
    "eval_auc": f"""
WITH {_PREDICTED}, r AS (SELECT quality, (rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2) AS k FROM p)
SELECT round((sum(k) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 9) AS auc FROM r""",
    "eval_stratified_sample": r"""
WITH g AS (SELECT quality, toxic, count(*) AS g, min(doc_id) AS f FROM labels GROUP BY ALL),
r AS (SELECT l.*, f, row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) AS k, greatest(1, ceil(40 * g / (SELECT count(*) FROM labels))) AS q FROM labels l JOIN g USING (quality, toxic))
SELECT doc_id, quality, toxic FROM r WHERE k <= q ORDER BY f, k LIMIT 40""",
    "eval_fold_ids": r"""SELECT doc_id, ((row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) - 1) % 5)::INT AS fold FROM labels""",
    "eval_label_shares": r"""
SELECT 'quality' AS label, sum(quality)::BIGINT AS positives, round(100 * avg(quality), 4) AS percent FROM labels UNION ALL SELECT 'toxic', sum(toxic)::BIGINT, round(100 * avg(toxic), 4) FROM labels""",
    "eval_token_offsets": f'WITH {_TAGGED} SELECT o_custkey, i, token, tag, start, "end" FROM tt',
    "eval_tag_runs": f'WITH {_TAGGED} SELECT o_custkey, tag, first, last, start, "end" FROM runs',
    "eval_overlaps": f'WITH {_TAGGED} SELECT s.o_orderkey, r.tag AS b_tag, r.start AS b_start FROM span s JOIN runs r USING (o_custkey) WHERE s.start < r."end" AND s."end" > r.start',
    "eval_outside": f'WITH {_TAGGED} SELECT o_orderkey FROM span s WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.o_custkey = s.o_custkey AND s.start < r."end" AND s."end" > r.start)',
    "eval_region_scores": f"""
WITH {_TAGGED}, want AS (SELECT o_custkey, first AS region, unnest(CASE WHEN tag = 1 THEN ['NAME'] ELSE ['ZIP', 'NAME'] END) AS kind FROM runs),
hit AS (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'NAME' ELSE 'ZIP' END AS kind, start, "end" FROM span),
have AS (SELECT DISTINCT o_custkey, r.first AS region, h.kind, r.tag FROM hit h JOIN runs r USING (o_custkey) WHERE h.start < r."end" AND h."end" > r.start),
a AS (SELECT kind, count(h.region) AS tp, count(*) - count(h.region) AS fn FROM want LEFT JOIN have h USING (o_custkey, region, kind) GROUP BY kind),
f AS (SELECT kind FROM have ANTI JOIN want USING (o_custkey, region, kind) WHERE NOT (tag = 2 AND kind IN ('ADDRESS', 'NAME'))
  UNION ALL SELECT kind FROM hit s WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.o_custkey = s.o_custkey AND s.start < r."end" AND s."end" > r.start)),
c AS (SELECT kind, count(*) AS fp FROM f GROUP BY kind)
SELECT kind, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp FROM a FULL JOIN c USING (kind)""",
    "prep_levenshtein": r"SELECT p_partkey, levenshtein(p_name, p_type)::INT AS distance FROM part",
    "prep_line_positions": r"""
WITH w AS (SELECT l_orderkey, l_linenumber AS i, trunc(l_quantity)::INT // 20 AS band FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, band ORDER BY i) AS k, count(*) OVER (PARTITION BY l_orderkey, band) AS n FROM w)
SELECT l_orderkey, i, CASE WHEN n = 1 THEN 'single' WHEN k = 1 THEN 'first' WHEN k = n THEN 'last' ELSE 'mid' END AS line_pos, n AS line_len FROM k""",
} | image_oracles.SQL
_KIND = r"CASE WHEN regexp_matches(token, '^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}') THEN 'EMAIL' WHEN regexp_matches(token, '^[+]\([0-9]{3}\)[0-9]{3}-[0-9]{4}') THEN 'PHONE' WHEN regexp_matches(token, '^[0-9]{5}(-[0-9]{4})?$') THEN 'ZIP' END"
SQL |= {
    "pii_scan": _scan("documents", "doc_id", "text"),
    "pii_scan_pages": _scan("pages", "page_id", "html"),
    "crf_decode": f"WITH RECURSIVE {_VITERBI} SELECT id, i, word, ['O', 'NAME', 'ADDRESS', 'ACCOUNT'][path[i + 1] + 1] AS label FROM tok JOIN best USING (r)",
    "prep_refined_labels": rf"""
WITH {_TOK}, t AS (SELECT doc_id, i, word AS token, CASE i // 4 % 3 WHEN 1 THEN 5 WHEN 2 THEN 13 ELSE 0 END AS tag, lower({_CORE.format("word")}) AS core FROM tk),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - row_number() OVER (PARTITION BY doc_id, tag ORDER BY i) AS run FROM t),
v AS (SELECT *, core IN {_SET(crf.SUFFIXES)} AS suffix, count(*) OVER (PARTITION BY doc_id, tag, run) AS size,
  CASE WHEN tag = 5 THEN CASE WHEN regexp_matches(core, '^[0-9]') AND length(core) <= 5 THEN i WHEN core IN {_SET(crf.SUFFIXES)} THEN i + 1 END
    WHEN regexp_matches(token, '^[0-9]') AND length(token) <= 5 THEN i END AS cut FROM u),
w AS (SELECT *, arg_min(cut, i) FILTER (cut IS NOT NULL) OVER r AS c,
  bool_or(suffix OR (length(core) = 2 AND upper(core) IN {_SET(crf.STATES)}) OR core IN {_SET(crf.DIRECTIONS)} OR (size = 1 AND regexp_full_match(core, '[0-9]{{5}}(-[0-9]{{4}})?'))) OVER r AS signed
  FROM v WINDOW r AS (PARTITION BY doc_id, tag, run)),
k AS (SELECT *, {_KIND} AS kind, regexp_full_match(token, '[0-9]+') AS digits, regexp_full_match(token, '\p{{L}}{{2,}}') AS letters, c IS NULL OR i < c AS before_ FROM w),
a AS (SELECT *, coalesce(kind, CASE WHEN digits AND length(token) BETWEEN 6 AND 20 THEN 'ACCOUNT' END) AS plain FROM k),
l AS (SELECT tag, coalesce(CASE WHEN tag = 5 THEN CASE WHEN before_ THEN CASE WHEN letters THEN 'NAME' ELSE 'ADDRESS' END ELSE coalesce(kind, 'ADDRESS') END
  WHEN tag = 13 THEN coalesce(CASE WHEN NOT signed THEN plain WHEN before_ THEN coalesce(plain, CASE WHEN letters THEN 'NAME' END) ELSE coalesce(plain, 'ADDRESS') END, CASE WHEN digits AND length(token) BETWEEN 4 AND 20 THEN 'ACCOUNT' END) END, 'O') AS label FROM a)
SELECT tag, label, count(*) AS n FROM l GROUP BY ALL""",
    "prep_noisy": f"""
WITH {_TAGGED}, v AS (SELECT o_custkey, i, token, 'O' AS label, variant::INT AS variant FROM tok, range(2) k(variant)),
d AS (SELECT *, {", ".join(f"('0x' || substr(md5(concat_ws(':', o_custkey, i, variant, '42', '{k}')), 1, 8))::BIGINT / 4294967296 AS d{k}" for k in range(4))} FROM v),
a AS (SELECT *, floor(d2 * length(token))::INT + 1 AS cut FROM d WHERE d0 >= 0.1::DOUBLE), o AS (SELECT *, substr(token, cut, 1) AS old FROM a),
n AS (SELECT *, CASE old {" ".join(f"WHEN '{x}' THEN '{y}'" for x, y in prepare._SWAPS.items())} ELSE CASE WHEN regexp_matches(old, '\\p{{L}}') THEN substr('aeiouAEIOU809', floor(d3 * 13)::INT + 1, 1) ELSE old END END AS new FROM o)
SELECT o_custkey, i, label, variant, CASE WHEN d1 < 0.15::DOUBLE AND length(token) >= 3 THEN substr(token, 1, cut - 1) || new || substr(token, cut + 1) ELSE token END AS token FROM n""",
    "prep_align": """
WITH RECURSIVE p AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS truth FROM part), q AS (SELECT *, list_transform(truth, lambda w: regexp_replace(w, '[aeiou]', 'o', 'g')) AS found FROM p),
s(p_partkey, k, nxt, hit) AS (SELECT p_partkey, 0, 0, -1 FROM q UNION ALL
  SELECT p_partkey, k + 1, CASE WHEN near // 1000 <= greatest(3, length(truth[k + 1]) // 2) THEN near % 1000 + 1 ELSE nxt END, CASE WHEN near // 1000 <= greatest(3, length(truth[k + 1]) // 2) THEN near % 1000 ELSE -1 END
  FROM (SELECT s.p_partkey, k, nxt, truth, list_min(list_transform(range(nxt, least(nxt + 5, len(found))), lambda j: levenshtein(lower(truth[k + 1]), lower(found[j + 1])) * 1000 + j)) AS near FROM s JOIN q USING (p_partkey) WHERE k < len(truth)))
SELECT p_partkey, (k - 1)::INT AS truth_i, hit::INT AS found_i, found[hit + 1] AS word FROM s JOIN q USING (p_partkey) WHERE k > 0 AND hit >= 0""",
    "pii_bill_to": """
WITH n AS (SELECT c_custkey, list_aggregate(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS land FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT c_custkey, CASE WHEN regexp_matches(land, '[0-9]') THEN 'Ann' ELSE 'Ann ' || land END AS name, CASE WHEN regexp_matches(land, '[0-9]') THEN land || ' ' ELSE '' END AS lead FROM n),
t AS (SELECT *, 8 + length(name) AS b, lead || c_custkey || ' Oak Street Springfield, IL 62701 US' AS place FROM d),
h AS (SELECT c_custkey, 0 AS o, 'NAME' AS kind, name AS text, 8 AS start, b AS "end" FROM t UNION ALL SELECT c_custkey, 1, 'ADDRESS', place, b, b + 2 + length(place) FROM t
  UNION ALL SELECT c_custkey, 2, 'ZIP', c_custkey::VARCHAR, b + 1 + length(lead), b + 6 + length(lead) FROM t WHERE length(c_custkey::VARCHAR) = 5 UNION ALL SELECT c_custkey, 3, 'ZIP', '62701', b + length(place) - 7, b + length(place) - 2 FROM t
  UNION ALL SELECT c_custkey, 4, 'PHONE', '+(212)555-0199', b + length(place) + 6, b + length(place) + 20 FROM t)
SELECT c_custkey, (row_number() OVER (PARTITION BY c_custkey ORDER BY o) - 1)::INT AS seq, kind, text, start::INT AS start, "end"::INT AS "end" FROM h""",
    "gbdt_labels": """
WITH z AS (SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity < 25 THEN -0.5 ELSE 0.5 END + CASE WHEN l_discount < 0.05 THEN CASE WHEN l_extendedprice < 30000 THEN 0.25 ELSE -0.25 END ELSE 1.0 END)::DOUBLE AS d,
  (CASE WHEN l_tax < 0.04 THEN -1.0 WHEN l_quantity < 10 THEN 2.0 ELSE 0.125 END)::DOUBLE AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, d AS logit_is_document, (d >= 0)::INT AS pred_is_document, p AS logit_is_paper, (p >= 0)::INT AS pred_is_paper FROM z""",
    "img_classify": f"WITH {_PIXELS} SELECT id, round(1 / (1 + exp(-CASE WHEN avg(v) < 118 THEN -0.75 ELSE 0.5 END::DOUBLE)), 9) AS is_document, round(1 / (1 + exp(-CASE WHEN avg(r) < 120 THEN 1.0 ELSE -1.0 END::DOUBLE)), 9) AS is_paper FROM px GROUP BY id",
    "img_ranked_scores": f"""
WITH {_PIXELS}, s AS (SELECT id, CASE WHEN avg(v) < 118 THEN -0.75 ELSE 0.5 END AS d, CASE WHEN avg(r) < 120 THEN 1.0 ELSE -1.0 END AS p FROM px GROUP BY id)
SELECT id, (d < p)::INT AS place, 'is_document' AS label FROM s UNION ALL SELECT id, (d >= p)::INT, 'is_paper' FROM s""",
    "region_lists": f"""
WITH {_LINES} SELECT l_orderkey AS doc_id, 'glm-' || (ln - 1) AS id, 'w' || ln AS text, ln::DOUBLE AS x0, l_quantity::DOUBLE AS x1, round(CASE WHEN l_returnflag <> 'A' THEN least(greatest(l_discount * 2000, 0), 100) ELSE 75 END::DOUBLE, 6) AS confidence, 'glm-ocr' AS source FROM ll""",
    "region_reasons": f"""
WITH {_BOXES}, d AS (SELECT m.doc_id, m.ti, m.iou, m.ca, m.cb, f.winner FROM fate f JOIN matched m ON m.doc_id = f.doc_id AND m.ti = f.ti AND m.gi = coalesce(f.winner, list_min(f.gis)))
SELECT doc_id, ti AS pos, 'won (' || printf('%.1f', CASE WHEN winner IS NULL THEN ca ELSE cb END) || ') over ' || CASE WHEN ca = cb THEN 'equal' ELSE printf('%.1f', CASE WHEN winner IS NULL THEN cb ELSE ca END) END || ', IoU=' || floor(iou * 100 + 0.5)::BIGINT || '%' AS reason FROM d""",
    "region_hit_words": f"""
WITH {_LINES} SELECT l_orderkey AS doc_id, 'A' || o_orderkey % 4 AS text, 'r' || (ln - 1) AS region_id FROM ll JOIN orders ON o_orderkey = l_orderkey WHERE contains('a' || ln, 'a' || o_orderkey % 4)""",
    "region_rectangle": f"WITH {_BOXES} SELECT doc_id, pos FROM box WHERE x0 + dx < 33 AND x0 + dx + w > 12 AND y0 < 11 AND y0 + 8 > 3",
    "region_pixels": f"""
WITH {_LINES}, p AS (SELECT l_orderkey, ln, ['text', 'table', 'formula', 'figure'][ln % 4 + 1] AS task, (l_quantity * 30 - 100)::DOUBLE AS x0, (ln * 90)::DOUBLE AS y0, (l_quantity * 40)::DOUBLE AS x1, (ln * 190)::DOUBLE AS y1 FROM ll)
SELECT l_orderkey, ln, task, {", ".join(f"least(greatest(trunc({c} / 1000 * {s})::INT, 0), {s}) AS {c}" for c, s in (("x0", 640), ("y0", 480), ("x1", 640), ("y1", 480)))} FROM p WHERE task <> 'figure'""",
    "text_fences": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"n":' || p_partkey || '}' ELSE '{"text":"' || p_name || '"}' END AS answer FROM part""",
    "doc_unredacted": f"WITH {_LINES} SELECT o_orderkey::VARCHAR AS id, max('r' || (ln - 1)) AS region FROM orders JOIN ll ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(*) > 1",
    "doc_regions": f"""
WITH {_LINES} SELECT o_orderkey::VARCHAR AS id, max('a3') FILTER (ln = 3) AS text, max(trunc(l_discount * 1000)::DOUBLE) FILTER (ln = 3) AS confidence FROM orders JOIN ll ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    "eval_token_types": """
WITH c AS (SELECT c_custkey, c_name, c_custkey AS k FROM customer), t AS (
  SELECT c_custkey, 0 AS i, 'EMAIL' AS kind FROM c UNION ALL SELECT c_custkey, 1, 'PHONE' FROM c UNION ALL SELECT c_custkey, 2, 'ZIP' FROM c UNION ALL SELECT c_custkey, 3, NULL FROM c UNION ALL SELECT c_custkey, 4, NULL FROM c
  UNION ALL SELECT c_custkey, 5, CASE WHEN k % 2 = 1 THEN 'ACCOUNT' END FROM c UNION ALL SELECT c_custkey, 6, CASE WHEN k % 2 = 1 THEN 'ACCOUNT' END FROM c UNION ALL SELECT c_custkey, 7, NULL FROM c)
SELECT c_custkey, i, kind FROM t""",
    "eval_address_signs": r"""
WITH p AS (SELECT p_partkey, concat_ws(' ', p_name, CASE p_partkey % 3 WHEN 0 THEN '12 Oak Street' WHEN 1 THEN 'TX 75001' END, p_type) AS said, p_partkey % 5 AS pos FROM part),
n AS (SELECT p_partkey, substr(said, 1 + greatest(pos - 12, 0)::INT, 28) AS near FROM p)
SELECT p_partkey, regexp_matches(near, '(?i)\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|boulevard|blvd|way|court|ct|place|pl)\b') OR regexp_matches(near, '\b[A-Z]{2}\s+\d{5}\b') OR regexp_matches(near, '(?i)\bp\.?\s?o\.?\s?box\b')
  OR regexp_matches(near, '(?i)\b(apt|suite|ste|unit)\b') OR regexp_matches(near, '\b[0-9]{1,5}\s+\p{Lu}\p{Ll}+') OR regexp_matches(near, '(?i)\b(north|south|east|west)\b') OR regexp_matches(near, '\bUS\b') AS sign FROM n""",
    "eval_invoice_numbers": "SELECT o_orderkey, o_orderkey % 5 <> 1 AS invoice FROM orders",
    "eval_samples": "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 3",
    "prep_dataset_labels": f"""
WITH d(i, dataset, {", ".join(prepare.LABELS)}) AS (VALUES {", ".join(f"({k}, '{name}', {', '.join(map(str, bits))})" for k, (name, bits) in enumerate(sorted(prepare.DATASETS.items())))})
SELECT dataset || '/' || p_partkey || '.png' AS filename, {", ".join(prepare.LABELS)} FROM part JOIN d ON p_partkey % 6 = i""",
    "prep_labelled": f"WITH {_TAGGED} SELECT o_custkey, count(*) AS n FROM tt WHERE o_custkey % 3 = 0 GROUP BY o_custkey HAVING count(*) FILTER (tag = 1) > 0",
}
_WORD_KEY = "CASE WHEN strlen(lower(word)) <= 20 THEN lower(word) ELSE '__LONG__' END"
_FLAGS = {
    "upper": r"regexp_full_match(word, '\p{Lu}+')", "title": r"regexp_full_match(word, '\p{Lu}\p{Ll}*')", "digit": "regexp_full_match(word, '[0-9]+')", "alpha": r"regexp_full_match(word, '\p{L}+')",
    "has_digit": "regexp_matches(word, '[0-9]')", "has_at": "contains(word, '@')", "has_hyphen": "contains(word, '-')", "has_alpha": r"regexp_matches(word, '\p{L}')",
    "punct": r"NOT regexp_matches(word, '[\p{L}\p{N}]')", "street_suffix": f"core IN {_SET(crf.SUFFIXES)}", "state_abbrev": f"length(word) = 2 AND word IN {_SET(crf.STATES)}", "direction": f"core IN {_SET(crf.DIRECTIONS)}",
    "is_bldg_num": "regexp_matches(word, '^[0-9]') AND strlen(word) <= 5 AND NOT regexp_full_match(word, '[0-9]+')", "title_prefix": f"core IN {_SET(crf.TITLES)}", "po_box": f"core IN {_SET(crf.BOXES)}",
    "is_name_word": rf"regexp_full_match(word, '\p{{Lu}}\p{{L}}*') AND strlen(word) BETWEEN 2 AND 20 AND NOT (length(word) = 2 AND word IN {_SET(crf.STATES)}) AND core NOT IN {_SET(crf.SUFFIXES | crf.DIRECTIONS | crf.TITLES | crf.BOXES)}",
}
_NAMES = [
    "'w:' || key", "'w_shape:' || shape", "'w_len:' || least(strlen(word), 20)", r"'w_starts:' || CASE WHEN regexp_matches(word, '^[0-9]') THEN 'D' WHEN regexp_matches(word, '^\p{L}') THEN 'A' WHEN regexp_matches(word, '^[.,()/-]') THEN 'P' ELSE 'X' END",
    *[f"'w_{k}:' || ({v})::INT" for k, v in _FLAGS.items()],
    *[f"CASE WHEN strlen(word) >= {n} THEN 'w_{side}{n}:' || {cut} END" for n in (2, 3) for side, cut in (("prefix", f"left(lower(word), {n})"), ("suffix", f"right(lower(word), {n})"))],
    "'pos_bias:' || CASE WHEN i = 0 THEN 1 WHEN i = n - 1 THEN 2 ELSE 0 END",
    *[f"'w{k:+}:' || coalesce(key{k + 2}, '{'__BOS__' if k < 0 else '__EOS__'}')" for k in crf.AROUND], *[f"'w{k:+}_shape:' || left(shape{k + 2}, 8)" for k in crf.AROUND],
]
_NEAR_TOKENS = ", ".join(f"{'lag' if k < 0 else 'lead'}({c}, {abs(k)}) OVER w AS {c}{k + 2}" for k in crf.AROUND for c in ("key", "shape"))
SQL |= {
    "crf_feature_counts": rf"""
WITH txt AS (SELECT row_number() OVER () AS r, regexp_extract_all(text, '[^ \t\n\f\r]+') AS ws FROM conversations),
tok AS (SELECT r, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws)))::INT AS i FROM txt),
one AS (SELECT *, {_WORD_KEY} AS key, {_SHAPE} AS shape, lower({_CORE.format("word")}) AS core FROM tok),
two AS (SELECT *, {_NEAR_TOKENS} FROM one WINDOW w AS (PARTITION BY r ORDER BY i)),
f AS (SELECT unnest([{", ".join(_NAMES)}]) AS feature FROM two)
SELECT feature, count(*) AS n FROM f WHERE feature IS NOT NULL GROUP BY feature""",
    "crf_reloaded": SQL["crf_decode"],
    "gbdt_reloaded": SQL["gbdt_scores"],
    "eval_hold_out": "SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 100 < 20 AS held_out FROM customer",
    "src_label_table": f"SELECT 'set, ' || p_partkey || '\".png' AS filename, {', '.join(f'((p_partkey >> {k}) & 1)::INT AS {x}' for k, x in enumerate(prepare.LABELS))} FROM part",
    "doc_replaced": "SELECT o_orderkey::VARCHAR AS id, 102 AS width, (o_orderkey % 50 + 2)::INT AS height, count(*)::INT AS regions FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "src_data_urls": "SELECT p_partkey, 'data:image/png;base64,' || to_base64(encode(p_name)) AS url, p_name AS said FROM part",
    "src_words": f"""
WITH {_LINES} SELECT 'f' || l_orderkey AS filename, 'é' || chr(10) AS "ocrText", (ln - 1)::INT AS i, 'w"' || ln AS text, ln::INT AS x0, l_discount::DOUBLE AS sure, round(avg(l_tax) OVER (PARTITION BY l_orderkey), 9)::DOUBLE AS confidence FROM ll""",
    "src_tsv_words": f"""
WITH {_LINES} SELECT l_orderkey, (ln - 1)::INT AS line, 't' || ln AS text, (ln * 10)::INT AS x0, 7 AS y0, (ln * 10 + trunc(l_quantity))::INT AS x1, 16 AS y1, CASE WHEN ln % 3 = 0 THEN 0 ELSE trunc(l_discount * 100) END::DOUBLE AS confidence
FROM ll WHERE ln % 4 <> 0 AND ln % 5 <> 0 AND ln % 7 <> 0""",
    "src_image_numbers": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey + 8600 END::INT AS number FROM part",
}
#: For each query of a few features, their places among the 81.
_PLACES = {name: columns for name, (_, columns) in image_oracles.COLUMNS.items()} | {
    "img_channel_stats": {"r_mean": 0, "r_std": 1, "g_mean": 4, "g_std": 5, "b_mean": 8, "b_std": 9},
    "img_gray_stats": {"mean": 12, "median": 13, "std": 14, "entropy": 15},
    "img_color": {"colorfulness": 16, "saturation_mean": 17, "saturation_var": 18},
    "img_laplacian": {"laplacian_variance": 19},
    "img_sobel": {"sobel_mean": 20, "sobel_std": 21, "sobel_p90": 22},
    "img_fractal": {"fractal": 49},
    "img_blockiness": {"rows_blockiness": 51, "columns_blockiness": 52},
    "img_cell_density": {"cell_std": 69},
    "img_anisotropy": {"anisotropy": 70},
    "img_tile_entropy": {"peak": 71},
}
_AT = {k: f"q{n}.{column}" for n, columns in enumerate(_PLACES.values()) for column, k in columns.items()}
SQL["img_features81"] = f"SELECT id, [{', '.join(f'({_AT[k]})::DOUBLE' for k in range(81))}] AS features FROM " + " JOIN ".join(f"({SQL[name]}) q{n}" + (" USING (id)" if n else "") for n, name in enumerate(_PLACES))
