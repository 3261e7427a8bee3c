"""DuckDB SQL for the image features: the same pictures, one for each supplier, as a table of pixels."""

from __future__ import annotations

EDGE = 32

PIXELS = f"""
px AS (SELECT s_suppkey AS id, y, x, (12 * x + s_suppkey) & 255 AS r, (12 * y) & 255 AS g, (6 * (x + y)) & 255 AS b,
  0.299::DOUBLE * ((12 * x + s_suppkey) & 255) + 0.587::DOUBLE * ((12 * y) & 255) + 0.114::DOUBLE * ((6 * (x + y)) & 255) AS v
  FROM supplier, range({EDGE}) q(y), range({EDGE}) p(x))"""
#: Neighbours, with borders repeated: l, e beside; nw, n, ne above; sw, s, se below.
NINE = """
rows3 AS (SELECT *, coalesce(lag(v) OVER a, v) AS l, coalesce(lead(v) OVER a, v) AS e FROM px WINDOW a AS (PARTITION BY id, y ORDER BY x)),
nine AS (SELECT *, coalesce(lag(l) OVER a, l) AS nw, coalesce(lag(v) OVER a, v) AS n, coalesce(lag(e) OVER a, e) AS ne,
  coalesce(lead(l) OVER a, l) AS sw, coalesce(lead(v) OVER a, v) AS s, coalesce(lead(e) OVER a, e) AS se FROM rows3 WINDOW a AS (PARTITION BY id, x ORDER BY y))"""
SOBEL = f"""{PIXELS}, {NINE},
ad AS (SELECT id, y, x, (ne - nw) + 2 * (e - l) + (se - sw) AS a, (sw - nw) + 2 * (s - n) + (se - ne) AS d FROM nine),
so AS (SELECT id, y, x, sqrt(a * a + d * d) AS len, atan2(d, a) AS ang FROM ad)"""
INNER = f"""{PIXELS}, {NINE},
inn AS (SELECT id, y, x, sqrt((e - l) * (e - l) + (s - n) * (s - n)) AS m FROM nine WHERE y BETWEEN 1 AND {EDGE - 2} AND x BETWEEN 1 AND {EDGE - 2})"""


def otsu(name: str, source: str, value: str, bins: int, bin_: str, centre: str, result: str) -> str:
    """A table name(id, t): the first threshold of greatest between-class variance. bin_, centre, result: SQL of a row's bin, and of a bin k's
    centre and threshold, over columns lo and width."""
    return f"""
{name}_r AS (SELECT id, min({value}) AS lo, (max({value}) - min({value})) / {bins} AS width FROM {source} GROUP BY id),
{name}_b AS (SELECT id, {bin_} AS k, count(*) AS c FROM {source} JOIN {name}_r USING (id) GROUP BY ALL),
{name}_h AS (SELECT r.id, k.k, coalesce(c, 0)::DOUBLE AS c, {centre} AS mid, {result} AS res FROM {name}_r r CROSS JOIN range({bins}) k(k) LEFT JOIN {name}_b b ON b.id = r.id AND b.k = k.k),
{name}_c AS (SELECT *, sum(c) OVER w AS below, sum(c) OVER (PARTITION BY id) AS n, sum(mid * c) OVER w AS mass, sum(mid * c) OVER (PARTITION BY id) AS total FROM {name}_h WINDOW w AS (PARTITION BY id ORDER BY k)),
{name}_v AS (SELECT *, CASE WHEN below >= 1 AND n - below >= 1 THEN below * (n - below) * power(mass / below - (total - mass) / (n - below), 2) ELSE 0 END AS between_ FROM {name}_c),
{name} AS (SELECT id, arg_max(res, (round(between_, 3), -k)) AS t FROM {name}_v GROUP BY id)"""


_OTSU_64 = ("least(floor(({v} - lo) / width), 63)::INT", "lo + (k.k + 0.5) * width", "lo + (k.k + 1.0) * width")
_OTSU_256 = ("floor(least(greatest(v, 0), 255))::INT", "k.k::DOUBLE", "k.k::DOUBLE")
INK = otsu("ots", "px", "v", 256, *_OTSU_256) + ", ink AS (SELECT px.*, v <= t AS dark FROM px JOIN ots USING (id))"

_RING = ("n", "ne", "e", "se", "s", "sw", "l", "nw")
_PATTERN = " + ".join(f"(({c} >= v)::INT << {k})" for k, c in enumerate(_RING))
_MEAN = "(" + " + ".join(["v", *_RING]) + ") / 9"
LBP = f"""{PIXELS}, {NINE},
pat AS (SELECT range::INT AS p, list_min(list_transform(range(8), lambda k: ((range >> k) | (range << (8 - k))) & 255)) AS low FROM range(256)),
bins AS (SELECT p, CASE WHEN bit_count((xor(low, ((low >> 1) | (low << 7)) & 255))::INT) <= 2 THEN bit_count(low::INT) ELSE 9 END AS bin FROM pat),
lb AS (SELECT id, {_PATTERN} AS p, sqrt((power(v - {_MEAN}, 2) + {" + ".join(f"power({c} - {_MEAN}, 2)" for c in _RING)}) / 9) AS dev FROM nine WHERE y BETWEEN 1 AND {EDGE - 2} AND x BETWEEN 1 AND {EDGE - 2}),
lbp AS (SELECT id, bin, dev FROM lb JOIN bins USING (p))"""

_DCT = "CASE WHEN {u} = 0 THEN sqrt(1 / 8) ELSE sqrt(2 / 8) END * cos((2 * {x} + 1) * {u} * pi() / 16)"
def _morph(name: str, source: str, pick: str, best: str, radius: int = 10) -> str:
    """The extreme over a disk, row by row; a border's repeats lie nearer the middle as well, so windows may end there."""
    half = {dy: int((radius * radius - dy * dy) ** 0.5) for dy in range(-radius, radius + 1)}
    wide = ", ".join(f"{pick}(v) OVER (PARTITION BY id, y ORDER BY x ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS m{k}" for k in sorted(set(half.values())))
    tall = ", ".join(f"{'lead' if dy > 0 else 'lag'}(m{k}, {abs(dy)}) OVER c" for dy, k in half.items())
    return f"""
{name}_w AS (SELECT id, y, x, {wide} FROM {source}), {name} AS (SELECT id, y, x, {best}({tall}) AS v FROM {name}_w WINDOW c AS (PARTITION BY id, x ORDER BY y))"""


SQL = {
    # Running moments, pixel after pixel, with the weights that the features have.
    "img_channel_moments": f"""
WITH {PIXELS}, c AS (SELECT id, 'r' AS c, y * {EDGE} + x AS i, r::DOUBLE AS u FROM px UNION ALL SELECT id, 'g', y * {EDGE} + x, g FROM px UNION ALL SELECT id, 'b', y * {EDGE} + x, b FROM px),
m AS (SELECT *, sum(u) OVER w / (i + 1) AS mean FROM c WINDOW w AS (PARTITION BY id, c ORDER BY i)),
d AS (SELECT *, u - coalesce(lag(mean) OVER w, 0) AS delta FROM m WINDOW w AS (PARTITION BY id, c ORDER BY i)),
e AS (SELECT *, delta / (i + 1) AS dn, delta * (delta / (i + 1)) * i AS term, sum(delta * (u - mean)) OVER w AS m2 FROM d WINDOW w AS (PARTITION BY id, c ORDER BY i)),
f AS (SELECT *, coalesce(lag(m2) OVER w, 0) AS old2 FROM e WINDOW w AS (PARTITION BY id, c ORDER BY i)),
g AS (SELECT *, sum(term * dn * (i - 2) - 3 * dn * old2) OVER w AS m3 FROM f WINDOW w AS (PARTITION BY id, c ORDER BY i)),
h AS (SELECT *, coalesce(lag(m3) OVER w, 0) AS old3 FROM g WINDOW w AS (PARTITION BY id, c ORDER BY i)),
s AS (SELECT id, c, arg_max(m2, i) / count(*) AS v, arg_max(m3, i) / count(*) AS t, sum(term * dn * dn * (i * i - 3 * i + 3) + 6 * dn * dn * old2 - 4 * dn * old3) / count(*) AS q FROM h GROUP BY id, c)
SELECT id, {", ".join(f"round(max(t / (v * sqrt(v))) FILTER (c = '{c}'), 6) AS {c}_skew, round(max(q / (v * v) - 3) FILTER (c = '{c}'), 6) AS {c}_kurtosis" for c in "rgb")} FROM s GROUP BY id""",
    "img_edge_density": f"""
WITH {SOBEL}, {otsu("ot", "so", "len", 64, *[x.format(v="len") for x in _OTSU_64])} SELECT id, round(avg((len > t)::INT), 6) AS edge_density FROM so JOIN ot USING (id) GROUP BY id""",
    "img_edge_directions": f"""
WITH {SOBEL}, st AS (SELECT * FROM (SELECT *, avg(len) OVER (PARTITION BY id) AS m FROM so) WHERE len > m),
f AS (SELECT *, least(floor((ang + pi()) / (2 * pi()) * 8), 7)::INT AS bin, CASE WHEN abs(ang) > pi() / 2 THEN pi() - abs(ang) ELSE abs(ang) END AS a FROM st),
k AS (SELECT *, a < radians(10) OR abs(pi() / 2 - a) < radians(10) AS axis FROM f), z AS (SELECT *, NOT axis AND abs(a - pi() / 4) < pi() / 4 - radians(10) AS slant FROM k)
SELECT id, {", ".join(f"round(avg((bin = {k})::INT), 6) AS d{k}" for k in range(8))},
  round(CASE WHEN coalesce(sum(len) FILTER (slant), 0) >= 1e-12 THEN coalesce(sum(len) FILTER (axis), 0) / sum(len) FILTER (slant) WHEN coalesce(sum(len) FILTER (axis), 0) > 0 THEN 10 ELSE 1 END, 6) AS hv_ratio FROM z GROUP BY id""",
    "img_canny": f"""
WITH {SOBEL}, w AS (SELECT *, lag(len) OVER a AS l, lead(len) OVER a AS e FROM so WINDOW a AS (PARTITION BY id, y ORDER BY x)),
q AS (SELECT *, lag(l) OVER a AS nw, lag(len) OVER a AS n, lag(e) OVER a AS ne, lead(l) OVER a AS sw, lead(len) OVER a AS s, lead(e) OVER a AS se, floor((ang + pi()) / (pi() / 4) + 0.5)::INT % 4 AS sector FROM w WINDOW a AS (PARTITION BY id, x ORDER BY y)),
t AS (SELECT id, CASE WHEN y BETWEEN 1 AND {EDGE - 2} AND x BETWEEN 1 AND {EDGE - 2}
  AND len >= CASE sector WHEN 0 THEN n WHEN 1 THEN ne WHEN 2 THEN l ELSE nw END AND len >= CASE sector WHEN 0 THEN s WHEN 1 THEN sw WHEN 2 THEN e ELSE se END THEN len ELSE 0 END AS thin FROM q),
{otsu("ot", "t", "thin", 64, *[x.format(v="thin") for x in _OTSU_64])} SELECT id, round(avg((thin > ot.t)::INT), 6) AS canny FROM t JOIN ot USING (id) GROUP BY id""",
    "img_dct": f"""
WITH {PIXELS}, u AS (SELECT id, y // 8 AS gy, x // 8 AS gx, y % 8 AS y, u, sum(v * ({_DCT.format(u="u", x="(x % 8)")})) AS v FROM px, range(8) k(u) GROUP BY ALL),
c AS (SELECT id, gy, gx, u, w, abs(sum(v * ({_DCT.format(u="w", x="y")}))) AS c FROM u, range(8) k(w) GROUP BY ALL),
b AS (SELECT id, gy, gx, sum(c) FILTER (w = 0 AND u < 3) / sum(c) AS share FROM c GROUP BY ALL) SELECT id, round(avg(share), 6) AS low_share FROM b GROUP BY id""",
    "img_lbp": f"WITH {LBP} SELECT id, {', '.join(f'round(avg((bin = {k})::INT), 6) AS bin{k}' for k in range(10))} FROM lbp GROUP BY id",
    "img_lbp_variance": f"WITH {LBP} SELECT id, {', '.join(f'round(coalesce(sum(dev) FILTER (bin = {k}), 0) / sum(dev), 6) AS bin{k}' for k in range(10))} FROM lbp GROUP BY id",
    "img_glcm": f"""
WITH {PIXELS}, t AS (SELECT id, yy, xx, v FROM px JOIN range(64) a(yy) ON y = yy // 2 JOIN range(64) b(xx) ON x = xx // 2),
q AS (SELECT id, yy, xx, floor((v - min(v) OVER i) / (max(v) OVER i - min(v) OVER i) * 15)::INT AS q FROM t WINDOW i AS (PARTITION BY id)),
p AS (SELECT a.id, o, a.q AS i, b.q AS j, count(*) AS c FROM (SELECT id, q, o, xx + dx AS bx, yy + dy AS by_ FROM q, (VALUES (0, 5, 0), (1, 0, 5), (2, 5, 5), (3, -5, 5)) k(o, dx, dy)) a
  JOIN q b ON b.id = a.id AND b.xx = bx AND b.yy = by_ GROUP BY ALL),
n AS (SELECT *, c / sum(c) OVER (PARTITION BY id, o) AS p FROM p), m AS (SELECT *, sum(i * p) OVER w AS mx, sum(j * p) OVER w AS my FROM n WINDOW w AS (PARTITION BY id, o)),
f AS (SELECT id, o, sum((i - j) * (i - j) * p) AS contrast, sum((i - mx) * (j - my) * p) / sqrt(sum((i - mx) * (i - mx) * p) * sum((j - my) * (j - my) * p)) AS corr, sum(p * p) AS energy, sum(p / (1 + abs(i - j))) AS homogeneity FROM m GROUP BY id, o)
SELECT id, round(avg(contrast), 6) AS contrast, round(avg(corr), 6) AS correlation, round(avg(energy), 6) AS energy, round(avg(homogeneity), 6) AS homogeneity FROM f GROUP BY id""",
    "img_residual": f"""
WITH {INNER}, w AS (SELECT p.id, p.y, p.x, any_value(p.v) AS v, quantile_disc(q.v, 0.5) AS med FROM (SELECT *, least(greatest(y + dy, 0), {EDGE - 1}) AS qy, least(greatest(x + dx, 0), {EDGE - 1}) AS qx FROM px, range(-2, 3) a(dy), range(-2, 3) b(dx)) p
  JOIN px q ON q.id = p.id AND q.y = qy AND q.x = qx GROUP BY p.id, p.y, p.x),
r AS (SELECT id, var_pop(v - med) AS res FROM w GROUP BY id), g AS (SELECT id, avg(m) AS m FROM inn GROUP BY id)
SELECT id, round(res, 6) AS residual_variance, round(m / res, 6) AS gradient_snr FROM r JOIN g USING (id)""",
    "img_shadow": f"""
WITH {PIXELS}, {_morph("wide", "px", "max", "greatest")}, {_morph("light", "wide", "min", "least")},
j AS MATERIALIZED (SELECT l.id, l.y, l.x, l.v AS light, p.v AS g FROM light l JOIN px p USING (id, y, x)),
k AS (SELECT *, lead(light) OVER a - lag(light) OVER a AS dx, lead(light) OVER b - lag(light) OVER b AS dy FROM j WINDOW a AS (PARTITION BY id, y ORDER BY x), b AS (PARTITION BY id, x ORDER BY y)),
s AS (SELECT id, avg(sqrt(dx * dx + dy * dy)) AS slope FROM k WHERE dx IS NOT NULL AND dy IS NOT NULL GROUP BY id)
SELECT id, round(avg((g < 0.7::DOUBLE * light)::INT), 6) AS shadow_share, round(var_pop(light), 6) AS light_variance, round(coalesce(avg(light - g) FILTER (light > g), 0), 6) AS depth_mean,
  round(coalesce(stddev_pop(light - g) FILTER (light > g), 0), 6) AS depth_std, round(any_value(slope), 6) AS slope FROM j JOIN s USING (id) GROUP BY id""",
    "img_ink_runs": f"""
WITH {PIXELS}, {INK}, i AS (SELECT id, y, x - row_number() OVER (PARTITION BY id, y ORDER BY x) AS k FROM ink WHERE dark), r AS (SELECT id, count(*) AS n FROM i GROUP BY id, y, k),
m AS (SELECT id, avg(n) AS mean, stddev_pop(n) AS std FROM r GROUP BY id), l AS (SELECT id, y, sum(dark::INT) AS n FROM ink GROUP BY ALL), p AS (SELECT id, stddev_pop(n) AS rows_std FROM l GROUP BY id)
SELECT id, round(mean, 6) AS run_mean, round(std, 6) AS run_std, round(rows_std, 6) AS rows_std FROM m JOIN p USING (id)""",
    "img_saturation_edges": f"""
WITH {INNER}, s AS (SELECT px.id, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS sat, coalesce(m, 0) AS m FROM px LEFT JOIN inn USING (id, y, x)),
t AS (SELECT *, m < max(m) OVER (PARTITION BY id) * 0.3::DOUBLE AS flat FROM s)
SELECT id, round(avg(sat) FILTER (flat) / avg(sat) FILTER (NOT flat), 6) AS saturation_ratio FROM t GROUP BY id""",
    "img_lines": f"""
WITH {PIXELS}, {INK}, h AS (SELECT id, t, floor((x * cos(t * (pi() / 64)) + y * sin(t * (pi() / 64)) + sqrt({2 * EDGE * EDGE})) / (2 * sqrt({2 * EDGE * EDGE}) / 64))::INT AS r FROM ink, range(64) k(t) WHERE dark),
a AS (SELECT id, r, t, count(*) AS c FROM h WHERE r < 64 GROUP BY ALL), m AS (SELECT *, max(c) OVER (PARTITION BY id) AS most FROM a),
p AS (SELECT a.id, a.r, a.t FROM m a LEFT JOIN a b ON b.id = a.id AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.t BETWEEN a.t - 1 AND a.t + 1 AND b.c > a.c
  WHERE a.most >= 3 AND a.c >= floor(a.most * 0.5) AND a.r BETWEEN 1 AND 62 AND a.t BETWEEN 1 AND 62 AND b.id IS NULL)
SELECT s_suppkey AS id, round(count(p.id)::DOUBLE, 6) AS lines FROM supplier LEFT JOIN p ON p.id = s_suppkey GROUP BY s_suppkey""",
    "img_components": f"""
WITH RECURSIVE {PIXELS}, {INK}, d AS (SELECT id, y, x, y * {EDGE} + x AS i FROM ink WHERE dark),
run AS (SELECT *, y * {EDGE} + x - row_number() OVER (PARTITION BY id, y ORDER BY x) AS k FROM d),
seg AS (SELECT id, y, k, min(x) AS x0, max(x) AS x1, min(i) AS s, count(*) AS n FROM run GROUP BY id, y, k),
adj AS (SELECT a.id, a.s, b.s AS o FROM seg a JOIN seg b ON a.id = b.id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
reach(id, s, o) AS (SELECT id, s, s FROM seg UNION SELECT r.id, r.s, a.o FROM reach r JOIN adj a ON a.id = r.id AND a.s = r.o),
lab AS (SELECT id, s, min(o) AS c FROM reach GROUP BY id, s),
comp AS (SELECT id, c, sum(n) AS n, max(x1) - min(x0) + 1 AS w, max(y) - min(y) + 1 AS h FROM seg JOIN lab USING (id, s) GROUP BY id, c),
big AS (SELECT *, w / h AS aspect, n / (2 * (w + h)) AS stroke FROM comp WHERE n >= 3)
SELECT id, any_value(k)::DOUBLE AS components, round(median(aspect), 6) AS aspect, round(median(stroke), 6) AS stroke, round(avg((n < 100 AND (aspect > 3 OR aspect < 0.33))::INT), 6) AS thin_share
FROM big JOIN (SELECT id, count(*) AS k FROM comp GROUP BY id) USING (id) GROUP BY id""",
}
#: For each query the group that holds its features, and their columns.
COLUMNS = {
    "img_channel_moments": ("color", {"r_skew": 2, "r_kurtosis": 3, "g_skew": 6, "g_kurtosis": 7, "b_skew": 10, "b_kurtosis": 11}),
    "img_edge_density": ("edges", {"edge_density": 23}),
    "img_edge_directions": ("edges", {f"d{k}": 24 + k for k in range(8)} | {"hv_ratio": 32}),
    "img_canny": ("edges", {"canny": 33}),
    "img_dct": ("texture", {"low_share": 34}),
    "img_lbp": ("texture", {f"bin{k}": 35 + k for k in range(10)}),
    "img_lbp_variance": ("crumple", {f"bin{k}": 59 + k for k in range(10)}),
    "img_glcm": ("texture", {"contrast": 45, "correlation": 46, "energy": 47, "homogeneity": 48}),
    "img_residual": ("noise", {"residual_variance": 50, "gradient_snr": 53}),
    "img_shadow": ("shadow", {"shadow_share": 54, "light_variance": 55, "depth_mean": 56, "depth_std": 57, "slope": 58}),
    "img_components": ("document", {"components": 72, "aspect": 73, "stroke": 74, "thin_share": 75}),
    "img_ink_runs": ("document", {"run_mean": 76, "run_std": 77, "rows_std": 78}),
    "img_lines": ("document", {"lines": 79}),
    "img_saturation_edges": ("document", {"saturation_ratio": 80}),
}
