"""Resampling, rasterisation, spectra and equalisation over the derived rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clahe as cl
from ..operators import rasterize as ra
from ..operators import resample as rs
from ..operators import spectral as sp
from ..sources import derived as src
from ..sources.derived import with_sql
from .registry import fixed, fixed_sql, query

C = F.col


def _grid_sql(w: int, h: int) -> str:
    return f"(SELECT CAST(a AS INTEGER) AS dx, CAST(b AS INTEGER) AS dy FROM (SELECT unnest(generate_series(0, {w - 1})) AS a), (SELECT unnest(generate_series(0, {h - 1})) AS b))"


def _border_sql(i: str, border: str, n: int = 8) -> str:
    m = n - 1
    if border == "wrap":
        return f"((({i}) % {n}) + {n}) % {n}"
    if border == "constant":
        return f"CASE WHEN {i} BETWEEN 0 AND {m} THEN {i} END"
    r = {
        "replicate": i,
        "reflect": f"CASE WHEN {i} < 0 THEN -({i}) - 1 WHEN {i} > {m} THEN {2 * m + 1} - ({i}) ELSE {i} END",
        "reflect101": f"CASE WHEN {i} < 0 THEN -({i}) WHEN {i} > {m} THEN {2 * m} - ({i}) ELSE {i} END",
    }[border]
    return f"greatest(0, least({m}, {r}))"


def _bilinear_sql(dst: tuple[int, int], px: str, py: str, border: str, value: int, out: str) -> str:
    taps = ", ".join(f"{_border_sql(f'(x0 + {k % 2})', border)} AS x{k}, {_border_sql(f'(y0 + {k // 2})', border)} AS y{k}" for k in range(4))
    joins = " ".join(f"LEFT JOIN gray8 g{k} ON g{k}.image_id = i.image_id AND g{k}.x = t.x{k} AND g{k}.y = t.y{k}" for k in range(4))
    v = [f"coalesce(CAST(g{k}.v AS DOUBLE), {value})" for k in range(4)]
    return f""", p AS (SELECT dx, dy, CAST({px} AS DOUBLE) AS px, CAST({py} AS DOUBLE) AS py FROM {_grid_sql(*dst)}),
q AS (SELECT dx, dy, px - floor(px) AS fx, py - floor(py) AS fy, CAST(floor(px) AS INTEGER) AS x0, CAST(floor(py) AS INTEGER) AS y0 FROM p),
t AS (SELECT dx, dy, fx, fy, {taps} FROM q),
w AS (SELECT i.image_id, t.dx, t.dy, fy, {v[0]} + ({v[1]} - {v[0]}) * fx AS top, {v[2]} + ({v[3]} - {v[2]}) * fx AS low FROM (SELECT DISTINCT image_id FROM gray8) i, t {joins})
SELECT image_id, dx AS x, dy AS y, {out.format(v='(top + (low - top) * fy)')} AS v FROM w"""


@query("bilinear", with_sql("gray8", _bilinear_sql((12, 12), "dx * 0.625 - 0.25", "dy * 0.75 - 0.5", "replicate", 0, fixed_sql("{v}"))))
def bilinear(spark, sf):
    p = rs.grid(spark, (12, 12)).select("dx", "dy", (C("dx") * 0.625 - 0.25).alias("px"), (C("dy") * 0.75 - 0.5).alias("py"))
    return rs.bilinear_at(src.gray8(spark, sf), p, (8, 8), 144).withColumn("v", fixed(C("v")))


_CLAMPED = "least(greatest(CAST({} AS DOUBLE), 0), CAST(8 AS DOUBLE) - 1 - CAST(0.001 AS DOUBLE))"


@query("interpolate", with_sql("gray8", _bilinear_sql((10, 10), _CLAMPED.format("dx * 0.875 - 0.5"), _CLAMPED.format("dy * 0.875"), "replicate", 0, fixed_sql("{v}"))))
def interpolate(spark, sf):
    p = rs.grid(spark, (10, 10)).select("dx", "dy", (C("dx") * 0.875 - 0.5).alias("px"), (C("dy") * 0.875).alias("py"))
    return rs.interpolate(src.gray8(spark, sf), p, (8, 8), 100).withColumn("v", fixed(C("v")))


#: Source = 0.5 p + 0.25 and 0.75 p - 2.5: exact in binary, and beyond both edges.
_H = [[2.0, 0.0, -0.5], [0.0, 4 / 3, 10 / 3], [0.0, 0.0, 1.0]]


def _warp(border: str, value: int = 0):
    m = rs.invert3(_H)
    px, py = (f"(CAST({r[0]!r} AS DOUBLE) * dx + CAST({r[1]!r} AS DOUBLE) * dy + CAST({r[2]!r} AS DOUBLE)) / (CAST({m[2][0]!r} AS DOUBLE) * dx + CAST({m[2][1]!r} AS DOUBLE) * dy + CAST({m[2][2]!r} AS DOUBLE))" for r in m[:2])
    sql = with_sql("gray8", _bilinear_sql((20, 16), px, py, border, value, "CAST(floor({v}) AS INTEGER)"))

    @query(f"warp_{border}", sql)
    def f(spark, sf):
        return rs.warp_perspective(src.gray8(spark, sf), (8, 8), (20, 16), _H, border, value)

    return f


for _b in rs.BORDERS:
    _warp(_b, 77 if _b == "constant" else 0)


def _window_sql(dst, scale, offset, hx, hy, source: str = "gray8") -> str:
    s, o = scale, offset
    hat = lambda d, h: f"greatest(CAST(0 AS DOUBLE), 1 - abs({d}) / CAST({h} AS DOUBLE))"
    return f""", p AS (SELECT dx, dy, dx * CAST({s[0]} AS DOUBLE) + CAST({o[0]} AS DOUBLE) AS px, dy * CAST({s[1]} AS DOUBLE) + CAST({o[1]} AS DOUBLE) AS py FROM {_grid_sql(*dst)}),
tx AS (SELECT dx, dy, px, py, unnest(generate_series(CAST(floor(px - {hx}) AS INTEGER), CAST(ceil(px + {hx}) AS INTEGER))) AS x FROM p),
t AS (SELECT dx, dy, px, py, x, unnest(generate_series(CAST(floor(py - {hy}) AS INTEGER), CAST(ceil(py + {hy}) AS INTEGER))) AS y FROM tx),
k AS (SELECT dx, dy, x, y, {hat('x - px', hx)} * {hat('y - py', hy)} AS w FROM t),
n AS (SELECT dx, dy, count(*) AS n, sum(w) AS total FROM k GROUP BY 1, 2),
g AS (SELECT image_id, dx, dy, count(*) AS c, sum(v * w) AS s, sum(w) AS own FROM k JOIN {source} USING (x, y) GROUP BY 1, 2, 3)"""


@query("scale_hat", with_sql("gray8", _window_sql((4, 4), (2.0, 2.0), (0.5, 0.5), 4.0, 4.0) + f" SELECT image_id, dx AS x, dy AS y, {fixed_sql('CASE WHEN total > 1e-15 THEN s / total ELSE 0 END')} AS v FROM g JOIN n USING (dx, dy)"))
def scale_hat(spark, sf):
    return rs.scale(src.gray8(spark, sf), (8, 8), (4, 4), rs.hat).withColumn("v", fixed(C("v")))


@query("crop_and_scale", with_sql("gray8", _window_sql((8, 8), (0.5, 0.5), (1.75, 2.75), 2.0, 2.0) + f" SELECT image_id, dx AS x, dy AS y, {fixed_sql('s / total')} AS v FROM g JOIN n USING (dx, dy)"))
def crop_and_scale(spark, sf):
    return rs.crop_and_scale(src.gray8(spark, sf), (4, 4, 2, 3), (8, 8), rs.hat).withColumn("v", fixed(C("v")))


@query("reconstruct_masked", with_sql("sparse", _window_sql((64, 64), (1.0, 1.0), (0.25, -0.5), 2.0, 2.0, "sparse") + f" SELECT image_id, dx AS x, dy AS y, {fixed_sql('s / own')} AS v FROM g WHERE own >= 1e-15"))
def reconstruct_masked(spark, sf):
    p = rs._points(spark, (64, 64), (1.0, 1.0), (0.25, -0.5))
    return rs.reconstruct_valid(src.sparse(spark, sf), p, rs.hat(2.0, 2.0), (64, 64)).withColumn("v", fixed(C("v")))


def scale_sinc(spark, sf):
    return rs.scale(src.gray8(spark, sf), (8, 8), (12, 12)).withColumn("v", rs.clamp8(C("v")))


def _inside(v: str) -> str:
    return f"CAST(greatest(0, least(7, {v})) AS INTEGER)"


@query("mask_transform", with_sql("mask_b", f""", p AS (SELECT dx, dy, CAST(0.75 * dx + 0.5 AS DOUBLE) AS px, CAST(0.5 * dy + 0.25 AS DOUBLE) AS py FROM {_grid_sql(10, 14)}),
b AS (SELECT dx, dy, {_inside('floor(px - 0.375)')} AS xa, {_inside('ceil(px + 0.375)')} AS xb, {_inside('floor(py - 0.25)')} AS ya, {_inside('ceil(py + 0.25)')} AS yb FROM p)
SELECT mask_id, dx AS x, dy AS y FROM mask_b JOIN b ON mask_b.x BETWEEN xa AND xb AND mask_b.y BETWEEN ya AND yb GROUP BY mask_id, dx, dy, xa, xb, ya, yb HAVING count(*) = (xb - xa + 1) * (yb - ya + 1)"""))
def mask_transform(spark, sf):
    return rs.transform_mask(src.mask_b(spark, sf), (8, 8), (10, 14), [[0.75, 0.0, 0.5], [0.0, 0.5, 0.25]])


# ------------------------------------------------------------------ triangles and lines

_SCAN = """, o AS (SELECT tri_id, image_id, list_sort([{'y': ay, 'k': 0, 'x': ax, 'z': az}, {'y': \"by\", 'k': 1, 'x': bx, 'z': bz}, {'y': cy, 'k': 2, 'x': cx, 'z': cz}]) AS p FROM triangles),
l AS (SELECT tri_id, image_id, p[1] AS t, p[2] AS m, p[3] AS b, unnest(generate_series(CAST(greatest(ceil(p[1].y), 0) AS INTEGER), CAST(least(ceil(p[3].y), 64) AS INTEGER) - 1)) AS y FROM o),
e AS (SELECT tri_id, image_id, CAST(y AS INTEGER) AS y,
  CASE WHEN y < m.y THEN t.x + (m.x - t.x) / nullif(m.y - t.y, 0) * (y - t.y) ELSE m.x + (b.x - m.x) / nullif(b.y - m.y, 0) * (y - m.y) END AS xa,
  CASE WHEN y < m.y THEN t.z + (m.z - t.z) / nullif(m.y - t.y, 0) * (y - t.y) ELSE m.z + (b.z - m.z) / nullif(b.y - m.y, 0) * (y - m.y) END AS za,
  t.x + (b.x - t.x) / nullif(b.y - t.y, 0) * (y - t.y) AS xb, t.z + (b.z - t.z) / nullif(b.y - t.y, 0) * (y - t.y) AS zb FROM l),
s AS (SELECT tri_id, image_id, y, CASE WHEN xa >= xb THEN xb ELSE xa END AS x1, CASE WHEN xa >= xb THEN xa ELSE xb END AS x2, CASE WHEN xa >= xb THEN zb ELSE za END AS z1, CASE WHEN xa >= xb THEN za ELSE zb END AS z2 FROM e)"""
_FRAG = ", f0 AS (SELECT *, unnest(generate_series(CAST(greatest(ceil(x1), 0) AS INTEGER), CAST(least(ceil(x2), 64) AS INTEGER) - 1)) AS px FROM s), f AS (SELECT tri_id, image_id, CAST(px AS INTEGER) AS x, y, z1 + (z2 - z1) / (x2 - x1) * (px - x1) AS z FROM f0)"


@query("scanlines", with_sql("triangles", f"{_SCAN} SELECT tri_id, image_id, y, {fixed_sql('x1')} AS x1, {fixed_sql('x2')} AS x2, {fixed_sql('z1')} AS z1, {fixed_sql('z2')} AS z2 FROM s"))
def scanlines(spark, sf):
    return ra.scanlines(src.triangles(spark, sf), 0, 64).select("tri_id", "image_id", "y", *[fixed(C(c)).alias(c) for c in ("x1", "x2", "z1", "z2")])


@query("rasterize", with_sql("triangles", f"{_SCAN}{_FRAG} SELECT image_id, x, y, count(*) AS n FROM f GROUP BY 1, 2, 3"))
def rasterize(spark, sf):
    return ra.rasterize(src.triangles(spark, sf), (0, 0, 64, 64)).groupBy("image_id", "x", "y").agg(F.count("*").alias("n"))


@query("zbuffer_max", with_sql("triangles", f"{_SCAN}{_FRAG} SELECT image_id, x, y, {fixed_sql('max(z)')} AS z FROM f GROUP BY 1, 2, 3"))
def zbuffer_max(spark, sf):
    return ra.zbuffer(ra.rasterize(src.triangles(spark, sf), (0, 0, 64, 64))).withColumn("z", fixed(C("z")))


@query("zbuffer_min", with_sql("triangles", f"{_SCAN}{_FRAG}, b AS (SELECT image_id, x, y, min(z) AS z FROM f GROUP BY 1, 2, 3) SELECT CAST(i AS BIGINT) AS image_id, dx AS x, dy AS y, {fixed_sql('least(10.0, coalesce(b.z, 10.0))')} AS z FROM (SELECT unnest(generate_series(0, 7)) AS i), {_grid_sql(64, 64)} LEFT JOIN b ON b.image_id = i AND b.x = dx AND b.y = dy"))
def zbuffer_min(spark, sf):
    start = spark.range(8 * 4096).select(F.expr("id div 4096").alias("image_id"), (C("id") % 64).cast("int").alias("x"), F.expr("cast(id % 4096 div 64 as int)").alias("y"), F.lit(10.0).alias("z"))
    return ra.zbuffer(ra.rasterize(src.triangles(spark, sf), (0, 0, 64, 64)), False, start).withColumn("z", fixed(C("z")))


_DDA = """, l AS (SELECT tri_id, ax AS x1, ay AS y1, bx AS x2, \"by\" AS y2 FROM triangles),
s AS (SELECT *, unnest(generate_series(0, CAST(greatest(abs(x2 - x1), abs(y2 - y1)) AS INTEGER))) AS step, nullif(greatest(abs(x2 - x1), abs(y2 - y1)), 0) AS m, nullif(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0) AS len FROM l)"""


@query("dda_line", with_sql("triangles", f"{_DDA} SELECT tri_id, CAST(step AS INTEGER) AS step, CAST(round(x1 + step * coalesce((x2 - x1) / m, 0)) AS INTEGER) AS x, CAST(round(y1 + step * coalesce((y2 - y1) / m, 0)) AS INTEGER) AS y, {fixed_sql('step * sqrt(((x2 - x1) / m) * ((x2 - x1) / m) + ((y2 - y1) / m) * ((y2 - y1) / m)) / len')} AS p FROM s"))
def dda_line(spark, sf):
    t = src.triangles(spark, sf).select("tri_id", C("ax").alias("x1"), C("ay").alias("y1"), C("bx").alias("x2"), C("by").alias("y2"))
    return ra.dda(t).withColumn("p", fixed(C("p")))


@query("fill_rectangle", with_sql("gray8", "SELECT image_id, x, y, CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN -3 AND 4 THEN 9 ELSE v END AS v FROM gray8"))
def fill_rectangle(spark, sf):
    return ra.fill_rectangle(src.gray8(spark, sf), 2, -3, 5, 4, 9)


# ------------------------------------------------------------------ spectra

_BASIS = "(CASE WHEN {k} = 0 THEN sqrt(CAST(0.125 AS DOUBLE)) ELSE CAST(0.5 AS DOUBLE) END * cos((2 * {x} + 1) * {k} * pi() / 16))"
_DCT = """, uv AS (SELECT a AS u, b AS v FROM (SELECT unnest(generate_series(0, 7)) AS a), (SELECT unnest(generate_series(0, 7)) AS b)),
d AS (SELECT image_id, x // 8 AS bx, y // 8 AS \"by\", uv.u, uv.v, sum(p.val * {bu} * {bv}) AS c FROM ({px}) p, uv GROUP BY 1, 2, 3, 4, 5)"""


def _dct_sql(px: str) -> str:
    return _DCT.format(bu=_BASIS.format(k="uv.u", x="(y % 8)"), bv=_BASIS.format(k="uv.v", x="(x % 8)"), px=px)


@query("dct8", with_sql("gray8", _dct_sql("SELECT image_id, x, y, v AS val FROM gray8") + " SELECT image_id, CAST(bx AS BIGINT) AS bx, CAST(\"by\" AS BIGINT) AS \"by\", CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, CAST(floor(c * 1000 + 0.5137) AS BIGINT) AS c FROM d"))
def dct8(spark, sf):
    return sp.dct8(src.gray8(spark, sf)).withColumn("c", F.floor(C("c") * 1000 + 0.5137))


_ACT = (
    ", b AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM mosaic GROUP BY 1), st AS (SELECT image_id, x, y, (v - lo) * 255 / CAST(hi - lo AS DOUBLE) AS val FROM mosaic JOIN b USING (image_id)), sd AS (SELECT image_id, sqrt(sum(val * val) / count(*) - sum(val) * sum(val) / (count(*) * count(*))) AS sd FROM st GROUP BY 1)"
    + _dct_sql("SELECT * FROM st")
    + ", act AS (SELECT image_id, u, v, count(*) FILTER (abs(c) > sd * CAST(0.2 AS DOUBLE)) AS n FROM d JOIN sd USING (image_id) GROUP BY 1, 2, 3)"
)


@query("dct_activity", with_sql("mosaic", f"{_ACT} SELECT image_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, n FROM act"))
def dct_activity(spark, sf):
    return sp.activity(src.mosaic(spark, sf), (48, 48))


_CROSS = """, sums AS (SELECT image_id, 'v' AS axis, u AS k, sum(n) AS s FROM act GROUP BY 1, 3 UNION ALL SELECT image_id, 'h', v, sum(n) FROM act GROUP BY 1, 3),
r AS (SELECT image_id, axis, k, CAST(s AS DOUBLE) / CAST(first_value(s) OVER w AS DOUBLE) AS r FROM sums WINDOW w AS (PARTITION BY image_id, axis ORDER BY k)),
x AS (SELECT *, lead(r) OVER (PARTITION BY image_id, axis ORDER BY k) AS nxt FROM r),
l AS (SELECT image_id, axis, max(k) AS k, arg_max(r, k) AS r, arg_max(nxt, k) AS nxt FROM x WHERE r >= 0.97 GROUP BY 1, 2),
a AS (SELECT image_id, axis, CASE WHEN k = 7 THEN 1.0 ELSE (k + (0.97 - r) / (nxt - r)) / 7 END AS cross_at FROM l)"""


@query("effective_scale", with_sql("mosaic", f"{_ACT}{_CROSS} SELECT image_id, {fixed_sql("max(CASE WHEN axis = 'h' THEN cross_at END)")} AS h_scale, {fixed_sql("max(CASE WHEN axis = 'v' THEN cross_at END)")} AS v_scale FROM a GROUP BY 1"))
def effective_scale(spark, sf):
    out = sp.effective_scale(src.mosaic(spark, sf), (48, 48), 0.97)
    return out.select("image_id", fixed(C("h_scale")).alias("h_scale"), fixed(C("v_scale")).alias("v_scale"))


# ------------------------------------------------------------------ equalisation


@query("clahe_hist", with_sql("mosaic", "SELECT image_id, CAST(x // 16 AS INTEGER) AS rx, CAST(y // 16 AS INTEGER) AS ry, v, count(*) AS n FROM mosaic GROUP BY 1, 2, 3, 4"))
def clahe_hist(spark, sf):
    return cl.region_histogram(src.mosaic(spark, sf), (16, 16))


_AHE = """, h AS (SELECT image_id, x // 16 AS rx, y // 16 AS ry, v, count(*) AS n FROM mosaic GROUP BY 1, 2, 3, 4),
z AS (SELECT image_id, rx, ry, i AS v FROM (SELECT DISTINCT image_id, rx, ry FROM h), (SELECT unnest(generate_series(0, 255)) AS i)),
m AS (SELECT z.image_id, z.rx, z.ry, z.v, least(255, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY z.image_id, z.rx, z.ry ORDER BY z.v) AS BIGINT) * 255 // 256) AS m FROM z LEFT JOIN h ON h.image_id = z.image_id AND h.rx = z.rx AND h.ry = z.ry AND h.v = z.v),
p AS (SELECT image_id, x, y, v, CASE WHEN x < 8 THEN -1 ELSE (x - 8) // 16 END AS kx, CASE WHEN y < 8 THEN -1 ELSE (y - 8) // 16 END AS ky FROM mosaic),
q AS (SELECT *, CASE WHEN kx = -1 OR kx = 2 THEN 8 ELSE 16 END AS sx, CASE WHEN ky = -1 OR ky = 2 THEN 8 ELSE 16 END AS sy, CASE WHEN kx = -1 THEN x ELSE (x - 8) % 16 END AS xc, CASE WHEN ky = -1 THEN y ELSE (y - 8) % 16 END AS yc FROM p),
t AS (SELECT q.*, i, j, greatest(0, least(2, kx + i)) AS rx, greatest(0, least(2, ky + j)) AS ry, (CASE WHEN i = 0 THEN sx - xc ELSE xc END) * (CASE WHEN j = 0 THEN sy - yc ELSE yc END) AS w FROM q, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT t.image_id, t.x, t.y, CAST(CAST(sum(w * m.m) AS BIGINT) // (sx * sy) AS INTEGER) AS v FROM t JOIN m ON m.image_id = t.image_id AND m.rx = t.rx AND m.ry = t.ry AND m.v = t.v GROUP BY t.image_id, t.x, t.y, sx, sy"""


@query("ahe", with_sql("mosaic", _AHE))
def ahe(spark, sf):
    return cl.clahe(src.mosaic(spark, sf), (48, 48), (16, 16))


def _clip_sql() -> str:
    from .row_queries import _recursive, clipped_sql

    counted = "SELECT image_id, x // 16 AS rx, y // 16 AS ry, v, count(*) AS n FROM mosaic GROUP BY 1, 2, 3, 4"
    return _recursive(with_sql("mosaic", clipped_sql("mosaic", 16, 4) + _AHE.replace(counted, "SELECT * FROM t").replace(", t AS (SELECT q.*", ", tt AS (SELECT q.*").replace("\nt AS (SELECT q.*", "\ntt AS (SELECT q.*").replace("FROM t JOIN m", "FROM tt t JOIN m")))


def clahe_clip(spark, sf):
    return cl.clahe(src.mosaic(spark, sf), (48, 48), (16, 16), 4.0)
