"""Blocked rasters, and images of many sizes in one table, over the derived rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, headers
from ..operators import contours as ct
from ..operators import harmonic, masks, mixed, resample, tiles
from ..sources import derived as src
from ..sources.derived import with_sql
from .registry import fixed, fixed_sql, query

C = F.col


def _near(v):
    """Whole millionths, cut where no weighted mean of whole values lies, as sums differ in their last bit by their order."""
    return F.floor(v * 1e6 + 0.37)


_NEAR_SQL = "CAST(floor(({}) * 1e6 + 0.37) AS BIGINT)"

# ------------------------------------------------------------------ tiles


def _square_sql(table: str, f: str, r: int, out: str) -> str:
    return f"{out} AS (SELECT a.image_id, a.x, a.y, {f}(b.v) AS v FROM {table} a JOIN {table} b ON a.image_id = b.image_id AND b.x BETWEEN a.x - {r} AND a.x + {r} AND b.y BETWEEN a.y - {r} AND a.y + {r} GROUP BY 1, 2, 3)"


@query("tile_roundtrip", with_sql("sparse", "SELECT image_id, x, y, v FROM sparse"))
def tile_roundtrip(spark, sf):
    return tiles.to_pixels(tiles.from_pixels(src.sparse(spark, sf), 16), 16, "bigint")


@query("erode_tiles", with_sql("sparse", f", {_square_sql('sparse', 'min', 2, 'e')} SELECT * FROM e"))
def erode_tiles(spark, sf):
    return tiles.to_pixels(tiles.erode(tiles.from_pixels(src.sparse(spark, sf), 16), 5, 16), 16, "bigint")


@query("opening_tiles", with_sql("mosaic", f", {_square_sql('mosaic', 'min', 1, 'e')}, {_square_sql('e', 'max', 2, 'd')} SELECT * FROM d"))
def opening_tiles(spark, sf):
    """Two kernels in a row: tiles stay where they are in between."""
    t = tiles.from_pixels(src.mosaic(spark, sf), 16)
    return tiles.to_pixels(tiles.dilate(tiles.erode(t, 3, 16), 5, 16), 16, "int")


_MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > {1} - 1 THEN 2 * {1} - 2 - ({0}) ELSE {0} END"
_BLUR = f""", k AS (SELECT * FROM (VALUES (-2, 0.0625), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625)) k(k, w)),
h AS (SELECT a.image_id, a.x, a.y, CAST(sum(CAST(k.w AS DOUBLE) * b.v) AS DOUBLE) AS v FROM mixed a JOIN mixed_sizes s USING (image_id), k JOIN mixed b ON b.image_id = a.image_id AND b.y = a.y AND b.x = {_MIRROR.format('(a.x + k.k)', 's.width')} GROUP BY 1, 2, 3),
r AS (SELECT a.image_id, a.x, a.y, CAST(sum(CAST(k.w AS DOUBLE) * b.v) AS DOUBLE) AS v FROM h a JOIN mixed_sizes s USING (image_id), k JOIN h b ON b.image_id = a.image_id AND b.x = a.x AND b.y = {_MIRROR.format('(a.y + k.k)', 's.height')} GROUP BY 1, 2, 3)
SELECT image_id, x, y, {fixed_sql('v')} AS v FROM r"""
_WEIGHTS = [0.0625, 0.25, 0.375, 0.25, 0.0625]


@query("blur_tiles", with_sql("mixed mixed_sizes", _BLUR))
def blur_tiles(spark, sf):
    t = tiles.sized(tiles.from_pixels(src.mixed(spark, sf), 16), src.mixed_sizes(spark, sf))
    return tiles.to_pixels(tiles.blur(t, _WEIGHTS, 16), 16).withColumn("v", fixed(C("v")))


@query("blur_each", with_sql("mixed mixed_sizes", _BLUR))
def blur_each(spark, sf):
    return mixed.blur(src.mixed(spark, sf), src.mixed_sizes(spark, sf), _WEIGHTS).withColumn("v", fixed(C("v")))


# ------------------------------------------------------------------ warps that differ by image

_DST = {"dst_width": "cast(20 + 7 * (image_id % 5) as int)", "dst_height": "cast(36 - 6 * (image_id % 2) as int)"}
#: From destination to source: exact in binary but for the last row, which is a perspective in every third image.
_INVERSE = ["0.5 + 0.25 * (image_id % 4)", "0.125 * (image_id % 2)", "-1.5", "0.0625", "1.25 - 0.25 * (image_id % 3)", "2.25", "if(image_id % 3 = 2, 0.0078125, 0.0)", "0.0", "1.0"]


def _params(spark, sf):
    inverse = "array(" + ", ".join(f"cast({e} as double)" for e in _INVERSE) + ")"
    return src.mixed_sizes(spark, sf).selectExpr("*", *[f"{e} as {n}" for n, e in _DST.items()], f"{inverse} as inverse")


def _border(i: str, n: str, border: str) -> str:
    if border == "constant":
        return f"CASE WHEN {i} BETWEEN 0 AND {n} - 1 THEN {i} END"
    return f"greatest(0, least({n} - 1, {_MIRROR.format(i, n)}))"


def _warp_sql(border: str, value: int) -> str:
    m = [f"CAST({e.replace('if(image_id % 3 = 2, 0.0078125, 0.0)', 'CASE WHEN image_id % 3 = 2 THEN 0.0078125 ELSE 0.0 END')} AS DOUBLE)" for e in _INVERSE]
    row = lambda r: f"({m[3 * r]} * dx + {m[3 * r + 1]} * dy + {m[3 * r + 2]})"
    taps = ", ".join(f"{_border(f'(x0 + {k % 2})', 'width', border)} AS a{k}, {_border(f'(y0 + {k // 2})', 'height', border)} AS b{k}" for k in range(4))
    joins = " ".join(f"LEFT JOIN mixed g{k} ON g{k}.image_id = t.image_id AND g{k}.x = t.a{k} AND g{k}.y = t.b{k}" for k in range(4))
    v = [f"coalesce(CAST(g{k}.v AS DOUBLE), {value})" for k in range(4)]
    return f""", p0 AS (SELECT *, unnest(generate_series(0, {_DST['dst_width']} - 1)) AS dx FROM mixed_sizes),
p1 AS (SELECT *, unnest(generate_series(0, {_DST['dst_height']} - 1)) AS dy FROM p0),
p AS (SELECT image_id, width, height, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, {row(0)} / {row(2)} AS px, {row(1)} / {row(2)} AS py FROM p1),
q AS (SELECT *, px - floor(px) AS fx, py - floor(py) AS fy, CAST(floor(px) AS INTEGER) AS x0, CAST(floor(py) AS INTEGER) AS y0 FROM p),
t AS (SELECT *, {taps} FROM q),
w AS (SELECT t.image_id, t.dx, t.dy, fy, {v[0]} + ({v[1]} - {v[0]}) * fx AS top, {v[2]} + ({v[3]} - {v[2]}) * fx AS low FROM t {joins})
SELECT image_id, dx AS x, dy AS y, CAST(floor(top + (low - top) * fy) AS INTEGER) AS v FROM w"""


@query("warp_tiles", with_sql("mixed mixed_sizes", _warp_sql("constant", 77)))
def warp_tiles(spark, sf):
    out = tiles.warp(tiles.from_pixels(src.mixed(spark, sf), 16), _params(spark, sf), "constant", 77, 16)
    return tiles.to_pixels(out, 16).withColumn("v", F.floor("v").cast("int"))


@query("warp_tiles_reflect101", with_sql("mixed mixed_sizes", _warp_sql("reflect101", 0)))
def warp_tiles_reflect101(spark, sf):
    out = tiles.warp(tiles.from_pixels(src.mixed(spark, sf), 16), _params(spark, sf), "reflect101", 0, 16)
    return tiles.to_pixels(out, 16).withColumn("v", F.floor("v").cast("int"))


@query("warp_each", with_sql("mixed mixed_sizes", _warp_sql("constant", 77)))
def warp_each(spark, sf):
    return mixed.warp(src.mixed(spark, sf), _params(spark, sf), "constant", 77)


@query("warp_each_reflect101", with_sql("mixed mixed_sizes", _warp_sql("reflect101", 0)))
def warp_each_reflect101(spark, sf):
    return mixed.warp(src.mixed(spark, sf), _params(spark, sf), "reflect101")


# ------------------------------------------------------------------ filters that differ by image


def _filter_sql(sx: str, sy: str, ox: str, oy: str, dw: str, dh: str) -> str:
    d = lambda e: f"CAST({e} AS DOUBLE)"
    hat = lambda v, h: f"greatest(CAST(0 AS DOUBLE), 1 - abs({v}) / {h})"
    return f""", m AS (SELECT image_id, {sx} AS sx, {sy} AS sy, {ox} AS ox, {oy} AS oy, {dw} AS dw, {dh} AS dh FROM mixed_sizes),
h AS (SELECT *, greatest({d('2')}, 2 * sx) AS hx, greatest({d('2')}, 2 * sy) AS hy, unnest(generate_series(0, dw - 1)) AS dx FROM m),
p0 AS (SELECT *, unnest(generate_series(0, dh - 1)) AS dy FROM h),
p AS (SELECT *, dx * sx + ox AS px, dy * sy + oy AS py FROM p0),
tx AS (SELECT *, unnest(generate_series(CAST(floor(px - hx) AS INTEGER), CAST(ceil(px + hx) AS INTEGER))) AS x FROM p),
t AS (SELECT *, unnest(generate_series(CAST(floor(py - hy) AS INTEGER), CAST(ceil(py + hy) AS INTEGER))) AS y FROM tx),
k AS (SELECT image_id, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, x, y, {hat('x - px', 'hx')} * {hat('y - py', 'hy')} AS w FROM t),
n AS (SELECT image_id, dx, dy, sum(w) AS total FROM k GROUP BY 1, 2, 3),
g AS (SELECT k.image_id, dx, dy, sum(b.v * w) AS s FROM k JOIN mixed b ON b.image_id = k.image_id AND b.x = k.x AND b.y = k.y GROUP BY 1, 2, 3)
SELECT image_id, dx AS x, dy AS y, {_NEAR_SQL.format('CASE WHEN total > 1e-15 THEN s / total ELSE 0 END')} AS v FROM g JOIN n USING (image_id, dx, dy)"""


@query("scale_each", with_sql("mixed mixed_sizes", _filter_sql("CAST(width AS DOUBLE) / 16", "CAST(height AS DOUBLE) / (8 * (1 + image_id % 3))", "sx * 0.5 - 0.5", "sy * 0.5 - 0.5", "16", "8 * (1 + image_id % 3)")))
def scale_each(spark, sf):
    p = src.mixed_sizes(spark, sf).selectExpr("*", "16 as dst_width", "cast(8 * (1 + image_id % 3) as int) as dst_height")
    return mixed.scale(src.mixed(spark, sf), p, resample.hat).withColumn("v", _near(C("v")))


@query("crop_each", with_sql("mixed mixed_sizes", _filter_sql("CAST(0.5 + 0.25 * (image_id % 2) AS DOUBLE)", "CAST(1.5 AS DOUBLE)", "sx * 0.5 - 0.5 + 3 + image_id % 4", "sy * 0.5 - 0.5 + 2", "16", "12 + 4 * (image_id % 2)")))
def crop_each(spark, sf):
    p = src.mixed_sizes(spark, sf).selectExpr("image_id", "16 as dst_width", "cast(12 + 4 * (image_id % 2) as int) as dst_height", "cast(3 + image_id % 4 as int) as crop_x", "2 as crop_y")
    p = p.selectExpr("*", "16 * (cast(0.5 as double) + cast(0.25 as double) * (image_id % 2)) as crop_width", "dst_height * cast(1.5 as double) as crop_height")
    return mixed.crop_and_scale(src.mixed(spark, sf), p, resample.hat).withColumn("v", _near(C("v")))


# ------------------------------------------------------------------ Laplace filling over tiles


@query("laplace_tiles_residual", with_sql("mixed mixed_sizes", "SELECT image_id, count(*) AS pixels, CAST(0 AS BIGINT) AS moved, CAST(0 AS BIGINT) AS off FROM mixed GROUP BY 1"))
def laplace_tiles_residual(spark, sf):
    """By image: pixels, known ones that changed, and filled ones that are not the mean of their neighbours; holes span many tiles.

    The equations have one solution, so an image without such pixels is it.
    """
    known = F.expr("(x - 20) * (x - 20) + (y - 18) * (y - 18) > 200 + 10 * (image_id % 5) and (x * 5 + y * 3 + image_id) % 7 > 1")
    px = src.mixed(spark, sf)
    got = harmonic.fill(px.withColumn("known", known), src.mixed_sizes(spark, sf), 16, 12, 1e-8).select("image_id", "x", "y", C("v").alias("u"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    told = got.select("image_id", "u", "x", "y", step.alias("d")).select("image_id", (C("x") + C("d.i")).alias("x"), (C("y") + C("d.j")).alias("y"), "u")
    mean = told.groupBy("image_id", "x", "y").agg(F.avg("u").alias("mean"))
    both = got.join(px, ["image_id", "x", "y"]).withColumn("known", known).join(mean, ["image_id", "x", "y"])
    return both.groupBy("image_id").agg(F.count("*").alias("pixels"), F.count_if(C("known") & (F.abs(C("u") - C("v")) > 1e-9)).alias("moved"), F.count_if(~C("known") & (F.abs(C("u") - C("mean")) > 1e-6)).alias("off"))


# ------------------------------------------------------------------ masks that differ by image


def _mask(spark, sf):
    return masks.from_raster(src.mixed(spark, sf), C("v") >= 128)


def _mask_sizes(spark, sf):
    return src.mixed_sizes(spark, sf).withColumnRenamed("image_id", "mask_id")


_MASK = ", mk AS (SELECT image_id AS mask_id, x, y FROM mixed WHERE v >= 128)"


@query("resize_each", with_sql("mixed mixed_sizes", f"{_MASK}, p0 AS (SELECT *, 20 + 11 * (image_id % 3) AS dw, unnest(generate_series(0, 19 + 11 * (image_id % 3))) AS x FROM mixed_sizes), p AS (SELECT *, unnest(generate_series(0, 32)) AS y FROM p0) SELECT p.image_id AS mask_id, CAST(p.x AS INTEGER) AS x, CAST(p.y AS INTEGER) AS y FROM p JOIN mk ON mk.mask_id = p.image_id AND mk.x = floor(p.x * CAST(width AS DOUBLE) / dw + 0.5) AND mk.y = floor(p.y * CAST(height AS DOUBLE) / 33 + 0.5)"))
def resize_each(spark, sf):
    p = _mask_sizes(spark, sf).selectExpr("*", "cast(20 + 11 * (mask_id % 3) as int) as dst_width", "33 as dst_height")
    return mixed.resize_mask(_mask(spark, sf), p)


_CLAMP = "CAST(greatest(0, least({n} - 1, {v})) AS INTEGER)"


@query("mask_transform_each", with_sql("mixed mixed_sizes", f"""{_MASK}, p0 AS (SELECT *, CAST(0.5 + 0.25 * (image_id % 3) AS DOUBLE) AS a, unnest(generate_series(0, 29)) AS dx FROM mixed_sizes),
p AS (SELECT *, a * dx + 0.5 AS px, 0.75 * dy + 0.25 AS py FROM (SELECT *, unnest(generate_series(0, 24 + image_id % 2)) AS dy FROM p0)),
b AS (SELECT image_id, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, {_CLAMP.format(n='width', v='floor(px - a / 2)')} AS xa, {_CLAMP.format(n='width', v='ceil(px + a / 2)')} AS xb, {_CLAMP.format(n='height', v='floor(py - 0.375)')} AS ya, {_CLAMP.format(n='height', v='ceil(py + 0.375)')} AS yb FROM p)
SELECT mask_id, dx AS x, dy AS y FROM mk JOIN b ON b.image_id = mask_id AND mk.x BETWEEN xa AND xb AND mk.y BETWEEN ya AND yb GROUP BY mask_id, dx, dy, xa, xb, ya, yb HAVING count(*) = (xb - xa + 1) * (yb - ya + 1)"""))
def mask_transform_each(spark, sf):
    p = _mask_sizes(spark, sf).selectExpr("*", "30 as dst_width", "cast(25 + mask_id % 2 as int) as dst_height", "transform(array(0.5 + 0.25 * (mask_id % 3), 0.0, 0.5, 0.0, 0.75, 0.25), c -> cast(c as double)) as matrix")
    return mixed.transform_mask(_mask(spark, sf), p)


@query("boundary_each", with_sql("mixed mixed_sizes", f"{_MASK} SELECT a.mask_id, a.x, a.y FROM mk a JOIN mk b ON a.mask_id = b.mask_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 JOIN mixed_sizes s ON s.image_id = a.mask_id GROUP BY 1, 2, 3, width, height HAVING count(*) < (CASE WHEN a.x IN (0, width - 1) THEN 2 ELSE 3 END) * (CASE WHEN a.y IN (0, height - 1) THEN 2 ELSE 3 END)"))
def boundary_each(spark, sf):
    return mixed.boundary(_mask(spark, sf), _mask_sizes(spark, sf))


#: Eight times the area that a mask's contours enclose: a pixel with square corners is 8; of cells with one set corner that are mitred each takes 1 from it, of those with three each adds 1.
_AREA = f"""{_MASK}, c0 AS (SELECT mask_id, x AS i, y AS j, 8 AS b FROM mk UNION ALL SELECT mask_id, x - 1, y, 4 FROM mk UNION ALL SELECT mask_id, x - 1, y - 1, 2 FROM mk UNION ALL SELECT mask_id, x, y - 1, 1 FROM mk),
c AS (SELECT mask_id, i, j, CAST(sum(b) AS INTEGER) AS code FROM c0 GROUP BY 1, 2, 3),
f AS (SELECT mask_id, arg_min(code, j * 100000 + i) AS state FROM c WHERE code IN (5, 10) GROUP BY 1),
q AS (SELECT c.*, state, j = -1 OR j = height - 1 OR i = width - 1 AS square FROM c JOIN mixed_sizes s ON s.image_id = mask_id LEFT JOIN f USING (mask_id)),
a AS (SELECT mask_id, sum(CASE WHEN code IN (1, 2, 4, 8) THEN CASE WHEN square THEN 2 ELSE 1 END WHEN code IN (3, 6, 9, 12) THEN 4 WHEN code IN (5, 10) THEN CASE WHEN code = state THEN 6 ELSE 2 END WHEN code = 15 THEN 8 ELSE CASE WHEN square THEN 6 ELSE 7 END END) AS area8,
  count(*) FILTER (code IN (3, 6, 9, 12)) + count(*) FILTER (code IN (1, 2, 4, 8, 7, 11, 13, 14) AND NOT square) + 2 * count(*) FILTER (code IN (5, 10)) + 2 * count(*) FILTER (code IN (1, 2, 4, 8, 7, 11, 13, 14) AND square) AS n FROM q GROUP BY 1)
SELECT mask_id, CAST(n AS BIGINT) AS n, CAST(area8 AS BIGINT) AS area8 FROM a"""


@query("contours_each", with_sql("mixed mixed_sizes", _AREA))
def contours_each(spark, sf):
    return ct.ring_measures(mixed.contour_segments(_mask(spark, sf), _mask_sizes(spark, sf)), ["mask_id"])


@query("mask_intersect_sized", with_sql("mixed mixed_sizes", f"{_MASK} SELECT mask_id, x, y FROM mk WHERE x >= 4"))
def mask_intersect_sized(spark, sf):
    m = _mask(spark, sf)
    return masks.intersect(m, m.filter("x >= 4"), (_mask_sizes(spark, sf), _mask_sizes(spark, sf)))


@query("mask_subtract_sized", with_sql("mixed mixed_sizes", f"{_MASK} SELECT mask_id, x, y FROM mk WHERE x < 4 OR mask_id % 2 = 0"))
def mask_subtract_sized(spark, sf):
    """Masks that only the first side has stay whole."""
    m, sizes = _mask(spark, sf), _mask_sizes(spark, sf)
    return masks.subtract(m, m.filter("x >= 4 and mask_id % 2 = 1"), (sizes, sizes.filter("mask_id % 2 = 1")))


# ------------------------------------------------------------------ packed luma and chroma, typed tags


_BYTE = "CAST(greatest(0, least(255, round(({}) * 255.0))) AS INTEGER)"
_YCC = ", ".join(f"CAST({m[0]!r} AS DOUBLE) * r + CAST({m[1]!r} AS DOUBLE) * g + CAST({m[2]!r} AS DOUBLE) * b AS {n}" for m, n in zip(color.TO_YCC, ("yy", "cb", "cr"), strict=True))


@query("pack_ycc", with_sql("rgb8", f", u AS (SELECT image_id, x, y, CAST(r AS DOUBLE) / 255 AS r, CAST(g AS DOUBLE) / 255 AS g, CAST(b AS DOUBLE) / 255 AS b FROM rgb8), c AS (SELECT image_id, x, y, {_YCC} FROM u), p AS (SELECT image_id, x, y, {_BYTE.format('yy')} AS luma, {_BYTE.format('cb + 0.5')} AS cb, {_BYTE.format('cr + 0.5')} AS cr FROM c) SELECT *, CAST(luma AS INTEGER) AS luma_back, CAST(cb AS INTEGER) AS cb_back, CAST(cr AS INTEGER) AS cr_back FROM p"))
def pack_ycc(spark, sf):
    """Colours as bytes of luma and chroma, and these again after unpacking."""
    names = ("luma", "cb", "cr")
    packed = color.pack_ycc8(*color.rgb_to_ycc(*[color.unpack8(C(c)) for c in "rgb"]))
    p = src.rgb8(spark, sf).select("image_id", "x", "y", *[v.alias(n) for v, n in zip(packed, names, strict=True)])
    again = color.pack_ycc8(*color.unpack_ycc8(*[C(n) for n in names]))
    return p.select("*", *[v.alias(f"{n}_back") for v, n in zip(again, names, strict=True)])


_TAG = "CASE p_partkey % 4 WHEN 0 THEN concat(p_partkey - 50, '/', p_size % 5) WHEN 1 THEN concat(p_size, ' ', p_partkey) WHEN 2 THEN concat(p_partkey, '.5') ELSE 'none' END"


@query("exif_typed", f"""WITH t AS (SELECT p_partkey AS file_id, p_partkey % 4 AS k, p_partkey AS p, p_size AS s, p_size % 5 AS d, {_TAG} AS text FROM part)
SELECT file_id, text, coalesce(CAST(CASE k WHEN 0 THEN trunc((p - 50) / CAST(nullif(d, 0) AS DOUBLE)) WHEN 1 THEN s WHEN 2 THEN p END AS BIGINT), -1000000) AS whole,
  {fixed_sql('coalesce(CASE k WHEN 0 THEN (p - 50) / CAST(nullif(d, 0) AS DOUBLE) WHEN 1 THEN s WHEN 2 THEN p + 0.5 END, -1000000)')} AS number, CAST(CASE WHEN k = 1 THEN p ELSE -1000000 END AS BIGINT) AS second, CAST(CASE WHEN k = 0 AND d <> 0 THEN d WHEN k = 1 THEN 1 ELSE -1000000 END AS BIGINT) AS den FROM t""")
def exif_typed(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey as file_id", "case p_partkey % 4 when 0 then concat(p_partkey - 50, '/', p_size % 5) when 1 then concat(p_size, ' ', p_partkey) when 2 then concat(p_partkey, '.5') else 'none' end as text")
    t, none = C("text"), lambda v: F.coalesce(v, F.lit(-1000000))
    whole, second, den = headers.exif_as(t, "long"), headers.exif_as(t, "long", 2), headers.exif_as(t, "rational")["den"]
    return p.select("file_id", headers.exif_as(t, "string").alias("text"), none(whole).alias("whole"), fixed(none(headers.exif_as(t, "double"))).alias("number"), none(second).alias("second"), none(den).alias("den"))
