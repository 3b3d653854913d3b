"""Pixel projections, histograms, masks and neighbourhoods over the derived rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, geometry
from ..operators import masks, neighborhood, pixels
from ..sources import derived as src
from ..sources.derived import with_sql
from .registry import fixed, fixed_sql, query

C = F.col


# The matrix from luma and chroma to R, G, B, once more for the SQL.
_RGB_OF_YCC = ((1.0, 9.2674e-4, 1.4017), (1.0, -0.34370, -0.7142), (1.0, 1.7722, 9.9022e-4))

# ------------------------------------------------------------------ histograms


@query("histogram", with_sql("sparse", "SELECT image_id, v, count(*) AS n FROM sparse WHERE v BETWEEN 10 AND 200 GROUP BY 1, 2"))
def histogram(spark, sf):
    return pixels.histogram(src.sparse(spark, sf), 10, 200)


_THRESHOLD = """, h AS (SELECT image_id, v, count(*) AS n FROM gray8 GROUP BY 1, 2),
c AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS cum, sum(n) OVER (PARTITION BY image_id) AS total FROM h)
SELECT image_id, min(v) AS threshold FROM c WHERE cum >= 0.5 * total GROUP BY 1"""


@query("histogram_threshold", with_sql("gray8", _THRESHOLD))
def histogram_threshold(spark, sf):
    return pixels.threshold(pixels.histogram(src.gray8(spark, sf)), 0.5)


@query("prevalent_value", with_sql("sparse", "SELECT image_id, v FROM (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, v) AS k FROM sparse GROUP BY 1, 2) WHERE k = 1"))
def prevalent_value(spark, sf):
    return pixels.prevalent(pixels.histogram(src.sparse(spark, sf)))


@query("histogram_channel", with_sql("rgb8", "SELECT image_id, CAST(g AS INTEGER) AS v, count(*) AS n FROM rgb8 WHERE g BETWEEN 100 AND 160 GROUP BY 1, 2"))
def histogram_channel(spark, sf):
    return pixels.histogram_channel(src.rgb8(spark, sf), ["r", "g", "b"], 100, 160)


@query("stretch_values", with_sql("gray8", "SELECT image_id, x, y, CAST(CASE WHEN v < 100 THEN 0 WHEN v > 160 THEN 255 ELSE floor(255.0 * (v - 100) / 60) END AS INTEGER) AS v FROM gray8"))
def stretch_values(spark, sf):
    return src.gray8(spark, sf).select("image_id", "x", "y", pixels.stretch(C("v"), 100, 160).alias("v"))


# ------------------------------------------------------------------ depth and colour


@query("to_8bit_256", with_sql("u16", "SELECT image_id, x, y, CAST(greatest(0, least(255, round_even(v / 256.0, 0))) AS INTEGER) AS v FROM u16"))
def to_8bit_256(spark, sf):
    return src.u16(spark, sf).select("image_id", "x", "y", color.to_8bit_256(C("v")).alias("v"))


@query("to_8bit_257", with_sql("u16", "SELECT image_id, x, y, CAST(greatest(0, least(255, round_even(v * (CAST(255 AS DOUBLE) / CAST(65535 AS DOUBLE)), 0))) AS INTEGER) AS v FROM u16"))
def to_8bit_257(spark, sf):
    return src.u16(spark, sf).select("image_id", "x", "y", color.to_8bit_257(C("v")).alias("v"))


_D = lambda x: f"CAST({x} AS DOUBLE)"
_YCC_CTE = """, u AS (SELECT image_id, x, y, CAST(r AS DOUBLE) / 255 AS r, CAST(g AS DOUBLE) / 255 AS g, CAST(b AS DOUBLE) / 255 AS b FROM rgb8),
c AS (SELECT image_id, x, y, CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b AS yy,
  CAST(-0.169 AS DOUBLE) * r + CAST(-0.331 AS DOUBLE) * g + CAST(0.5 AS DOUBLE) * b AS cb,
  CAST(0.5 AS DOUBLE) * r + CAST(-0.419 AS DOUBLE) * g + CAST(-0.081 AS DOUBLE) * b AS cr FROM u)"""


def _ycc(spark, sf):
    u = [color.unpack8(C(c)) for c in "rgb"]
    y, cb, cr = color.rgb_to_ycc(*u)
    return src.rgb8(spark, sf).select("image_id", "x", "y", y.alias("yy"), cb.alias("cb"), cr.alias("cr"))


@query("rgb_to_ycc", with_sql("rgb8", f"{_YCC_CTE} SELECT image_id, x, y, {fixed_sql('yy')} AS luma, {fixed_sql('cb')} AS cb, {fixed_sql('cr')} AS cr FROM c"))
def rgb_to_ycc(spark, sf):
    return _ycc(spark, sf).select("image_id", "x", "y", fixed(C("yy")).alias("luma"), fixed(C("cb")).alias("cb"), fixed(C("cr")).alias("cr"))


def _clip_sql() -> str:
    d = [f"(CAST({_RGB_OF_YCC[k][1]!r} AS DOUBLE) * cb + CAST({_RGB_OF_YCC[k][2]!r} AS DOUBLE) * cr)" for k in range(3)]
    ctes, prev = "", "(SELECT image_id, x, y, yy, 3 * cb AS cb, 3 * cr AS cr, CAST(1 AS DOUBLE) AS s FROM c)"
    for k in range(3):
        for b in (0, 1):
            name = f"s{k}{b}"
            test = f"yy + s * {d[k]} < 0" if b == 0 else f"yy + s * {d[k]} > 1"
            ctes += f", {name} AS (SELECT image_id, x, y, yy, cb, cr, CASE WHEN {test} AND {d[k]} <> 0 THEN ({b} - yy) / {d[k]} ELSE s END AS s FROM {prev})"
            prev = name
    rgb = [f"yy + CAST({m[1]!r} AS DOUBLE) * (cb * s) + CAST({m[2]!r} AS DOUBLE) * (cr * s)" for m in _RGB_OF_YCC]
    out = ", ".join(f"{fixed_sql(e)} AS {n}" for e, n in zip(rgb, "rgb", strict=True))
    return f"{_YCC_CTE}{ctes} SELECT image_id, x, y, {out} FROM {prev}"


@query("ycc_to_rgb_clip", with_sql("rgb8", _clip_sql()))
def ycc_to_rgb_clip(spark, sf):
    p = _ycc(spark, sf).withColumns({"cb": C("cb") * 3, "cr": C("cr") * 3})
    cb, cr = color.clip_chroma(C("yy"), C("cb"), C("cr"))
    p = p.select("image_id", "x", "y", "yy", cb.alias("cb"), cr.alias("cr"))
    return p.select("image_id", "x", "y", *[fixed(v).alias(n) for v, n in zip(color.ycc_to_rgb(C("yy"), C("cb"), C("cr")), "rgb", strict=True)])


@query("hue_diff", with_sql("rgb8", f"{_YCC_CTE}, d AS (SELECT image_id, x, y, abs(atan2(cr, cb) - atan2(cb, CAST(0.25 AS DOUBLE))) AS d FROM c) SELECT image_id, x, y, {fixed_sql('least(d, CAST(6.283185307179586 AS DOUBLE) - d)')} AS d FROM d"))
def hue_diff(spark, sf):
    return _ycc(spark, sf).select("image_id", "x", "y", fixed(color.hue_diff(C("cb"), C("cr"), F.lit(0.25), C("cb"))).alias("d"))


def _ramp_sql(v: str) -> str:
    return f"CASE WHEN {v} <= -0.75 THEN 0 WHEN {v} <= -0.25 THEN ({v} + 0.75) * 2 WHEN {v} <= 0.25 THEN 1 WHEN {v} <= 0.75 THEN 1 - ({v} - 0.25) * 2 ELSE 0 END"


_JET = ", ".join(f"{fixed_sql(_ramp_sql(f'(q {o})'))} AS {n}" for n, o in (("r", "- 0.5"), ("g", "+ 0"), ("b", "+ 0.5")))


@query("jet_colormap", with_sql("gray8", f", q AS (SELECT image_id, x, y, CAST(v AS DOUBLE) / 128 - 1 AS q FROM gray8) SELECT image_id, x, y, {_JET} FROM q"))
def jet_colormap(spark, sf):
    r, g, b = color.jet(C("v") / 128.0 - 1)
    return src.gray8(spark, sf).select("image_id", "x", "y", fixed(r).alias("r"), fixed(g).alias("g"), fixed(b).alias("b"))


@query("palette", with_sql("gray8", "SELECT image_id, x, y, (v & 1) * 146 + ((v >> 3) & 1) * 73 + ((v >> 6) & 1) * 36 AS r, ((v >> 1) & 1) * 146 + ((v >> 4) & 1) * 73 + ((v >> 7) & 1) * 36 AS g, ((v >> 2) & 1) * 170 + ((v >> 5) & 1) * 85 AS b FROM gray8"))
def palette(spark, sf):
    r, g, b = color.palette(C("v"))
    return src.gray8(spark, sf).select("image_id", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"))


# ------------------------------------------------------------------ geometry


@query("crop_parse", with_sql("crops", ", m AS (SELECT id, regexp_extract(crop, '(\\d+)x(\\d+)([+-]\\d+)([+-]\\d+)', ['w', 'h', 'x', 'y']) AS m FROM crops) SELECT id, CAST(m.w AS INTEGER) AS w, CAST(m.h AS INTEGER) AS h, CAST(m.x AS INTEGER) AS x, CAST(m.y AS INTEGER) AS y, concat(m.w, 'x', m.h, m.x, m.y) AS again FROM m"))
def crop_parse(spark, sf):
    p = src.crops(spark, sf).withColumn("c", geometry.parse_crop(C("crop")))
    return p.select("id", C("c.width").alias("w"), C("c.height").alias("h"), C("c.x").alias("x"), C("c.y").alias("y"), geometry.format_crop(C("c")).alias("again"))


@query("crop_scale", with_sql("crops", f", m AS (SELECT id, regexp_extract(crop, '(\\d+)x(\\d+)([+-]\\d+)([+-]\\d+)', ['w', 'h', 'x', 'y']) AS m FROM crops) SELECT id, {fixed_sql('CAST(m.w AS DOUBLE) * 0.5')} AS w, {fixed_sql('CAST(m.h AS DOUBLE) * 0.25')} AS h, {fixed_sql('(0.5 + CAST(m.x AS DOUBLE)) * 0.5')} AS x, {fixed_sql('(0.5 + CAST(m.y AS DOUBLE)) * 0.25')} AS y FROM m"))
def crop_scale(spark, sf):
    c = geometry.scale_crop(geometry.parse_crop(C("crop")), 0.5, 0.25)
    return src.crops(spark, sf).select("id", c.alias("c")).select("id", fixed(C("c.width")).alias("w"), fixed(C("c.height")).alias("h"), fixed(C("c.x")).alias("x"), fixed(C("c.y")).alias("y"))


@query("georef_extents", with_sql("georefs", "SELECT id, least(ul.x, ur.x, lr.x, ll.x) AS x0, least(ul.y, ur.y, lr.y, ll.y) AS y0, greatest(ul.x, ur.x, lr.x, ll.x) AS x1, greatest(ul.y, ur.y, lr.y, ll.y) AS y1 FROM georefs"))
def georef_extents(spark, sf):
    return src.georefs(spark, sf).select("id", *geometry.extents(["x", "y"]))


@query("georef_text", with_sql("georefs", "SELECT id, concat_ws(',', ul.x, ul.y, ur.x, ur.y, lr.x, lr.y, ll.x, ll.y) AS text, ur.x AS urx, ll.y AS lly FROM georefs"))
def georef_text(spark, sf):
    p = src.georefs(spark, sf).select("id", geometry.format_georef(["x", "y"]).alias("text"))
    g = geometry.parse_georef(C("text"), ["x", "y"], "bigint")
    return p.withColumn("g", g).select("id", "text", C("g.ur.x").alias("urx"), C("g.ll.y").alias("lly"))


@query("mappings", with_sql("rects", f"SELECT rect_id, {fixed_sql('CAST(w AS DOUBLE) / 64 * 0.5 - 0.5 + CAST(w AS DOUBLE) / 64 * h')} AS area_x, {fixed_sql('CAST(w AS DOUBLE) / 63 * h')} AS grid_x, {fixed_sql('CAST(w AS DOUBLE) / 64 * 0.5 - 0.5 + 3 + CAST(w AS DOUBLE) / 64 * h')} AS crop_x, {fixed_sql('CAST(w AS DOUBLE) / 64')} AS dx FROM rects"))
def mappings(spark, sf):
    w, h = C("w").cast("double"), C("h")
    area, grid, crop = geometry.area_scaling(F.lit(64), w), geometry.grid_scaling(F.lit(64), w + 1), geometry.crop_scaling(w, F.lit(3), F.lit(64))
    return src.rects(spark, sf).select("rect_id", fixed(area.map(h)).alias("area_x"), fixed(grid.map(h)).alias("grid_x"), fixed(crop.map(h)).alias("crop_x"), fixed(area.derivative).alias("dx"))


# ------------------------------------------------------------------ masks


@query("mask_threshold", with_sql("gray8", "SELECT image_id AS mask_id, x, y FROM gray8 WHERE v >= 128"))
def mask_threshold(spark, sf):
    return masks.from_raster(src.gray8(spark, sf), C("v") >= 128)


@query("masked_pixels", with_sql("gray8 mask_b", "SELECT g.* FROM gray8 g WHERE EXISTS (SELECT 1 FROM mask_b m WHERE m.mask_id = g.image_id AND m.x = g.x AND m.y = g.y)"))
def masked_pixels(spark, sf):
    return masks.masked(src.gray8(spark, sf), src.mask_b(spark, sf))


@query("mask_union", with_sql("mask_a mask_b", "SELECT * FROM mask_a UNION SELECT * FROM mask_b"))
def mask_union(spark, sf):
    return masks.union(src.mask_a(spark, sf), src.mask_b(spark, sf))


@query("mask_intersect", with_sql("mask_a mask_b", "SELECT * FROM mask_a INTERSECT SELECT * FROM mask_b"))
def mask_intersect(spark, sf):
    return masks.intersect(src.mask_a(spark, sf), src.mask_b(spark, sf))


@query("mask_subtract", with_sql("mask_a mask_b", "SELECT * FROM mask_a EXCEPT SELECT * FROM mask_b"))
def mask_subtract(spark, sf):
    return masks.subtract(src.mask_a(spark, sf), src.mask_b(spark, sf))


def _sizes(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(C("vec_id").alias("mask_id"), F.lit(8).alias("width"), F.lit(8).alias("height"))


@query("mask_invert", with_sql("gray8", "SELECT image_id AS mask_id, x, y FROM gray8 WHERE v < 128"))
def mask_invert(spark, sf):
    return masks.invert(src.mask_a(spark, sf), _sizes(spark, sf))


@query("mask_update", with_sql("gray8", "SELECT image_id AS mask_id, x, y FROM gray8 WHERE CASE WHEN (x + y) % 3 = 0 THEN v % 2 = 0 WHEN (x + y) % 3 = 1 THEN true ELSE v >= 128 END"))
def mask_update(spark, sf):
    g = src.gray8(spark, sf).withColumnRenamed("image_id", "mask_id")
    first = g.filter("(x + y) % 3 <> 2").select("mask_id", "x", "y", F.lit(True).alias("value"), F.lit(1).alias("seq"))
    second = g.filter("(x + y) % 3 = 0").select("mask_id", "x", "y", (C("v") % 2 == 0).alias("value"), F.lit(2).alias("seq"))
    return masks.update(src.mask_a(spark, sf), first.union(second))


@query("mask_count", with_sql("mask_a", "SELECT mask_id, count(*) AS count FROM mask_a GROUP BY 1"))
def mask_count(spark, sf):
    return masks.count(src.mask_a(spark, sf))


@query("mask_boundary", with_sql("mask_a", "SELECT a.mask_id, a.x, a.y FROM mask_a a JOIN mask_a b ON a.mask_id = b.mask_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3 HAVING count(*) < (CASE WHEN a.x IN (0, 7) THEN 2 ELSE 3 END) * (CASE WHEN a.y IN (0, 7) THEN 2 ELSE 3 END)"))
def mask_boundary(spark, sf):
    return masks.boundary(src.mask_a(spark, sf), 8, 8)


@query("mask_radius", with_sql("mask_a", "SELECT mask_id, CAST(floor(sqrt(max(pow(x * 2.0 - 7, 2) + pow(y * 2.0 - 6, 2)))) AS INTEGER) AS radius FROM mask_a GROUP BY 1"))
def mask_radius(spark, sf):
    return masks.radius(src.mask_a(spark, sf), (16, 16), (2, 2, 10, 8), (8, 8))


@query("mask_get", with_sql("mask_a", "SELECT p.mask_id, p.x, p.y, EXISTS (SELECT 1 FROM mask_a m WHERE m.mask_id = p.mask_id AND m.x = greatest(0, least(7, p.x)) AND m.y = greatest(0, least(7, p.y))) AS value FROM (SELECT vec_id AS mask_id, CAST(vec_id % 14 - 3 AS INTEGER) AS x, CAST(vec_id % 11 - 2 AS INTEGER) AS y FROM embeddings) p"))
def mask_get(spark, sf):
    p = spark.read.parquet(f"{sf}/embeddings.parquet").select(C("vec_id").alias("mask_id"), (C("vec_id") % 14 - 3).cast("int").alias("x"), (C("vec_id") % 11 - 2).cast("int").alias("y"))
    return masks.get(p, src.mask_a(spark, sf), 8, 8, clamped=True)


@query("mask_coarsen", with_sql("mask_a", "SELECT DISTINCT mask_id, x // 2 AS tx, y // 2 AS ty FROM mask_a"))
def mask_coarsen(spark, sf):
    return masks.coarsen(src.mask_a(spark, sf), 2).select("mask_id", C("tx").cast("int").alias("tx"), C("ty").cast("int").alias("ty"))


@query("quad_rollup", with_sql("mask_a", "SELECT mask_id, x // 4 AS tx, y // 4 AS ty, CASE WHEN count(*) = 16 THEN 1 ELSE -1 END AS state FROM mask_a GROUP BY 1, 2, 3"))
def quad_rollup(spark, sf):
    return masks.roll_up(src.mask_a(spark, sf), 8, 8, 4).select("mask_id", C("tx").cast("int").alias("tx"), C("ty").cast("int").alias("ty"), F.when(C("white"), 1).otherwise(-1).alias("state"))


@query("mask_resize", with_sql("mask_a", "SELECT m.mask_id, d.x, e.y FROM mask_a m JOIN (SELECT CAST(unnest(generate_series(0, 11)) AS INTEGER) AS x) d ON m.x = CAST(floor(d.x * 8.0 / 12 + 0.5) AS INTEGER) JOIN (SELECT CAST(unnest(generate_series(0, 4)) AS INTEGER) AS y) e ON m.y = CAST(floor(e.y * 8.0 / 5 + 0.5) AS INTEGER)"))
def mask_resize(spark, sf):
    return masks.resize(src.mask_a(spark, sf), (8, 8), (12, 5))


# ------------------------------------------------------------------ neighbourhoods


def _morph(f: str) -> str:
    return with_sql("sparse", f"SELECT a.image_id, a.x, a.y, {f}(b.v) AS v FROM sparse a JOIN sparse b ON a.image_id = b.image_id AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 GROUP BY 1, 2, 3")


def _morph_dense(f: str) -> str:
    return with_sql("mosaic", f"SELECT a.image_id, a.x, a.y, {f}(b.v) AS v FROM mosaic a JOIN mosaic b ON a.image_id = b.image_id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY 1, 2, 3")


@query("erode", _morph_dense("min"))
def erode(spark, sf):
    return neighborhood.erode(src.mosaic(spark, sf), 3)


@query("dilate", _morph_dense("max"))
def dilate(spark, sf):
    return neighborhood.dilate(src.mosaic(spark, sf), 3)


@query("row_filter", with_sql("gray8", f", w AS (SELECT image_id, y, x, sum(k.w * g2) AS v FROM (SELECT a.image_id, a.x, a.y, k.k, k.w, b.v AS g2 FROM gray8 a, (VALUES (-1, 0.25), (0, 0.5), (1, 0.25)) k(k, w) JOIN gray8 b ON b.image_id = a.image_id AND b.y = a.y AND b.x = greatest(0, least(7, a.x + k.k))) k GROUP BY 1, 2, 3) SELECT image_id, x, y, {fixed_sql('CAST(v AS DOUBLE)')} AS v FROM w"))
def row_filter(spark, sf):
    return neighborhood.row_filter(src.gray8(spark, sf), [0.25, 0.5, 0.25], (8, 8)).select("image_id", "x", "y", fixed(C("v")).alias("v"))


_REFLECT = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
_BLUR = f""", k AS (SELECT * FROM (VALUES (-1, 0.25), (0, 0.5), (1, 0.25)) k(k, w)),
b AS (SELECT a.image_id, a.x, a.y, CAST(sum(CAST(kx.w * ky.w AS DOUBLE) * s.v) AS DOUBLE) AS v FROM gray8 a, k kx, k ky, gray8 s
  WHERE s.image_id = a.image_id AND s.x = {_REFLECT.format('(a.x + kx.k)')} AND s.y = {_REFLECT.format('(a.y + ky.k)')} GROUP BY 1, 2, 3)"""


@query("gaussian_blur", with_sql("gray8", f"{_BLUR} SELECT image_id, x, y, {fixed_sql('v')} AS v FROM b"))
def gaussian_blur(spark, sf):
    return neighborhood.blur(src.gray8(spark, sf), [0.25, 0.5, 0.25], (8, 8)).select("image_id", "x", "y", fixed(C("v")).alias("v"))


@query("sharpen", with_sql("gray8", f"{_BLUR}, d AS (SELECT g.image_id, g.x, g.y, g.v, g.v - round_even(b.v, 0) AS d FROM gray8 g JOIN b USING (image_id, x, y)) SELECT image_id, x, y, CAST(CASE WHEN abs(d) < 4 THEN v ELSE greatest(0, least(255, v + round((CASE WHEN d < 0 THEN 1.5 ELSE 0.75 END) * d))) END AS INTEGER) AS v FROM d"))
def sharpen(spark, sf):
    return neighborhood.sharpen(src.gray8(spark, sf), (8, 8), dark=1.5, light=0.75, threshold=4, weights=[0.25, 0.5, 0.25])


@query("cell_codes", with_sql("mosaic", ", m AS (SELECT image_id AS mask_id, x, y FROM mosaic WHERE v >= 128), t AS (SELECT mask_id, x AS i, y AS j, 8 AS b FROM m UNION ALL SELECT mask_id, x - 1, y, 4 FROM m UNION ALL SELECT mask_id, x - 1, y - 1, 2 FROM m UNION ALL SELECT mask_id, x, y - 1, 1 FROM m) SELECT mask_id, i, j, CAST(sum(b) AS INTEGER) AS code FROM t GROUP BY 1, 2, 3"))
def cell_codes(spark, sf):
    return neighborhood.cell_codes(masks.from_raster(src.mosaic(spark, sf), C("v") >= 128))
