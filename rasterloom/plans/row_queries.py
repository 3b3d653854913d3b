"""Readers, writers, geometry, shapes and solvers over files put together byte by byte and over the derived fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color, geometry, headers, svg
from ..operators import clahe, masks, neighborhood, quadtree, rasterize, resample, shapes, solve
from ..operators.rounds import settled
from ..sources import derived as src
from ..sources import files, formats
from ..sources.derived import with_sql
from .registry import fixed, fixed_sql, query
from .resample_queries import _FRAG, _SCAN, _clip_sql, _window_sql, clahe_clip, scale_sinc
from .shape_queries import _be, _gif, _jp2, _jpeg, _le16, _lit, _parts, _png, _SIZES, _tiff, _exr

C = F.col





# ------------------------------------------------------------------ readers and writers


@query("read_16bit_as_8bit", with_sql("u16", "SELECT image_id, x, y, CAST(round_even(v * CAST(255 AS DOUBLE) / 65535, 0) AS INTEGER) AS v FROM u16"))
def read_16bit_as_8bit(spark, sf):
    tiff = files.images(src.u16(spark, sf), formats.tiff_encode, size=(8, 8), depth="uint16")
    out = files.pixels(files.to_8bit(files.decode_images(tiff.withColumn("path", F.lit("a.tif")))), "image_id")
    return out.select("image_id", "x", "y", C("px")[0].alias("v"))


@query("png_raw_rgb", with_sql("rgb8", "SELECT image_id, x, y, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b FROM rgb8"))
def png_raw_rgb(spark, sf):
    flat = files.arrays(src.rgb8(spark, sf), ["r", "g", "b"], 8, 8)
    data = F.unhex(F.array_join(F.transform("data", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    rows = flat.select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(3).alias("channels"), data.alias("data"))
    png = files.encode_png_raw(rows, 9).select("image_id", "content", F.lit("").alias("path"))
    out = files.pixels(files.decode_images(png), "image_id")
    return out.select("image_id", "x", "y", *[C("px")[k].alias(c) for k, c in enumerate("rgb")])


@query("image_arrays", with_sql("rgb8", "SELECT image_id, string_agg(concat(r, ',', g, ',', b), ',' ORDER BY y, x) AS data FROM rgb8 GROUP BY 1"))
def image_arrays(spark, sf):
    return files.arrays(src.rgb8(spark, sf), ["r", "g", "b"], 8, 8).select("image_id", F.concat_ws(",", "data").alias("data"))


@query("gif_pixels", with_sql("gray8", "SELECT image_id, x, y, v // 2 * 2 AS r, 255 - v // 2 AS g, v // 2 AS b FROM gray8"))
def gif_pixels(spark, sf):
    """GIFs of 128 colours, put together byte by byte; of odd images the rows are stored interlaced (0, 4, 2, 6, 1, 3, 5, 7).

    A clear code (80) before 64 one-byte codes keeps these at eight bits each, so the data is the pixels as they are.
    """
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(C("vec_id").alias("image_id"), "embedding")
    gray = F.transform("embedding", lambda v: F.shiftright(src._gray(v.cast("double")), 1))
    order = F.when(C("image_id") % 2 == 1, F.array(*[F.lit(k) for k in (0, 4, 2, 6, 1, 3, 5, 7)])).otherwise(F.array(*[F.lit(k) for k in range(8)]))
    rows = F.flatten(F.transform(order, lambda k: F.slice(gray, k * 8 + 1, F.lit(8))))
    data = F.unhex(F.array_join(F.transform(rows, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    head = _lit("474946383961" + "0800" + "0800" + "E60000")
    table = _lit("".join(f"{2 * i:02X}{255 - i:02X}{i:02X}" for i in range(128)))
    image = F.concat(_lit("2C" + "00000000" + "0800" + "0800"), F.when(C("image_id") % 2 == 1, _lit("40")).otherwise(_lit("00")), _lit("07" + "42" + "80"), data, _lit("81" + "00" + "3B"))
    made = e.select("image_id", F.concat(head, table, image).alias("content"), F.lit("a.gif").alias("path"))
    out = files.pixels(files.decode_images(made), "image_id")
    return out.select("image_id", "x", "y", *[C("px")[k].alias(c) for k, c in enumerate("rgb")])


@query("tiff_lzw_pixels", with_sql("gray8", "SELECT image_id, x, y, CAST(v AS INTEGER) AS v FROM gray8"))
def tiff_lzw_pixels(spark, sf):
    """TIFFs whose strip is LZW: a clear code, one code of nine bits for each pixel, an end code."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(C("vec_id").alias("image_id"), "embedding")
    codes = F.concat(F.array(F.lit(256)), F.transform("embedding", lambda v: src._gray(v.cast("double"))), F.array(F.lit(257)))
    bits = F.array_join(F.transform(codes, lambda c: F.lpad(F.bin(c.cast("long")), 9, "0")), "")
    strip = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(593), F.lit(8)), lambda i: F.lpad(F.conv(F.rpad(F.substring(bits, i, F.lit(8)), 8, "0"), 2, 16), 2, "0")), ""))
    entries = ((256, 8), (257, 8), (258, 8), (259, 5), (262, 1), (273, 8), (277, 1), (278, 8), (279, 75))
    at = 8 + 75 + 1  # the strip, one byte to an even place
    directory = "0900" + "".join(tag.to_bytes(2, "little").hex() + "0400" + "01000000" + v.to_bytes(4, "little").hex() for tag, v in entries) + "00000000"
    made = e.select("image_id", F.concat(_lit("49492A00" + at.to_bytes(4, "little").hex()), strip, _lit("00" + directory)).alias("content"), F.lit("a.tif").alias("path"))
    out = files.pixels(files.decode_images(made), "image_id")
    return out.select("image_id", "x", "y", C("px")[0].alias("v"))


@query("container_roundtrip", "SELECT concat('/', coalesce(lang, '-'), '/', doc_id % 20) AS path, CAST(doc_id AS VARCHAR) AS name, md5(coalesce(text, '')) AS md5 FROM documents")
def container_roundtrip(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    path = F.concat(F.lit("/"), F.coalesce("lang", F.lit("-")), F.lit("/"), C("doc_id") % 20)
    entries = d.select(path.alias("path"), C("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return files.container_entries(files.containers(entries)).select("path", "name", F.md5("content").alias("md5"))


@query("embedded_mask_permissive", with_sql("mask_a", "SELECT vec_id AS mask_id, vec_id % 3 <> 0 AS carries, CASE WHEN vec_id % 3 <> 0 THEN (SELECT count(*) FROM mask_a WHERE mask_id = vec_id) ELSE -1 END AS n FROM embeddings"))
def embedded_mask_permissive(spark, sf):
    """Images of which every third carries no mask: null instead of an error."""
    image = files.encode_png(src.gray8(spark, sf), size=(8, 8)).withColumnRenamed("image_id", "mask_id")
    mask = files.dump_masks(src.mask_a(spark, sf), 8, 8, "tree").withColumnRenamed("content", "mask")
    carried = files.embed_masks(image.filter("mask_id % 3 <> 0").join(mask, "mask_id")).drop("mask")
    read = files.embedded_masks(carried.unionByName(image.filter("mask_id % 3 = 0")), permissive=True)
    n = masks.count(files.load_masks(read.filter("mask is not null").select("mask_id", C("mask").alias("content"))))
    return read.select("mask_id", C("mask").isNotNull().alias("carries")).join(n.withColumnRenamed("count", "n"), "mask_id", "left").withColumn("n", F.coalesce("n", F.lit(-1)).cast("long"))


@query("exif_from_bytes", "SELECT p_partkey AS file_id, CAST(1 + p_partkey % 8 AS VARCHAR) AS orientation, concat(p_partkey % 65536, '/', p_size) AS x_resolution, concat('maker ', chr(CAST(65 + p_partkey % 26 AS INTEGER))) AS make, " + fixed_sql("CAST(p_partkey % 65536 AS DOUBLE) / p_size") + " AS value FROM part")
def exif_from_bytes(spark, sf):
    """TIFF blocks with three tags: orientation (in place), a text and a rational (behind the directory)."""
    k = C("file_id")
    four = lambda v: F.concat(_le16(v), _lit("0000"))
    entry = lambda tag, kind, n, v: F.concat(_le16(F.lit(tag)), _le16(F.lit(kind)), four(F.lit(n)), v)
    head = F.concat(_lit("49492A0008000000"), _le16(F.lit(3)), entry(271, 2, 8, four(F.lit(50))), entry(274, 3, 1, four(k % 8 + 1)), entry(282, 5, 1, four(F.lit(58))), _lit("00000000"))
    body = F.concat(_lit(b"maker ".hex()), _be(k % 26 + 65, 1), _lit("00"), four(k % 65536), four(C("h")))
    tags = _parts(spark, sf).select("file_id", headers.exif_tags(F.concat(head, body)).alias("tags"))
    got = lambda name: headers.exif_entry(C("tags"), name)
    return tags.select("file_id", got("0112").alias("orientation"), got("011a").alias("x_resolution"), got("010f").alias("make"), fixed(headers.exif_rational(got("011a"))).alias("value"))


@query("image_size_by_path", _SIZES)
def image_size_by_path(spark, sf):
    """Sizes by the extension of the path, in whatever case."""
    kinds = ((_png, ".PNG"), (_gif, ".gif"), (_jpeg, ".jpeg"), (_jp2, ".jp2"), (_exr, ".exr"), (lambda: _tiff(1), ".Tif"))
    k = C("file_id") % len(kinds)
    content, ext = F.lit(None).cast("binary"), F.lit("")
    for i, (make, e) in enumerate(kinds):
        content, ext = F.when(k == i, make()).otherwise(content), F.when(k == i, F.lit(e)).otherwise(ext)
    made = _parts(spark, sf).select("file_id", content.alias("content"), F.concat(F.lit("/a/b.c/"), C("file_id"), ext).alias("path"))
    out = made.withColumn("s", headers.image_size_by_path(C("path"), C("content")))
    return out.select("file_id", C("s.width").alias("width"), C("s.height").alias("height"))


@query("svg_document", """SELECT p_partkey AS file_id, concat('<?xml version="1.0"?>', chr(10), '<svg xmlns="http://www.w3.org/2000/svg"', chr(10), '     xmlns:xlink="http://www.w3.org/1999/xlink"', chr(10), '     width="', 1 + p_partkey % 4096, '" height="', p_size, '">', chr(10), '<g id="', p_partkey, '">', chr(10), 'x', '</g>', chr(10), '</svg>', chr(10)) AS svg FROM part""")
def svg_document(spark, sf):
    group = F.concat(F.lit('<g id="'), C("file_id"), F.lit('">\n'), F.lit("x</g>\n"))
    return _parts(spark, sf).select("file_id", svg.document(group, C("w"), C("h")).alias("svg"))


@query("pack_colors", with_sql("gray8", "SELECT image_id, x, y, CAST(v AS INTEGER) AS back, CAST(greatest(0, least(255, round(255 * ((v - 100) / CAST(100 AS DOUBLE))))) AS INTEGER) AS v FROM gray8"))
def pack_colors(spark, sf):
    """Bytes to 0..1 and back, and values beyond both ends."""
    g = src.gray8(spark, sf)
    return g.select("image_id", "x", "y", color.pack8(color.unpack8(C("v"))).alias("back"), color.pack8((C("v") - 100) / F.lit(100.0)).alias("v"))


# ------------------------------------------------------------------ geometry


@query("patch_maps", "SELECT p_partkey AS id, p_size + 0.25 + (p_partkey % 7 - 3) AS mapped, CAST(p_size AS DOUBLE) AS back, p_size + 0.25 - p_size // 2 + p_partkey % 5 AS adjusted FROM part".replace("0.25", "CAST(0.25 AS DOUBLE)"))
def patch_maps(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(C("p_partkey").alias("id"), "p_size")
    shift, at = C("id") % 7 - 3, C("p_size") + 0.25
    return p.select("id", geometry.patch_map(shift, at).alias("mapped"), geometry.patch_inverse(shift, geometry.patch_map(shift, C("p_size").cast("double"))).alias("back"), geometry.adjust_uv(at, F.expr("p_size div 2"), C("id") % 5).alias("adjusted"))


@query("bounds_checks", "SELECT p_partkey AS id, x BETWEEN 0 AND 19 AND y BETWEEN 0 AND 9 AS inside, floor(x) >= 0 AND floor(x) < 20 AND floor(y) >= 0 AND floor(y) < 10 AS valid FROM (SELECT p_partkey, p_size / CAST(2 AS DOUBLE) - 2 AS x, p_partkey % 25 / CAST(2 AS DOUBLE) - 1 AS y FROM part)")
def bounds_checks(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(C("p_partkey").alias("id"), (C("p_size") / 2.0 - 2).alias("x"), (C("p_partkey") % 25 / 2.0 - 1).alias("y"))
    return p.select("id", geometry.inside(C("x"), C("y"), 20, 10).alias("inside"), geometry.in_bounds(F.floor("x"), F.floor("y"), 20, 10).alias("valid"))


@query("uv_rect_checks", "SELECT p_partkey AS id, x1 >= 5 AND y1 >= 3 AS valid, x1 >= 5 AND y1 >= 3 AND x1 <= 30 AND y1 <= 20 AS held, (greatest(x1, 30) - 5) * (greatest(y1, 20) - 3) < (x1 - 5) * (y1 - 3) + 25 * 17 AS pays FROM (SELECT p_partkey, p_size AS x1, p_partkey % 29 AS y1 FROM part)")
def uv_rect_checks(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(C("p_partkey").alias("id"), C("p_size").alias("x1"), (C("p_partkey") % 29).alias("y1"))
    r = {"x0": F.lit(5), "y0": F.lit(3), "x1": C("x1"), "y1": C("y1")}
    whole = {"x0": F.lit(5), "y0": F.lit(3), "x1": F.lit(30), "y1": F.lit(20)}
    return p.select("id", geometry.uv_valid(r).alias("valid"), (geometry.uv_valid(r) & geometry.uv_contains(whole, r)).alias("held"), geometry.merge_pays(r, whole).alias("pays"))


@query("running_bounds", "SELECT l_orderkey, l_linenumber, min(l_partkey) OVER w AS x0, min(l_suppkey) OVER w AS y0, max(l_partkey) OVER w AS x1, max(l_suppkey) OVER w AS y1 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE UNBOUNDED PRECEDING)")
def running_bounds(spark, sf):
    """Bounds of the points of an order up to each line; lines of one number count together."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(Window.unboundedPreceding, 0)
    names = ("x0", "y0", "x1", "y1")
    return line.select("l_orderkey", "l_linenumber", *[b.over(w).alias(n) for b, n in zip(geometry.bounds(C("l_partkey"), C("l_suppkey")), names, strict=True)])


@query("georef_extents_3d", "SELECT c_custkey AS id, c_custkey % 360 - 182 AS x0, CAST(c_nationkey - 9 AS BIGINT) AS y0, c_custkey % 5 - 1 AS z0, c_custkey % 360 - 173 AS x1, CAST(c_nationkey AS BIGINT) AS y1, c_custkey % 5 + 2 AS z1 FROM customer")
def georef_extents_3d(spark, sf):
    z = {"ul": 0, "ur": 2, "lr": -1, "ll": 1}
    g = src.georefs(spark, sf)
    lifted = g.select("id", *[F.struct(C(f"{c}.x").alias("x"), C(f"{c}.y").alias("y"), (C("id") % 5 + d).alias("z")).alias(c) for c, d in z.items()])
    return lifted.select("id", *geometry.extents(["x", "y", "z"]))


@query("merge_rect_pairs", "SELECT atlas_id, CASE WHEN pays THEN 1 ELSE 2 END AS n, CASE WHEN pays THEN joint ELSE own END AS area FROM (SELECT *, joint < own AS pays FROM (SELECT p_partkey // 2 AS atlas_id, (max(x1) - min(x0)) * (max(y1) - min(y0)) AS joint, sum((x1 - x0) * (y1 - y0)) AS own FROM (SELECT p_partkey, p_partkey % 7 AS x0, p_partkey % 11 AS y0, p_partkey % 7 + p_size AS x1, p_partkey % 11 + 1 + p_partkey % 37 AS y1 FROM part) GROUP BY 1 HAVING count(*) = 2))".replace("CASE WHEN pays THEN joint ELSE own END", "CAST(CASE WHEN pays THEN joint ELSE own END AS BIGINT)").replace("CASE WHEN pays THEN 1 ELSE 2 END", "CAST(CASE WHEN pays THEN 1 ELSE 2 END AS BIGINT)"))
def merge_rect_pairs(spark, sf):
    """Two bounds each: one where the joint bounds are smaller than both together, else two."""
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", C("p_size").cast("long").alias("s"))
    k = C("p_partkey")
    r = p.select(F.expr("p_partkey div 2").alias("atlas_id"), k.alias("rect_id"), (k % 7).alias("x0"), (k % 11).alias("y0"), (k % 7 + C("s")).alias("x1"), (k % 11 + 1 + k % 37).alias("y1"))
    r = r.join(r.groupBy("atlas_id").count().filter("count = 2").select("atlas_id"), "atlas_id", "left_semi")
    return shapes.merge_rects(r).groupBy("atlas_id").agg(F.count("*").alias("n"), F.sum((C("x1") - C("x0")) * (C("y1") - C("y0"))).alias("area"))


# ------------------------------------------------------------------ masks and quads


@query("mask_create", with_sql("mask_b", "SELECT vec_id * 4 AS mask_id, x, y FROM embeddings, (SELECT CAST(unnest(generate_series(0, 4)) AS INTEGER) AS x), (SELECT CAST(unnest(generate_series(0, 2)) AS INTEGER) AS y) UNION ALL SELECT mask_id * 4 + 1, x, y FROM mask_b WHERE x < 5 AND y < 3"))
def mask_create(spark, sf):
    """Full masks of 5 x 3 (id 4k), copies of other masks cut to that size (4k + 1), and empty ones (4k + 2, no pixels)."""
    sizes = spark.read.parquet(f"{sf}/embeddings.parquet").select(C("vec_id").alias("mask_id"), F.lit(5).alias("width"), F.lit(3).alias("height"))
    made = [masks.create(sizes, full=True), masks.create(sizes, src.mask_b(spark, sf)), masks.create(sizes)]
    out = [m.select((C("mask_id") * 4 + k).alias("mask_id"), "x", "y") for k, m in enumerate(made)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("mask_union_sized", with_sql("mask_a mask_b", "SELECT * FROM mask_a UNION SELECT * FROM mask_b"))
def mask_union_sized(spark, sf):
    """A union that first holds the masks' sizes against each other."""
    sizes = spark.read.parquet(f"{sf}/embeddings.parquet").select(C("vec_id").alias("mask_id"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return masks.union(src.mask_a(spark, sf), src.mask_b(spark, sf), (sizes, sizes))


@query("quad_find", with_sql("mask_b", "SELECT mask_id, x, y FROM mask_b WHERE x >= 4 AND y < 4"))
def quad_find(spark, sf):
    """The leaves found at one address, as pixels within it."""
    q = quadtree.find_quad(quadtree.contract(src.mask_b(spark, sf), 8), 8, 1, 1, 0)
    return quadtree.expand(q, 8, 8).filter("x >= 4 and y < 4")


@query("quad_paint", with_sql("mask_b", "SELECT mask_id, 2 * x + i AS x, 2 * y + j AS y FROM mask_b, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)"))
def quad_paint(spark, sf):
    """Leaves painted at twice the size: the pixels they cover, none of them twice."""
    r = quadtree.paint(quadtree.contract(src.mask_b(spark, sf), 8), 8, 8, 2.0)
    x = r.withColumn("x", F.explode(F.sequence(C("x0"), C("x1") - 1)))
    return x.select("mask_id", "x", F.explode(F.sequence(C("y0"), C("y1") - 1)).alias("y"))


#: White quads by level: a quad counts if it is full and its parent is not.
_LEAVES = ", l AS (SELECT mask_id, s, x // s AS qx, y // s AS qy, x // (2 * s) AS px, y // (2 * s) AS py FROM mask_b, (VALUES (1), (2), (4), (8)) k(s)), f AS (SELECT mask_id, s, qx, qy, px, py FROM l GROUP BY ALL HAVING count(*) = s * s) SELECT f.mask_id, f.s AS size, count(*) AS n FROM f LEFT JOIN f p ON p.mask_id = f.mask_id AND p.s = 2 * f.s AND p.qx = f.px AND p.qy = f.py WHERE p.s IS NULL GROUP BY 1, 2"


@query("quad_leaves", with_sql("mask_b", _LEAVES))
def quad_leaves(spark, sf):
    """How many white leaves of each size a mask's tree has."""
    return quadtree.contract(src.mask_b(spark, sf), 8).groupBy("mask_id", "size").agg(F.count("*").alias("n"))


@query("quad_clipped", with_sql("mask_b", "SELECT mask_id, count(*) AS area FROM mask_b WHERE x < 5 AND y < 6 GROUP BY 1"))
def quad_clipped(spark, sf):
    """Area of leaves clipped to 5 x 6."""
    c = quadtree.clipped(quadtree.contract(src.mask_b(spark, sf), 8), 5, 6)
    return c.groupBy("mask_id").agg(F.sum(C("size_x") * C("size_y")).cast("long").alias("area"))


# ------------------------------------------------------------------ shapes


def _tiling(px, found):
    """By image: pixels covered, covered by several, covered by a shape of another value, and shapes that come too late.

    Shapes are numbered from the bottom right: of two, the one whose last corner stands later in reading order is first.
    """
    x = found.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    held = x.select("image_id", "x", "y", C("v").alias("own")).join(px.select("image_id", "x", "y", "v"), ["image_id", "x", "y"])
    by_pixel = held.groupBy("image_id", "x", "y").agg(F.count("*").alias("n"), F.count_if(C("own") != C("v")).alias("wrong"))
    sums = by_pixel.groupBy("image_id").agg(F.count("*").alias("covered"), F.count_if(C("n") > 1).alias("twice"), F.sum("wrong").alias("wrong"))
    w = Window.partitionBy("image_id").orderBy("seq")
    late = found.withColumn("before", F.lag(C("y1") * 100_000 + C("x1")).over(w)).filter(C("before") <= C("y1") * 100_000 + C("x1"))
    late = late.groupBy("image_id").agg(F.count("*").alias("late"))
    return sums.join(late, "image_id", "left").select("image_id", "covered", "twice", "wrong", F.coalesce("late", F.lit(0)).cast("long").alias("late"))


@query("rectangle_tiling", with_sql("blocky", "SELECT image_id, count(*) AS covered, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS late FROM blocky GROUP BY 1"))
def rectangle_tiling(spark, sf):
    px = src.blocky(spark, sf)
    return _tiling(px, shapes.find_rectangles(px, apart=True))


@query("square_tiling", with_sql("blocky", "SELECT image_id, count(*) AS covered, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS late, CAST(0 AS BIGINT) AS oblong FROM blocky WHERE v >= 128 GROUP BY 1"))
def square_tiling(spark, sf):
    """Squares of bright values only."""
    px = src.blocky(spark, sf)
    found = shapes.find_squares(px, C("v") >= 128)
    oblong = found.groupBy("image_id").agg(F.count_if(C("x1") - C("x0") != C("y1") - C("y0")).alias("oblong"))
    return _tiling(px, found).join(oblong, "image_id")


#: The first rectangle found ends at the bottom right corner: its width is the run there, its height the rows whose runs are as wide.
_CORNER = ", r AS (SELECT image_id, x, y, v, lead(v) OVER (PARTITION BY image_id, y ORDER BY x) AS nxt FROM blocky), e AS (SELECT b.image_id, b.y, b.v, 47 - coalesce(max(o.x), -1) AS w FROM blocky b LEFT JOIN blocky o ON o.image_id = b.image_id AND o.y = b.y AND o.v <> b.v WHERE b.x = 47 GROUP BY 1, 2, 3), c AS (SELECT * FROM e WHERE y = 47) SELECT c.image_id, CAST(48 - c.w AS INTEGER) AS x0, CAST(coalesce(max(e.y), -1) + 1 AS INTEGER) AS y0, 47 AS x1, 47 AS y1, c.v FROM c LEFT JOIN e ON e.image_id = c.image_id AND (e.v <> c.v OR e.w < (SELECT w2.w FROM e w2 WHERE w2.image_id = e.image_id AND w2.y = e.y + 1)) GROUP BY c.image_id, c.w, c.v"


@query("first_rectangle", with_sql("blocky", _CORNER))
def first_rectangle(spark, sf):
    """The rectangle at the bottom right: as wide as the run there, as high as rows above whose runs are no shorter than the one below."""
    found = shapes.find_rectangles(src.blocky(spark, sf))
    return found.filter("seq = 0").select("image_id", "x0", "y0", "x1", "y1", "v")


def _packed(p):
    """By atlas: rectangles, their area, how many lie outside and how many pairs of a sheet overlap."""
    p = settled(p)  # read three times, packed once
    out = (C("pack_x") < 0) | (C("pack_y") < 0) | (C("pack_x") + C("w") > C("atlas_w")) | (C("pack_y") + C("h") > C("atlas_h"))
    sums = p.groupBy("atlas_id").agg(F.count("*").alias("n"), F.sum(C("w") * C("h")).cast("long").alias("area"), F.count_if(out).alias("outside"))
    a, b = (p.select("atlas_id", *[C(c).alias(f"{c}_{s}") for c in ("rect_id", "pack_x", "pack_y", "w", "h")], "sheet") for s in "ab")
    # neighbours by cells of 64, so no rectangle meets all others of its atlas
    cells = lambda d, s: d.withColumn("cx", F.explode(F.sequence(F.expr(f"pack_x_{s} div 64"), F.expr(f"(pack_x_{s} + w_{s} - 1) div 64")))).withColumn("cy", F.explode(F.sequence(F.expr(f"pack_y_{s} div 64"), F.expr(f"(pack_y_{s} + h_{s} - 1) div 64"))))
    met = cells(a, "a").join(cells(b, "b"), ["atlas_id", "sheet", "cx", "cy"]).filter("rect_id_a < rect_id_b")
    met = met.filter("pack_x_a < pack_x_b + w_b and pack_x_b < pack_x_a + w_a and pack_y_a < pack_y_b + h_b and pack_y_b < pack_y_a + h_a")
    over = met.groupBy("atlas_id").agg(F.count_distinct("rect_id_a", "rect_id_b").alias("overlaps"))
    return sums.join(over, "atlas_id", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)).cast("long"))


_NO_OVERLAP = "SELECT atlas_id, count(*) AS n, CAST(sum(w * h) AS BIGINT) AS area, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS overlaps FROM rects GROUP BY 1"


@query("pack_overlaps", with_sql("rects", _NO_OVERLAP))
def pack_overlaps(spark, sf):
    return _packed(shapes.pack(src.rects(spark, sf)))


@query("pack_inflated", with_sql("rects", _NO_OVERLAP.replace("FROM rects", "FROM (SELECT rect_id % 64 AS atlas_id, w, h FROM rects)")))
def pack_inflated(spark, sf):
    """Small atlases that grow by half, up to a largest size; what it does not hold goes to further sheets."""
    r = src.rects(spark, sf).withColumn("atlas_id", C("rect_id") % 64)
    return _packed(shapes.pack(r, 1.5, (4096, 4096)))


# ------------------------------------------------------------------ meshes, resampling, sharpening, filling


@query("rasterize_faces", with_sql("triangles", f"{_SCAN}{_FRAG} SELECT image_id, x, y, {fixed_sql('max(z)')} AS z FROM f GROUP BY 1, 2, 3"))
def rasterize_faces(spark, sf):
    """The triangles as a mesh: faces of vertex numbers, depths into one buffer an image."""
    t = src.triangles(spark, sf)
    # equal triangles are one, as ids of line items repeat
    number = lambda k: F.xxhash64(F.lit(k), *t.columns)
    point = F.explode(F.array(*[F.struct(number(k).alias("vertex"), *[C(f"{p}{a}").alias(a) for a in "xyz"]) for k, p in enumerate("abc")]))
    vertices = t.distinct().select(point.alias("p")).select("p.*")
    faces = t.distinct().select(C("tri_id").alias("face_id"), "image_id", *[number(k).alias(c) for k, c in enumerate("ijk")])
    return rasterize.zbuffer(rasterize.rasterize_faces(faces, vertices, (0, 0, 64, 64))).withColumn("z", fixed(C("z")))


_SINC = lambda d, h: f"(CASE WHEN abs({d}) > {h} THEN 0 ELSE CASE WHEN abs(({d}) * 2 * pi() / {h}) < 1e-12 THEN 1 ELSE sin(({d}) * 2 * pi() / {h}) / (({d}) * 2 * pi() / {h}) END * (CAST(0.54 AS DOUBLE) + CAST(0.46 AS DOUBLE) * cos(({d}) * pi() / {h})) END)"
_HAT = lambda d, h: f"greatest(CAST(0 AS DOUBLE), 1 - abs({d}) / CAST({h} AS DOUBLE))"


def _sinc_sql(sql: str, hx, hy) -> str:
    hat, sinc = (f"{f('x - px', hx)} * {f('y - py', hy)}" for f in (_HAT, _SINC))
    assert hat in sql
    return sql.replace(hat, sinc)


@query("scale_sinc_exact", with_sql("gray8", _sinc_sql(_window_sql((12, 12), (2 / 3, 2 / 3), (2 / 3 * 0.5 - 0.5, 2 / 3 * 0.5 - 0.5), 2.0, 2.0), 2.0, 2.0) + " SELECT image_id, dx AS x, dy AS y, CAST(floor(CASE WHEN total > 1e-15 THEN s / total ELSE 0 END * 1000 + 0.5137) AS BIGINT) AS v FROM g JOIN n USING (dx, dy)"))
def scale_sinc_exact(spark, sf):
    return resample.scale(src.gray8(spark, sf), (8, 8), (12, 12)).withColumn("v", F.floor(C("v") * 1000 + 0.5137))


_RGB_SPARSE = ", h AS (SELECT image_id, x, y, v AS r, 255 - v AS g, (v * 7) % 256 AS b FROM sparse)"


@query("reconstruct_channels", with_sql("sparse", _RGB_SPARSE + _window_sql((64, 64), (1.0, 1.0), (0.25, -0.5), 2.0, 2.0, "h").replace("sum(v * w) AS s,", "sum(r * w) AS sr, sum(g * w) AS sg, sum(b * w) AS sb,") + f" SELECT image_id, dx AS x, dy AS y, {fixed_sql('sr / own')} AS r, {fixed_sql('sg / own')} AS g, {fixed_sql('sb / own')} AS b FROM g WHERE own >= 1e-15"))
def reconstruct_channels(spark, sf):
    """Three channels with missing pixels, weighted in one aggregation."""
    px = src.sparse(spark, sf).select("image_id", "x", "y", C("v").alias("r"), (F.lit(255) - C("v")).alias("g"), (C("v") * 7 % 256).alias("b"))
    p = resample._points(spark, (64, 64), (1.0, 1.0), (0.25, -0.5))
    out = resample.reconstruct_valid(px, p, resample.hat(2.0, 2.0), (64, 64), ("r", "g", "b"))
    return out.select("image_id", "x", "y", *[fixed(C(c)).alias(c) for c in "rgb"])


_D14 = lambda e: f"(({e} + 8192) >> 14)"
_B = lambda e: f"greatest(0, least(255, {e}))"
_YCC = f", l AS (SELECT image_id, x, y, CAST(r AS BIGINT) AS r, CAST(b AS BIGINT) AS b, {_D14('(r * 4899 + g * 9617 + b * 1868)')} AS v FROM rgb8), k AS (SELECT image_id, x, y, v, {_B(_D14('(r - v) * 11682') + ' + 128')} - 128 AS cr, {_B(_D14('(b - v) * 9241') + ' + 128')} - 128 AS cb FROM l)"
_FOLD = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
_SOFT = f", t AS (SELECT d, w FROM (VALUES (-1, 0.25), (0, 0.5), (1, 0.25)) t(d, w)), h1 AS (SELECT k.image_id, k.x, k.y, sum(CAST(w AS DOUBLE) * o.v) AS s FROM k, t JOIN k o ON o.image_id = k.image_id AND o.y = k.y AND o.x = {_FOLD.format('(k.x + d)')} GROUP BY 1, 2, 3), h2 AS (SELECT k.image_id, k.x, k.y, round_even(sum(CAST(w AS DOUBLE) * o.s), 0) AS s FROM k, t JOIN h1 o ON o.image_id = k.image_id AND o.x = k.x AND o.y = {_FOLD.format('(k.y + d)')} GROUP BY 1, 2, 3), z AS (SELECT image_id, x, y, cr, cb, CAST(greatest(0, least(255, v + round((CASE WHEN v < s THEN 1.5 ELSE 0.75 END) * (v - s)))) AS BIGINT) AS v FROM k JOIN h2 USING (image_id, x, y))"
_SHARP = with_sql("rgb8", f"{_YCC}{_SOFT} SELECT image_id, x, y, CAST({_B('v + ' + _D14('cr * 22987'))} AS INTEGER) AS r, CAST({_B('v + ' + _D14('(cr * -11698 + cb * -5636)'))} AS INTEGER) AS g, CAST({_B('v + ' + _D14('cb * 29049'))} AS INTEGER) AS b, CAST((x + y) % 256 AS INTEGER) AS a FROM z")


@query("sharpen_rgba", _SHARP)
def sharpen_rgba(spark, sf):
    """Colours sharpened by their luma, alpha kept."""
    px = src.rgb8(spark, sf).withColumn("a", ((C("x") + C("y")) % 256).cast("int"))
    return neighborhood.sharpen_color(px, (8, 8), dark=1.5, light=0.75, weights=[0.25, 0.5, 0.25])


@query("laplace_residual", with_sql("gray8", "SELECT vec_id AS image_id, CAST(64 AS BIGINT) AS pixels, CAST(0 AS BIGINT) AS moved, CAST(0 AS BIGINT) AS off FROM embeddings"))
def laplace_residual(spark, sf):
    """By image: pixels, known ones that changed, and filled ones that are not the mean of their neighbours.

    The equations have one solution, so an image without such pixels is it.
    """
    known = (C("x") * 3 + C("y") * 5 + C("image_id")) % 4 != 0
    px = src.gray8(spark, sf)
    got = solve.laplace_interpolate(px.withColumn("known", known), whole=False).select("image_id", "x", "y", C("v").alias("u"))
    both = got.join(px, ["image_id", "x", "y"]).withColumn("known", known)
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    told = got.select("image_id", "u", "x", "y", step.alias("d")).select("image_id", (C("x") + C("d.i")).alias("x"), (C("y") + C("d.j")).alias("y"), "u")
    mean = told.groupBy("image_id", "x", "y").agg(F.avg("u").alias("mean"))
    out = both.join(mean, ["image_id", "x", "y"]).groupBy("image_id")
    return out.agg(F.count("*").alias("pixels"), F.count_if(C("known") & (F.abs(C("u") - C("v")) > 1e-9)).alias("moved"), F.count_if(~C("known") & (F.abs(C("u") - C("mean")) > 1e-6)).alias("off"))


# ------------------------------------------------------------------ clipped histograms


def clipped_sql(px: str, region: int, cap: int) -> str:
    """CTEs from `px` to t (image_id, rx, ry, v, n): counts of 256 values by region, cut at cap and given back.

    A recursion walks over the first bins of the sweeps; each step meets every (256 // left)-th bin from there.
    """
    return f""", hh AS (SELECT image_id, x // {region} AS rx, y // {region} AS ry, v, count(*) AS n FROM {px} GROUP BY ALL),
hc AS (SELECT z.image_id, z.rx, z.ry, list(CAST(coalesce(n, 0) AS BIGINT) ORDER BY z.v) AS h FROM (SELECT image_id, rx, ry, i AS v FROM (SELECT DISTINCT image_id, rx, ry FROM hh), (SELECT unnest(generate_series(0, 255)) AS i)) z LEFT JOIN hh USING (image_id, rx, ry, v) GROUP BY ALL),
hs AS (SELECT *, CAST(list_sum(list_transform(h, lambda v: greatest(v - {cap}, 0))) AS BIGINT) // 256 AS share, CAST(list_sum(list_transform(h, lambda v: greatest(v - {cap}, 0))) AS BIGINT) AS cut FROM hc),
h0 AS (SELECT image_id, rx, ry, list_transform(h, lambda v: least(v + share, {cap})) AS h, CAST(cut - list_sum(list_transform(h, lambda v: CASE WHEN v > {cap} THEN 0 WHEN {cap} - v < share THEN share - ({cap} - v) ELSE share END)) AS BIGINT) AS gap FROM hs),
r AS (SELECT image_id, rx, ry, h, gap, 0 AS first FROM h0
  UNION ALL SELECT image_id, rx, ry, list_transform(h, lambda v, i: v + CASE WHEN list_contains(met, i - 1) THEN 1 ELSE 0 END), gap - len(met), (first + 1) % 256
  FROM (SELECT *, list_slice(list_filter(generate_series(first, 255, greatest(1, 256 // gap)), lambda p: h[p + 1] < {cap}), 1, gap) AS met FROM r WHERE gap > 0 AND list_min(h) < {cap})),
e AS (SELECT image_id, rx, ry, arg_min(h, gap * 1000000 - list_sum(h)) AS h FROM r GROUP BY ALL),
t AS (SELECT image_id, rx, ry, v, h[v + 1] AS n FROM (SELECT *, unnest(generate_series(0, 255)) AS v FROM e) WHERE h[v + 1] > 0)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("clahe_clip_counts", _recursive(with_sql("blocky", clipped_sql("blocky", 24, 9) + " SELECT image_id, CAST(rx AS INTEGER) AS rx, CAST(ry AS INTEGER) AS ry, CAST(v AS INTEGER) AS v, n FROM t")))
def clahe_clip_counts(spark, sf):
    """Counts of flat blocks: much is cut, and even shares as well as single ones are given back."""
    return clahe.clip_histogram(clahe.region_histogram(src.blocky(spark, sf), (24, 24)), 4.0, (24, 24))


query("clahe_clip", _clip_sql())(clahe_clip)
query("scale_sinc", with_sql("gray8", _sinc_sql(_window_sql((12, 12), (2 / 3, 2 / 3), (2 / 3 * 0.5 - 0.5, 2 / 3 * 0.5 - 0.5), 2.0, 2.0), 2.0, 2.0) + " SELECT image_id, dx AS x, dy AS y, CAST(greatest(0, least(255, round_even(s / total, 0))) AS INTEGER) AS v FROM g JOIN n USING (dx, dy)"))(scale_sinc)
