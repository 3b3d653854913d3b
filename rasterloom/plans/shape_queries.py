"""Headers, codecs, contours, rectangles, packing, filling and quads over the derived fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, headers, svg
from ..operators import contours as ct
from ..operators import masks, quadtree, rings, shapes, solve, stacks
from ..operators.rounds import settled
from ..sources import derived as src
from ..sources import files, formats
from ..sources.derived import with_sql
from .registry import fixed, fixed_sql, query

C = F.col


# ------------------------------------------------------------------ headers


def _be(v, size):
    return F.unhex(F.lpad(F.hex(v.cast("long")), 2 * size, "0"))


def _le16(v):
    v = v.cast("long")
    return F.concat(_be(v % 256, 1), _be(F.shiftright(v, 8), 1))


def _lit(hex_text: str):
    return F.unhex(F.lit(hex_text))


def _parts(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size")
    return p.select(C("p_partkey").alias("file_id"), (F.lit(1) + C("p_partkey") % 4096).alias("w"), C("p_size").alias("h"))


_SIZES = "SELECT p_partkey AS file_id, CAST(1 + p_partkey % 4096 AS INTEGER) AS width, p_size AS height FROM part"


def _sized(spark, sf, content, size):
    out = _parts(spark, sf).select("file_id", content.alias("content")).withColumn("s", size(C("content")))
    return out.select("file_id", C("s.width").alias("width"), C("s.height").alias("height"))


def _png():
    return F.concat(_lit("89504E470D0A1A0A0000000D49484452"), _be(C("w"), 4), _be(C("h"), 4), _lit("0800000000"))


def _gif():
    return F.concat(_lit("474946383961"), _le16(C("w")), _le16(C("h")), _lit("000000"))


def _jp2():
    return F.concat(_lit("0000000C6A5020200D0A870A"), _lit("00000014667479706A703220000000006A703220"), _lit("0000001E6A703268"), _lit("0000001669686472"), _be(C("h"), 4), _be(C("w"), 4), _lit("000107070000"))


def _jpeg():
    return F.concat(_lit("FFD8FFE000104A46494600010100000100010000"), _lit("FFC0001108"), _be(C("h"), 2), _be(C("w"), 2), _lit("03011100021101031101"))


def _tiff(orientation: int):
    entry = lambda tag, v: F.concat(_le16(F.lit(tag)), _lit("040001000000"), _le16(v), _lit("0000"))
    return F.concat(_lit("49492A0008000000"), _le16(F.lit(3)), entry(256, C("w")), entry(257, C("h")), entry(274, F.lit(orientation)), _lit("00000000"))


def _exr():
    text = "channels\0chlist\0".encode().hex()
    window = "dataWindow\0box2i\0".encode().hex()
    return F.concat(_lit("762F310102000000"), _lit(text), _lit("01000000" + "00"), _lit(window), _lit("10000000"), _lit("0200000003000000"), _le16(C("w") + 1), _lit("0000"), _le16(C("h") + 2), _lit("0000"), _lit("00"))


@query("png_size", _SIZES)
def png_size(spark, sf):
    return _sized(spark, sf, _png(), headers.png_size)


@query("gif_size", _SIZES)
def gif_size(spark, sf):
    return _sized(spark, sf, _gif(), headers.gif_size)


@query("jp2_size", _SIZES)
def jp2_size(spark, sf):
    return _sized(spark, sf, _jp2(), headers.jp2_size)


@query("jpeg_size", _SIZES)
def jpeg_size(spark, sf):
    return _sized(spark, sf, _jpeg(), headers.jpeg_size)


@query("tiff_size", "SELECT p_partkey AS file_id, p_size AS width, CAST(1 + p_partkey % 4096 AS INTEGER) AS height FROM part")
def tiff_size(spark, sf):
    return _sized(spark, sf, _tiff(6), headers.tiff_size)


@query("exr_size", _SIZES)
def exr_size(spark, sf):
    return _sized(spark, sf, _exr(), headers.exr_size)


def _mixed():
    k = C("file_id") % 5
    return F.when(k == 0, _png()).when(k == 1, _gif()).when(k == 2, _jpeg()).when(k == 3, _jp2()).otherwise(_tiff(1))


@query("image_size", _SIZES)
def image_size(spark, sf):
    return _sized(spark, sf, _mixed(), headers.image_size)


@query("image_type", "SELECT p_partkey AS file_id, CASE p_partkey % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.gif' WHEN 2 THEN '.jpg' WHEN 3 THEN '.jp2' ELSE '.tif' END AS type FROM part")
def image_type(spark, sf):
    return _parts(spark, sf).select("file_id", headers.image_type(_mixed()).alias("type"))


@query("image_mime", "SELECT p_partkey AS file_id, CASE p_partkey % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/jp2' WHEN 4 THEN 'image/tiff' ELSE '' END AS mime FROM part")
def image_mime(spark, sf):
    k = C("file_id") % 6
    content = F.when(k == 0, _png()).when(k == 1, _gif()).when(k == 2, _jpeg()).when(k == 3, _jp2()).when(k == 4, _tiff(1)).otherwise(_lit("424D"))
    return _parts(spark, sf).select("file_id", headers.image_mime(content).alias("mime"))


@query("exif_orientation", "SELECT p_partkey AS file_id, ['TopLeft', 'TopRight', 'BottomRight', 'BottomLeft', 'LeftTop', 'RightTop', 'RightBottom', 'LeftBottom'][1 + p_partkey % 8] AS name, CAST(1 + p_partkey % 8 AS INTEGER) AS value FROM part")
def exif_orientation(spark, sf):
    p = _parts(spark, sf).select("file_id", headers.orientation_name(F.lit(1) + C("file_id") % 8).alias("name"))
    return p.withColumn("value", headers.orientation_value(C("name")))


@query("exif_values", f"SELECT p_partkey AS file_id, CASE p_partkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 254 WHEN 3 THEN 1 ELSE 0 END AS num, CASE p_partkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 10000 WHEN 3 THEN 100 ELSE 0 END AS den, {fixed_sql('CASE WHEN p_size % 5 <> 0 THEN CAST(p_partkey AS DOUBLE) / (p_size % 5) ELSE -1 END')} AS value, CASE WHEN p_size % 2 = 0 THEN 'maker' ELSE 'none' END AS make FROM part")
def exif_values(spark, sf):
    tags = F.map_from_entries(F.when(C("h") % 2 == 0, F.array(F.struct(F.lit("010f"), F.lit("maker")))).otherwise(F.array(F.struct(F.lit("0110"), F.lit("model")))))
    p = _parts(spark, sf).select("file_id", headers.resolution_unit(C("file_id") % 4).alias("u"), headers.exif_rational(F.concat_ws("/", C("file_id"), C("h") % 5)).alias("v"), headers.exif_entry(tags, "010f", "none").alias("make"))
    return p.select("file_id", F.coalesce("u.num", F.lit(0)).cast("int").alias("num"), F.coalesce("u.den", F.lit(0)).cast("int").alias("den"), fixed(F.coalesce("v", F.lit(-1.0))).alias("value"), "make")


@query("orientation_remap", with_sql("mosaic", "SELECT image_id, CASE image_id % 8 WHEN 0 THEN x WHEN 1 THEN 47 - x WHEN 2 THEN 47 - x WHEN 3 THEN x WHEN 4 THEN y WHEN 5 THEN 47 - y WHEN 6 THEN 47 - y ELSE y END AS x, CASE image_id % 8 WHEN 0 THEN y WHEN 1 THEN y WHEN 2 THEN 47 - y WHEN 3 THEN 47 - y WHEN 4 THEN x WHEN 5 THEN x WHEN 6 THEN 47 - x ELSE 47 - x END AS y, v FROM mosaic"))
def orientation_remap(spark, sf):
    x, y = headers.orient(C("x"), C("y"), 48, 48, C("image_id") % 8 + 1)
    return src.mosaic(spark, sf).select("image_id", x.cast("int").alias("x"), y.cast("int").alias("y"), "v")


# ------------------------------------------------------------------ codecs

_GRAY = with_sql("gray8", "SELECT * FROM gray8")


def _decoded(content):
    out = files.pixels(files.decode_images(content.withColumn("path", F.lit(""))), "image_id")
    return out.select("image_id", "x", "y", C("px")[0].alias("v"))


@query("png_roundtrip", _GRAY)
def png_roundtrip(spark, sf):
    return _decoded(files.encode_png(src.gray8(spark, sf), 9))


@query("tiff_roundtrip", _GRAY)
def tiff_roundtrip(spark, sf):
    return _decoded(files.images(src.gray8(spark, sf), lambda image: formats.tiff_encode(image, tile=16)))


@query("embedded_mask_roundtrip", with_sql("mask_a", "SELECT * FROM mask_a"))
def embedded_mask_roundtrip(spark, sf):
    image = files.encode_png(src.gray8(spark, sf)).withColumnRenamed("image_id", "mask_id")
    mask = files.dump_masks(src.mask_a(spark, sf), 8, 8, "tree").withColumnRenamed("content", "mask")
    carried = files.embedded_masks(files.embed_masks(image.join(mask, "mask_id")).drop("mask"))
    return files.load_masks(carried.select("mask_id", C("mask").alias("content")))


def _mask_trip(kind):
    @query(f"{kind}_roundtrip", with_sql("mask_b", "SELECT * FROM mask_b"))
    def f(spark, sf):
        return files.load_masks(files.dump_masks(src.mask_b(spark, sf), 8, 8, {"mask_bits": "bits", "qmask": "tree", "mqmask": "mapped"}[kind]))


for _k in ("mask_bits", "qmask", "mqmask"):
    _mask_trip(_k)


def _bits_sql(order: str) -> str:
    """Set pixels of the 2x2 masks whose pixel n (of `order`: x, y pairs) is bit n of the key."""
    return f"SELECT p_partkey AS mask_id, x, y FROM part, (SELECT * FROM (VALUES {order}) k(n, x, y)) WHERE (p_partkey >> n) & 1 = 1"


_QUAD = "(0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)"


@query("qmask_bytes", _bits_sql(_QUAD))
def qmask_bytes(spark, sf):
    """Dumps of 2x2 quadtrees put together byte by byte: a node is 00 (set), 01 (not set) or 02 (mixed)."""
    leaf = lambda n: _be(F.lit(1) - F.shiftright("file_id", n) % 2, 1)
    content = F.concat(_lit("514D41534B000000" + "02000000" * 3 + "00000000" + "02"), *[leaf(n) for n in range(4)])
    return files.load_masks(_parts(spark, sf).select(C("file_id").alias("mask_id"), content.alias("content")))


@query("mqmask_bytes", _bits_sql("(0, 2, 0), (1, 3, 0), (2, 2, 1), (3, 3, 1)"))
def mqmask_bytes(spark, sf):
    """Mapped trees of depth 2 and 12 bytes: the root has one mixed quarter (upper right), at a place aligned to four bytes behind its jump."""
    quarter = sum(F.shiftright("file_id", n) % 2 * (3 << 6 - 2 * n) for n in range(4))
    content = F.concat(_lit("4D514D41534B0000" + "02" + "08000000"), _lit("10" + "0000" + "01000000"), _be(quarter, 1))
    return files.load_masks(_parts(spark, sf).select(C("file_id").alias("mask_id"), content.alias("content")))


@query("mapped_leaves", with_sql("mask_a", "SELECT mask_id, CAST(x // 4 * 4 AS INTEGER) AS x, CAST(y // 4 * 4 AS INTEGER) AS y, count(*) = 16 AS white FROM mask_a WHERE x >= 4 GROUP BY 1, 2, 3"))
def mapped_leaves(spark, sf):
    cut = files.mask_leaves(files.dump_masks(src.mask_a(spark, sf), 8, 8, "mapped"), 1, (4, 0, 7, 7))
    return cut.filter("white is null or white").select("mask_id", "x", "y", F.coalesce("white", F.lit(False)).alias("white"))


# ------------------------------------------------------------------ contours

_CELLS = """, m AS (SELECT image_id AS mask_id, x, y FROM mosaic WHERE v >= 128), t AS (SELECT mask_id, x AS i, y AS j, 8 AS b FROM m UNION ALL SELECT mask_id, x - 1, y, 4 FROM m UNION ALL SELECT mask_id, x - 1, y - 1, 2 FROM m UNION ALL SELECT mask_id, x, y - 1, 1 FROM m),
c0 AS (SELECT mask_id, i, j, CAST(sum(b) AS INTEGER) AS code, j = -1 OR j = 47 OR i = 47 AS sq FROM t GROUP BY 1, 2, 3),
st AS (SELECT mask_id, arg_min(code, j * 1000 + i) AS state FROM c0 WHERE code IN (5, 10) GROUP BY 1),
c AS (SELECT c0.*, state FROM c0 LEFT JOIN st USING (mask_id))"""


def _segment_values() -> str:
    """Segments by the sides of a cell, clockwise from the top: one begins where a set corner is followed by an unset one, and ends at the other kind.

    With two of each, it ends at the next side clockwise if the cell is like the one that decides, else at the one before.
    Square cells with one or three set corners turn at the centre.
    """
    middle, rows = [(1, 0), (2, 1), (1, 2), (0, 1)], []
    for code in range(1, 15):
        corner = [code >> 3 & 1, code >> 2 & 1, code >> 1 & 1, code & 1]
        begin = [k for k in range(4) if corner[k] and not corner[(k + 1) % 4]]
        end = [k for k in range(4) if not corner[k] and corner[(k + 1) % 4]]
        if len(begin) == 2:
            for state, step in ((code, 1), (15 - code, 3)):
                rows += [(code, q, state, *middle[k], *middle[(k + step) % 4]) for k in begin for q in (0, 1)]
            continue
        a, b = middle[begin[0]], middle[end[0]]
        rows.append((code, 0, -1, *a, *b))
        rows += [(code, 1, -1, *a, 1, 1), (code, 1, -1, 1, 1, *b)] if sum(corner) != 2 else [(code, 1, -1, *a, *b)]
    return "(VALUES " + ", ".join(str(r) for r in rows) + ") k(code, sq, state, ax, ay, bx, by_)"


_SEGS = f"{_CELLS}, s AS (SELECT mask_id, CAST(2 * i + ax AS INTEGER) AS sx, CAST(2 * j + ay AS INTEGER) AS sy, CAST(2 * i + bx AS INTEGER) AS ex, CAST(2 * j + by_ AS INTEGER) AS ey FROM c JOIN {_segment_values()} ON k.code = c.code AND k.sq = CAST(c.sq AS INTEGER) AND (k.state = -1 OR k.state = c.state))"


def _mosaic_mask(spark, sf):
    return masks.from_raster(src.mosaic(spark, sf), C("v") >= 128)


@query("contour_segments", with_sql("mosaic", f"{_SEGS} SELECT * FROM s"))
def contour_segments(spark, sf):
    return ct.segments(ct.mask_cells(_mosaic_mask(spark, sf), 48, 48)).select("mask_id", "sx", "sy", "ex", "ey")


@query("contour_border", with_sql("mosaic", f"{_CELLS}, k AS (SELECT * FROM (VALUES (0, 0, 8), (1, 0, 4), (1, 1, 2), (0, 1, 1)) k(dx, dy, bit)) SELECT DISTINCT mask_id, i + dx AS x, j + dy AS y FROM c, k WHERE code BETWEEN 1 AND 14 AND (code NOT IN (1, 2, 4, 8, 3, 6, 9, 12) OR (code & bit) > 0) AND i + dx BETWEEN 0 AND 47 AND j + dy BETWEEN 0 AND 47"))
def contour_border(spark, sf):
    return ct.border_pixels(ct.mask_cells(_mosaic_mask(spark, sf), 48, 48), 48, 48)


@query("contours", with_sql("mosaic", f"{_SEGS} SELECT mask_id, count(*) AS n_points, CAST(sum(sx * ey - ex * sy) AS BIGINT) AS area8 FROM s GROUP BY 1"))
def contours(spark, sf):
    found = ct.find_contour(_mosaic_mask(spark, sf), 48, 48)
    p = found.select("mask_id", "points", F.posexplode("points").alias("k", "a"))
    nxt = F.element_at("points", ((C("k") + 1) % F.size("points") + 1).cast("int"))
    cross = C("a.x") * nxt["y"] - nxt["x"] * C("a.y")
    return p.groupBy("mask_id").agg(F.count("*").alias("n_points"), F.round(F.sum(cross * 4)).cast("long").alias("area8"))


_LABEL = """, t AS (SELECT image_id, color, x AS i, y AS j, 8 AS b FROM label_raster UNION ALL SELECT image_id, color, x - 1, y, 4 FROM label_raster UNION ALL SELECT image_id, color, x - 1, y - 1, 2 FROM label_raster UNION ALL SELECT image_id, color, x, y - 1, 1 FROM label_raster),
c0 AS (SELECT image_id, color, i, j, CAST(sum(b) AS INTEGER) AS code FROM t GROUP BY 1, 2, 3, 4),
q AS (SELECT image_id, i, j, count(*) + CASE WHEN i IN (-1, 47) OR j IN (-1, 47) THEN 1 ELSE 0 END + CASE WHEN i IN (-1, 47) AND j IN (-1, 47) THEN 1 ELSE 0 END AS areas, arg_min(code, color) FILTER (code IN (5, 10)) AS state FROM c0 GROUP BY 1, 2, 3),
c AS (SELECT c0.*, areas > 2 AS sq, state FROM c0 JOIN q USING (image_id, i, j))"""
_LABEL_SEGS = f"{_LABEL}, s AS (SELECT image_id, color, 2 * i + ax AS sx, 2 * j + ay AS sy, 2 * i + bx AS ex, 2 * j + by_ AS ey FROM c JOIN {_segment_values()} ON k.code = c.code AND k.sq = CAST(c.sq AS INTEGER) AND (k.state = -1 OR k.state = c.state))"


@query("contours_colors", with_sql("label_raster", f"{_LABEL_SEGS} SELECT image_id, color, count(*) AS n, CAST(sum(sx * ey - ex * sy) AS BIGINT) AS area8 FROM s GROUP BY 1, 2"))
def contours_colors(spark, sf):
    segs = ct.segments(ct.label_cells(src.label_raster(spark, sf), 48, 48))
    return ct.ring_measures(segs, ["image_id", "color"])


def _walk_sql(segs: str, keys: str) -> str:
    """Vertices v (keys, ring, seq, x, y, stone) of all rings: a walk from every vertex goes on while no smaller one comes, so only a ring's least vertex gets round."""
    k, on = keys.split(", "), " AND ".join(f"g.{c} = w.{c}" for c in keys.split(", "))
    w = ", ".join(f"w.{c}" for c in k)
    vertex = lambda c: f"(({c}x + 10) * 100000 + {c}y + 10)"
    return f""", g AS (SELECT {keys}, {vertex('s')} AS s, {vertex('e')} AS e, sx, sy, sx % 2 <> 0 AND sy % 2 <> 0 AS stone FROM ({segs})),
w AS (SELECT {keys}, s AS ring, CAST(0 AS BIGINT) AS seq, s, e, sx AS x, sy AS y, stone FROM g
  UNION ALL SELECT {w}, w.ring, w.seq + 1, g.s, g.e, g.sx, g.sy, g.stone FROM w JOIN g ON {on} AND g.s = w.e AND w.e > w.ring),
c1 AS (SELECT {keys}, ring, seq + 1 AS n FROM w WHERE e = ring),
ids AS (SELECT {keys}, ring, n, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY ring) AS INTEGER) - 1 AS ring_id FROM c1),
v AS (SELECT {keys}, ring_id, n, seq, x, y, stone FROM w JOIN ids USING ({keys}, ring))"""


def _with_recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("contour_rings", _with_recursive(with_sql("mosaic", f"{_SEGS}{_walk_sql('SELECT * FROM s', 'mask_id')} SELECT mask_id, ring_id, n, seq, x, y FROM v")))
def contour_rings(spark, sf):
    segs = ct.segments(ct.mask_cells(_mosaic_mask(spark, sf), 48, 48))
    return rings.numbered(rings.link(segs, ["mask_id"]), ["mask_id"]).select("mask_id", "ring_id", "n", "seq", "x", "y")


@query("contours_simple", _with_recursive(with_sql("mosaic", f"""{_SEGS}{_walk_sql('SELECT * FROM s', 'mask_id')}, bent AS (SELECT b.*, (b.x - a.x) * (c.y - b.y) - (b.y - a.y) * (c.x - b.x) <> 0 AS turn FROM v b JOIN v a ON a.mask_id = b.mask_id AND a.ring_id = b.ring_id AND a.seq = (b.seq + b.n - 1) % b.n JOIN v c ON c.mask_id = b.mask_id AND c.ring_id = b.ring_id AND c.seq = (b.seq + 1) % b.n)
SELECT mask_id, ring_id, seq, x, y FROM bent WHERE turn""")))
def contours_simple(spark, sf):
    segs = ct.segments(ct.mask_cells(_mosaic_mask(spark, sf), 48, 48))
    linked = settled(rings.link(segs, ["mask_id"]))
    kept = rings.straightened(linked, ["mask_id"])
    return kept.join(rings.ring_ids(linked, ["mask_id"]), ["mask_id", "ring"]).select("mask_id", "ring_id", "seq", "x", "y")


_RK = "image_id, color, ring_id"
_RDP = f"""{_walk_sql('SELECT * FROM s', 'image_id, color')},
i1 AS (SELECT {_RK}, n, coalesce(min(seq) FILTER (stone), 0) AS start, count(*) FILTER (stone) AS stones FROM v GROUP BY {_RK}, n),
i2 AS (SELECT i1.*, (b.x - a.x) * (c.y - b.y) - (b.y - a.y) * (c.x - b.x) < 0 AS turned FROM i1 JOIN v a USING ({_RK}) JOIN v b USING ({_RK}) JOIN v c USING ({_RK}) WHERE a.seq = (start + i1.n - 1) % i1.n AND b.seq = start AND c.seq = (start + 1) % i1.n),
at_p AS (SELECT {_RK}, v.n, seq, x, y, stone, stones, CASE WHEN turned THEN (v.n - (seq + v.n - start) % v.n) % v.n ELSE (seq + v.n - start) % v.n END AS p FROM v JOIN i2 USING ({_RK})),
zz AS (SELECT *, p = 0 OR CASE WHEN stones > 1 THEN stone ELSE p = n // 2 END AS stop FROM at_p WHERE n >= 5),
h0 AS (SELECT {_RK}, n, p AS a, lead(p, 1, n) OVER (PARTITION BY {_RK} ORDER BY p) AS b FROM zz WHERE stop),
h AS (SELECT {_RK}, n, a, b FROM h0
  UNION ALL SELECT {_RK}, n, unnest([a, best.p]) AS a, unnest([best.p, b]) AS b FROM (
    SELECT h.image_id, h.color, h.ring_id, h.n, h.a, h.b, max({{'d': abs((t.x - f.x) * (f.y - z.y) - (f.x - z.x) * (t.y - f.y)) / sqrt(CAST((t.x - f.x) * (t.x - f.x) + (t.y - f.y) * (t.y - f.y) AS DOUBLE)), 'x': -z.x, 'y': -z.y, 'p': z.p}}) AS best
    FROM h JOIN zz f ON f.image_id = h.image_id AND f.color = h.color AND f.ring_id = h.ring_id AND f.p = h.a
    JOIN zz t ON t.image_id = h.image_id AND t.color = h.color AND t.ring_id = h.ring_id AND t.p = h.b % h.n
    JOIN zz z ON z.image_id = h.image_id AND z.color = h.color AND z.ring_id = h.ring_id AND z.p > h.a AND z.p < h.b
    WHERE h.b - h.a >= 4 GROUP BY h.image_id, h.color, h.ring_id, h.n, h.a, h.b) WHERE best.d > 1.8),
held AS (SELECT {_RK}, a AS p FROM h UNION SELECT {_RK}, unnest(generate_series(a, b - 1)) AS p FROM h WHERE b - a < 4)
SELECT {_RK}, seq, x, y FROM at_p WHERE n < 5 UNION ALL SELECT {_RK}, seq, x, y FROM at_p JOIN held USING ({_RK}, p) WHERE n >= 5"""


@query("contours_rdp", _with_recursive(with_sql("label_raster", f"{_LABEL_SEGS}{_RDP}")))
def contours_rdp(spark, sf):
    """Kept vertices (doubled) of the rings of all colours, with their places before simplification."""
    keys = ["image_id", "color"]
    linked = settled(rings.link(ct.segments(ct.label_cells(src.label_raster(spark, sf), 48, 48)), keys))
    kept = rings.simplified(linked, keys)
    return kept.join(rings.ring_ids(linked, keys), [*keys, "ring"]).select(*keys, "ring_id", "seq", "x", "y")


@query("run_widths", with_sql("blocky", ", a AS (SELECT image_id, x, y, v, x - row_number() OVER (PARTITION BY image_id, y, v ORDER BY x) AS g FROM blocky) SELECT image_id, x, y, v, CAST(row_number() OVER (PARTITION BY image_id, y, v, g ORDER BY x) AS INTEGER) AS w FROM a"))
def run_widths(spark, sf):
    return ct.runs(src.blocky(spark, sf))


_WIDE = ", a AS (SELECT image_id, x, y, v, x - row_number() OVER (PARTITION BY image_id, y, v ORDER BY x) AS g FROM blocky), r AS (SELECT image_id, x, y, v, CAST(row_number() OVER (PARTITION BY image_id, y, v, g ORDER BY x) AS INTEGER) AS w FROM a)"


#: The height is the distance to the last row, from here up, that differs from the one above it or is narrower there.
@query("run_heights", with_sql("blocky", f"{_WIDE}, b AS (SELECT r.image_id, r.x, r.y, r.v, r.w, u.v IS NOT NULL AND u.v = r.v AND u.w >= r.w AS goes_on FROM r LEFT JOIN r u ON u.image_id = r.image_id AND u.x = r.x AND u.y = r.y - 1) SELECT b.image_id, b.x, b.y, b.v, b.w, CAST(b.y - max(s.y) + 1 AS INTEGER) AS h FROM b JOIN b s ON s.image_id = b.image_id AND s.x = b.x AND s.y <= b.y AND NOT s.goes_on GROUP BY b.image_id, b.x, b.y, b.v, b.w"))
def run_heights(spark, sf):
    return stacks.stack_sizes(src.blocky(spark, sf))


#: Sums of breaks between neighbours over all pixels up to one tell of each square whether it has a break inside.
_SUMS = """, d AS (SELECT image_id, x, y, v, CASE WHEN lag(v) OVER (PARTITION BY image_id, y ORDER BY x) <> v THEN 1 ELSE 0 END AS bh, CASE WHEN lag(v) OVER (PARTITION BY image_id, x ORDER BY y) <> v THEN 1 ELSE 0 END AS bv FROM blocky),
e AS (SELECT *, sum(bh) OVER (PARTITION BY image_id, y ORDER BY x) AS rh, sum(bv) OVER (PARTITION BY image_id, y ORDER BY x) AS rv FROM d),
p AS (SELECT image_id, x, y, v, CAST(sum(rh) OVER w AS BIGINT) AS ph, CAST(sum(rv) OVER w AS BIGINT) AS pv FROM e WINDOW w AS (PARTITION BY image_id, x ORDER BY y)),
m AS (SELECT *, unnest(generate_series(1, least(x, y) + 1)) AS m FROM p)
SELECT m.image_id, m.x, m.y, m.v, CAST(max(m.m) AS INTEGER) AS side FROM m
LEFT JOIN p a ON a.image_id = m.image_id AND a.x = m.x - m.m + 1 AND a.y = m.y LEFT JOIN p b ON b.image_id = m.image_id AND b.x = m.x AND b.y = m.y - m.m LEFT JOIN p c ON c.image_id = m.image_id AND c.x = m.x - m.m + 1 AND c.y = m.y - m.m
LEFT JOIN p f ON f.image_id = m.image_id AND f.x = m.x - m.m AND f.y = m.y LEFT JOIN p g ON g.image_id = m.image_id AND g.x = m.x AND g.y = m.y - m.m + 1 LEFT JOIN p h ON h.image_id = m.image_id AND h.x = m.x - m.m AND h.y = m.y - m.m + 1
WHERE m.ph - a.ph - coalesce(b.ph, 0) + coalesce(c.ph, 0) = 0 AND m.pv - coalesce(f.pv, 0) - g.pv + coalesce(h.pv, 0) = 0 GROUP BY m.image_id, m.x, m.y, m.v"""


@query("square_sides", with_sql("blocky", _SUMS))
def square_sides(spark, sf):
    return stacks.square_sides(src.blocky(spark, sf))


# ------------------------------------------------------------------ rectangles and packing


def _covered(found):
    area = (C("x1") - C("x0") + 1) * (C("y1") - C("y0") + 1)
    return found.groupBy("image_id", "v").agg(F.sum(area).cast("long").alias("covered"))


@query("find_rectangles", with_sql("blocky", "SELECT image_id, v, count(*) AS covered FROM blocky GROUP BY 1, 2"))
def find_rectangles(spark, sf):
    return _covered(shapes.find_rectangles(src.blocky(spark, sf), apart=True))


@query("find_squares")
def find_squares(spark, sf):
    return shapes.find_squares(src.blocky(spark, sf), C("v") >= 128)


@query("pack_rects", with_sql("rects", "SELECT atlas_id, count(*) AS n, CAST(sum(w * h) AS BIGINT) AS area, 0 AS outside FROM rects GROUP BY 1"))
def pack_rects(spark, sf):
    p = shapes.pack(src.rects(spark, sf))
    out = (C("pack_x") < 0) | (C("pack_y") < 0) | (C("pack_x") + C("w") > C("atlas_w")) | (C("pack_y") + C("h") > C("atlas_h"))
    return p.groupBy("atlas_id").agg(F.count("*").alias("n"), F.sum(C("w") * C("h")).cast("long").alias("area"), F.sum(out.cast("int")).cast("int").alias("outside"))


@query("uv_rects", with_sql("rects", "SELECT rect_id, CAST(floor(w / 2.0) AS BIGINT) AS first, CAST(ceil(w / 2.0 + h / 4.0) - floor(w / 2.0) + 1 AS BIGINT) AS n, CAST(floor(w / 2.0 - 0.5) AS BIGINT) AS pfirst, greatest(w - 10, 0) AS clip_at, CAST(greatest(least(w - 10 + h, 40) - greatest(w - 10, 0), 0) AS INTEGER) AS clip_n FROM rects"))
def uv_rects(spark, sf):
    r = src.rects(spark, sf)
    first, n = geometry.uv_pixels(C("w") / 2.0, C("w") / 2.0 + C("h") / 4.0)
    pfirst, _ = geometry.patch_pixels(C("w") / 2.0, C("w") / 2.0 + C("h") / 4.0)
    at, size, _ = geometry.clip_axis(C("w") - 10, C("h"), F.lit(40), F.lit(0))
    return r.select("rect_id", first.alias("first"), n.alias("n"), pfirst.alias("pfirst"), at.alias("clip_at"), size.alias("clip_n"))


# ------------------------------------------------------------------ filling and quads


def _holes(spark, sf):
    return src.gray8(spark, sf).withColumn("known", (C("x") * 3 + C("y") * 5 + C("image_id")) % 4 != 0)


@query("laplace")
def laplace(spark, sf):
    return solve.laplace_interpolate(_holes(spark, sf))


#: A block with one unknown pixel inside is the mean of its four neighbours, which SQL can tell.
_ONE = with_sql("gray8", """, k AS (SELECT *, NOT (image_id % 3 = 0 OR (image_id % 3 = 1 AND x = 3 AND y = 4)) AS known FROM gray8)
SELECT k.image_id, k.x, k.y, CASE WHEN k.image_id % 3 = 0 THEN 0 WHEN known THEN v ELSE (SELECT floor(sum(n.v) / 4.0 + 0.5) FROM gray8 n WHERE n.image_id = k.image_id AND abs(n.x - 3) + abs(n.y - 4) = 1) END::INTEGER AS v FROM k""")


@query("jpeg_inpaint", _ONE)
def jpeg_inpaint(spark, sf):
    known = ~((C("image_id") % 3 == 0) | ((C("image_id") % 3 == 1) & (C("x") == 3) & (C("y") == 4)))
    return solve.block_inpaint(src.gray8(spark, sf).withColumn("known", known)).withColumn("v", C("v").cast("int"))


@query("quad_contract", with_sql("mask_b", "SELECT mask_id, count(*) AS area FROM mask_b GROUP BY 1"))
def quad_contract(spark, sf):
    q = quadtree.contract(src.mask_b(spark, sf), 8)
    return q.groupBy("mask_id").agg(F.sum(C("size") * C("size")).cast("long").alias("area"))


@query("quad_expand", with_sql("blocky", "SELECT image_id AS mask_id, x, y FROM blocky WHERE v >= 128"))
def quad_expand(spark, sf):
    q = quadtree.contract(masks.from_raster(src.blocky(spark, sf), C("v") >= 128), 64)
    return quadtree.expand(q, 48, 48)


@query("quad_depth", with_sql("blocky", "SELECT image_id AS mask_id, x // 16 AS qx, y // 16 AS qy, CASE WHEN count(*) = 256 THEN 1 ELSE -1 END AS state FROM blocky WHERE v >= 128 GROUP BY 1, 2, 3"))
def quad_depth(spark, sf):
    q = quadtree.contract(masks.from_raster(src.blocky(spark, sf), C("v") >= 128), 64)
    cut = quadtree.at_depth(q, 64, 2).filter("size = 16")
    return cut.select("mask_id", C("qx").cast("int").alias("qx"), C("qy").cast("int").alias("qy"), F.when(C("white"), 1).otherwise(-1).alias("state"))


@query("quad_set", with_sql("mask_a", "SELECT * FROM mask_a WHERE NOT (x BETWEEN 4 AND 7 AND y BETWEEN 0 AND 3) UNION ALL SELECT vec_id, x, y FROM embeddings, (SELECT CAST(unnest(generate_series(4, 7)) AS INTEGER) AS x), (SELECT CAST(unnest(generate_series(0, 3)) AS INTEGER) AS y)"))
def quad_set(spark, sf):
    sizes = spark.read.parquet(f"{sf}/embeddings.parquet").select(C("vec_id").alias("mask_id"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return quadtree.set_quad(src.mask_a(spark, sf), sizes, 8, 1, 1, 0, True)


@query("quad_subtree", with_sql("mask_a", "SELECT mask_id, x - 4 AS x, y - 4 AS y FROM mask_a WHERE x >= 4 AND y >= 4"))
def quad_subtree(spark, sf):
    return quadtree.subtree(src.mask_a(spark, sf), 8, 1, 1, 1)


@query("quad_graft", with_sql("mask_a mask_b", "SELECT * FROM mask_a WHERE NOT (x < 4 AND y >= 4) UNION ALL SELECT mask_id, x, y + 4 FROM mask_b WHERE x < 4 AND y < 4"))
def quad_graft(spark, sf):
    return quadtree.graft(src.mask_a(spark, sf), src.mask_b(spark, sf), 8, 1, 0, 1, 8, 8)


# ------------------------------------------------------------------ SVG


@query("svg_polygons", with_sql("triangles", """SELECT tri_id, concat('<polygon points="', CAST(ax AS INTEGER), ',', CAST(ay AS INTEGER), ' ', CAST(bx AS INTEGER), ',', CAST("by" AS INTEGER), ' ', CAST(cx AS INTEGER), ',', CAST(cy AS INTEGER), ' " style="fill:none;stroke:rgb(255,', image_id, ',0);stroke-width:1" vector-effect="non-scaling-stroke" />', chr(10)) AS svg FROM triangles"""))
def svg_polygons(spark, sf):
    ring = F.array(*[F.struct(C(f"{p}x").alias("x"), C(f"{p}y").alias("y")) for p in "abc"])
    return src.triangles(spark, sf).select("tri_id", svg.polygon(ring, svg.color(F.lit(255), C("image_id"), F.lit(0))).alias("svg"))
