"""Linear quadtrees: leaves of masks over the derived rasters, against the same sets of pixels contracted in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linear as ln
from ..operators import masks, quadtree
from ..sources import derived as src
from ..sources.derived import with_sql
from .registry import query

C = F.col
SIDE, TOP = 64, 6

#: Two masks over images of twelve sizes, in flat blocks of four pixels and of single ones, so leaves of all sizes meet.
_A = "(v >= 128 or (x div 8 + y div 8 + image_id) % 3 = 0)"
_B = "((x div 16 + y div 4) % 2 = 0 or v % 5 = 0)"
_PIXELS = ", a AS (SELECT image_id AS mask_id, x, y FROM mixed WHERE v >= 128 OR (x // 8 + y // 8 + image_id) % 3 = 0), b AS (SELECT image_id AS mask_id, x, y FROM mixed WHERE (x // 16 + y // 4) % 2 = 0 OR v % 5 = 0)"
#: The fewest quads of pixels m.
_CONTRACT = f""", n AS (SELECT mask_id, l, x >> l AS qx, y >> l AS qy FROM m, (SELECT CAST(unnest(generate_series(0, {TOP})) AS INTEGER) AS l) GROUP BY 1, 2, 3, 4 HAVING count(*) = 1 << (2 * l))
SELECT mask_id, CAST(1 << l AS BIGINT) AS size, CAST(qx AS BIGINT) AS qx, CAST(qy AS BIGINT) AS qy FROM n WHERE NOT EXISTS (SELECT 1 FROM n u WHERE u.mask_id = n.mask_id AND u.l = n.l + 1 AND u.qx = n.qx >> 1 AND u.qy = n.qy >> 1)"""


def _sql(m: str) -> str:
    return with_sql("mixed mixed_sizes", f"{_PIXELS}, m AS ({m}){_CONTRACT}")


def _leaves(spark, sf, where):
    mask = masks.from_raster(src.mixed(spark, sf), F.expr(where))
    return ln.leaves(quadtree.contract(mask, SIDE))


def _sizes(spark, sf):
    return src.mixed_sizes(spark, sf).withColumnRenamed("image_id", "mask_id")


def _out(rows):
    return ln.quads(rows).select("mask_id", "size", "qx", "qy")


@query("leaf_union", _sql("SELECT * FROM a UNION SELECT * FROM b"))
def leaf_union(spark, sf):
    return _out(ln.union(_leaves(spark, sf, _A), _leaves(spark, sf, _B), TOP))


@query("leaf_intersect", _sql("SELECT * FROM a INTERSECT SELECT * FROM b"))
def leaf_intersect(spark, sf):
    return _out(ln.intersect(_leaves(spark, sf, _A), _leaves(spark, sf, _B), TOP))


@query("leaf_subtract", _sql("SELECT * FROM a EXCEPT SELECT * FROM b"))
def leaf_subtract(spark, sf):
    return _out(ln.subtract(_leaves(spark, sf, _A), _leaves(spark, sf, _B), TOP))


@query("leaf_invert", _sql("SELECT image_id AS mask_id, x, y FROM mixed EXCEPT SELECT * FROM a"))
def leaf_invert(spark, sf):
    return _out(ln.invert(_leaves(spark, sf, _A), _sizes(spark, sf), TOP))


@query("leaf_full", _sql("SELECT image_id AS mask_id, x, y FROM mixed"))
def leaf_full(spark, sf):
    return _out(ln.rectangles(_sizes(spark, sf)))


@query("leaf_area", with_sql("mixed", f"{_PIXELS} SELECT mask_id, count(*) AS count FROM a GROUP BY 1"))
def leaf_area(spark, sf):
    return ln.area(_leaves(spark, sf, _A))


@query("leaf_get", with_sql("mixed", f"{_PIXELS}, p AS (SELECT vec_id, vec_id // 36 AS mask_id, CAST(vec_id * 7 % 53 - 2 AS INTEGER) AS x, CAST(vec_id * 5 % 51 - 1 AS INTEGER) AS y FROM embeddings) SELECT vec_id, mask_id, x, y, EXISTS (SELECT 1 FROM a WHERE a.mask_id = p.mask_id AND a.x = p.x AND a.y = p.y) AS value FROM p"))
def leaf_get(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    p = e.selectExpr("vec_id", "vec_id div 36 as mask_id", "cast(vec_id * 7 % 53 - 2 as int) as x", "cast(vec_id * 5 % 51 - 1 as int) as y")
    return ln.get(p, _leaves(spark, sf, _A), TOP)


#: A quad of each mask by its id: level 2 to 4, near the far edges in some.
_PLACES = "SELECT image_id AS mask_id, CAST(2 + image_id % 3 AS INTEGER) AS level, CAST((9 + image_id % 3) >> (image_id % 3) AS BIGINT) AS qx, CAST((5 + image_id % 7) >> (image_id % 3) AS BIGINT) AS qy FROM mixed_sizes"


def _places(spark, sf):
    return _sizes(spark, sf).selectExpr("mask_id", "cast(2 + mask_id % 3 as int) as level", "shiftright(9 + mask_id % 3, cast(mask_id % 3 as int)) as qx", "shiftright(5 + mask_id % 7, cast(mask_id % 3 as int)) as qy")


_IN = "x >> level = qx AND y >> level = qy"
_EDIT = f"{_PIXELS}, t AS ({_PLACES}), place AS (SELECT g.image_id AS mask_id, x, y, t.level, t.qx, t.qy, {_IN} AS inside, t.mask_id % 4 <> 1 AS value FROM mixed g JOIN t ON t.mask_id = g.image_id)"


def _edit_sql(m: str) -> str:
    return with_sql("mixed mixed_sizes", f"{_EDIT}, m AS ({m}){_CONTRACT}")


@query("leaf_set", _edit_sql("SELECT mask_id, x, y FROM place WHERE inside AND value UNION SELECT a.* FROM a JOIN place USING (mask_id, x, y) WHERE NOT inside"))
def leaf_set(spark, sf):
    places = _places(spark, sf).withColumn("value", C("mask_id") % 4 != 1)
    return _out(ln.set_quads(_leaves(spark, sf, _A), places, _sizes(spark, sf), TOP))


@query("leaf_graft", _edit_sql("SELECT a.* FROM a JOIN place USING (mask_id, x, y) WHERE NOT inside UNION SELECT place.mask_id, place.x, place.y FROM place JOIN b ON b.mask_id = place.mask_id AND b.x = place.x - (qx << level) AND b.y = place.y - (qy << level) WHERE inside"))
def leaf_graft(spark, sf):
    return _out(ln.graft(_leaves(spark, sf, _A), _leaves(spark, sf, _B), _places(spark, sf), _sizes(spark, sf), TOP))


@query("leaf_subtree", _edit_sql("SELECT a.mask_id, CAST(a.x - (qx << level) AS INTEGER) AS x, CAST(a.y - (qy << level) AS INTEGER) AS y FROM a JOIN place USING (mask_id, x, y) WHERE inside"))
def leaf_subtree(spark, sf):
    return _out(ln.subtree(_leaves(spark, sf, _A), _places(spark, sf)))


@query("leaf_find", with_sql("mixed mixed_sizes", f"{_PIXELS}, m AS (SELECT * FROM a), t AS ({_PLACES}), q AS (SELECT * FROM ({_CONTRACT.replace(', n AS', 'WITH n AS', 1)})) SELECT q.mask_id, size, q.qx, q.qy FROM q JOIN t USING (mask_id) WHERE q.qx * size < (t.qx + 1) << level AND (q.qx + 1) * size > t.qx << level AND q.qy * size < (t.qy + 1) << level AND (q.qy + 1) * size > t.qy << level"))
def leaf_find(spark, sf):
    return _out(ln.find(_leaves(spark, sf, _A), _places(spark, sf)))


@query("leaf_coarsen", _sql("SELECT DISTINCT mask_id, (x >> 2 << 2) + i AS x, (y >> 2 << 2) + j AS y FROM a, (SELECT CAST(unnest(generate_series(0, 3)) AS INTEGER) AS i), (SELECT CAST(unnest(generate_series(0, 3)) AS INTEGER) AS j)"))
def leaf_coarsen(spark, sf):
    return _out(ln.coarsen(_leaves(spark, sf, _A), 2, TOP))
