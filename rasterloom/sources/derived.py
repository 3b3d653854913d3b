"""Rasters derived from plain tables, for queries without image files.

Pixels are rows (image_id, x, y, v): x to the right, y down, no row where a pixel is invalid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    return e.select("vec_id", "label", (F.col("i") % 8).alias("x"), F.expr("cast(i div 8 as int)").alias("y"), F.col("e").cast("double").alias("e"))


def _gray(e):
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e + 0.6) * 212.5))).cast("int")


def gray8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 8x8 images of 8 bits, one for each vector."""
    return _cells(spark, sf_dir).select(F.col("vec_id").alias("image_id"), "x", "y", _gray(F.col("e")).alias("v"))


def u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 8x8 images of 16 bits."""
    v = F.greatest(F.lit(0), F.least(F.lit(65535), F.floor((F.col("e") + 0.6) * 54612.0))).cast("int")
    return _cells(spark, sf_dir).select(F.col("vec_id").alias("image_id"), "x", "y", v.alias("v"))


def rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 8x8 colour images: three vectors each, in one aggregation by pixel."""
    g = gray8(spark, sf_dir).withColumn("k", F.col("image_id") % 3)
    band = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    out = g.groupBy(F.expr("image_id div 3").alias("image_id"), "x", "y").agg(band(0).alias("r"), band(1).alias("g"), band(2).alias("b"))
    return out.dropna()


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 48x48 images of 36 vectors each, all vectors in order of their ids; cells without a vector are 0."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    tiles = e.groupBy(F.expr("vec_id div 36").alias("image_id")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("vec_id") % 36).alias("k"), "embedding"))).alias("tiles"))
    cells = tiles.select("image_id", "tiles", F.explode(F.sequence(F.lit(0), F.lit(35))).alias("k"))
    blank = F.array_repeat(F.lit(None).cast("float"), 64)
    e = cells.select("image_id", "k", F.posexplode(F.coalesce(F.try_element_at("tiles", F.col("k").cast("long")), blank)).alias("i", "e"))
    x = (F.col("k") % 6 * 8 + F.col("i") % 8).cast("int")
    y = F.expr("cast((k div 6) * 8 + i div 8 as int)")
    return e.select("image_id", x.alias("x"), y.alias("y"), F.when(F.col("e").isNull(), 0).otherwise(_gray(F.col("e").cast("double"))).alias("v"))


def blocky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaic in flat 4x4 blocks, each as its upper left pixel: broadcast by arithmetic, not by a join."""
    corner = mosaic(spark, sf_dir).filter("x % 4 = 0 and y % 4 = 0")
    spread = corner.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return spread.select("image_id", (F.col("x") + F.col("d") % 4).alias("x"), F.expr("cast(y + d div 4 as int)").alias("y"), "v")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaics cut to twelve sizes, see mixed_sizes."""
    return mosaic(spark, sf_dir).filter("x < 48 - 8 * (image_id % 3) and y < 48 - 5 * (image_id % 4)")


def mixed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height) of the mixed images."""
    ids = _table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 36").alias("image_id")).distinct()
    return ids.select("image_id", F.expr("cast(48 - 8 * (image_id % 3) as int)").alias("width"), F.expr("cast(48 - 5 * (image_id % 4) as int)").alias("height"))


def label_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaic in four colours."""
    color = F.greatest(F.lit(0), F.least(F.lit(3), F.expr("(v - 96) div 16"))).cast("int")
    return mosaic(spark, sf_dir).select("image_id", "x", "y", color.alias("color"))


def sparse(spark: SparkSession, sf_dir: str, side: int = 64) -> DataFrame:
    """Seven sparse images of side x side, values from sums of quantities."""
    line = _table(spark, sf_dir, "lineitem").select("l_linenumber", "l_partkey", "l_orderkey", "l_quantity")
    out = line.groupBy(F.col("l_linenumber").cast("long").alias("image_id"), (F.col("l_partkey") % side).cast("int").alias("x"), (F.col("l_orderkey") % side).cast("int").alias("y"))
    return out.agg((F.sum("l_quantity").cast("long") % 256).alias("v"))


def mask_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray8(spark, sf_dir).filter("v >= 128").select(F.col("image_id").alias("mask_id"), "x", "y")


def mask_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray8(spark, sf_dir).filter("(x + y + v) % 3 <> 0").select(F.col("image_id").alias("mask_id"), "x", "y")


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small triangles (ax..cz), one for each line item; some have no area."""
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    s = (F.lit(1) + F.col("l_quantity").cast("int") % 12).cast("double")
    ax, ay, n = (F.col("l_partkey") % 64).cast("double"), (F.col("l_orderkey") % 64).cast("double"), F.col("l_linenumber").cast("double")
    return line.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tri_id"), (F.col("l_suppkey") % 8).alias("image_id"),
        ax.alias("ax"), ay.alias("ay"), F.col("l_quantity").alias("az"),
        (ax + s).alias("bx"), (ay + n).alias("by"), n.alias("bz"),
        (ax + n).alias("cx"), (ay + s).alias("cy"), (F.col("l_suppkey") % 16).cast("double").alias("cz"),
    )


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return p.select((F.col("p_partkey") % 16).alias("atlas_id"), F.col("p_partkey").alias("rect_id"), F.col("p_size").alias("w"), (F.lit(1) + F.col("p_partkey") % 37).cast("int").alias("h"))


def georefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    x, y = F.col("c_custkey") % 360 - 180, F.col("c_nationkey").cast("long")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return c.select(F.col("c_custkey").alias("id"), point(x, y).alias("ul"), point(x + 7, y - 1).alias("ur"), point(x + 6, y - 9).alias("lr"), point(x - 2, y - 8).alias("ll"))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return p.select(F.col("p_partkey").alias("id"), F.format_string("%dx%d+%d-%d", F.col("p_size"), F.col("p_partkey") % 97 + 1, F.col("p_partkey"), F.col("p_size")).alias("crop"))


# The same as DuckDB SQL, as common table expressions.
_V = "CAST(greatest(0, least(255, floor((CAST(embedding[i] AS DOUBLE) + 0.6) * 212.5))) AS INTEGER)"
SQL = {
    "gray8": f"SELECT vec_id AS image_id, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y, {_V} AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings)",
    "u16": "SELECT vec_id AS image_id, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y, CAST(greatest(0, least(65535, floor((CAST(embedding[i] AS DOUBLE) + 0.6) * 54612.0))) AS INTEGER) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings)",
    "rgb8": "SELECT a.image_id // 3 AS image_id, a.x, a.y, a.v AS r, b.v AS g, c.v AS b FROM gray8 a JOIN gray8 b ON b.image_id = a.image_id + 1 AND b.x = a.x AND b.y = a.y JOIN gray8 c ON c.image_id = a.image_id + 2 AND c.x = a.x AND c.y = a.y WHERE a.image_id % 3 = 0",
    "mosaic": f"SELECT c.image_id, CAST(8 * (c.k % 6) + (i - 1) % 8 AS INTEGER) AS x, CAST(8 * (c.k // 6) + (i - 1) // 8 AS INTEGER) AS y, CASE WHEN vec_id IS NULL THEN 0 ELSE {_V} END AS v FROM (SELECT image_id, k, unnest(generate_series(1, 64)) AS i FROM (SELECT image_id, unnest(generate_series(0, 35)) AS k FROM (SELECT DISTINCT vec_id // 36 AS image_id FROM embeddings))) c LEFT JOIN embeddings ON vec_id = 36 * c.image_id + c.k",
    "blocky": "SELECT m.image_id, m.x, m.y, c.v FROM mosaic m JOIN mosaic c ON c.image_id = m.image_id AND c.x = m.x - m.x % 4 AND c.y = m.y - m.y % 4",
    "mixed": "SELECT image_id, x, y, v FROM mosaic WHERE x < 48 - 8 * (image_id % 3) AND y < 48 - 5 * (image_id % 4)",
    "mixed_sizes": "SELECT DISTINCT vec_id // 36 AS image_id, CAST(48 - 8 * (vec_id // 36 % 3) AS INTEGER) AS width, CAST(48 - 5 * (vec_id // 36 % 4) AS INTEGER) AS height FROM embeddings",
    "label_raster": "SELECT image_id, x, y, CAST(greatest(0, least(3, (v - 96) // 16)) AS INTEGER) AS color FROM mosaic",
    "sparse": "SELECT CAST(l_linenumber AS BIGINT) AS image_id, CAST(l_partkey % 64 AS INTEGER) AS x, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(sum(l_quantity) AS BIGINT) % 256 AS v FROM lineitem GROUP BY 1, 2, 3",
    "mask_a": "SELECT image_id AS mask_id, x, y FROM gray8 WHERE v >= 128",
    "mask_b": "SELECT image_id AS mask_id, x, y FROM gray8 WHERE (x + y + v) % 3 <> 0",
    "triangles": "SELECT l_orderkey * 8 + l_linenumber AS tri_id, l_suppkey % 8 AS image_id, CAST(l_partkey % 64 AS DOUBLE) AS ax, CAST(l_orderkey % 64 AS DOUBLE) AS ay, l_quantity AS az, ax + s AS bx, ay + l_linenumber AS \"by\", CAST(l_linenumber AS DOUBLE) AS bz, ax + l_linenumber AS cx, ay + s AS cy, CAST(l_suppkey % 16 AS DOUBLE) AS cz FROM (SELECT *, CAST(1 + CAST(l_quantity AS INTEGER) % 12 AS DOUBLE) AS s FROM lineitem)",
    "rects": "SELECT p_partkey % 16 AS atlas_id, p_partkey AS rect_id, p_size AS w, CAST(1 + p_partkey % 37 AS INTEGER) AS h FROM part",
    "georefs": "SELECT c_custkey AS id, {'x': c_custkey % 360 - 180, 'y': CAST(c_nationkey AS BIGINT)} AS ul, {'x': c_custkey % 360 - 173, 'y': CAST(c_nationkey - 1 AS BIGINT)} AS ur, {'x': c_custkey % 360 - 174, 'y': CAST(c_nationkey - 9 AS BIGINT)} AS lr, {'x': c_custkey % 360 - 182, 'y': CAST(c_nationkey - 8 AS BIGINT)} AS ll FROM customer",
    "crops": "SELECT p_partkey AS id, concat(p_size, 'x', p_partkey % 97 + 1, '+', p_partkey, '-', p_size) AS crop FROM part",
}
#: What a common table expression reads.
NEEDS = {"rgb8": ["gray8"], "blocky": ["mosaic"], "label_raster": ["mosaic"], "mixed": ["mosaic"], "mask_a": ["gray8"], "mask_b": ["gray8"]}


def with_sql(names: str, body: str) -> str:
    """WITH clause of the named fixtures and what they need, before `body`; a body that begins with a comma adds its own."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    head = "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"{head}{body}" if body.lstrip().startswith(",") else f"{head} {body}"
