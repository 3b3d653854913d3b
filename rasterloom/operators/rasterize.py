"""Triangles and lines to pixels, and depth buffers, in closed form: spans by explode, no loop over pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = ("a", "b", "c")


def _sorted(tri: DataFrame) -> DataFrame:
    """Vertices by y as p0, p1, p2 (structs y, k, x, z); of equal y the earlier first."""
    points = [F.struct(F.col(f"{p}y").alias("y"), F.lit(k).alias("k"), F.col(f"{p}x").alias("x"), F.col(f"{p}z").alias("z")) for k, p in enumerate(POINTS)]
    keep = [c for c in tri.columns if c not in {f"{p}{a}" for p in POINTS for a in "xyz"}]
    s = tri.select(*keep, F.array_sort(F.array(*points)).alias("p"))
    return s.select(*keep, *[F.col("p")[k].alias(f"p{k}") for k in range(3)])


def scanlines(tri: DataFrame, ymin: int, ymax: int) -> DataFrame:
    """Spans (y, x1, x2, z1, z2) of triangles (ax..cz), x1 <= x2: rows from ceil(top) to below bottom, within [ymin, ymax).

    Points without z (no such columns) lie at 0. Other columns are kept.
    """
    for p in POINTS:
        if f"{p}z" not in tri.columns:
            tri = tri.withColumn(f"{p}z", F.lit(0.0))
    s = _sorted(tri)
    keep = [c for c in s.columns if c not in ("p0", "p1", "p2")]
    top, mid, bot = F.col("p0"), F.col("p1"), F.col("p2")
    first = F.greatest(F.ceil(top["y"]), F.lit(ymin)).cast("int")
    last = F.least(F.ceil(bot["y"]), F.lit(ymax)).cast("int") - 1
    # no filter: pushed down, it would draw the sorting of vertices into the scan
    rows = s.withColumn("y", F.explode(F.when(last >= first, F.sequence(first, last))))
    y = F.col("y").cast("double")

    def edge(p: Column, q: Column, axis: str) -> Column:
        return p[axis] + (q[axis] - p[axis]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) * (y - p["y"])

    upper = y < mid["y"]
    ends = {}
    for a in ("x", "z"):
        ends[a] = (F.when(upper, edge(top, mid, a)).otherwise(edge(mid, bot, a)), edge(top, bot, a))
    # explode of one element computes the ends once; plain projections would be folded into each other, one edge many times
    once = F.explode(F.array(F.struct(ends["x"][0].alias("xa"), ends["x"][1].alias("xb"), ends["z"][0].alias("za"), ends["z"][1].alias("zb"))))
    spans = rows.select(*keep, "y", once.alias("e"))
    swap = F.col("e.xa") >= F.col("e.xb")
    pick = lambda p, q: F.when(swap, F.col(f"e.{q}")).otherwise(F.col(f"e.{p}"))
    return spans.select(*keep, "y", pick("xa", "xb").alias("x1"), pick("xb", "xa").alias("x2"), pick("za", "zb").alias("z1"), pick("zb", "za").alias("z2"))


def span_pixels(spans: DataFrame, xmin: int, xmax: int) -> DataFrame:
    """Pixels (x, y, z) of spans: x from ceil(x1) to below x2, within [xmin, xmax), z linear."""
    first = F.greatest(F.ceil("x1"), F.lit(xmin)).cast("int")
    last = F.least(F.ceil("x2"), F.lit(xmax)).cast("int") - 1
    rows = spans.withColumn("x", F.explode(F.when(last >= first, F.sequence(first, last))))
    z = F.col("z1") + (F.col("z2") - F.col("z1")) / (F.col("x2") - F.col("x1")) * (F.col("x") - F.col("x1"))
    keep = [c for c in spans.columns if c not in ("x1", "x2", "z1", "z2", "y")]
    return rows.select(*keep, "x", "y", z.alias("z"))


def rasterize(tri: DataFrame, extents: tuple[int, int, int, int]) -> DataFrame:
    """All pixels of triangles inside [x0, x1) x [y0, y1)."""
    x0, y0, x1, y1 = extents
    return span_pixels(scanlines(tri, y0, y1), x0, x1)


def rasterize_faces(faces: DataFrame, vertices: DataFrame, extents: tuple[int, int, int, int]) -> DataFrame:
    """Triangles by vertex index: faces (face_id, i, j, k, ...), vertices (vertex, x, y, z); three equi joins."""
    out = faces
    for p, c in zip(POINTS, "ijk", strict=True):
        out = out.join(vertices.select(F.col("vertex").alias(c), *[F.col(a).alias(f"{p}{a}") for a in "xyz"]), c)
    return rasterize(out.drop("i", "j", "k"), extents)


def zbuffer(fragments: DataFrame, greater: bool = True, initial: DataFrame | None = None) -> DataFrame:
    """(image_id, x, y, z): the greatest (or least) depth of each pixel; an initial buffer stays where it is not exceeded.

    One aggregation with map-side combination; pixels outside the initial buffer are dropped.
    """
    f, g = (F.max, F.greatest) if greater else (F.min, F.least)
    best = fragments.groupBy("image_id", "x", "y").agg(f("z").alias("z"))
    if initial is None:
        return best
    both = initial.withColumnRenamed("z", "z0").join(best, ["image_id", "x", "y"], "left")
    return both.select("image_id", "x", "y", g("z0", "z").alias("z"))


def dda(lines: DataFrame) -> DataFrame:
    """Pixels (step, x, y, p) of lines (x1, y1, x2, y2): as many steps as the longer side has whole pixels, p along the line.

    The walk begins at the truncated first point and moves by the direction over its longer side; coordinates round half
    away from zero.
    """
    keep = [c for c in lines.columns if c not in ("x1", "y1", "x2", "y2")]
    i = lambda c: F.col(c).cast("int")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    steps = F.greatest(F.abs(i("x2") - i("x1")), F.abs(i("y2") - i("y1")))
    longest = F.nullif(F.greatest(F.abs(dx), F.abs(dy)), F.lit(0.0))
    length = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    ox, oy = F.col("x1") - i("x1"), F.col("y1") - i("y1")
    rows = lines.select("*", F.explode(F.sequence(F.lit(0), steps)).alias("step"))
    ux, uy = dx / longest, dy / longest
    p = F.sqrt(ox * ox + oy * oy) / length + F.col("step") * F.sqrt(ux * ux + uy * uy) / length
    at = lambda c, u: F.round(i(c) + F.col("step") * F.coalesce(u, F.lit(0.0))).cast("int")
    return rows.select(*keep, "step", at("x1", ux).alias("x"), at("y1", uy).alias("y"), p.alias("p"))


def fill_rectangle(px: DataFrame, x0: int, y0: int, x1: int, y1: int, value) -> DataFrame:
    """A solid value in the closed rectangle, as far as it lies in the image."""
    return px.withColumn("v", F.when(F.col("x").between(x0, x1) & F.col("y").between(y0, y1), F.lit(value)).otherwise(F.col("v")))
