"""Masks as quads: leaves (mask_id, size, qx, qy), all white; qx, qy count quads of their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def side_of(width: int, height: int) -> int:
    """Side of the square that a mask's tree spans: the next power of two."""
    return 1 << max(0, (max(width, height, 1) - 1).bit_length())


def contract(mask: DataFrame, side: int) -> DataFrame:
    """Fewest quads of set pixels: a quad is a leaf if all of it is set and not all of the quad that holds it.

    Each pixel counts for its quads of all log2(side) + 1 sizes in one aggregation with map-side sums, whatever the side.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(max(0, side.bit_length() - 1))))
    at = mask.select("mask_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), level.alias("level"))
    up = lambda c, n: F.expr(f"shiftright({c}, {n})")
    counts = at.groupBy("mask_id", "level", up("x", "level").alias("qx"), up("y", "level").alias("qy")).agg(F.count("*").alias("n"))
    full = counts.filter("n = shiftleft(1L, 2 * level)").select("mask_id", "level", "qx", "qy")
    held = full.select("mask_id", (F.col("level") - 1).alias("level"), F.col("qx").alias("px"), F.col("qy").alias("py"))
    own = full.withColumn("px", up("qx", 1)).withColumn("py", up("qy", 1))
    return own.join(held, ["mask_id", "level", "px", "py"], "left_anti").select("mask_id", F.expr("shiftleft(1, level)").alias("size"), "qx", "qy")


def expand(quads: DataFrame, width: int, height: int) -> DataFrame:
    """Set pixels of quads, clipped to the image."""
    span = lambda q, most: F.sequence(F.col(q) * F.col("size"), F.least(F.col(q) * F.col("size") + F.col("size"), F.lit(most)) - 1)
    inside = quads.filter((F.col("qx") * F.col("size") < width) & (F.col("qy") * F.col("size") < height))
    x = inside.select("*", F.explode(span("qx", width)).alias("x"))
    out = x.select("mask_id", "x", F.explode(span("qy", height)).alias("y"))
    return out.select("mask_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def clipped(quads: DataFrame, width: int, height: int) -> DataFrame:
    """Quads as rectangles (mask_id, x, y, size_x, size_y) clipped to the image."""
    x, y = F.col("qx") * F.col("size"), F.col("qy") * F.col("size")
    out = quads.select("mask_id", x.alias("x"), y.alias("y"), F.least(F.col("size"), F.lit(width) - x).alias("size_x"), F.least(F.col("size"), F.lit(height) - y).alias("size_y"))
    return out.filter("size_x > 0 and size_y > 0")


def at_depth(quads: DataFrame, side: int, depth: int) -> DataFrame:
    """(mask_id, size, qx, qy, white): the tree cut at a depth; white is null where a quad there is mixed."""
    least = side >> depth
    large = quads.filter(F.col("size") >= least).withColumn("white", F.lit(True))
    up = lambda q: F.expr(f"({q} * size) div {least}").alias(q)
    mixed = quads.filter(F.col("size") < least).select("mask_id", F.lit(least).alias("size"), up("qx"), up("qy")).distinct().withColumn("white", F.lit(None).cast("boolean"))
    return large.unionByName(mixed)


def overlapping(quads: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Quads that meet the closed extents: a range filter that reaches the scan."""
    x, y = F.col("qx") * F.col("size"), F.col("qy") * F.col("size")
    return quads.filter((x <= x1) & (y <= y1) & (x + F.col("size") > x0) & (y + F.col("size") > y0))


def _within(size: int, qx: int, qy: int) -> Column:
    return F.col("x").between(qx * size, qx * size + size - 1) & F.col("y").between(qy * size, qy * size + size - 1)


def set_quad(mask: DataFrame, sizes: DataFrame, side: int, depth: int, qx: int, qy: int, value: bool) -> DataFrame:
    """Pixels (mask_id, x, y) with a whole quad set or cleared, clipped to each mask's size (mask_id, width, height)."""
    size = side >> depth
    kept = mask.select("mask_id", "x", "y").filter(~_within(size, qx, qy))
    if not value:
        return kept
    span = lambda q, c: F.sequence(F.lit(q * size), F.least(F.lit(q * size + size), F.col(c)) - 1)
    new = sizes.filter((F.col("width") > qx * size) & (F.col("height") > qy * size)).select("mask_id", F.explode(span(qx, "width")).alias("x"), span(qy, "height").alias("ys"))
    return kept.unionByName(new.select("mask_id", "x", F.explode("ys").alias("y")))


def subtree(mask: DataFrame, side: int, depth: int, qx: int, qy: int) -> DataFrame:
    """The pixels of a quad as masks of their own."""
    size = side >> depth
    part = mask.filter(_within(size, qx, qy))
    return part.select("mask_id", (F.col("x") - qx * size).alias("x"), (F.col("y") - qy * size).alias("y"))


def graft(mask: DataFrame, other: DataFrame, side: int, depth: int, qx: int, qy: int, width: int, height: int) -> DataFrame:
    """A quad replaced by other masks of the same ids; nothing happens where the quad lies outside or is below the pixel."""
    size = side >> depth
    if size < 1 or qx * size >= width or qy * size >= height or qx < 0 or qy < 0:
        return mask.select("mask_id", "x", "y")
    moved = other.filter((F.col("x") < size) & (F.col("y") < size)).select("mask_id", (F.col("x") + qx * size).alias("x"), (F.col("y") + qy * size).alias("y"))
    return mask.select("mask_id", "x", "y").filter(~_within(size, qx, qy)).unionByName(moved.filter((F.col("x") < width) & (F.col("y") < height)))


def find_quad(quads: DataFrame, side: int, depth: int, qx: int, qy: int) -> DataFrame:
    """The leaves within a quad, or the leaf that holds it."""
    size = side >> depth
    return overlapping(quads, qx * size, qy * size, qx * size + size - 1, qy * size + size - 1)


def coarsen(mask: DataFrame, size: int, side: int) -> DataFrame:
    """Quads of `size` with a set pixel become white; sizes under 2 change nothing, sizes above the tree's side are an error."""
    if size > side:
        raise ValueError("larger than the mask's tree")
    if size < 2:
        return contract(mask, side)
    return mask.select("mask_id", F.lit(size).alias("size"), F.expr(f"x div {size}").alias("qx"), F.expr(f"y div {size}").alias("qy")).distinct()


def paint(quads: DataFrame, width: int, height: int, pixel: float = 1.0) -> DataFrame:
    """White quads scaled by the pixel size, half open: rectangles (mask_id, x0, y0, x1, y1) of whole pixels."""
    c = clipped(quads, width, height)
    at = lambda v: F.floor(v * pixel).cast("int")
    return c.select("mask_id", at(F.col("x")).alias("x0"), at(F.col("y")).alias("y0"), at(F.col("x") + F.col("size_x")).alias("x1"), at(F.col("y") + F.col("size_y")).alias("y1"))
