"""Validity masks as relations: a row (mask_id, x, y) is a set pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["mask_id", "x", "y"]


def from_raster(px: DataFrame, predicate: Column, inverse: bool = False) -> DataFrame:
    """Pixels that the predicate holds for; inverse: those of a full mask that it does not remove."""
    return px.filter(~predicate if inverse else predicate).select(F.col("image_id").alias("mask_id"), "x", "y")


def masked(px: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels that are set in the mask."""
    return px.join(mask.withColumnRenamed("mask_id", "image_id"), ["image_id", "x", "y"], "left_semi")


def check_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes (mask_id, width, height) of the masks of both sides, an error where they differ; one that only one side has is empty on the other."""
    other = b.select("mask_id", F.col("width").alias("w2"), F.col("height").alias("h2"))
    alike = F.coalesce((F.col("width") == F.col("w2")) & (F.col("height") == F.col("h2")), F.lit(True))
    both = a.join(other, "mask_id", "full").withColumn("checked", F.assert_true(alike, F.lit("mask sizes differ"))).filter("checked is null")
    return both.select("mask_id", F.coalesce("width", "w2").alias("width"), F.coalesce("height", "h2").alias("height"))


def create(sizes: DataFrame, source: DataFrame | None = None, full: bool = False) -> DataFrame:
    """Masks of the sizes (mask_id, width, height): full, or a copy of the source's pixels within, or empty."""
    if full:
        return grid(sizes)
    if source is None:
        return sizes.select("mask_id", F.lit(0).alias("x"), F.lit(0).alias("y")).filter(F.lit(False))
    inside = F.col("x").between(0, F.col("width") - 1) & F.col("y").between(0, F.col("height") - 1)
    return source.select(KEY).join(sizes, "mask_id").filter(inside).select(KEY)


def _alike(a: DataFrame, sizes: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """The pixels of a; if the sizes of both sides are given, an error where they differ for a mask."""
    return a.select(KEY) if sizes is None else a.select(KEY).join(check_sizes(*sizes).select("mask_id"), "mask_id", "left_semi")


def union(a: DataFrame, b: DataFrame, sizes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pixels of either mask. With sizes (of a, of b) as (mask_id, width, height), masks of different size are an error."""
    return _alike(a, sizes).union(_alike(b, sizes)).distinct()


def intersect(a: DataFrame, b: DataFrame, sizes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pixels of both masks; sizes as for union."""
    return _alike(a, sizes).join(b.select(KEY), KEY, "left_semi").distinct()


def subtract(a: DataFrame, b: DataFrame, sizes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pixels of the first mask alone; sizes as for union."""
    return _alike(a, sizes).join(b.select(KEY), KEY, "left_anti").distinct()


def grid(sizes: DataFrame, key: str = "mask_id") -> DataFrame:
    """All pixels of masks with (key, width, height)."""
    x = sizes.select(key, "height", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    return x.select(key, "x", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))


def invert(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """The other pixels of the masks' areas; masks of `sizes` without a set pixel become full."""
    return grid(sizes).join(mask.select(KEY), KEY, "left_anti")


def update(mask: DataFrame, changes: DataFrame) -> DataFrame:
    """Point updates (mask_id, x, y, value, seq): the last one of a pixel counts."""
    last = changes.groupBy(KEY).agg(F.max_by("value", "seq").alias("value"))
    kept = mask.select(KEY).join(last, KEY, "left_anti")
    return kept.union(last.filter("value").select(KEY))


def count(mask: DataFrame) -> DataFrame:
    return mask.groupBy("mask_id").agg(F.count("*").alias("count"))


def boundary(mask: DataFrame, width: int, height: int) -> DataFrame:
    """Set pixels with an unset neighbour (of eight) inside the image.

    Each set pixel tells its neighbours, so one aggregation by pixel replaces eight joins.
    """
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    told = mask.select("mask_id", "x", "y", step.alias("d"))
    told = told.select("mask_id", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"), ((F.col("d.i") == 0) & (F.col("d.j") == 0)).alias("own"))
    seen = told.groupBy(KEY).agg(F.count("*").alias("n"), F.max("own").alias("own")).filter("own")
    across = F.when((F.col("x") == 0) | (F.col("x") == width - 1), 2 if width > 1 else 1).otherwise(3)
    down = F.when((F.col("y") == 0) | (F.col("y") == height - 1), 2 if height > 1 else 1).otherwise(3)
    return seen.filter(F.col("n") < across * down).select(KEY)


def radius(mask: DataFrame, ref_size: tuple[int, int], ref_roi: tuple[float, float, float, float], size: tuple[int, int]) -> DataFrame:
    """(mask_id, radius): greatest distance of a set pixel from the centre of a region (x, y, w, h), truncated.

    The region lies in an image of ref_size; the mask is scaled from `size` to it.
    """
    sx, sy = ref_size[0] / size[0], ref_size[1] / size[1]
    cx, cy = ref_roi[0] + ref_roi[2] / 2, ref_roi[1] + ref_roi[3] / 2
    d = F.pow(F.col("x") * F.lit(sx) - cx, 2) + F.pow(F.col("y") * F.lit(sy) - cy, 2)
    return mask.groupBy("mask_id").agg(F.floor(F.sqrt(F.max(d))).cast("int").alias("radius"))


def get(points: DataFrame, mask: DataFrame, width: int, height: int, clamped: bool = False) -> DataFrame:
    """points (mask_id, x, y, ...) with `value`: whether the pixel is set; outside false, or the nearest pixel's if clamped."""
    x = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.col("x"))) if clamped else F.col("x")
    y = F.greatest(F.lit(0), F.least(F.lit(height - 1), F.col("y"))) if clamped else F.col("y")
    at = points.withColumn("_x", x).withColumn("_y", y)
    held = mask.select("mask_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.lit(True).alias("value"))
    return at.join(held, ["mask_id", "_x", "_y"], "left").withColumn("value", F.coalesce("value", F.lit(False))).drop("_x", "_y")


def coarsen(mask: DataFrame, size: int) -> DataFrame:
    """Tiles of size x size pixels that hold a set one become full; (mask_id, tx, ty), tiles counted from 0."""
    return mask.select("mask_id", F.expr(f"x div {size}").alias("tx"), F.expr(f"y div {size}").alias("ty")).distinct()


def roll_up(mask: DataFrame, width: int, height: int, size: int) -> DataFrame:
    """(mask_id, tx, ty, white): true where a tile (clipped to the image) is full, null where it is mixed; empty tiles have no row."""
    tile = mask.groupBy("mask_id", F.expr(f"x div {size}").alias("tx"), F.expr(f"y div {size}").alias("ty")).agg(F.count("*").alias("n"))
    wide = F.least(F.lit(size), F.lit(width) - F.col("tx") * size)
    high = F.least(F.lit(size), F.lit(height) - F.col("ty") * size)
    return tile.select("mask_id", "tx", "ty", F.when(F.col("n") == wide * high, True).alias("white"))


def resize(mask: DataFrame, src: tuple[int, int], dst: tuple[int, int], clamp: bool = False) -> DataFrame:
    """Nearest pixel by round(x * scale), half away from zero; an index at the far edge is unset unless clamped.

    Each source pixel is sent to the few destination ones around its scaled place that round back to it, by arithmetic,
    so neither a grid of images nor a table of columns is built.
    """
    def axis(n_src: int, n_dst: int, name: str) -> Column:
        c, s = F.col(name), n_src / n_dst
        back = lambda i: F.floor(i * F.lit(float(n_src)) / F.lit(float(n_dst)) + 0.5)
        low = F.greatest(F.lit(0), F.floor((c - 0.5) / s)).cast("int") - 1
        high = F.least(F.lit(n_dst - 1), F.ceil((c + 0.5) / s).cast("int") + 1)
        if clamp:
            high = F.when(c == n_src - 1, n_dst - 1).otherwise(high)
        at = F.sequence(F.greatest(low, F.lit(0)), F.greatest(high, F.lit(0)))
        return F.explode(F.filter(at, lambda i: (F.least(back(i), F.lit(n_src - 1)) if clamp else back(i)) == c))

    x = mask.select("mask_id", "y", axis(src[0], dst[0], "x").alias("x"))
    return x.select("mask_id", "x", axis(src[1], dst[1], "y").alias("y"))


def white_area(quads: DataFrame) -> DataFrame:
    """(mask_id, count) from leaves (mask_id, size_x, size_y, white)."""
    return quads.groupBy("mask_id").agg(F.sum(F.when(F.col("white"), F.col("size_x") * F.col("size_y")).otherwise(0)).alias("count"))
