"""Resampling: destination pixels pull source pixels through a table of taps.

A mapping is the same for all images, so the taps (dx, dy, x, y, w) of one destination image are one table. Pixels join
it on (x, y) and are summed by destination pixel: one shuffle, no window join. The table is broadcast up to
BROADCAST_TAPS rows (32 bytes each); for larger images it is joined by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_TAPS = 500_000
BORDERS = ("constant", "replicate", "reflect", "reflect101", "wrap")


@dataclass
class Kernel:
    """A separable filter: half widths and weight along each axis."""

    half_x: float
    half_y: float
    weight: Callable[[Column, float], Column]

    def at(self, dx: Column, dy: Column) -> Column:
        return self.weight(dx, self.half_x) * self.weight(dy, self.half_y)


def hat(half_x: float, half_y: float) -> Kernel:
    """Triangle that falls to 0 at the half width."""
    return Kernel(half_x, half_y, lambda d, h: F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(d) / h))


def sinc_hamming(half_x: float, half_y: float) -> Kernel:
    """Sinc under a Hamming window; zeros every half of the half width."""

    def weight(d: Column, h: float) -> Column:
        t = d * (2 * math.pi / h)
        sinc = F.when(F.abs(t) < 1e-12, 1.0).otherwise(F.sin(t) / t)
        return F.when(F.abs(d) > h, 0.0).otherwise(sinc * (0.54 + 0.46 * F.cos(d * (math.pi / h))))

    return Kernel(half_x, half_y, weight)


def grid(spark: SparkSession, size: tuple[int, int]) -> DataFrame:
    """(dx, dy) of all pixels of an image."""
    w, h = size
    return spark.range(w * h).select((F.col("id") % w).cast("int").alias("dx"), F.expr(f"cast(id div {w} as int)").alias("dy"))


def window(points: DataFrame, kernel: Kernel) -> DataFrame:
    """Taps of points (dx, dy, px, py): all pixels of the kernel's window with their weights, inside the image or not."""
    span = lambda p, h: F.sequence(F.floor(F.col(p) - h).cast("int"), F.ceil(F.col(p) + h).cast("int"))
    taps = points.withColumn("x", F.explode(span("px", kernel.half_x))).withColumn("y", F.explode(span("py", kernel.half_y)))
    return taps.select("dx", "dy", "x", "y", kernel.at(F.col("x") - F.col("px"), F.col("y") - F.col("py")).alias("w"))


def _joined(px: DataFrame, taps: DataFrame, rows: int) -> DataFrame:
    return px.join(F.broadcast(taps) if rows <= BROADCAST_TAPS else taps, ["x", "y"])


def _taps(size: tuple[int, int], kernel: Kernel) -> int:
    return int(size[0] * size[1] * (2 * kernel.half_x + 2) * (2 * kernel.half_y + 2))


def reconstruct_default(px: DataFrame, points: DataFrame, kernel: Kernel, dst: tuple[int, int], default: float = 0.0) -> DataFrame:
    """(image_id, x, y, v): sum of weighted values over the sum of weights; pixels outside count with the default.

    A sum of weights of 1e-15 or less gives 0. v is a double, not clamped. Every image of px has all destination pixels
    that at least one of its pixels reaches; others are the default.
    """
    taps = window(points, kernel)
    total = taps.groupBy("dx", "dy").agg(F.sum("w").alias("total"))
    got = _joined(px, taps, _taps(dst, kernel)).groupBy("image_id", "dx", "dy").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("own"))
    both = got.join(F.broadcast(total) if dst[0] * dst[1] <= BROADCAST_TAPS else total, ["dx", "dy"])
    v = (F.col("s") + (F.col("total") - F.col("own")) * default) / F.col("total")
    return both.select("image_id", F.col("dx").alias("x"), F.col("dy").alias("y"), F.when(F.col("total") > 1e-15, v).otherwise(0.0).alias("v"))


def reconstruct_valid(px: DataFrame, points: DataFrame, kernel: Kernel, dst: tuple[int, int], values: tuple[str, ...] = ("v",)) -> DataFrame:
    """(image_id, x, y, v) from valid pixels alone; destination pixels that are undefined have no row.

    values: the channels, any number of them, each of which comes back under its name; weights are summed once. With all of the window valid, all weights count; else those that are not negative. A sum under 1e-15 is undefined.
    """
    taps = window(points, kernel)
    n = taps.groupBy("dx", "dy").agg(F.count("*").alias("n"))
    w = F.col("w")
    up = w >= 0
    channels = [s for c in values for s in (F.sum(F.when(up, w * F.col(c)).otherwise(0.0)).alias(f"{c}0"), F.sum(F.when(up, 0.0).otherwise(w * F.col(c))).alias(f"{c}1"))]
    sums = _joined(px, taps, _taps(dst, kernel)).groupBy("image_id", "dx", "dy").agg(
        F.count("*").alias("k"), F.sum(F.when(up, w).otherwise(0.0)).alias("w0"), F.sum(F.when(up, 0.0).otherwise(w)).alias("w1"), *channels
    )
    both = sums.join(F.broadcast(n) if dst[0] * dst[1] <= BROADCAST_TAPS else n, ["dx", "dy"])
    part = F.col("k") < F.col("n")
    weight = F.when(part, F.col("w0")).otherwise(F.col("w0") + F.col("w1"))
    out = [(F.when(part, F.col(f"{c}0")).otherwise(F.col(f"{c}0") + F.col(f"{c}1")) / weight).alias(c) for c in values]
    return both.filter(weight >= 1e-15).select("image_id", F.col("dx").alias("x"), F.col("dy").alias("y"), *out)


def clamp8(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(v))).cast("int")


def _points(spark: SparkSession, dst: tuple[int, int], scale: tuple[float, float], offset: tuple[float, float]) -> DataFrame:
    g = grid(spark, dst)
    return g.select("dx", "dy", (F.col("dx") * scale[0] + offset[0]).alias("px"), (F.col("dy") * scale[1] + offset[1]).alias("py"))


def transform(px: DataFrame, dst: tuple[int, int], scale: tuple[float, float], offset: tuple[float, float], kernel=sinc_hamming) -> DataFrame:
    """Each destination pixel at scale * p + offset in the source; the filter is as wide as two pixels of the coarser side."""
    k = kernel(max(2.0, 2.0 * scale[0]), max(2.0, 2.0 * scale[1]))
    return reconstruct_default(px, _points(px.sparkSession, dst, scale, offset), k, dst)


def scale(px: DataFrame, src: tuple[int, int], dst: tuple[int, int], kernel=sinc_hamming) -> DataFrame:
    """The whole image in another size."""
    s = (src[0] / dst[0], src[1] / dst[1])
    return transform(px, dst, s, (s[0] * 0.5 - 0.5, s[1] * 0.5 - 0.5), kernel)


def crop_and_scale(px: DataFrame, crop: tuple[float, float, float, float], dst: tuple[int, int], kernel=sinc_hamming) -> DataFrame:
    """A crop (width, height, x, y) in another size. Pixels that no window reaches are filtered before the join."""
    s = (crop[0] / dst[0], crop[1] / dst[1])
    o = (s[0] * 0.5 - 0.5 + crop[2], s[1] * 0.5 - 0.5 + crop[3])
    hx, hy = max(2.0, 2.0 * s[0]) + 1, max(2.0, 2.0 * s[1]) + 1
    near = F.col("x").between(math.floor(o[0] - hx), math.ceil(o[0] + s[0] * dst[0] + hx)) & F.col("y").between(math.floor(o[1] - hy), math.ceil(o[1] + s[1] * dst[1] + hy))
    return transform(px.filter(near), dst, s, o, kernel)


def border_index(i: Column, n: int, border: str) -> Column:
    """Index of the pixel that stands for i; null outside if the border is constant."""
    m = n - 1
    if border == "constant":
        return F.when((i >= 0) & (i <= m), i)
    if border == "wrap":
        return F.pmod(i, F.lit(n))
    if border == "reflect":
        i = F.when(i < 0, -i - 1).when(i > m, F.lit(2 * m + 1) - i).otherwise(i)
    elif border == "reflect101":
        i = F.when(i < 0, -i).when(i > m, F.lit(2 * m) - i).otherwise(i)
    elif border != "replicate":
        raise ValueError(f"unknown border {border}, not one of {BORDERS}")
    return F.greatest(F.lit(0), F.least(F.lit(m), i))


def bilinear_at(px: DataFrame, points: DataFrame, src: tuple[int, int], n_points: int, border: str = "replicate", value: float = 0.0) -> DataFrame:
    """(image_id, x, y, v): linear between the four neighbours of points (dx, dy, px, py), a border rule for each.

    The four are picked by conditional maxima, so each result is one closed form, whatever the order of rows.
    """
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    four = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k % 2).alias("m"), F.lit(k // 2).alias("n")) for k in range(4)]))
    taps = points.select("dx", "dy", fx.alias("fx"), fy.alias("fy"), (F.floor("px")).cast("int").alias("x0"), (F.floor("py")).cast("int").alias("y0"), four.alias("t"))
    taps = taps.select("dx", "dy", "fx", "fy", F.col("t.k").alias("k"), border_index(F.col("x0") + F.col("t.m"), src[0], border).alias("x"), border_index(F.col("y0") + F.col("t.n"), src[1], border).alias("y"))
    got = _joined(px, taps.filter("x is not null and y is not null"), 4 * n_points).groupBy("image_id", "dx", "dy").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(4)])
    if border == "constant":  # points whose neighbours all lie outside
        got = px.select("image_id").distinct().join(F.broadcast(points.select("dx", "dy")) if n_points <= BROADCAST_TAPS else points.select("dx", "dy")).join(got, ["image_id", "dx", "dy"], "left")
    part = points.select("dx", "dy", fx.alias("fx"), fy.alias("fy"))
    both = got.join(F.broadcast(part) if n_points <= BROADCAST_TAPS else part, ["dx", "dy"])
    v = [F.coalesce(F.col(f"v{k}").cast("double"), F.lit(float(value))) for k in range(4)]
    top, low = v[0] + (v[1] - v[0]) * F.col("fx"), v[2] + (v[3] - v[2]) * F.col("fx")
    return both.select("image_id", F.col("dx").alias("x"), F.col("dy").alias("y"), (top + (low - top) * F.col("fy")).alias("v"))


def interpolate(px: DataFrame, points: DataFrame, src: tuple[int, int], n_points: int, eps: float = 1e-3) -> DataFrame:
    """Bilinear with the point itself clamped into the image, just short of its last pixel."""
    inside = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(n - 1.0 - eps)).alias(c)
    return bilinear_at(px, points.select("dx", "dy", inside("px", src[0]), inside("py", src[1])), src, n_points)


def invert3(h: list[list[float]]) -> list[list[float]]:
    """Inverse of a 3x3 matrix by cofactors."""
    minor = lambda r, c: [[h[i][j] for j in range(3) if j != c] for i in range(3) if i != r]
    det2 = lambda m: m[0][0] * m[1][1] - m[0][1] * m[1][0]
    cof = [[(-1) ** (r + c) * det2(minor(r, c)) for c in range(3)] for r in range(3)]
    det = sum(h[0][c] * cof[0][c] for c in range(3))
    if det == 0:
        raise ValueError("the matrix has no inverse")
    return [[cof[c][r] / det for c in range(3)] for r in range(3)]


def warp_perspective(px: DataFrame, src: tuple[int, int], dst: tuple[int, int], matrix: list[list[float]], border: str = "constant", value: int = 0) -> DataFrame:
    """Each destination pixel through the inverse of the matrix, bilinear, truncated to whole values."""
    if border not in BORDERS:
        raise ValueError(f"unknown border {border}, not one of {BORDERS}")
    m = invert3(matrix)
    row = lambda r: m[r][0] * F.col("dx") + m[r][1] * F.col("dy") + m[r][2]
    points = grid(px.sparkSession, dst).select("dx", "dy", (row(0) / row(2)).alias("px"), (row(1) / row(2)).alias("py"))
    out = bilinear_at(px, points, src, dst[0] * dst[1], border, value)
    return out.withColumn("v", F.floor("v").cast("int"))


def transform_mask(mask: DataFrame, src: tuple[int, int], dst: tuple[int, int], matrix: list[list[float]]) -> DataFrame:
    """Destination pixels whose whole scaled kernel in the source, clamped to the image, is set; matrix is 2x3.

    A row and column more of kernel is looked at on either side (floor and ceil); pixels are counted, so one aggregation
    decides.
    """
    m, (kw, kh) = matrix, (matrix[0][0] / 2, matrix[1][1] / 2)
    g = grid(mask.sparkSession, dst)
    p = [m[r][0] * F.col("dx") + m[r][1] * F.col("dy") + m[r][2] for r in range(2)]
    inside = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("int")
    span = [F.sequence(inside(F.floor(p[r] - k), src[r]), inside(F.ceil(p[r] + k), src[r])) for r, k in ((0, kw), (1, kh))]
    boxes = g.select("dx", "dy", span[0].alias("xs"), span[1].alias("ys")).withColumn("n", F.size("xs") * F.size("ys"))
    taps = boxes.select("dx", "dy", "n", F.explode("xs").alias("x"), "ys").select("dx", "dy", "n", "x", F.explode("ys").alias("y"))
    rows = int(dst[0] * dst[1] * (2 * kw + 3) * (2 * kh + 3))
    hit = _joined(mask.select("mask_id", "x", "y"), taps, rows).groupBy("mask_id", "dx", "dy", "n").agg(F.count("*").alias("k"))
    return hit.filter("k = n").select("mask_id", F.col("dx").alias("x"), F.col("dy").alias("y"))
