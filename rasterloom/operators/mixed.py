"""Images of many sizes and mappings in one table: what differs by image is a relation, joined by image_id.

Images of one size and mapping are a class, named after its least image_id. Taps are made once for each class and joined
with pixels by (class, x, y), so a collection of any sizes is one job; small tables of taps and parameters are counted
first and broadcast, larger ones shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contours
from .resample import BORDERS, BROADCAST_TAPS, Kernel, border_index, sinc_hamming

#: Images up to which parameters are broadcast (a few MB).
BROADCAST_IMAGES = 50_000
SIZES = ["width", "height", "dst_width", "dst_height"]


def _small(rows: DataFrame, n: int | None = None, most: int = BROADCAST_IMAGES) -> DataFrame:
    return F.broadcast(rows) if (rows.count() if n is None else n) <= most else rows


def classes(params: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(image_id, cls) of the images and (cls, columns) of their distinct parameters."""
    reps = params.groupBy(*columns).agg(F.min("image_id").alias("cls"))
    return params.select("image_id", *columns).join(reps, columns).select("image_id", "cls"), reps


def _grid(reps: DataFrame) -> DataFrame:
    """Classes with all pixels (dx, dy) of their destination images."""
    row = reps.withColumn("dx", F.explode(F.sequence(F.lit(0), F.col("dst_width") - 1)))
    return row.withColumn("dy", F.explode(F.sequence(F.lit(0), F.col("dst_height") - 1)))


def _counted(reps: DataFrame, each: Column) -> int:
    return int(reps.agg(F.sum(each.cast("double"))).first()[0] or 0)


# ---------------------------------------------------------------- filters


def transform(px: DataFrame, params: DataFrame, kernel=sinc_hamming, default: float = 0.0) -> DataFrame:
    """(image_id, x, y, v) of destination images: the weighted mean of the pixels around (sx * x + ox, sy * y + oy).

    params: (image_id, dst_width, dst_height, sx, sy, ox, oy). The filter is as wide as two pixels of the coarser side;
    pixels outside count with the default; a sum of weights of 1e-15 or less gives 0. Destination pixels that no source
    pixel reaches have no row.
    """
    members, reps = classes(params, ["dst_width", "dst_height", "sx", "sy", "ox", "oy"])
    half = {"hx": F.greatest(F.lit(2.0), F.col("sx") * 2), "hy": F.greatest(F.lit(2.0), F.col("sy") * 2)}
    points = _grid(reps.withColumns(half)).withColumns({"px": F.col("dx") * F.col("sx") + F.col("ox"), "py": F.col("dy") * F.col("sy") + F.col("oy")})
    span = lambda p, h: F.sequence(F.floor(F.col(p) - F.col(h)).cast("int"), F.ceil(F.col(p) + F.col(h)).cast("int"))
    k: Kernel = kernel(F.col("hx"), F.col("hy"))
    taps = points.withColumn("x", F.explode(span("px", "hx"))).withColumn("y", F.explode(span("py", "hy")))
    taps = taps.select("cls", "dx", "dy", "x", "y", k.at(F.col("x") - F.col("px"), F.col("y") - F.col("py")).alias("w"))
    n = _counted(reps.withColumns(half), F.col("dst_width") * F.col("dst_height") * (2 * F.col("hx") + 2) * (2 * F.col("hy") + 2))
    total = taps.groupBy("cls", "dx", "dy").agg(F.sum("w").alias("total"))
    got = px.join(_small(members), "image_id").join(_small(taps, n, BROADCAST_TAPS), ["cls", "x", "y"])
    got = got.groupBy("image_id", "cls", "dx", "dy").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("own"))
    both = got.join(_small(total, n, BROADCAST_TAPS), ["cls", "dx", "dy"])
    v = (F.col("s") + (F.col("total") - F.col("own")) * default) / F.col("total")
    return both.select("image_id", F.col("dx").alias("x"), F.col("dy").alias("y"), F.when(F.col("total") > 1e-15, v).otherwise(0.0).alias("v"))


def scale(px: DataFrame, params: DataFrame, kernel=sinc_hamming) -> DataFrame:
    """Whole images in other sizes; params: (image_id, width, height, dst_width, dst_height)."""
    s = {"sx": F.col("width") / F.col("dst_width"), "sy": F.col("height") / F.col("dst_height")}
    p = params.withColumns(s).withColumns({"ox": F.col("sx") * 0.5 - 0.5, "oy": F.col("sy") * 0.5 - 0.5})
    return transform(px, p, kernel)


def crop_and_scale(px: DataFrame, params: DataFrame, kernel=sinc_hamming) -> DataFrame:
    """Crops in other sizes; params: (image_id, crop_width, crop_height, crop_x, crop_y, dst_width, dst_height)."""
    s = {"sx": F.col("crop_width") / F.col("dst_width"), "sy": F.col("crop_height") / F.col("dst_height")}
    p = params.withColumns(s).withColumns({"ox": F.col("sx") * 0.5 - 0.5 + F.col("crop_x"), "oy": F.col("sy") * 0.5 - 0.5 + F.col("crop_y")})
    return transform(px, p, kernel)


def blur(px: DataFrame, sizes: DataFrame, weights: list[float]) -> DataFrame:
    """Separable filter with reflected borders in images of sizes (image_id, width, height), not rounded.

    Each pixel is told to the places that it stands for, its own and its mirror images, and from there to what they reach.
    """
    r = len(weights) // 2
    taps = F.array(*[F.struct(F.lit(k - r).alias("k"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights)])

    def along(rows: DataFrame, c: str, n: str) -> DataFrame:
        turn = F.greatest(F.lit(1), F.col(n) * 2 - 2)
        turns = F.sequence(-(F.lit(r) / turn).cast("int") - 1, (F.lit(r) / turn).cast("int") + 1)
        mirrored = F.array_distinct(F.flatten(F.transform(turns, lambda t: F.array(t * turn + F.col(c), t * turn - F.col(c)))))
        # an image of one pixel stands for every place
        places = F.when(F.col(n) == 1, F.sequence(F.lit(-r), F.lit(r))).otherwise(mirrored)
        told = rows.select("*", F.explode(places).alias("place")).filter(F.col("place").between(-r, F.col(n) - 1 + r))
        told = told.withColumn("t", F.explode(taps)).withColumn("to", F.col("place") - F.col("t.k")).filter(F.col("to").between(0, F.col(n) - 1))
        other = "y" if c == "x" else "x"
        return told.groupBy("image_id", other, F.col("to").cast("int").alias(c), "width", "height").agg(F.sum(F.col("v") * F.col("t.w")).alias("v"))

    both = px.select("image_id", "x", "y", "v").join(_small(sizes.select("image_id", "width", "height")), "image_id")
    return along(along(both, "x", "width"), "y", "height").select("image_id", "x", "y", "v")


# ---------------------------------------------------------------- points between pixels


def warp(px: DataFrame, params: DataFrame, border: str = "constant", value: int = 0) -> DataFrame:
    """Destination images (image_id, x, y, v), bilinear, truncated to whole values.

    params: (image_id, width, height, dst_width, dst_height, inverse); inverse is the matrix from destination to source,
    nine numbers by rows.
    """
    if border not in BORDERS:
        raise ValueError(f"unknown border {border}, not one of {BORDERS}")
    members, reps = classes(params, [*SIZES, "inverse"])
    row = lambda r: F.col("inverse")[3 * r] * F.col("dx") + F.col("inverse")[3 * r + 1] * F.col("dy") + F.col("inverse")[3 * r + 2]
    points = _grid(reps).withColumns({"px": F.try_divide(row(0), row(2)), "py": F.try_divide(row(1), row(2))})
    points = points.select("cls", "dx", "dy", "width", "height", *[(F.col(p) - F.floor(p)).alias(f) for p, f in (("px", "fx"), ("py", "fy"))], F.floor("px").alias("x0"), F.floor("py").alias("y0"))
    four = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k % 2).alias("m"), F.lit(k // 2).alias("n")) for k in range(4)]))
    at = lambda c, o, n: border_index(F.col(c) + F.col(o), F.col(n), border).cast("int")
    taps = points.select("*", four.alias("t")).select("cls", "dx", "dy", F.col("t.k").alias("k"), at("x0", "t.m", "width").alias("x"), at("y0", "t.n", "height").alias("y")).filter("x is not null and y is not null")
    n = _counted(reps, F.col("dst_width") * F.col("dst_height") * 4)
    members = _small(members)
    got = px.join(members, "image_id").join(_small(taps, n, BROADCAST_TAPS), ["cls", "x", "y"])
    got = got.groupBy("image_id", "dx", "dy").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(4)])
    every = members.join(points.select("cls", "dx", "dy", "fx", "fy"), "cls").join(got, ["image_id", "dx", "dy"], "left")
    v = [F.coalesce(F.col(f"v{k}").cast("double"), F.lit(float(value))) for k in range(4)]
    top, low = v[0] + (v[1] - v[0]) * F.col("fx"), v[2] + (v[3] - v[2]) * F.col("fx")
    out = F.coalesce(top + (low - top) * F.col("fy"), F.lit(float(value)))
    return every.select("image_id", F.col("dx").alias("x"), F.col("dy").alias("y"), F.floor(out).cast("int").alias("v"))


# ---------------------------------------------------------------- masks


def resize_mask(mask: DataFrame, params: DataFrame, clamp: bool = False) -> DataFrame:
    """Nearest pixel by round(x * scale); params: (mask_id, width, height, dst_width, dst_height). No table of columns is built."""

    def axis(c: str, n: str, m: str) -> Column:
        src, dst = F.col(n).cast("double"), F.col(m).cast("double")
        back = lambda i: F.floor(i * src / dst + 0.5)
        low = F.greatest(F.lit(0), F.floor((F.col(c) - 0.5) * dst / src).cast("int") - 1)
        high = F.least(F.col(m) - 1, F.ceil((F.col(c) + 0.5) * dst / src).cast("int") + 1)
        if clamp:
            high = F.when(F.col(c) == F.col(n) - 1, F.col(m) - 1).otherwise(high)
        found = (lambda i: F.least(back(i), F.col(n) - 1)) if clamp else back
        return F.explode(F.filter(F.sequence(low, F.greatest(low, high)), lambda i: (i < F.col(m)) & (found(i) == F.col(c))))

    both = mask.select("mask_id", "x", "y").join(_small(params), "mask_id")
    return both.select("*", axis("x", "width", "dst_width").alias("to")).drop("x").withColumnRenamed("to", "x").select("mask_id", "x", axis("y", "height", "dst_height").alias("y"))


def transform_mask(mask: DataFrame, params: DataFrame) -> DataFrame:
    """Destination pixels whose whole scaled kernel, clamped to the source, is set; params: (mask_id, width, height, dst_width, dst_height, matrix), a 2x3 matrix by rows."""
    members, reps = classes(params.withColumnRenamed("mask_id", "image_id"), [*SIZES, "matrix"])
    m = F.col("matrix")
    p = [m[3 * r] * F.col("dx") + m[3 * r + 1] * F.col("dy") + m[3 * r + 2] for r in range(2)]
    inside = lambda v, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, v.cast("int")))
    span = [F.sequence(inside(F.floor(p[r] - k / 2), n), inside(F.ceil(p[r] + k / 2), n)) for r, k, n in ((0, m[0], "width"), (1, m[4], "height"))]
    boxes = _grid(reps).select("cls", "dx", "dy", span[0].alias("xs"), span[1].alias("ys")).withColumn("n", F.size("xs") * F.size("ys"))
    taps = boxes.select("cls", "dx", "dy", "n", F.explode("xs").alias("x"), "ys").select("cls", "dx", "dy", "n", "x", F.explode("ys").alias("y"))
    n = _counted(reps, F.col("dst_width") * F.col("dst_height") * (m[0] + 3) * (m[4] + 3))
    both = mask.select(F.col("mask_id").alias("image_id"), "x", "y").join(_small(members), "image_id").join(_small(taps, n, BROADCAST_TAPS), ["cls", "x", "y"])
    hit = both.groupBy("image_id", "dx", "dy", "n").agg(F.count("*").alias("k")).filter("k = n")
    return hit.select(F.col("image_id").alias("mask_id"), F.col("dx").alias("x"), F.col("dy").alias("y"))


def boundary(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """Set pixels with an unset neighbour (of eight) inside the image; sizes: (mask_id, width, height)."""
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    told = mask.select("mask_id", "x", "y", step.alias("d")).select("mask_id", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"), F.expr("d.i = 0 and d.j = 0").alias("own"))
    seen = told.groupBy("mask_id", "x", "y").agg(F.count("*").alias("n"), F.max("own").alias("own")).filter("own").join(_small(sizes), "mask_id")
    near = lambda c, n: F.lit(1) + (F.col(c) > 0).cast("int") + (F.col(c) < F.col(n) - 1).cast("int")
    return seen.filter(F.col("n") < near("x", "width") * near("y", "height")).select("mask_id", "x", "y")


def contour_segments(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boundary segments of masks of sizes (mask_id, width, height)."""
    return contours.segments(contours.mask_cells(mask, F.col("width"), F.col("height"), _small(sizes)).drop("width", "height"))


def label_segments(px: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boundary segments by colour of label images of sizes (image_id, width, height)."""
    return contours.segments(contours.label_cells(px, F.col("width"), F.col("height"), _small(sizes)))
