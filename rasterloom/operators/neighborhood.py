"""Window operators: morphology, filters, sharpening, cell codes.

Two-dimensional windows are taken as rows, then columns, where they separate. Windows are partitioned by image and row or
column; an image whose rows hold many millions of pixels should be tiled first (see tiles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tiles(px: DataFrame, size: int, halo: int) -> DataFrame:
    """Pixels dealt to square tiles (tx, ty) with a border of `halo` pixels of the neighbours; `own` tells which count."""
    def span(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size))

    out = px.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
    own = (F.floor(F.col("x") / size) == F.col("tx")) & (F.floor(F.col("y") / size) == F.col("ty"))
    return out.withColumn("own", own).filter("tx >= 0 and ty >= 0")


def _line(key: list[str], other: str, along: str, before: int, after: int):
    return Window.partitionBy(*key, other).orderBy(along).rangeBetween(-before, after)


def morphology(px: DataFrame, kernel: int, grow: bool) -> DataFrame:
    """Least (erode) or greatest (dilate) value in a square of 2 * (kernel // 2) + 1 pixels, cut at the borders."""
    r = kernel // 2
    f = F.max if grow else F.min
    rows = px.select("image_id", "x", "y", f("v").over(_line(["image_id"], "y", "x", r, r)).alias("v"))
    return rows.select("image_id", "x", "y", f("v").over(_line(["image_id"], "x", "y", r, r)).alias("v"))


def erode(px: DataFrame, kernel: int) -> DataFrame:
    return morphology(px, kernel, False)


def dilate(px: DataFrame, kernel: int) -> DataFrame:
    return morphology(px, kernel, True)


def spread_filter(px: DataFrame, weights: list[float], size: tuple[int, int], along: str, edge: str = "reflect101", value: str = "v") -> DataFrame:
    """Sum of weighted neighbours along one axis: each pixel adds to those it reaches, one aggregation by pixel.

    edge: reflect101, replicate, or none (what is outside counts 0). weights are centred.
    """
    r, n = len(weights) // 2, size[0] if along == "x" else size[1]
    # a place that a window may ask for, from -r to n - 1 + r, is one of these images of the pixel
    at = F.col(along)
    images = F.array(at)
    if edge == "replicate":
        images = F.when(at == 0, F.sequence(F.lit(-r), F.lit(0))).otherwise(images)
        images = F.when(at == n - 1, F.concat(images, F.when(F.lit(r > 0), F.sequence(F.lit(n), F.lit(n - 1 + r))).otherwise(F.array().cast("array<int>")))).otherwise(images)
    elif edge == "reflect101" and n > 1:
        turns = range(-(r // (2 * n - 2)) - 1, r // (2 * n - 2) + 2)
        images = F.array_distinct(F.array(*[F.lit(2 * (n - 1) * k) + s for k in turns for s in (at, -at)]))
    elif edge == "reflect101":
        images = F.sequence(F.lit(-r), F.lit(r))
    taps = F.array(*[F.struct(F.lit(k - r).alias("k"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights)])
    told = px.select("*", F.explode(images).alias("place")).filter(F.col("place").between(-r, n - 1 + r))
    told = told.withColumn("t", F.explode(taps)).withColumn("to", F.col("place") - F.col("t.k")).filter(F.col("to").between(0, n - 1))
    other = "y" if along == "x" else "x"
    out = told.groupBy("image_id", other, F.col("to").cast("int").alias(along)).agg(F.sum(F.col(value) * F.col("t.w")).alias(value))
    return out.select("image_id", "x", "y", value)


def row_filter(px: DataFrame, weights: list[float], size: tuple[int, int], edge: str = "replicate") -> DataFrame:
    """One-dimensional filter of each row."""
    return spread_filter(px, weights, size, "x", edge)


def gaussian(kernel: int, sigma: float) -> list[float]:
    import math

    w = [math.exp(-((i - kernel // 2) ** 2) / (2 * sigma * sigma)) for i in range(kernel)]
    return [x / sum(w) for x in w]


def blur(px: DataFrame, weights: list[float], size: tuple[int, int]) -> DataFrame:
    """Separable filter with reflected borders, not rounded."""
    return spread_filter(spread_filter(px, weights, size, "x"), weights, size, "y")


def sharpen(px: DataFrame, size: tuple[int, int], kernel: int = 3, sigma: float = 1.0, dark: float = 1.0, light: float = 1.0, threshold: float = 0.0, weights: list[float] | None = None) -> DataFrame:
    """Unsharp masking of a luma band (v, 0..255) with one weight where the pixel is darker than its surroundings and one where lighter.

    The blur is rounded to whole values (half to even); pixels whose difference from it is below `threshold` stay.
    """
    if kernel % 2 == 0:
        raise ValueError("the kernel must be odd")
    soft = blur(px, weights or gaussian(kernel, sigma), size).select("image_id", "x", "y", F.rint("v").alias("soft"))
    d = F.col("v") - F.col("soft")
    add = F.round(F.when(d < 0, F.lit(dark)).otherwise(F.lit(light)) * d)
    out = F.when(F.abs(d) < threshold, F.col("v")).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), F.col("v") + add)))
    return px.join(soft, ["image_id", "x", "y"]).select("image_id", "x", "y", out.cast("int").alias("v"))


# Weights of luma and of the differences from it, in 1 / 16384, as 8-bit images are converted.
LUMA, CHROMA, BACK = (4899, 9617, 1868), (11682, 9241), (22987, -11698, -5636, 29049)


def _scaled(v: Column) -> Column:
    """Sums of 1 / 16384 to whole values, half up."""
    return F.shiftright(v + 8192, 14)


def _byte(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")


def sharpen_color(px: DataFrame, size: tuple[int, int], ycrcb: bool = False, **params) -> DataFrame:
    """Sharpening of colour pixels (r, g, b, and `a` if there is one) by their luma; alpha stays as it is.

    ycrcb: the three channels are luma and chroma already (y in r), and chroma stays. Else whole-valued conversion to
    luma and chroma and back. params as for sharpen.
    """
    c = {k: F.col(k).cast("int") for k in "rgb"}
    if ycrcb:
        parts = {"l": c["r"], "cr": c["g"], "cb": c["b"]}
    else:
        luma = _scaled(c["r"] * LUMA[0] + c["g"] * LUMA[1] + c["b"] * LUMA[2])
        parts = {"l": luma, "cr": _byte(_scaled((c["r"] - luma) * CHROMA[0]) + 128), "cb": _byte(_scaled((c["b"] - luma) * CHROMA[1]) + 128)}
    keep = ["a"] if "a" in px.columns else []
    own = px.select("image_id", "x", "y", *keep, *[v.alias(k) for k, v in parts.items()])
    sharp = sharpen(own.select("image_id", "x", "y", F.col("l").alias("v")), size, **params)
    both = own.join(sharp, ["image_id", "x", "y"])
    y, cr, cb = F.col("v"), F.col("cr") - 128, F.col("cb") - 128
    if ycrcb:
        out = {"r": y, "g": F.col("cr"), "b": F.col("cb")}
    else:
        out = {"r": _byte(y + _scaled(cr * BACK[0])), "g": _byte(y + _scaled(cr * BACK[1] + cb * BACK[2])), "b": _byte(y + _scaled(cb * BACK[3]))}
    return both.select("image_id", "x", "y", *[v.alias(k) for k, v in out.items()], *keep)


def cell_codes(mask: DataFrame, key: str = "mask_id") -> DataFrame:
    """(key, i, j, code) of the marching-squares cells that touch a set pixel: UL 8, UR 4, LR 2, LL 1.

    Cell (i, j) has the corners (i, j) to (i + 1, j + 1); each set pixel adds its bit to four cells.
    """
    bits = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(b).alias("b")) for i, j, b in ((0, 0, 8), (-1, 0, 4), (-1, -1, 2), (0, -1, 1))])
    keys = [key] if isinstance(key, str) else list(key)
    told = mask.select(*keys, "x", "y", F.explode(bits).alias("t"))
    cells = told.groupBy(*keys, (F.col("x") + F.col("t.i")).alias("i"), (F.col("y") + F.col("t.j")).alias("j"))
    return cells.agg(F.sum("t.b").cast("int").alias("code"))
