"""Block cosine transform and the scale at which an image still has detail."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIDE = 8


def basis() -> list[list[float]]:
    """Orthonormal cosine basis: [u][x]."""
    return [[math.sqrt((1 if u == 0 else 2) / SIDE) * math.cos((2 * x + 1) * u * math.pi / (2 * SIDE)) for x in range(SIDE)] for u in range(SIDE)]


def stretch255(px: DataFrame) -> DataFrame:
    """Values of each image stretched from its least and greatest to 0..255, as doubles; null if they are equal.

    The bounds are aggregated and joined back, so a large image is no single window.
    """
    bounds = px.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = (F.col("v") - F.col("lo")) * 255 / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))
    return px.join(bounds, "image_id").select("image_id", "x", "y", v.cast("double").alias("v"))


def deviation(px: DataFrame) -> DataFrame:
    """(image_id, sd): standard deviation of all values."""
    n, s, q = F.count("*"), F.sum("v"), F.sum(F.col("v") * F.col("v"))
    return px.groupBy("image_id").agg(F.sqrt(q / n - s * s / (n * n)).alias("sd"))


def dct8(px: DataFrame) -> DataFrame:
    """(image_id, bx, by, u, v, c): coefficients of each 8x8 block, u down and v across; rows first, then columns."""
    table = basis()
    by_place = [F.array(*[F.lit(table[u][x]) for u in range(SIDE)]) for x in range(SIDE)]
    look = F.array(*by_place)
    rows = px.select("image_id", F.expr("x div 8").alias("bx"), "y", F.col("v").alias("value"), look[F.col("x") % SIDE].alias("w"))
    across = rows.select("image_id", "bx", "y", *[(F.col("value") * F.col("w")[u]).alias(f"a{u}") for u in range(SIDE)])
    across = across.groupBy("image_id", "bx", "y").agg(*[F.sum(f"a{u}").alias(f"a{u}") for u in range(SIDE)])
    down = across.select("image_id", "bx", F.expr("y div 8").alias("by"), look[F.col("y") % SIDE].alias("w"), *[f"a{u}" for u in range(SIDE)])
    cells = down.groupBy("image_id", "bx", "by").agg(*[F.sum(F.col("w")[u] * F.col(f"a{v}")).alias(f"c{u}{v}") for u in range(SIDE) for v in range(SIDE)])
    flat = F.explode(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"), F.col(f"c{u}{v}").alias("c")) for u in range(SIDE) for v in range(SIDE)]))
    return cells.select("image_id", "bx", "by", flat.alias("t")).select("image_id", "bx", "by", "t.u", "t.v", "t.c")


def activity(px: DataFrame, sizes: tuple[int, int], share: float = 0.2) -> DataFrame:
    """(image_id, u, v, n): number of blocks whose coefficient exceeds that share of the standard deviation.

    Values are stretched first; the part of the image beyond whole blocks counts for the deviation only.
    """
    full = stretch255(px)
    w, h = sizes[0] // SIDE * SIDE, sizes[1] // SIDE * SIDE
    coef = dct8(full.filter((F.col("x") < w) & (F.col("y") < h))).join(deviation(full), "image_id")
    return coef.groupBy("image_id", "u", "v").agg(F.count_if(F.abs("c") > F.col("sd") * share).alias("n"))


def effective_scale(px: DataFrame, sizes: tuple[int, int], threshold: float = 0.1) -> DataFrame:
    """(image_id, h_scale, v_scale): where the row and column sums of the activity last cross the threshold, 0..1.

    Sums count relative to the first one; null where that is 0.
    """
    act = activity(px, sizes)
    sums = act.groupBy("image_id", F.col("u").alias("k")).agg(F.sum("n").alias("s")).withColumn("axis", F.lit("v"))
    sums = sums.unionByName(act.groupBy("image_id", F.col("v").alias("k")).agg(F.sum("n").alias("s")).withColumn("axis", F.lit("h")))
    line = Window.partitionBy("image_id", "axis").orderBy("k")
    first = F.first("s").over(line)
    rel = sums.select("image_id", "axis", "k", F.try_divide(F.col("s"), first).alias("r"))
    cross = rel.withColumn("next", F.lead("r").over(line)).filter(F.col("r") >= threshold)
    last = cross.groupBy("image_id", "axis").agg(F.max("k").alias("k"), F.max_by("r", "k").alias("r"), F.max_by("next", "k").alias("next"))
    at = F.when(F.col("k") == SIDE - 1, 1.0).otherwise((F.col("k") + (threshold - F.col("r")) / (F.col("next") - F.col("r"))) / (SIDE - 1))
    return last.groupBy("image_id").agg(F.max(F.when(F.col("axis") == "h", at)).alias("h_scale"), F.max(F.when(F.col("axis") == "v", at)).alias("v_scale"))
