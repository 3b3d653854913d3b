"""Sizes of one-coloured squares and stacks at each pixel, as windows and rounds over pixels: no image is one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .contours import runs
from .rounds import settled


def stack_sizes(px: DataFrame) -> DataFrame:
    """Pixels (image_id, x, y, v) with w, the equal run that ends here, and h, the rows from here up whose runs are no narrower than the next.

    A stack goes on over a row as long as the pixel above has the same value and a run at least as wide as the one below
    it, so heights are places within islands of each column.
    """
    wide = runs(px)
    column = Window.partitionBy("image_id", "x").orderBy("y")
    above = lambda c: F.lag(c).over(column)
    goes_on = F.coalesce((above("v") == F.col("v")) & (above("y") == F.col("y") - 1) & (above("w") >= F.col("w")), F.lit(False))
    marked = wide.withColumn("new", (~goes_on).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(column)).drop("new")
    return marked.withColumn("h", F.row_number().over(Window.partitionBy("image_id", "x", "island").orderBy("y"))).drop("island")


def _told(state: DataFrame, step: int) -> DataFrame:
    """For each pixel of the state what the pixels `step` to the left, above and both have, together with its own."""
    to = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, step) for j in (0, step)]))
    told = state.select("image_id", "x", "y", "v", "side", to.alias("d"))
    own = F.expr("d.i = 0 and d.j = 0")
    told = told.select("image_id", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"), "v", "side", own.alias("own"))
    seen = told.groupBy("image_id", "x", "y").agg(F.count("*").alias("n"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("side").alias("least"), F.max(F.when(F.col("own"), F.struct("v", "side"))).alias("mine"))
    return seen.filter("mine is not null").select("image_id", "x", "y", F.col("mine.v").alias("v"), F.col("mine.side").alias("side"), "n", "v0", "v1", "least")


def square_sides(px: DataFrame) -> DataFrame:
    """Pixels (image_id, x, y, v) with side, that of the largest square of one value that ends here; missing pixels are in none.

    First sides are doubled: a square of 2s is four of s with one value. Then they are halved back: with sides known to
    whole multiples of 2s, a square of side + s is four overlapping ones of `side`, which the pixels s away have or not.
    So two rounds for each bit of the largest side, each one aggregation by pixel.
    """
    edge = px.agg(F.max("x"), F.max("y")).first()
    most = min(edge[0], edge[1]) + 1 if edge[0] is not None else 1
    state = px.select("image_id", "x", "y", "v", F.lit(1).alias("side"))
    step = 1
    while 2 * step <= most:
        # only whole squares of `step` double; smaller ones are passed by
        doubled = _told(state, step).withColumn("grown", (F.col("n") == 4) & (F.col("v0") == F.col("v1")) & (F.col("least") == step))
        state = settled(doubled.select("image_id", "x", "y", "v", F.when(F.col("grown"), 2 * step).otherwise(F.col("side")).alias("side"), "grown"))
        any_ = not state.filter("grown").isEmpty()
        state = state.drop("grown")
        if not any_:
            break
        step *= 2
    step //= 2
    while step:
        wider = (F.col("side") >= 2 * step) & (F.col("n") == 4) & (F.col("least") >= F.col("side"))
        state = settled(_told(state, step).select("image_id", "x", "y", "v", F.when(wider, F.col("side") + step).otherwise(F.col("side")).alias("side")))
        step //= 2
    return state
