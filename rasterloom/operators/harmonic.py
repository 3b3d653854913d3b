"""Laplace filling of images of any size: overlapping tiles solve for themselves, halos carry their values from round to round."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import settled
from .tiles import KEY, _window, from_pixels, sized, to_pixels, with_halo

#: Side of a tile, pixels by which a tile looks into its neighbours, and how much coarser each level of first guesses is.
SIDE, OVERLAP, COARSER = 64, 16, 4


def solve_window(known: np.ndarray, guess: np.ndarray, x0: int, y0: int, width: int, height: int, tolerance: float) -> np.ndarray:
    """guess with the unknown pixels of a window such that each is the mean of its neighbours inside the image.

    known is NaN where a pixel is not; unknown ones on the window's rim stay as guessed. Conjugate gradients with the
    diagonal as preconditioner, from the guess on.
    """
    h, w = known.shape
    ys, xs = np.mgrid[y0 : y0 + h, x0 : x0 + w]
    inside = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
    free = inside & np.isnan(known)
    free[0], free[-1], free[:, 0], free[:, -1] = False, False, False, False
    values = np.where(np.isnan(known), np.where(np.isnan(guess) | ~inside, 0.0, guess), known)
    if not free.any():
        return values

    def around(a):
        s = np.zeros((h, w))
        s[1:] += a[:-1]
        s[:-1] += a[1:]
        s[:, 1:] += a[:, :-1]
        s[:, :-1] += a[:, 1:]
        return s

    diagonal = around(inside.astype(float))[free]
    right = around(np.where(free | ~inside, 0.0, values))[free]

    def apply(v):
        a = np.zeros((h, w))
        a[free] = v
        return diagonal * v - around(a)[free]

    v = values[free]
    r = right - apply(v)
    z = r / diagonal
    p, rz = z.copy(), r @ z
    for _ in range(20 * len(v)):
        if np.abs(r).max() <= tolerance:
            break
        ap = apply(p)
        step = rz / (p @ ap)
        v = v + step * p
        r = r - step * ap
        z = r / diagonal
        rz, old = r @ z, rz
        p = z + rz / old * p
    values[free] = v
    return values


def _solver(side: int, overlap: int, tolerance: float):
    @F.pandas_udf("struct<u:array<double>,moved:double>")
    def run(known: pd.Series, at: pd.Series, u: pd.Series, halo: pd.Series, tx: pd.Series, ty: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        out, moved = [], []
        own = slice(overlap, overlap + side)
        for k, a, v, h, x, y, w, n in zip(known, at, u, halo, tx, ty, width, height, strict=True):
            guess = _window(a, v, h, side, overlap)
            before = guess[own, own].copy()
            k = np.asarray(k, dtype=np.float64).reshape(guess.shape)
            new = solve_window(k, guess, x * side - overlap, y * side - overlap, w, n, tolerance / 10)[own, own]
            new = np.where(np.isnan(before), np.nan, new)
            out.append(new.ravel())
            moved.append(float(np.nanmax(np.abs(new - before), initial=0.0)))
        return pd.DataFrame({"u": out, "moved": moved})

    return run


def _known_windows(side: int, overlap: int):
    @F.pandas_udf("array<double>")
    def run(at: pd.Series, v: pd.Series, halo: pd.Series) -> pd.Series:
        return pd.Series([_window(a, x, h, side, overlap).ravel() for a, x, h in zip(at, v, halo, strict=True)])

    return run


def fill(px: DataFrame, sizes: DataFrame, side: int = SIDE, overlap: int = OVERLAP, tolerance: float = 1e-9) -> DataFrame:
    """Dense pixels (image_id, x, y, v, known) of images of sizes (image_id, width, height), the unknown ones filled: (image_id, x, y, v).

    Each unknown pixel becomes the mean of its neighbours inside the image. Tiles look `overlap` pixels into their
    neighbours and solve the equations there with what these last had at the rim; a round shuffles halos alone, and the
    rounds end once no tile moves by more than the tolerance. The first guess is the filled image of a quarter of the
    size, which is filled alike, so large holes do not wait for values to travel through many tiles. Tiles without an
    unknown pixel are only read for their values. Images without a known pixel become 0.
    """
    px = px.select("image_id", "x", "y", F.col("v").cast("double").alias("v"), "known")
    large = sizes.filter(F.greatest("width", "height") > side)
    if large.isEmpty():
        guess = px.select("image_id", "x", "y", F.lit(0.0).alias("u"))
    else:
        up = lambda c: F.expr(f"{c} div {COARSER}").cast("int").alias(c)
        small = px.groupBy("image_id", up("x"), up("y")).agg(F.avg(F.when(F.col("known"), F.col("v"))).alias("v"))
        small = settled(small.withColumn("known", F.col("v").isNotNull()))
        less = sizes.select("image_id", *[F.ceil(F.col(c) / COARSER).cast("int").alias(c) for c in ("width", "height")])
        coarse = fill(small, less, side, overlap, tolerance * 1000).select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("v").alias("u"))
        at = px.select("image_id", "x", "y", F.expr(f"x div {COARSER}").cast("int").alias("cx"), F.expr(f"y div {COARSER}").cast("int").alias("cy"))
        guess = at.join(coarse, ["image_id", "cx", "cy"]).select("image_id", "x", "y", "u")
    both = px.join(guess, ["image_id", "x", "y"]).select("image_id", "x", "y", F.when(F.col("known"), F.col("v")).alias("k"), F.when(F.col("known"), F.col("v")).otherwise(F.col("u")).alias("v"))
    known = from_pixels(both.select("image_id", "x", "y", F.coalesce("k", F.lit(float("nan"))).alias("v")), side)
    windows = with_halo(known, overlap, side).select(*KEY, _known_windows(side, overlap)("at", "v", "halo").alias("known"))
    start = settled(sized(from_pixels(both, side), sizes.select("image_id", "width", "height")).join(windows, KEY))
    state = start
    solver = _solver(side, overlap, tolerance)
    while True:
        made = with_halo(state, overlap, side).withColumn("s", solver("known", "at", "v", "halo", "tx", "ty", "width", "height"))
        state = settled(made.select(*KEY, "width", "height", "known", F.lit(None).cast("array<int>").alias("at"), F.col("s.u").alias("v"), F.col("s.moved").alias("moved")))
        last = state.agg(F.max("moved")).first()[0]
        state = state.drop("moved")
        if last is None or last <= tolerance:
            return to_pixels(state, side)
