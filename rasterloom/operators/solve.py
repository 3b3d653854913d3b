"""Filling unset pixels by the Laplace equation, by image or by block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unknowns up to which the system is solved directly.
DIRECT = 256


def laplace_fill(values: np.ndarray, known: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """values (h, w) with unset pixels such that each is the mean of its neighbours inside the image.

    Few unknowns are solved directly, many by conjugate gradients with the diagonal as preconditioner. Without a known
    pixel all is 0.
    """
    h, w = values.shape
    out = np.where(known, values, 0.0).astype(float)
    if known.all() or not known.any():
        return out
    neighbours = np.full((h, w), 4)
    neighbours[0] -= 1
    neighbours[-1] -= 1
    neighbours[:, 0] -= 1
    neighbours[:, -1] -= 1
    free = ~known

    def around(a):
        s = np.zeros((h, w))
        s[1:] += a[:-1]
        s[:-1] += a[1:]
        s[:, 1:] += a[:, :-1]
        s[:, :-1] += a[:, 1:]
        return s

    right = around(out)[free]
    diagonal = neighbours[free].astype(float)

    def apply(v):
        a = np.zeros((h, w))
        a[free] = v
        return diagonal * v - around(a)[free]

    n = len(right)
    if n <= DIRECT:
        out[free] = np.linalg.solve(np.array([apply(e) for e in np.eye(n)]).T, right)
        return out
    v = np.zeros(n)
    r = right - apply(v)
    z = r / diagonal
    p, rz = z.copy(), r @ z
    goal = tolerance * max(1e-30, np.linalg.norm(right))
    for _ in range(10 * n):
        if np.linalg.norm(r) <= goal:
            break
        ap = apply(p)
        step = rz / (p @ ap)
        v += step * p
        r -= step * ap
        z = r / diagonal
        rz, old = r @ z, rz
        p = z + rz / old * p
    out[free] = v
    return out


def _fill(px: DataFrame, keys: list[str], whole: bool) -> DataFrame:
    """Groups of keys with x, y, v and known, filled; whole: values are rounded half away from zero."""

    def run(pdf):
        x, y = pdf["x"].to_numpy() - pdf["x"].min(), pdf["y"].to_numpy() - pdf["y"].min()
        values, known = np.zeros((y.max() + 1, x.max() + 1)), np.zeros((y.max() + 1, x.max() + 1), dtype=bool)
        values[y, x] = pdf["v"].fillna(0).to_numpy()
        known[y, x] = pdf["known"].to_numpy()
        v = laplace_fill(values, known)[y, x]
        v = np.where(pdf["known"], pdf["v"].fillna(0), np.sign(v) * np.floor(np.abs(v) + 0.5) if whole else v)
        return pdf.assign(v=v)[["image_id", "x", "y", "v"]]

    return px.groupBy(*keys).applyInPandas(run, f"image_id {px.schema['image_id'].dataType.simpleString()}, x int, y int, v double")


def laplace_interpolate(px: DataFrame, whole: bool = True) -> DataFrame:
    """Dense pixels (image_id, x, y, v, known) with the unknown ones interpolated; an image is one group."""
    return _fill(px.select("image_id", "x", "y", F.col("v").cast("double").alias("v"), "known"), ["image_id"], whole)


def block_inpaint(px: DataFrame, width: int = 8, height: int = 8, whole: bool = True) -> DataFrame:
    """Dense pixels (image_id, x, y, v, known): blocks without a known pixel become 0, mixed ones are interpolated within.

    One pass counts known pixels by block; only mixed blocks go through Python.
    """
    tagged = px.select("image_id", "x", "y", F.col("v").cast("double").alias("v"), "known", F.expr(f"x div {width}").alias("bx"), F.expr(f"y div {height}").alias("by"))
    keys = ["image_id", "bx", "by"]
    state = tagged.groupBy(*keys).agg(F.count_if("known").alias("k"), F.count("*").alias("n"))
    both = tagged.join(state, keys)
    plain = both.filter("k = 0 or k = n").select("image_id", "x", "y", F.when(F.col("k") == 0, 0.0).otherwise(F.col("v")).alias("v"))
    return plain.unionByName(_fill(both.filter("k > 0 and k < n").select(*keys, "x", "y", "v", "known"), keys, whole))
