"""Blocked rasters: a row is a square tile of an image, its pixels one array; kernels run on whole tiles.

Tiles are (image_id, tx, ty, at, v): v holds the values, at their places in the tile, row by row; without `at` they are all
places, null or NaN where there is no pixel. Pixels become tiles in one grouping by (image_id, tx, ty); tiles stay where it
leaves them (or where a table bucketed by these columns has them), and a kernel's only shuffle is of the strips that
neighbours ask for. What a kernel returns has been in Python, so a next one deals its tiles anew, and reads them twice:
write them in between where a chain is long. A tile holds side * side values, whatever the image's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["image_id", "tx", "ty"]
SIDE = 64
#: Images up to which their sizes and mappings are broadcast (a few MB); of more they are joined by a shuffle.
BROADCAST_IMAGES = 50_000


def _floor_div(c: str, side: int) -> Column:
    return F.floor(F.col(c) / side).cast("int")


# ---------------------------------------------------------------- pixels to tiles and back


def from_pixels(px: DataFrame, side: int = SIDE, value: str = "v") -> DataFrame:
    """Tiles of pixels (image_id, x, y, value)."""
    at = (F.pmod(F.col("y"), F.lit(side)) * side + F.pmod(F.col("x"), F.lit(side))).cast("int")
    cells = F.collect_list(F.struct(at.alias("at"), F.col(value).cast("double").alias("v"))).alias("cells")
    # columns of their own, as a partitioning by expressions is not known under the names of their results
    placed = px.filter(F.col(value).isNotNull()).withColumns({"tx": _floor_div("x", side), "ty": _floor_div("y", side)})
    return placed.groupBy(*KEY).agg(cells).select(*KEY, F.col("cells.at").alias("at"), F.col("cells.v").alias("v"))


def to_pixels(tiles: DataFrame, side: int = SIDE, kind: str = "double") -> DataFrame:
    """Pixels (image_id, x, y, v) of tiles."""
    at = F.coalesce("at", F.sequence(F.lit(0), F.lit(side * side - 1)))
    px = tiles.select(*KEY, F.explode(F.arrays_zip(at.alias("at"), "v")).alias("c")).select(*KEY, "c.at", "c.v").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    x, y = F.col("tx") * side + F.col("at") % side, F.col("ty") * side + F.expr(f"at div {side}").cast("int")
    return px.select("image_id", x.alias("x"), y.alias("y"), F.col("v").cast(kind).alias("v"))


def _dense(at, v, side: int) -> np.ndarray:
    """A tile as a square, NaN where there is no pixel."""
    v = np.asarray(v, dtype=np.float64)
    if at is None:
        return v.reshape(side, side)
    tile = np.full(side * side, np.nan)
    tile[np.asarray(at)] = v
    return tile.reshape(side, side)


def sized(tiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tiles with the columns of sizes (image_id, width, height, ...), which are counted first and broadcast if few."""
    return tiles.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_IMAGES else sizes, "image_id")


# ---------------------------------------------------------------- halos


def _part(step: int, side: int, r: int) -> slice:
    """Of a tile's rows or columns those that the neighbour `step` further needs."""
    return slice(side - r, side) if step == 1 else slice(0, r) if step == -1 else slice(0, side)


def with_halo(tiles: DataFrame, r: int, side: int = SIDE) -> DataFrame:
    """Tiles with `halo`, the strips of r pixels of up to eight neighbours: the only rows that are shuffled."""
    if not 0 < r <= side:
        raise ValueError("a halo is one pixel wide at least and no wider than a tile")
    steps = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j]

    @F.pandas_udf("array<struct<i:int,j:int,strip:binary>>")
    def strips(at: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for p, t in zip(at, v, strict=True):
            a = _dense(p, t, side)
            cut = [(i, j, a[_part(j, side, r), _part(i, side, r)]) for i, j in steps]
            out.append([{"i": i, "j": j, "strip": s.tobytes()} for i, j, s in cut if not np.isnan(s).all()])
        return pd.Series(out)

    told = tiles.select(*KEY, F.explode(strips("at", "v")).alias("s"))
    told = told.select("image_id", (F.col("tx") + F.col("s.i")).alias("tx"), (F.col("ty") + F.col("s.j")).alias("ty"), F.struct((-F.col("s.i")).alias("i"), (-F.col("s.j")).alias("j"), F.col("s.strip").alias("strip")).alias("s"))
    halos = told.groupBy(*KEY).agg(F.collect_list("s").alias("halo"))  # eight at most
    return tiles.join(halos, KEY, "left")


def _window(at, v, halo, side: int, r: int) -> np.ndarray:
    """A tile within its halo, NaN where there is none."""
    w = np.full((side + 2 * r, side + 2 * r), np.nan)
    w[r : r + side, r : r + side] = _dense(at, v, side)
    place = {-1: slice(0, r), 0: slice(r, r + side), 1: slice(r + side, side + 2 * r)}
    for s in halo if halo is not None else ():
        part = w[place[s["j"]], place[s["i"]]]
        part[:] = np.frombuffer(s["strip"]).reshape(part.shape)
    return w


def stencil(tiles: DataFrame, r: int, kernel: Callable, side: int = SIDE, columns: tuple[str, ...] = ()) -> DataFrame:
    """Tiles of kernel(window, x0, y0, *columns): window is the tile with r pixels around, whose first one is (x0, y0)."""

    @F.pandas_udf("array<double>")
    def run(at: pd.Series, v: pd.Series, halo: pd.Series, tx: pd.Series, ty: pd.Series, *more: pd.Series) -> pd.Series:
        rows = zip(at, v, halo, tx, ty, *more, strict=True)
        return pd.Series([kernel(_window(p, t, h, side, r), x * side - r, y * side - r, *c).ravel() for p, t, h, x, y, *c in rows])

    keep = [c for c in tiles.columns if c not in ("at", "v", "halo")]
    return with_halo(tiles, r, side).select(*keep, F.lit(None).cast("array<int>").alias("at"), run("at", "v", "halo", "tx", "ty", *columns).alias("v"))


# ---------------------------------------------------------------- morphology and filters


def morphology(tiles: DataFrame, kernel: int, grow: bool, side: int = SIDE) -> DataFrame:
    """Least (erode) or greatest (dilate) valid pixel of a square of 2 * (kernel // 2) + 1; pixels that are missing stay so.

    The square is taken as rows, then columns; a missing pixel keeps what its row has for the column, so sparse images
    get the least of the whole square too.
    """
    r = kernel // 2
    if not r:
        return tiles
    best = np.fmax if grow else np.fmin

    def run(w, x0, y0):
        rows = best.reduce([w[:, k : k + side] for k in range(2 * r + 1)])
        out = best.reduce([rows[k : k + side] for k in range(2 * r + 1)])
        return np.where(np.isnan(w[r : r + side, r : r + side]), np.nan, out)

    return stencil(tiles, r, run, side)


def erode(tiles: DataFrame, kernel: int, side: int = SIDE) -> DataFrame:
    return morphology(tiles, kernel, False, side)


def dilate(tiles: DataFrame, kernel: int, side: int = SIDE) -> DataFrame:
    return morphology(tiles, kernel, True, side)


def _inner(i: np.ndarray, n: int, edge: str) -> np.ndarray:
    """Index of the pixel that stands for i beyond an image of n, however far."""
    if edge == "replicate" or n == 1:
        return np.clip(i, 0, n - 1)
    i = np.mod(i, 2 * n - 2)
    return np.minimum(i, 2 * n - 2 - i)


def separable(tiles: DataFrame, weights_x: list[float], weights_y: list[float], edge: str = "reflect101", side: int = SIDE) -> DataFrame:
    """Weighted sums along rows, then columns, of sized dense tiles (see sized), not rounded; borders reflected or replicated."""
    if edge not in ("reflect101", "replicate"):
        raise ValueError(f"unknown edge {edge}")
    rx, ry = len(weights_x) // 2, len(weights_y) // 2
    r = max(rx, ry, 1)

    def run(w, x0, y0, width, height):
        n = side + 2 * r
        # beyond the last pixel but one halo away no own pixel looks, so what is outside the window is clipped
        xs = np.clip(_inner(np.arange(x0, x0 + n), width, edge) - x0, 0, n - 1)
        ys = np.clip(_inner(np.arange(y0, y0 + n), height, edge) - y0, 0, n - 1)
        full = w[np.ix_(ys, xs)]
        rows = sum(wt * full[:, r - rx + k : r - rx + k + side] for k, wt in enumerate(weights_x))
        out = sum(wt * rows[r - ry + k : r - ry + k + side] for k, wt in enumerate(weights_y))
        return np.where(np.isnan(w[r : r + side, r : r + side]), np.nan, out)

    return stencil(tiles, r, run, side, ("width", "height"))


def blur(tiles: DataFrame, weights: list[float], side: int = SIDE) -> DataFrame:
    return separable(tiles, weights, weights, "reflect101", side)


# ---------------------------------------------------------------- warping


def _taps(x: np.ndarray, y: np.ndarray, width: int, height: int, border: str) -> tuple:
    """Fractions of points and their four neighbours (0,0), (1,0), (0,1), (1,1) as y * width + x, -1 outside."""
    x0, y0 = np.floor(x), np.floor(y)

    def inner(i, n):
        if border == "constant":
            return np.where((i >= 0) & (i < n), i, -1)
        if border == "wrap":
            return np.mod(i, n)
        if border == "reflect":
            i = np.where(i < 0, -i - 1, np.where(i > n - 1, 2 * n - 1 - i, i))
        elif border == "reflect101":
            i = np.where(i < 0, -i, np.where(i > n - 1, 2 * n - 2 - i, i))
        return np.clip(i, 0, n - 1)

    four = []
    for k in range(4):
        a, b = inner(x0 + k % 2, width), inner(y0 + k // 2, height)
        four.append(np.where((a < 0) | (b < 0), -1, b * width + a).astype(np.int64))
    return x - x0, y - y0, np.stack(four)


def _pulled(tx: int, ty: int, m, dst_width: int, dst_height: int, width: int, height: int, border: str, side: int) -> tuple:
    """Taps of a destination tile's pixels, and which of these lie in the image."""
    gy, gx = np.mgrid[ty * side : ty * side + side, tx * side : tx * side + side].astype(np.float64)
    with np.errstate(all="ignore"):
        w = m[6] * gx + m[7] * gy + m[8]
        x, y = (m[0] * gx + m[1] * gy + m[2]) / w, (m[3] * gx + m[4] * gy + m[5]) / w
    # what lies beyond any image, or nowhere, is far outside
    x, y = (np.clip(np.where(np.isfinite(v), v, -1e9), -1e9, 1e9).ravel() for v in (x, y))
    inside = ((gx < dst_width) & (gy < dst_height)).ravel()
    return *_taps(x, y, width, height, border), inside


BORDERS = ("constant", "replicate", "reflect", "reflect101", "wrap")
_PARAMS = ("inverse", "dst_width", "dst_height", "width", "height")


def warp(tiles: DataFrame, params: DataFrame, border: str = "constant", value: float = 0.0, side: int = SIDE) -> DataFrame:
    """Tiles of destination images, each pixel bilinear at its place in the source; params is a row for each image.

    params: (image_id, width, height, dst_width, dst_height, inverse), the sizes of source and destination and the matrix
    from destination to source, nine numbers by rows; images differ in all of these. Destination tiles list the source
    tiles they look at, and get of each the pixels they use, four a pixel at most however much the image shrinks. Missing
    pixels count as `value`, with which a constant border is filled.
    """
    if border not in BORDERS:
        raise ValueError(f"unknown border {border}, not one of {BORDERS}")

    @F.pandas_udf("array<struct<tx:int,ty:int>>")
    def sources(dtx: pd.Series, dty: pd.Series, *p: pd.Series) -> pd.Series:
        out = []
        for x, y, m, dw, dh, w, h in zip(dtx, dty, *p, strict=True):
            *_, four, inside = _pulled(x, y, m, dw, dh, w, h, border, side)
            at = np.unique(four[:, inside])
            at = at[at >= 0]
            places = np.unique(np.stack([at % w // side, at // w // side]), axis=1).T.tolist()
            out.append([{"tx": a, "ty": b} for a, b in places])
        return pd.Series(out)

    @F.pandas_udf("struct<at:array<bigint>,v:array<double>>")
    def picked(places: pd.Series, values: pd.Series, tx: pd.Series, ty: pd.Series, dtx: pd.Series, dty: pd.Series, *p: pd.Series) -> pd.DataFrame:
        ats, vs = [], []
        for q, t, a, b, x, y, m, dw, dh, w, h in zip(places, values, tx, ty, dtx, dty, *p, strict=True):
            *_, four, inside = _pulled(x, y, m, dw, dh, w, h, border, side)
            at = np.unique(four[:, inside])
            at = at[(at >= 0) & (at % w // side == a) & (at // w // side == b)]
            ats.append(at)
            vs.append(_dense(q, t, side)[at // w % side, at % w % side])
        return pd.DataFrame({"at": ats, "v": vs})

    @F.pandas_udf("array<double>")
    def drawn(pieces: pd.Series, dtx: pd.Series, dty: pd.Series, *p: pd.Series) -> pd.Series:
        out = []
        for have, x, y, m, dw, dh, w, h in zip(pieces, dtx, dty, *p, strict=True):
            fx, fy, four, inside = _pulled(x, y, m, dw, dh, w, h, border, side)
            have = have if have is not None else []
            at = np.concatenate([np.zeros(0, np.int64), *[np.asarray(s["at"], dtype=np.int64) for s in have]])
            v = np.concatenate([np.zeros(0), *[np.asarray(s["v"], dtype=np.float64) for s in have]])
            order = np.argsort(at)
            at, v = np.append(at[order], np.iinfo(np.int64).max), np.append(v[order], np.nan)
            k = np.searchsorted(at, four)
            got = np.where(at[k] == four, v[k], np.nan)
            got = np.where(np.isnan(got), value, got)
            top, low = got[0] + (got[1] - got[0]) * fx, got[2] + (got[3] - got[2]) * fx
            out.append(np.where(inside, top + (low - top) * fy, np.nan))
        return pd.Series(out)

    many = lambda c: F.sequence(F.lit(0), F.floor((F.col(c) - 1) / side).cast("int"))
    dst = params.select("image_id", *_PARAMS, F.explode(many("dst_width")).alias("dtx"), "dst_height").select("image_id", *_PARAMS, "dtx", F.explode(many("dst_height")).alias("dty"))
    asked = dst.select("*", F.explode(sources("dtx", "dty", *_PARAMS)).alias("s")).select("image_id", "s.tx", "s.ty", "dtx", "dty", *_PARAMS)
    parts = tiles.select(*KEY, "at", "v").join(asked, KEY).select("image_id", "dtx", "dty", picked("at", "v", "tx", "ty", "dtx", "dty", *_PARAMS).alias("s"))
    got = parts.groupBy("image_id", "dtx", "dty").agg(F.collect_list("s").alias("pieces"))
    whole = dst.join(got, ["image_id", "dtx", "dty"], "left")
    return whole.select("image_id", F.col("dtx").alias("tx"), F.col("dty").alias("ty"), F.lit(None).cast("array<int>").alias("at"), drawn("pieces", "dtx", "dty", *_PARAMS).alias("v"))
