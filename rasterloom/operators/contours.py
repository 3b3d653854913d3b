"""Contours of masks and of label images: boundary segments as relations, rings by following them per image.

Coordinates are doubled within, so that midpoints of cell sides are whole numbers and joins are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .neighborhood import cell_codes

# Segments of a cell by its code, as (x1, y1, x2, y2) in doubled coordinates from the cell's upper left
# corner; the region lies on the right of a segment.
MITRED = {
    1: [(0, 1, 1, 2)], 2: [(1, 2, 2, 1)], 3: [(0, 1, 2, 1)], 4: [(2, 1, 1, 0)], 6: [(1, 2, 1, 0)], 7: [(0, 1, 1, 0)],
    8: [(1, 0, 0, 1)], 9: [(1, 0, 1, 2)], 11: [(1, 0, 2, 1)], 12: [(2, 1, 0, 1)], 13: [(2, 1, 1, 2)], 14: [(1, 2, 0, 1)],
}
# The two segments of an ambiguous cell by (its code, the code that decides).
AMBIGUOUS = {
    (5, 5): [(0, 1, 1, 0), (2, 1, 1, 2)], (10, 10): [(1, 0, 2, 1), (1, 2, 0, 1)],
    (10, 5): [(1, 0, 0, 1), (1, 2, 2, 1)], (5, 10): [(2, 1, 1, 0), (0, 1, 1, 2)],
}
#: Codes of one or three set corners turn by way of the cell's centre where cells are square.
TURNING = (1, 2, 4, 7, 8, 11, 13, 14)


def _square(code: int) -> list[tuple]:
    """The segments of a cell without mitre: through the centre, the second one marked."""
    (x1, y1, x2, y2), = MITRED[code]
    return [(x1, y1, 1, 1), (1, 1, x2, y2)] if code in TURNING else [(x1, y1, x2, y2)]


def _struct(s: tuple, key: bool) -> Column:
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("sx", "sy", "ex", "ey"), strict=True)], F.lit(key).alias("keystone"))


def segments(cells: DataFrame) -> DataFrame:
    """Segments (sx, sy, ex, ey, keystone) of cells (i, j, code, square, state); other columns are kept.

    state: the code 5 or 10 that decides ambiguous cells.
    """
    none = F.array().cast("array<struct<sx:int,sy:int,ex:int,ey:int,keystone:boolean>>")
    table = F.when(F.lit(False), none)
    for code in MITRED:
        square = F.array(*[_struct(s, k == 1) for k, s in enumerate(_square(code))])
        table = table.when((F.col("code") == code) & F.col("square"), square).when(F.col("code") == code, F.array(*[_struct(s, False) for s in MITRED[code]]))
    for (code, state), segs in AMBIGUOUS.items():
        table = table.when((F.col("code") == code) & (F.col("state") == state), F.array(*[_struct(s, False) for s in segs]))
    keep = [c for c in cells.columns if c not in ("i", "j", "code", "square", "state")]
    out = cells.select(*keep, "i", "j", F.explode(table).alias("s"))
    at = lambda c, o: (F.col(c) * 2 + F.col(f"s.{o}")).cast("int").alias(o)
    return out.select(*keep, at("i", "sx"), at("j", "sy"), at("i", "ex"), at("j", "ey"), "s.keystone")


def mask_cells(mask: DataFrame, width: int | Column, height: int | Column, sizes: DataFrame | None = None) -> DataFrame:
    """Cells of masks (mask_id, x, y): square in the first and last row and the last column; the first ambiguous cell decides for all.

    Of masks of several sizes, width and height are columns of `sizes`, which is joined by mask_id.
    """
    codes = cell_codes(mask)
    cells = (codes if sizes is None else codes.join(sizes, "mask_id")).withColumn("square", (F.col("j") == -1) | (F.col("j") == height - 1) | (F.col("i") == width - 1))
    state = cells.filter("code in (5, 10)").groupBy("mask_id").agg(F.min_by("code", F.struct("j", "i")).alias("state"))
    return cells.join(state, "mask_id", "left")


def label_cells(px: DataFrame, width: int | Column, height: int | Column, sizes: DataFrame | None = None) -> DataFrame:
    """Cells by colour of images (image_id, x, y, color): square where more than two areas meet, the lowest ambiguous colour decides.

    What is off the image is an area of its own, the image's outermost corners another; so is a missing pixel within.
    Of images of several sizes, width and height are columns of `sizes`, which is joined by image_id.
    """
    by_color = cell_codes(px.withColumnRenamed("color", "c"), ["image_id", "c"]).withColumnRenamed("c", "color")
    cell = ["image_id", "i", "j"]
    meet = by_color.groupBy(*cell).agg(F.count("*").alias("areas"), F.sum("code").alias("filled"), F.min_by(F.when(F.col("code").isin(5, 10), F.col("code")), F.when(F.col("code").isin(5, 10), F.col("color"))).alias("state"))
    meet = meet if sizes is None else meet.join(sizes, "image_id")
    left, right, top, low = F.col("i") == -1, F.col("i") == width - 1, F.col("j") == -1, F.col("j") == height - 1
    edge = left | right | top | low
    corner = (left | right) & (top | low)
    # corners of the cell that are off the image, as bits of its code
    off = F.when(left, F.lit(9)).when(right, F.lit(6)).otherwise(0).bitwiseOR(F.when(top, F.lit(12)).when(low, F.lit(3)).otherwise(0))
    missing = F.lit(15) - F.col("filled") - off > 0
    areas = F.col("areas") + edge.cast("int") + (corner | missing).cast("int")
    meet = meet.select(*cell, "state", (areas > 2).alias("square"))
    return by_color.join(meet, cell)


def border_pixels(cells: DataFrame, width: int, height: int, key: str = "mask_id") -> DataFrame:
    """Pixels (key, x, y) that segments touch: the set corners of a cell with one or two of them side by side, else all four."""
    corners = [(0, 0, 8), (1, 0, 4), (1, 1, 2), (0, 1, 1)]
    some = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(b).alias("b")) for x, y, b in corners])
    few = F.col("code").isin(1, 2, 4, 8, 3, 6, 9, 12)
    at = cells.filter("code between 1 and 14").select(key, "i", "j", "code", F.explode(some).alias("c"))
    at = at.filter(~few | (F.col("code").bitwiseAND(F.col("c.b")) > 0))
    at = at.select(key, (F.col("i") + F.col("c.x")).alias("x"), (F.col("j") + F.col("c.y")).alias("y"))
    return at.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).distinct()


def simple_chain(ring: list[tuple]) -> list[tuple]:
    """The ring without points on a straight line between their neighbours."""
    n = len(ring)
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
    kept = [ring[k] for k in range(n) if cross(ring[k - 1], ring[k], ring[(k + 1) % n])]
    return kept or ring


def _farthest(points: list[tuple], a: int, b: int) -> tuple[float, int]:
    """Greatest distance from the line between two points, and where; of equal ones the smaller point."""
    (x1, y1), (x2, y2) = points[a], points[b]
    length = math.hypot(x2 - x1, y2 - y1)
    best = (-1.0, 0)
    for k in range(a + 1, b):
        x, y = points[k]
        d = abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / length if length else math.hypot(x - x1, y - y1)
        if d > best[0] or (d == best[0] and points[k] < points[best[1]]):
            best = (d, k)
    return best


def rdp_chain(ring: list[tuple], keystones: set[tuple], most: float) -> list[tuple]:
    """Ramer-Douglas-Peucker on a ring; keystones, where several areas meet, stay.

    Rings under five points stay as they are. The walk begins at the first keystone, or the smallest point; where the ring
    turns clockwise there, it is walked the other way round, so that areas with a common border simplify it alike.
    """
    n = len(ring)
    if n < 5:
        return ring
    marked = [k for k in range(n) if ring[k] in keystones]
    start = marked[0] if marked else min(range(n), key=lambda k: ring[k])
    ring = ring[start:] + ring[:start]
    a, b, c = ring[-1], ring[0], ring[1]
    turned = (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) < 0
    if turned:
        ring = ring[:1] + ring[:0:-1]
    marked = [k for k in range(n) if ring[k] in keystones]
    stops = sorted({0, *marked}) if len(marked) > 1 else [0, n // 2]
    closed = [*ring, ring[0]]
    keep = set(stops)
    todo = list(zip(stops, [*stops[1:], n], strict=True))
    while todo:
        a, b = todo.pop()
        if b - a < 4:
            keep.update(range(a, b))
            continue
        d, k = _farthest(closed, a, b)
        if d > most:
            keep.add(k)
            todo += [(a, k), (k, b)]
    out = [ring[k] for k in sorted(keep) if k < n]
    return out[:1] + out[:0:-1] if turned else out


def follow(starts, ends) -> list[list[tuple]]:
    """Rings of segments: each begins at its smallest vertex, rings in order of these."""
    after: dict[tuple, list[tuple]] = {}
    for s, e in zip(starts, ends, strict=True):
        after.setdefault(s, []).append(e)
    rings = []
    for first in sorted(after):
        while after[first]:
            ring, at = [first], after[first].pop()
            while at != first:
                ring.append(at)
                if not after.get(at):
                    raise ValueError("a contour is not closed")
                at = after[at].pop()
            rings.append(ring)
    return rings


def rings(segs: DataFrame, keys: list[str], simplification: str = "none", corner: bool = False, most_error: float = 0.9) -> DataFrame:
    """(keys, ring_id, points) from segments, one group for each image and colour.

    simplification: none, simple or rdp. Points are pixel centres, or half a pixel further if pixels' corners are the origin.
    """
    if simplification not in ("none", "simple", "rdp"):
        raise ValueError(f"unknown simplification {simplification}")
    kinds = ", ".join(f"{k} {segs.schema[k].dataType.simpleString()}" for k in keys)
    shift = 0.5 if corner else 0.0

    def walk(key, pdf):
        import pandas as pd

        starts = list(zip(pdf["sx"].tolist(), pdf["sy"].tolist(), strict=True))
        ends = list(zip(pdf["ex"].tolist(), pdf["ey"].tolist(), strict=True))
        keystones = {s for s, k in zip(starts, pdf["keystone"].tolist(), strict=True) if k}
        out = []
        for ring in follow(starts, ends):
            if simplification == "simple":
                ring = simple_chain(ring)
            elif simplification == "rdp":
                ring = rdp_chain(ring, keystones, 2 * most_error)  # doubled coordinates
            out.append([{"x": x / 2 + shift, "y": y / 2 + shift} for x, y in ring])
        frame = pd.DataFrame({"ring_id": range(len(out)), "points": out})
        for k, v in zip(keys, key, strict=True):
            frame[k] = v
        return frame[[*keys, "ring_id", "points"]]

    return segs.groupBy(*keys).applyInPandas(walk, f"{kinds}, ring_id int, points array<struct<x:double,y:double>>")


def find_contour(mask: DataFrame, width: int, height: int, **params) -> DataFrame:
    """Rings (mask_id, ring_id, points) of masks."""
    return rings(segments(mask_cells(mask, width, height)), ["mask_id"], **params)


def find_contours(px: DataFrame, width: int, height: int, **params) -> DataFrame:
    """Rings (image_id, color, ring_id, points) of all colours of label images."""
    return rings(segments(label_cells(px, width, height)), ["image_id", "color"], **params)


def ring_measures(segs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, area8): number of segments and eight times the signed area, without following a ring."""
    cross = F.col("sx") * F.col("ey") - F.col("ex") * F.col("sy")
    return segs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(cross).cast("long").alias("area8"))


def runs(px: DataFrame) -> DataFrame:
    """Width of the run of equal values that ends at each pixel: gaps and islands per row."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    new = (F.lag("v").over(row).isNull() | (F.lag("v").over(row) != F.col("v")) | (F.lag("x").over(row) != F.col("x") - 1)).cast("int")
    marked = px.withColumn("run", new).withColumn("run", F.sum("run").over(row))
    return marked.withColumn("w", F.row_number().over(Window.partitionBy("image_id", "y", "run").orderBy("x"))).drop("run")
