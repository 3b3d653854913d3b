"""Masks as linear quadtrees: set operations and edits on leaves, which never become pixels.

A leaf is (mask_id, level, code): a quad of 2**level pixels that is set, at Morton code `code` among the quads of its
level. The quad that holds it one level up has the code without its last two bits, so a leaf and what holds it meet in an
equi join on (mask_id, level, code): the one side tells its few ancestors, one a level. All leaves are minimal (no four
that make up one quad) on return if they are when given. `top` is the level of the square that spans the largest mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["mask_id", "level", "code"]


# ---------------------------------------------------------------- codes


def _shift(v: str | Column, n: str | Column, left: bool = False) -> Column:
    """v shifted by n bits, both columns."""
    v, n = (F.col(c) if isinstance(c, str) else c for c in (v, n))
    return F.call_function("shiftleft" if left else "shiftright", v.cast("long"), n.cast("int"))


def _spread(v: Column) -> Column:
    """The bits of v, a zero before each: its binary digits read to base four."""
    return F.conv(F.bin(v.cast("long")), 4, 10).cast("long")


def _gather(v: Column) -> Column:
    """Every second bit of v: its digits to base four, all 0 or 1 then, read to base two."""
    keep = sum(1 << b for b in range(0, 62, 2))
    return F.conv(F.conv(v.bitwiseAND(F.lit(keep)).cast("string"), 10, 4), 2, 10).cast("long")


def morton(qx: Column, qy: Column) -> Column:
    """Code of a quad by its column and row among the quads of its level (up to 2**31 each)."""
    return _spread(qx).bitwiseOR(F.shiftleft(_spread(qy), 1))


def leaves(quads: DataFrame) -> DataFrame:
    """Leaves of quads (mask_id, size, qx, qy)."""
    return quads.select("mask_id", F.bit_count(F.col("size") - 1).cast("int").alias("level"), morton(F.col("qx"), F.col("qy")).alias("code"))


def quads(rows: DataFrame) -> DataFrame:
    """Quads (mask_id, size, qx, qy) of leaves."""
    return rows.select("mask_id", F.expr("shiftleft(1L, level)").alias("size"), _gather(F.col("code")).alias("qx"), _gather(F.shiftright("code", 1)).alias("qy"))


def top_of(width: int, height: int) -> int:
    """Level of the square that spans an image."""
    return (max(width, height, 1) - 1).bit_length()


def _ancestors(rows: DataFrame, top: int, own: bool) -> DataFrame:
    """Each leaf (as mask_id, own_level, own_code) with the quads (level, code) that hold it, itself included if `own`."""
    first = F.col("level") if own else F.col("level") + 1
    up = F.filter(F.sequence(F.col("level"), F.greatest(F.lit(top), F.col("level"))), lambda n: n >= first)
    told = rows.select("mask_id", F.col("level").alias("own_level"), F.col("code").alias("own_code"), F.explode(up).alias("level"))
    return told.withColumn("code", _shift("own_code", (F.col("level") - F.col("own_level")) * 2))


def _held(rows: DataFrame, others: DataFrame, top: int, own: bool) -> DataFrame:
    """The leaves that lie within one of the others; each once, as others do not overlap."""
    hit = _ancestors(rows, top, own).join(others.select(KEY), KEY, "left_semi")
    return hit.select("mask_id", F.col("own_level").alias("level"), F.col("own_code").alias("code"))


def _not_held(rows: DataFrame, others: DataFrame, top: int, own: bool) -> DataFrame:
    return rows.select(KEY).join(_held(rows, others, top, own), KEY, "left_anti")


def merge(rows: DataFrame, top: int) -> DataFrame:
    """The fewest leaves of the same area: areas are summed over ancestors in one aggregation, and full quads stay that no full one holds."""
    area = _ancestors(rows, top, True).groupBy(KEY).agg(F.sum(F.expr("shiftleft(1L, 2 * own_level)")).alias("area"))
    full = area.filter("area = shiftleft(1L, 2 * level)").select(KEY)
    held = full.select("mask_id", (F.col("level") - 1).alias("level"), F.col("code").alias("up"))
    return full.withColumn("up", F.shiftright("code", 2)).join(held, ["mask_id", "level", "up"], "left_anti").select(KEY)


# ---------------------------------------------------------------- set operations


def intersect(a: DataFrame, b: DataFrame, top: int) -> DataFrame:
    """Of leaves that meet, the smaller one; of equal ones one. Minimal, since four of a quad would be one in both masks."""
    return _held(a, b, top, True).unionByName(_held(b, a, top, False))


def union(a: DataFrame, b: DataFrame, top: int) -> DataFrame:
    """Leaves that none of the other mask holds, merged."""
    return merge(_not_held(a, b, top, False).unionByName(_not_held(b, a, top, True)), top)


def subtract(a: DataFrame, b: DataFrame, top: int) -> DataFrame:
    """The first mask without the second: leaves are split only where they hold leaves of the second.

    Of such a leaf, all quads on the way to what it holds are opened; their children off the way remain.
    """
    inner = _ancestors(b, top, False).join(a.select(KEY), KEY).select("mask_id", F.col("level").alias("top"), F.col("code").alias("top_code"), "own_level", "own_code")
    way = inner.select("mask_id", "top", "own_level", "own_code", F.explode(F.sequence("own_level", "top")).alias("level"))
    way = way.withColumn("code", _shift("own_code", (F.col("level") - F.col("own_level")) * 2))
    opened = way.filter("level > own_level").select(KEY).distinct()
    off = opened.select("mask_id", (F.col("level") - 1).alias("level"), F.explode(F.array(*[F.shiftleft("code", 2) + k for k in range(4)])).alias("code"))
    touched = way.filter("level < top").select(KEY).distinct()
    apart = _not_held(a, b, top, True).join(inner.select("mask_id", F.col("top").alias("level"), F.col("top_code").alias("code")).distinct(), KEY, "left_anti")
    return apart.unionByName(off.join(touched, KEY, "left_anti"))


def rectangles(sizes: DataFrame) -> DataFrame:
    """Leaves of whole images (mask_id, width, height): for each level the odd column and row at the far edge, and the top quad."""
    level = F.explode(F.sequence(F.lit(0), F.length(F.bin(F.greatest("width", "height").cast("long")))))
    at = sizes.filter("width > 0 and height > 0").select("mask_id", "width", "height", level.alias("level"))
    at = at.select("mask_id", "level", _shift("width", "level").alias("w"), _shift("height", "level").alias("h")).filter("w > 0 and h > 0")
    column = at.filter("w % 2 = 1").select("mask_id", "level", (F.col("w") - 1).alias("qx"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("qy"))
    # without the corner that the column has
    row = at.filter("h % 2 = 1").select("mask_id", "level", F.explode(F.expr("sequence(0L, w - 1)")).alias("qx"), (F.col("h") - 1).alias("qy"), "w").filter("not (w % 2 = 1 and qx = w - 1)").drop("w")
    return column.unionByName(row).select("mask_id", "level", morton(F.col("qx"), F.col("qy")).alias("code"))


def invert(rows: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """The other quads of the images."""
    return subtract(rectangles(sizes), rows, top)


def area(rows: DataFrame) -> DataFrame:
    """(mask_id, count): set pixels, without any pixel."""
    return rows.groupBy("mask_id").agg(F.sum(F.expr("shiftleft(1L, 2 * level)")).alias("count"))


# ---------------------------------------------------------------- lookups


def get(points: DataFrame, rows: DataFrame, top: int) -> DataFrame:
    """points (mask_id, x, y, ...) with `value`: whether a leaf holds the pixel; false beyond the tree."""
    inside = points.filter("x >= 0 and y >= 0").select("mask_id", "x", "y").distinct()
    told = _ancestors(inside.select("mask_id", F.lit(0).alias("level"), morton(F.col("x"), F.col("y")).alias("code")), top, True)
    hit = told.join(rows.select(KEY), KEY, "left_semi").select("mask_id", _gather(F.col("own_code")).cast("int").alias("x"), _gather(F.shiftright("own_code", 1)).cast("int").alias("y"), F.lit(True).alias("value"))
    return points.join(hit, ["mask_id", "x", "y"], "left").withColumn("value", F.coalesce("value", F.lit(False)))


def targets(places: DataFrame) -> DataFrame:
    """(mask_id, t_level, t_code) of places (mask_id, level, qx, qy), one a mask."""
    return places.select("mask_id", F.col("level").alias("t_level"), morton(F.col("qx"), F.col("qy")).alias("t_code"))


def _seen(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Leaves with their mask's place, and how they lie to it: `inside` it, or `over` it."""
    both = rows.select(KEY).join(places, "mask_id")
    inside = (F.col("level") <= F.col("t_level")) & (_shift("code", F.greatest(F.lit(0), (F.col("t_level") - F.col("level")) * 2)) == F.col("t_code"))
    over = (F.col("level") > F.col("t_level")) & (_shift("t_code", F.greatest(F.lit(0), (F.col("level") - F.col("t_level")) * 2)) == F.col("code"))
    return both.withColumns({"inside": inside, "over": over})


def find(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The leaves within the places, or the leaf over one."""
    return _seen(rows, targets(places)).filter("inside or over").select(KEY)


def subtree(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The places as masks of their own: leaves within get codes from the place on, one over it fills it."""
    seen = _seen(rows, targets(places)).filter("inside or over")
    code = F.col("code") - _shift("t_code", F.greatest(F.lit(0), (F.col("t_level") - F.col("level")) * 2), True)
    return seen.select("mask_id", F.when(F.col("over"), F.col("t_level")).otherwise(F.col("level")).alias("level"), F.when(F.col("over"), F.lit(0)).otherwise(code).cast("long").alias("code"))


# ---------------------------------------------------------------- edits


def _bits(v: Column) -> Column:
    return F.when(v > 0, F.length(F.bin(v))).otherwise(0)


def merge_path(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Leaves merged upwards from one place of each mask, the only quads that an edit there can have filled.

    Each leaf adds its area at the lowest quad that it shares with the place; the highest quad that these sums fill
    takes the place of all within.
    """
    both = rows.select(KEY).join(places, "mask_id", "left")
    m = F.greatest("level", "t_level")
    apart = _shift("code", (m - F.col("level")) * 2).bitwiseXOR(_shift("t_code", (m - F.col("t_level")) * 2))
    met = both.withColumn("met", (m + F.ceil(_bits(apart) / 2)).cast("int"))
    sums = met.filter("t_level is not null").groupBy("mask_id", "t_level", "t_code", "met").agg(F.sum(F.expr("shiftleft(1L, 2 * level)")).alias("area"))
    so_far = F.sum("area").over(Window.partitionBy("mask_id").orderBy("met"))  # a row a level
    # the sum stays up to the next level where a leaf joins it
    filled = sums.withColumn("so_far", so_far).filter("so_far = shiftleft(1L, 2 * met)").groupBy("mask_id").agg(F.max("met").alias("fill"))
    new = places.join(filled, "mask_id").select("mask_id", F.col("fill").alias("level"), _shift("t_code", (F.col("fill") - F.col("t_level")) * 2).alias("code"))
    kept = met.join(filled, "mask_id", "left").filter("fill is null or met > fill").select(KEY)
    return kept.unionByName(new)


def set_quads(rows: DataFrame, places: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """Masks with a quad each set, or cleared where `value` is false; places: (mask_id, level, qx, qy, value), clipped to sizes (mask_id, width, height).

    Masks without a place stay; only the leaves at a place, and what its quad fills, are rewritten.
    """
    at = places.select("mask_id", "level", morton(F.col("qx"), F.col("qy")).alias("code"), "value")
    cleared = subtract(rows, at.select(KEY), top)
    new = intersect(rectangles(sizes), at.filter("value").select(KEY), top)
    return merge_path(cleared.unionByName(new), targets(places))


def graft(rows: DataFrame, others: DataFrame, places: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """Masks with the quad at their place (mask_id, level, qx, qy) replaced by the upper left part of the others.

    A place outside its image changes nothing; what reaches beyond the image is cut.
    """
    size = F.expr("shiftleft(1L, level)")
    real = places.join(sizes, "mask_id").filter((F.col("level") >= 0) & (F.col("qx") >= 0) & (F.col("qy") >= 0) & (F.col("qx") * size < F.col("width")) & (F.col("qy") * size < F.col("height"))).select("mask_id", "level", "qx", "qy")
    at = targets(real)
    kept = subtract(rows, at.select("mask_id", F.col("t_level").alias("level"), F.col("t_code").alias("code")), top)
    both = others.select(KEY).join(at, "mask_id")
    small = both.filter("level <= t_level").filter(_shift("code", (F.col("t_level") - F.col("level")) * 2) == 0)
    small = small.select("mask_id", "level", (F.col("code") + _shift("t_code", (F.col("t_level") - F.col("level")) * 2, True)).alias("code"))
    whole = both.filter("level > t_level and code = 0").select("mask_id", F.col("t_level").alias("level"), F.col("t_code").alias("code"))
    return merge_path(kept.unionByName(intersect(rectangles(sizes), small.unionByName(whole), top)), at)


def coarsen(rows: DataFrame, level: int, top: int) -> DataFrame:
    """Quads of the level with a set part become full; level 0 changes nothing."""
    if level > top:
        raise ValueError("larger than the mask's tree")
    up = rows.select("mask_id", F.greatest("level", F.lit(level)).alias("level"), _shift("code", F.greatest(F.lit(0), F.lit(level) - F.col("level")) * 2).alias("code"))
    return merge(up.distinct(), top)
