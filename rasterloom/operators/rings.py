"""Rings of contours as relations of vertices: linked and simplified in rounds over all rings at once, none a task of its own.

Coordinates are doubled, as segments have them; a vertex is one long, x above y, so the least one is the lexicographically
smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rounds import settled

_HALF = 1 << 30
#: Places of a ring that are looked at together when stops are carried along it.
STRETCH = 4096


def _vertex(x: str, y: str) -> Column:
    return F.shiftleft(F.col(x).cast("long") + _HALF, 31) + F.col(y).cast("long") + _HALF


def _xy(v: str) -> tuple[Column, Column]:
    return (F.shiftright(F.col(v), 31) - _HALF).cast("int"), (F.col(v).bitwiseAND(F.lit((1 << 31) - 1)) - _HALF).cast("int")


def link(segs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, n, seq, x, y, keystone): vertices of closed rings in order; ring is the least vertex, at which seq is 0.

    segs: (keys, sx, sy, ex, ey, keystone), each vertex the begin of one segment and the end of one. Every vertex knows
    the least vertex of a stretch that begins at it and how far it lies; a round doubles all stretches by one equi join.
    Once no least vertex changes, stretches that follow each other all round the ring have the same one, which is the
    ring's, so the number of rounds is the logarithm of the longest ring. Segments that close no ring are an error.
    """
    at = settled(segs.select(*keys, _vertex("sx", "sy").alias("v"), _vertex("ex", "ey").alias("next"), "keystone"))
    loose = at.select(*keys, F.col("next").alias("v")).join(at, [*keys, "v"], "left_anti")
    if not loose.isEmpty():
        raise ValueError("a contour is not closed")
    state = at.select(*keys, "v", F.col("next").alias("to"), F.col("v").alias("least"), F.lit(0).cast("long").alias("far"))
    step = 1
    while True:
        ahead = state.select(*keys, F.col("v").alias("to"), F.col("to").alias("to_"), F.col("least").alias("least_"), F.col("far").alias("far_"))
        smaller = F.col("least_") < F.col("least")
        both = state.join(ahead, [*keys, "to"])
        state = settled(both.select(*keys, "v", F.col("to_").alias("to"), F.least("least", "least_").alias("least"), F.when(smaller, F.col("far_") + step).otherwise(F.col("far")).alias("far"), smaller.alias("moved")))
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
        step *= 2
    sizes = state.groupBy(*keys, "least").agg(F.count("*").alias("n"))
    placed = state.join(sizes, [*keys, "least"]).join(at.select(*keys, "v", "keystone"), [*keys, "v"])
    x, y = _xy("v")
    return placed.select(*keys, F.col("least").alias("ring"), "n", ((F.col("n") - F.col("far")) % F.col("n")).alias("seq"), x.alias("x"), y.alias("y"), "keystone")


def ring_ids(rings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, ring_id): the rings of each key, counted in order of their least vertices."""
    return rings.filter("seq = 0").select(*keys, "ring").withColumn("ring_id", F.row_number().over(Window.partitionBy(*keys).orderBy("ring")) - 1)


def numbered(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Vertices with ring_id instead of `ring`."""
    return rings.join(ring_ids(rings, keys), [*keys, "ring"]).drop("ring")


def polygons(rings: DataFrame, keys: list[str], corner: bool = False) -> DataFrame:
    """(keys, ring_id, points) of numbered vertices: pixel centres, or half a pixel further."""
    shift = 0.5 if corner else 0.0
    point = F.struct("seq", (F.col("x") / 2 + shift).alias("x"), (F.col("y") / 2 + shift).alias("y"))
    points = F.transform(F.sort_array(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return rings.groupBy(*keys, "ring_id").agg(points.alias("points"))


def straightened(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Vertices that are not on a straight line between their neighbours; rings of straight lines alone stay."""
    ring = [*keys, "ring"]
    told = rings.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d")).withColumn("at", F.pmod(F.col("seq") - F.col("d"), F.col("n")))
    part = lambda d, c: F.max(F.when(F.col("d") == d, F.col(c)))
    near = told.groupBy(*ring, F.col("at").alias("seq")).agg(*[part(d, c).alias(f"{c}{i}") for i, d in enumerate((1, -1)) for c in "xy"])
    # told by d = 1: the next one's place, so seq - 1 hears of seq
    both = rings.join(near, [*ring, "seq"])
    turn = (F.col("x") - F.col("x1")) * (F.col("y0") - F.col("y")) - (F.col("y") - F.col("y1")) * (F.col("x0") - F.col("x"))
    kept = both.withColumn("turn", turn != 0)
    some = kept.groupBy(*ring).agg(F.max("turn").alias("some"))
    return kept.join(some, ring).filter("turn or not some").select(rings.columns)


def _stops(rows: DataFrame, ring: list[str]) -> DataFrame:
    """rows (ring, p, n, stop) with a, the last stop before p, and b, the next one after it, or n.

    Within stretches of a ring by windows; what lies before and after a stretch is carried over a row for each of them.
    """
    part = F.expr(f"p div {STRETCH}").alias("part")
    rows = rows.withColumn("part", part)
    own = F.when(F.col("stop"), F.col("p"))
    ends = rows.groupBy(*ring, "part").agg(F.max(own).alias("last"), F.min(own).alias("first"))
    over = Window.partitionBy(*ring).orderBy("part")
    ends = ends.select(*ring, "part", F.max("last").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min("first").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    w = Window.partitionBy(*ring, "part").orderBy("p")
    a = F.max(own).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = F.min(own).over(w.rowsBetween(1, Window.unboundedFollowing))
    both = rows.withColumns({"a": a, "b": b}).join(ends, [*ring, "part"])
    return both.withColumns({"a": F.coalesce("a", "before"), "b": F.coalesce("b", "after", "n")}).drop("part", "before", "after")


def simplified(rings: DataFrame, keys: list[str], most_error: float = 0.9) -> DataFrame:
    """The vertices that Ramer-Douglas-Peucker keeps of linked rings, with their old places in seq.

    Rings under five vertices stay. A ring begins at its first keystone, or its least vertex, and is taken the other way
    round if it turns clockwise there, so that areas simplify a common border alike. It is cut at its keystones; at its
    begin and half of its vertices if it has one at most. All open chains of all rings are handled at once: one grouped
    maximum finds the farthest vertex of each, of equals the least one; beyond the error it is kept and parts the chain.
    Chains of fewer than four steps keep all.
    """
    ring = [*keys, "ring"]
    info = rings.groupBy(*ring).agg(F.coalesce(F.min(F.when(F.col("keystone"), F.col("seq"))), F.lit(0).cast("long")).alias("begin"), F.count_if("keystone").alias("stones"))
    rows = rings.join(info, ring)
    nth = lambda k, c: F.max(F.when(F.col("seq") == F.pmod(F.col("begin") + k, F.col("n")), F.col(c)))
    near = rows.groupBy(*ring).agg(*[nth(k, c).cast("long").alias(f"{c}{k + 1}") for k in (-1, 0, 1) for c in "xy"])
    turned = (F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y1")) - (F.col("y1") - F.col("y0")) * (F.col("x2") - F.col("x1")) < 0
    rows = rows.join(near.select(*ring, turned.alias("turned")), ring)
    p = F.pmod(F.col("seq") - F.col("begin"), F.col("n"))
    rows = rows.withColumn("p", F.when(F.col("turned"), F.pmod(-p, F.col("n"))).otherwise(p))
    stop = F.when(F.col("stones") > 1, F.col("keystone")).otherwise((F.col("p") == 0) | (F.col("p") == F.expr("n div 2")))
    rows = settled(rows.withColumn("stop", stop | (F.col("p") == 0)).select(*ring, "n", "seq", "p", "x", "y", "keystone", "stop"))
    few = rows.filter("n < 5")
    rows = rows.filter("n >= 5")
    kept = few.select(*ring, "seq").unionByName(rows.filter("stop").select(*ring, "seq"))
    chains = _stops(rows, ring).filter("not stop").select(*ring, "n", "seq", "p", "x", "y", "a", "b")
    spot = rows.filter("stop").select(*ring, "p", "x", "y")
    ends = lambda c: spot.select(*ring, F.col("p").alias(f"{c}_"), F.col("x").cast("long").alias(f"{c}x"), F.col("y").cast("long").alias(f"{c}y"))
    chains = chains.withColumn("a_", F.col("a")).withColumn("b_", F.col("b") % F.col("n"))
    chain = [*ring, "a", "b"]
    state = settled(chains.join(ends("a"), [*ring, "a_"]).join(ends("b"), [*ring, "b_"]).drop("a_", "b_", "n"))
    while not state.isEmpty():
        short = state.filter("b - a < 4")
        kept = kept.unionByName(short.select(*ring, "seq"))
        dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
        across = F.abs(dx * (F.col("ay") - F.col("y")) - (F.col("ax") - F.col("x")) * dy)
        away = F.when((dx == 0) & (dy == 0), F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))).otherwise(across / F.sqrt((dx * dx + dy * dy).cast("double")))
        best = F.max(F.struct(away.alias("d"), (-F.col("x")).alias("x"), (-F.col("y")).alias("y"), "p", "seq")).alias("f")
        cuts = settled(state.filter("b - a >= 4").groupBy(*chain).agg(best).filter(F.col("f.d") > 2 * most_error).select(*chain, F.col("f.p").alias("k"), (-F.col("f.x")).cast("long").alias("kx"), (-F.col("f.y")).cast("long").alias("ky"), F.col("f.seq").alias("kseq")))
        kept = kept.unionByName(cuts.select(*ring, F.col("kseq").alias("seq")))
        both = state.join(cuts, chain).filter("p <> k")
        low = F.col("p") < F.col("k")
        pick = lambda yes, no: F.when(low, F.col(yes)).otherwise(F.col(no))  # noqa: B023, E731
        new = both.select(*ring, "seq", "p", "x", "y", pick("a", "k").alias("a"), pick("k", "b").alias("b"), pick("ax", "kx").alias("ax"), pick("ay", "ky").alias("ay"), pick("kx", "bx").alias("bx"), pick("ky", "by").alias("by"))
        state = settled(new)
    return rings.join(kept.distinct(), [*ring, "seq"], "left_semi")
