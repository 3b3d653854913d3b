"""Leaves of linear quadtrees against sets of pixels."""

import random

import pytest

from rasterloom.operators import linear as ln
from rasterloom.operators import quadtree

SIZES = {1: (13, 7), 2: (32, 32), 3: (1, 1), 4: (20, 31), 5: (5, 5)}
TOP = 5


def pixels(seed):
    rng = random.Random(seed)
    out = {}
    for k, (w, h) in SIZES.items():
        own = set()
        for _ in range(6):
            x, y, s = rng.randrange(w), rng.randrange(h), rng.choice([1, 2, 4, 8, 16])
            own |= {(a, b) for a in range(x // s * s, min(w, x // s * s + s)) for b in range(y // s * s, min(h, y // s * s + s))}
        out[k] = own if k != 5 else (set() if seed % 2 else {(x, y) for x in range(w) for y in range(h)})
    return out


def contracted(own, top=TOP):
    """Fewest quads, by trying each square from the top."""
    def walk(level, qx, qy):
        s = 1 << level
        held = {(x, y) for x, y in own if x >> level == qx and y >> level == qy}
        if len(held) == s * s:
            return {(s, qx, qy)}
        return set() if not held else set().union(*[walk(level - 1, 2 * qx + i, 2 * qy + j) for i in (0, 1) for j in (0, 1)])

    return walk(top, 0, 0)


@pytest.fixture(scope="module")
def rows(spark):
    def make(own):
        frame = spark.createDataFrame([(k, x, y) for k, m in own.items() for x, y in m], "mask_id long, x int, y int")
        return ln.leaves(quadtree.contract(frame, 1 << TOP))

    return make


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame([(k, w, h) for k, (w, h) in SIZES.items()], "mask_id long, width int, height int")


def same(found, want):
    got = {}
    for r in ln.quads(found).collect():
        assert (r.size, r.qx, r.qy) not in got.setdefault(r.mask_id, set())
        got[r.mask_id].add((r.size, r.qx, r.qy))
    assert got == {k: contracted(v) for k, v in want.items() if v}


@pytest.mark.parametrize("seed", range(4))
def test_sets(rows, sizes, seed):
    a, b = pixels(seed), pixels(seed + 100)
    ra, rb = rows(a).cache(), rows(b).cache()
    same(ln.union(ra, rb, TOP), {k: a[k] | b[k] for k in a})
    same(ln.intersect(ra, rb, TOP), {k: a[k] & b[k] for k in a})
    same(ln.subtract(ra, rb, TOP), {k: a[k] - b[k] for k in a})
    same(ln.invert(ra, sizes, TOP), {k: {(x, y) for x in range(SIZES[k][0]) for y in range(SIZES[k][1])} - a[k] for k in a})
    same(ln.invert(ln.invert(ra, sizes, TOP), sizes, TOP), a)
    same(ln.coarsen(ra, 2, TOP), {k: {(x // 4 * 4 + i, y // 4 * 4 + j) for x, y in v for i in range(4) for j in range(4)} for k, v in a.items()})


@pytest.mark.parametrize("level, qx, qy", [(0, 3, 2), (2, 1, 0), (3, 0, 0), (5, 0, 0), (1, 9, 9)])
def test_edits(spark, rows, sizes, level, qx, qy):
    a, b = pixels(11), pixels(12)
    where = lambda p: (p[0] >> level, p[1] >> level) == (qx, qy)
    full = {k: {(x, y) for x in range(w) for y in range(h)} for k, (w, h) in SIZES.items()}
    places = spark.createDataFrame([(k, level, qx, qy, k != 2) for k in (1, 2, 3, 4)], "mask_id long, level int, qx long, qy long, value boolean")
    ra, rb = rows(a).cache(), rows(b)
    want = {k: {p for p in v if not where(p)} | ({p for p in full[k] if where(p)} if k != 2 else set()) if k != 5 else v for k, v in a.items()}
    same(ln.set_quads(ra, places, sizes, TOP), want)
    x0, y0 = qx << level, qy << level
    inside = {k: x0 < SIZES[k][0] and y0 < SIZES[k][1] and k != 5 for k in SIZES}
    want = {k: {p for p in v if not where(p)} | {p for p in full[k] if where(p) and (p[0] - x0, p[1] - y0) in b[k]} if inside[k] else v for k, v in a.items()}
    same(ln.graft(ra, rb, places.drop("value"), sizes, TOP), want)
    same(ln.subtree(ra, places), {k: {(x - x0, y - y0) for x, y in a[k] if where((x, y))} for k in (1, 2, 3, 4)})


def test_get(spark, rows):
    a = pixels(21)
    points = [(k, x, y) for k in SIZES for x in (-1, 0, 3, 12, 31, 40) for y in (-2, 0, 6, 30, 33)]
    found = ln.get(spark.createDataFrame(points, "mask_id long, x int, y int"), rows(a), TOP).collect()
    assert {(r.mask_id, r.x, r.y): r.value for r in found} == {p: p[1:] in a[p[0]] for p in points}
    assert {r.mask_id: r["count"] for r in ln.area(rows(a)).collect()} == {k: len(v) for k, v in a.items() if v}


def test_no_pixels_in_the_plan(rows):
    """Set operations on leaves explode ancestors, a row a level, and no pixels."""
    plan = ln.subtract(rows(pixels(1)), rows(pixels(2)), TOP)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in plan and "Generate" in plan and "BatchEval" not in plan and "MapIn" not in plan
