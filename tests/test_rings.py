"""Rings linked and simplified in rounds against following them one by one."""

import math
import random

import pytest

from rasterloom.operators import contours as ct
from rasterloom.operators import rings

SCHEMA = "mask_id long, x int, y int"


def blob(seed, side=60):
    """A large shape with a ragged edge, holes, and single pixels that touch at corners."""
    rng = random.Random(seed)
    phase = [rng.random() * 6 for _ in range(6)]
    inside = set()
    for y in range(side):
        for x in range(side):
            a, r = math.atan2(y - side / 2, x - side / 2), math.hypot(x - side / 2, y - side / 2)
            if r < side * 0.3 + sum(2.5 * math.sin((k + 2) * a + p) for k, p in enumerate(phase)) and (x // 9 + y // 9) % 5:
                inside.add((x, y))
    return inside | {(rng.randrange(side), rng.randrange(side)) for _ in range(40)}


def spiral(side=41):
    """One line wound up: a ring of nearly all pixels."""
    x = y = 0
    dx, dy, seen = 1, 0, {(0, 0)}
    while True:
        a, b = x + dx, y + dy
        if not (0 <= a < side and 0 <= b < side) or (a + dx, b + dy) in seen:
            dx, dy = -dy, dx
            a, b = x + dx, y + dy
            if not (0 <= a < side and 0 <= b < side) or (a + dx, b + dy) in seen or (a, b) in seen:
                return seen
        x, y = a, b
        seen.add((x, y))


@pytest.fixture(scope="module")
def segs(spark):
    masks = {1: blob(1), 2: blob(2), 3: spiral(), 4: {(5, 5)}, 5: {(x, y) for x in range(30) for y in range(30)}}
    rows = [(k, x, y) for k, m in masks.items() for x, y in m]
    return ct.segments(ct.mask_cells(spark.createDataFrame(rows, SCHEMA), 60, 60)).cache()


def expected(segs, change):
    out, rows = {}, segs.collect()
    for key in {r.mask_id for r in rows}:
        own = [r for r in rows if r.mask_id == key]
        stones = {(r.sx, r.sy) for r in own if r.keystone}
        followed = ct.follow([(r.sx, r.sy) for r in own], [(r.ex, r.ey) for r in own])
        out[key] = [change(ring, stones) for ring in followed]
    return out


def got(frame):
    out = {}
    for r in frame.orderBy("mask_id", "ring", "seq").collect():
        out.setdefault(r.mask_id, {}).setdefault(r.ring, []).append((r.x, r.y))
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def test_link(segs):
    linked = rings.link(segs, ["mask_id"])
    assert got(linked) == expected(segs, lambda ring, _: ring)
    assert linked.filter("mask_id = 3").agg({"n": "max"}).first()[0] > 1000


def test_straightened(segs):
    assert got(rings.straightened(rings.link(segs, ["mask_id"]), ["mask_id"])) == expected(segs, lambda ring, _: ct.simple_chain(ring))


@pytest.mark.parametrize("most", [0.9, 3.0])
def test_simplified(segs, most):
    """As sets by ring, and in ring order: the walk may begin elsewhere."""
    kept = got(rings.simplified(rings.link(segs, ["mask_id"]), ["mask_id"], most))
    want = expected(segs, lambda ring, stones: [p for p in ring if p in set(ct.rdp_chain(ring, stones, 2 * most))])
    assert kept == want
    assert sum(map(len, kept[1])) < 0.8 * sum(map(len, expected(segs, lambda ring, _: ring)[1]))


def test_polygons_and_ids(segs):
    linked = rings.link(segs.filter("mask_id in (2, 4)"), ["mask_id"])
    shapes = rings.polygons(rings.numbered(linked, ["mask_id"]), ["mask_id"], corner=True)
    want = ct.rings(segs.filter("mask_id in (2, 4)"), ["mask_id"], corner=True)
    assert sorted(map(tuple, shapes.collect())) == sorted(map(tuple, want.select(shapes.columns).collect()))


def test_stretches(segs, monkeypatch):
    """Stops carried over many stretches of one ring."""
    monkeypatch.setattr(rings, "STRETCH", 8)
    kept = got(rings.simplified(rings.link(segs, ["mask_id"]), ["mask_id"]))
    assert kept == expected(segs, lambda ring, stones: [p for p in ring if p in set(ct.rdp_chain(ring, stones, 1.8))])


def test_open_chain_is_an_error(segs):
    first = segs.filter("mask_id = 4").limit(1)
    with pytest.raises(ValueError, match="not closed"):
        rings.link(segs.filter("mask_id = 4").exceptAll(first), ["mask_id"])
