"""Laplace filling over tiles, stacks and squares, against whole arrays."""

import numpy as np
import pytest

from rasterloom.operators import harmonic, shapes, solve, stacks


def frame(spark, images, known=None):
    rows = [(k, x, y, float(a[y, x]), bool(known[k][y, x]) if known else True) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, x int, y int, v double, known boolean")


def test_fill_over_tiles(spark):
    """One image of many tiles with a hole of several, others of one tile, none known, all known."""
    rng = np.random.default_rng(2)
    images = {1: rng.random((50, 70)) * 255, 2: rng.random((9, 5)), 3: rng.random((20, 33)), 4: rng.random((18, 18))}
    known = {k: rng.random(a.shape) < 0.3 for k, a in images.items()}
    known[1][10:40, 15:60] = False
    known[3][:] = False
    known[4][:] = True
    sizes = spark.createDataFrame([(k, a.shape[1], a.shape[0]) for k, a in images.items()], "image_id long, width int, height int")
    out = {k: np.full(a.shape, np.nan) for k, a in images.items()}
    for r in harmonic.fill(frame(spark, images, known), sizes, side=16, overlap=8).collect():
        out[r.image_id][r.y, r.x] = r.v
    for k, a in images.items():
        assert out[k] == pytest.approx(solve.laplace_fill(a, known[k], 1e-12), abs=1e-5)


def test_stacks_and_squares(spark):
    rng = np.random.default_rng(6)
    images = {1: rng.integers(0, 2, (9, 13)), 2: np.zeros((11, 8)), 3: np.kron(rng.integers(0, 3, (5, 4)), np.ones((4, 4))), 4: np.ones((1, 1))}
    px = frame(spark, images).drop("known").selectExpr("image_id", "x", "y", "cast(v as int) as v")
    wide = {k: shapes.rectangle_sizes(np.asarray(a)) for k, a in images.items()}
    for r in stacks.stack_sizes(px).collect():
        assert (r.w, r.h) == (wide[r.image_id][0][r.y, r.x], wide[r.image_id][1][r.y, r.x])
    sides = {k: shapes.square_sizes(np.asarray(a))[0] for k, a in images.items()}
    got = stacks.square_sides(px).collect()
    assert len(got) == sum(a.size for a in images.values())
    for r in got:
        assert r.side == sides[r.image_id][r.y, r.x]
