"""Tiles against whole arrays: halos, borders, missing pixels, images of many sizes."""

import numpy as np
import pytest

from rasterloom.operators import mixed, tiles

SIDE = 8


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(3)
    return {k: rng.integers(0, 256, s).astype(float) for k, s in {1: (20, 33), 2: (8, 8), 3: (1, 30), 4: (17, 3)}.items()}


@pytest.fixture(scope="module")
def px(spark, images):
    return spark.createDataFrame([(k, x, y, float(a[y, x])) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id long, x int, y int, v double").cache()


@pytest.fixture(scope="module")
def sizes(spark, images):
    return spark.createDataFrame([(k, a.shape[1], a.shape[0]) for k, a in images.items()], "image_id long, width int, height int")


def arrays(frame, images, shapes=None):
    out = {k: np.full(shapes[k] if shapes else a.shape, np.nan) for k, a in images.items()}
    for r in frame.collect():
        out[r.image_id][r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("kernel, grow", [(3, False), (7, True), (17, False)])
def test_morphology(px, images, kernel, grow):
    out = arrays(tiles.to_pixels(tiles.morphology(tiles.from_pixels(px, SIDE), kernel, grow, SIDE), SIDE), images)
    r, best = kernel // 2, np.max if grow else np.min
    for k, a in images.items():
        want = [[best(a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]) for x in range(a.shape[1])] for y in range(a.shape[0])]
        assert np.array_equal(out[k], want)


def test_missing_pixels(spark, px, images):
    some = px.filter("(x * 7 + y * 3 + image_id) % 5 <> 0")
    out = arrays(tiles.to_pixels(tiles.erode(tiles.from_pixels(some, SIDE), 5, SIDE), SIDE), images)
    for k, a in images.items():
        y, x = np.mgrid[: a.shape[0], : a.shape[1]]
        b = np.where((x * 7 + y * 3 + k) % 5 == 0, np.nan, a)
        want = [[np.nanmin(b[max(0, j - 2) : j + 3, max(0, i - 2) : i + 3]) if not np.isnan(b[j, i]) else np.nan for i in range(a.shape[1])] for j in range(a.shape[0])]
        assert np.array_equal(out[k], want, equal_nan=True)


@pytest.mark.parametrize("edge, mode", [("reflect101", "reflect"), ("replicate", "edge")])
def test_separable(px, sizes, images, edge, mode):
    wx, wy = [1.0, 2.0, 4.0, 2.0, 1.0], [1.0, 3.0, 1.0]
    t = tiles.sized(tiles.from_pixels(px, SIDE), sizes)
    out = arrays(tiles.to_pixels(tiles.separable(t, wx, wy, edge, SIDE), SIDE), images)
    blurred = arrays(mixed.blur(px, sizes, wy), images)
    for k, a in images.items():
        h, w = a.shape
        pad = np.pad(np.pad(a, ((0, 0), (2, 2)), mode), ((1, 1), (0, 0)), mode)
        want = sum(wy[j] * wx[i] * pad[j : j + h, i : i + w] for j in range(3) for i in range(5))
        assert np.allclose(out[k], want, atol=1e-9)
        both = np.pad(a, 1, "reflect" if min(a.shape) > 1 else "edge") if min(a.shape) > 1 else np.pad(np.pad(a, ((0, 0), (1, 1)), "reflect"), ((1, 1), (0, 0)), "edge")
        assert np.allclose(blurred[k], sum(wy[j] * wy[i] * both[j : j + h, i : i + w] for j in range(3) for i in range(3)), atol=1e-9)


@pytest.mark.parametrize("border", tiles.BORDERS)
def test_warp(spark, px, images, border):
    """Tiles and pixels agree with each other, and with a plain loop."""
    rng = np.random.default_rng(5)
    rows, shapes = [], {}
    for k, a in images.items():
        m = [0.7 + 0.2 * k, 0.1, -2.5, -0.05, 1.1, -1.25, 0.002 * (k % 2), 0.001, 1.0]
        shapes[k] = (int(rng.integers(5, 30)), int(rng.integers(5, 30)))
        rows.append((k, a.shape[1], a.shape[0], shapes[k][1], shapes[k][0], m))
    params = spark.createDataFrame(rows, "image_id long, width int, height int, dst_width int, dst_height int, inverse array<double>")
    out = arrays(tiles.to_pixels(tiles.warp(tiles.from_pixels(px, SIDE), params, border, 9.0, SIDE), SIDE), images, shapes)
    flat = arrays(mixed.warp(px, params, border, 9), images, shapes)

    def inner(i, n):
        if border == "wrap":
            return i % n
        if border == "constant":
            return i if 0 <= i < n else None
        if border == "reflect":
            i = -i - 1 if i < 0 else 2 * n - 1 - i if i > n - 1 else i
        elif border == "reflect101":
            i = -i if i < 0 else 2 * n - 2 - i if i > n - 1 else i
        return max(0, min(n - 1, i))

    for k, w, h, dw, dh, m in rows:
        for y in range(dh):
            for x in range(dw):
                d = m[6] * x + m[7] * y + m[8]
                sx, sy = (m[0] * x + m[1] * y + m[2]) / d, (m[3] * x + m[4] * y + m[5]) / d
                x0, y0 = int(np.floor(sx)), int(np.floor(sy))
                v = []
                for j in (0, 1):
                    for i in (0, 1):
                        a, b = inner(x0 + i, w), inner(y0 + j, h)
                        v.append(9.0 if a is None or b is None else images[k][b, a])
                top, low = v[0] + (v[1] - v[0]) * (sx - x0), v[2] + (v[3] - v[2]) * (sx - x0)
                assert out[k][y, x] == pytest.approx(top + (low - top) * (sy - y0), abs=1e-9)
                assert abs(flat[k][y, x] - np.floor(out[k][y, x] + 1e-9)) <= (abs(out[k][y, x] - round(out[k][y, x])) < 1e-6)


def test_only_halos_move(px):
    """Pixels are shuffled once into tiles, which are read twice, and then strips alone; the tiles of the join are not."""
    t = tiles.from_pixels(px, SIDE)
    spark = px.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tiles.with_halo(t, 2, SIDE)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tiles_moved = [x for x in plan.splitlines() if "Exchange" in x]
    assert len(tiles_moved) == 3
    with pytest.raises(ValueError):
        tiles.with_halo(t, SIDE + 1, SIDE)
