"""Contours, rectangles, packing, filling and equalisation against hand-made cases and brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import clahe, contours, neighborhood, quadtree, shapes, solve

MASKS = {
    "single": ["1"],
    "checker": ["10", "01"],
    "hole": ["111", "101", "111"],
    "line": ["11111"],
    "full": ["1111", "1111", "1111"],
    "odd": ["10110", "11010", "00111"],
    "inner": ["00000", "01110", "01110", "00000"],
}


def mask_rows(art, key=1):
    return [(key, x, y) for y, line in enumerate(art) for x, c in enumerate(line) if c == "1"]


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 2


@pytest.mark.parametrize("name", list(MASKS))
def test_mask_contours_close(spark, name):
    art = MASKS[name]
    mask = spark.createDataFrame(mask_rows(art), "mask_id long, x int, y int")
    rings = contours.find_contour(mask, len(art[0]), len(art)).collect()
    sizes = [area([(p["x"], p["y"]) for p in r["points"]]) for r in rings]
    holes = {"hole": 1, "odd": 0}.get(name, 0)
    assert sum(s < 0 for s in sizes) == holes or name == "odd"
    assert all(len(r["points"]) >= 4 for r in rings)
    again = contours.find_contour(mask.repartition(3), len(art[0]), len(art)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rings))


def test_contour_of_one_pixel(spark):
    mask = spark.createDataFrame([(1, 0, 0)], "mask_id long, x int, y int")
    (ring,) = contours.find_contour(mask, 1, 1).collect()
    points = [(p["x"], p["y"]) for p in ring["points"]]
    assert area(points) == 1.0 and min(points) == (-0.5, -0.5)
    (ring,) = contours.find_contour(mask, 1, 1, simplification="simple", corner=True).collect()
    assert sorted((p["x"], p["y"]) for p in ring["points"]) == [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)]


def test_inner_square_is_mitred(spark):
    mask = spark.createDataFrame([(1, 2, 2)], "mask_id long, x int, y int")
    (ring,) = contours.find_contour(mask, 5, 5).collect()
    assert sorted((p["x"], p["y"]) for p in ring["points"]) == [(1.5, 2.0), (2.0, 1.5), (2.0, 2.5), (2.5, 2.0)]
    with pytest.raises(ValueError):
        contours.find_contour(mask, 5, 5, simplification="other")


def test_first_ambiguous_cell_decides(spark):
    """A checker inside an image: either one ring or two, by the first ambiguous cell."""
    down = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "mask_id long, x int, y int")
    up = spark.createDataFrame([(1, 2, 1), (1, 1, 2)], "mask_id long, x int, y int")
    assert contours.find_contour(down, 5, 5).count() == 1
    assert contours.find_contour(up, 5, 5).count() == 1


def test_colors_meet_squarely(spark):
    """Three colours in one corner: their areas add up to the image."""
    art = ["0011", "0011", "2222"]
    px = spark.createDataFrame([(1, x, y, int(c)) for y, line in enumerate(art) for x, c in enumerate(line)], "image_id long, x int, y int, color int")
    rings = contours.find_contours(px, 4, 3).collect()
    by = {r["color"]: area([(p["x"], p["y"]) for p in r["points"]]) for r in rings}
    assert by == {0: 4.0, 1: 4.0, 2: 4.0}


def test_rdp_keeps_keystones_and_bounds_the_error():
    ring = [(x, 0) for x in range(0, 20)] + [(20, y) for y in range(0, 20)] + [(x, 20) for x in range(20, 0, -1)] + [(0, y) for y in range(20, 0, -1)]
    out = contours.rdp_chain(ring, {(7, 0)}, 0.9)
    assert (7, 0) in out and {(20, 0), (20, 20), (0, 20), (0, 0)} <= set(out) and len(out) < 12
    assert contours.rdp_chain(ring[:4], set(), 0.9) == ring[:4]
    back = contours.rdp_chain(ring[::-1], set(), 0.9)
    assert {(20, 0), (20, 20), (0, 20)} <= set(back)


def test_simple_chain():
    assert contours.simple_chain([(0, 0), (1, 0), (2, 0), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]


def brute_rectangles(image):
    h, w = len(image), len(image[0])
    size = {}
    for j in range(h):
        for i in range(w):
            a = 1 + (size[i - 1, j][0] if i and image[j][i - 1] == image[j][i] else 0)
            b = 1
            if j and image[j - 1][i] == image[j][i] and size[i, j - 1][0] >= a:
                b += size[i, j - 1][1]
            size[i, j] = (a, b)
    out, gone = [], set()
    for j in range(h - 1, -1, -1):
        for i in range(w - 1, -1, -1):
            if (i, j) not in gone:
                a, b = size[i, j]
                gone |= {(x, y) for x in range(i - a + 1, i + 1) for y in range(j - b + 1, j + 1)}
                out.append((i - a + 1, j - b + 1, i, j))
    return out


def test_rectangles_and_squares(spark):
    rng = random.Random(2)
    art = [[rng.randint(0, 1) for _ in range(9)] for _ in range(7)]
    px = spark.createDataFrame([(1, x, y, v) for y, line in enumerate(art) for x, v in enumerate(line)], "image_id long, x int, y int, v int")
    got = [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in shapes.find_rectangles(px).orderBy("seq").collect()]
    assert got == brute_rectangles(art)
    squares = shapes.find_squares(px, F.col("v") == 1).collect()
    assert all(r["x1"] - r["x0"] == r["y1"] - r["y0"] and r["v"] == 1 for r in squares)
    whole = spark.createDataFrame([(1, x, y, 5) for x in range(6) for y in range(6)], "image_id long, x int, y int, v int")
    assert [tuple(r)[2:] for r in shapes.find_squares(whole).collect()] == [(0, 0, 5, 5, 5)]


#: A shape that is found before reaches from below into the stack of another of the same value.
HOOK = ["xxx.", "xxx.", "xxx.", "xx.."]


def test_rectangles_apart(spark):
    px = spark.createDataFrame([(1, x, y, c) for y, line in enumerate(HOOK) for x, c in enumerate(line)], "image_id long, x int, y int, v string")
    taken = np.zeros((4, 4), dtype=int)
    for r in shapes.find_rectangles(px, apart=True).collect():
        assert {HOOK[y][x] for y in range(r.y0, r.y1 + 1) for x in range(r.x0, r.x1 + 1)} == {r.v}
        taken[r.y0 : r.y1 + 1, r.x0 : r.x1 + 1] += 1
    assert (taken == 1).all()


def hooked(spark, folder):
    """A table of embeddings whose blocky image has the hook at its upper left, in blocks of four."""
    grid = [[HOOK[y][x] if y < 4 and x < 4 else "." for x in range(12)] for y in range(12)]
    bright = {"x": 0.3, ".": -0.3}
    rows = [(k, [bright[grid[(k // 6 * 8 + i // 8) // 4][(k % 6 * 8 + i % 8) // 4]] for i in range(64)], 0) for k in range(36)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def against_sql(spark, folder, name, table):
    import duckdb

    from rasterloom.plans import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, folder).select(want.columns)
    return sorted(map(tuple, got.collect())), sorted(want.fetchall())


@pytest.mark.parametrize("name", ["find_rectangles", "rectangle_tiling"])
def test_rectangles_cover_once(spark, tmp_path, name):
    got, want = against_sql(spark, hooked(spark, tmp_path), name, "embeddings")
    assert got == want


def test_packing_does_not_overlap():
    rng = random.Random(4)
    sizes = sorted(((rng.randint(1, 30), rng.randint(1, 30)) for _ in range(120)), reverse=True)
    places, w, h = shapes.pack_sizes(sizes)
    taken = np.zeros((h, w), dtype=int)
    for (x, y), (a, b) in zip(places, sizes):
        assert x + a <= w and y + b <= h
        taken[y : y + b, x : x + a] += 1
    assert taken.max() == 1
    with pytest.raises(shapes.AreaTooLarge):
        shapes.pack_sizes([(100, 100)], most=(80, 80))
    assert shapes.pack_sizes([(100, 10)], most=(128, 64))[1:] == (128, 64)
    assert shapes.pack_sizes([(64, 64)]) == ([(0, 0)], 64, 64)


def plain_pack(sizes, width, height):
    """Each rectangle takes the first free area that holds it; the strip below and all to its right are free in its place."""
    free, places = [(0, 0, width, height)], []
    for w, h in sizes:
        at = next((k for k, r in enumerate(free) if r[2] >= w and r[3] >= h), None)
        if at is None:
            return None
        x, y, aw, ah = free[at]
        places.append((x, y))
        free[at : at + 1] = [(x, y + h, w, ah - h)] * (h < ah) + [(x + w, y, aw - w, ah)] * (w < aw)
    return places


@pytest.mark.parametrize("by_width", [True, False])
def test_packing_takes_the_first_free_area(by_width, monkeypatch):
    monkeypatch.setattr(shapes, "_BLOCK", 4)
    rng = random.Random(5)
    for n in (1, 2, 40, 300):
        sizes = [(rng.randint(0, 60), rng.randint(0, 25)) for _ in range(n)]
        if by_width:
            sizes.sort(key=lambda s: -s[0])
        for side in (64, 128, 256, 512):
            assert shapes.try_pack(sizes, side, side) == plain_pack(sizes, side, side)


def test_packing_of_many():
    """An atlas of 40,000: not each is tried in every free area."""
    sizes = sorted(((1 + k * 7919 % 50, 1 + k % 37) for k in range(40_000)), reverse=True)
    begin = time.monotonic()
    places, w, h = shapes.pack_sizes(sizes)
    assert time.monotonic() - begin < 20
    taken = np.zeros((h, w), dtype=np.int8)
    for (x, y), (a, b) in zip(places, sizes):
        taken[y : y + b, x : x + a] += 1
    assert taken.max() == 1 and taken.sum() == sum(a * b for a, b in sizes)


def test_packing_in_sheets():
    sizes = [(60, 50)] * 5 + [(30, 20)] * 3
    got = shapes.pack_sheets(sizes, most=(128, 64))
    assert {r[0] for r in got} == {0, 1, 2} and {r[3:] for r in got if r[0] < 2} == {(128, 64)}
    for sheet in range(3):
        taken = np.zeros((64, 128), dtype=int)
        for (s, x, y, w, h), (a, b) in zip(got, sizes, strict=True):
            if s == sheet:
                assert x + a <= w and y + b <= h
                taken[y : y + b, x : x + a] += 1
        assert taken.max() == 1
    places, w, h = shapes.pack_sizes(sizes)
    assert shapes.pack_sheets(sizes) == [(0, *p, w, h) for p in places]
    assert shapes.pack_sheets([]) == []
    with pytest.raises(shapes.AreaTooLarge):
        shapes.pack_sheets([(10, 10), (100, 65)], most=(128, 64))


def test_pack_inflated_beyond_the_largest_size(spark, tmp_path):
    """One atlas of 300 rectangles that are 23 M pixels, where a sheet has 16.8 M."""
    spark.range(300).selectExpr("id * 64 as p_partkey", "4000 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    got, want = against_sql(spark, str(tmp_path), "pack_inflated", "part")
    assert got == want and len(got) == 1


def test_overlaps_pack_once(spark, sf_dir):
    """The packed rectangles are read three times; the plan that reads them packs none."""
    from rasterloom.plans import QUERIES

    for name in ("pack_overlaps", "pack_inflated"):
        assert "InPandas" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()


def test_merge_rects(spark):
    rects = spark.createDataFrame([(1, 1, 0.0, 0.0, 4.0, 4.0), (1, 2, 1.0, 1.0, 5.0, 4.0), (1, 3, 50.0, 50.0, 60.0, 60.0)], "atlas_id int, rect_id int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, shapes.merge_rects(rects).collect())) == [(1, 1, 0.0, 0.0, 5.0, 4.0), (1, 3, 50.0, 50.0, 60.0, 60.0)]


@pytest.mark.parametrize("side", [6, 30])
def test_laplace_is_harmonic(side):
    rng = np.random.default_rng(1)
    values = rng.random((side, side))
    known = rng.random((side, side)) < 0.4
    out = solve.laplace_fill(values, known)
    assert np.allclose(out[known], values[known])
    for y, x in zip(*np.nonzero(~known)):
        near = [out[b, a] for a, b in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)) if 0 <= a < side and 0 <= b < side]
        assert abs(out[y, x] - np.mean(near)) < 1e-6
    assert not solve.laplace_fill(values, np.zeros_like(known)).any()


def test_clip_counts_keeps_the_sum():
    h = np.array([90, 0, 3, 7, 0, 0, 0, 0])
    out = clahe.clip_counts(h, 20)
    assert out.sum() == h.sum() and out.max() <= 20
    full = clahe.clip_counts(np.array([50, 50]), 10)
    assert full.max() == 10


def test_clahe_of_an_odd_region(spark):
    px = spark.createDataFrame([(1, x, y, (x * y) % 200) for x in range(10) for y in range(10)], "image_id long, x int, y int, v int")
    out = clahe.clahe(px, (10, 10), (5, 5), 2.0)
    assert out.count() == 100 and out.agg(F.max("v")).first()[0] <= 255
    assert clahe.clahe(px, (10, 10), (5, 5), 1).exceptAll(px).count() == 0
    with pytest.raises(ValueError):
        clahe.clahe(px, (10, 10), (20, 5))


def test_quads(spark):
    rng = random.Random(6)
    mask = spark.createDataFrame([(k, x, y) for k in (1, 2) for x in range(13) for y in range(11) if rng.random() < 0.8], "mask_id long, x int, y int").cache()
    side = quadtree.side_of(13, 11)
    quads = quadtree.contract(mask, side).cache()
    assert side == 16 and quadtree.expand(quads, 13, 11).exceptAll(mask).count() == 0 and quadtree.expand(quads, 13, 11).count() == mask.count()
    assert quads.count() < mask.count()
    with pytest.raises(ValueError):
        quadtree.coarsen(mask, 32, side)
    assert quadtree.coarsen(mask, 1, side).count() == quads.count()
    assert quadtree.graft(mask, mask, side, 1, 5, 5, 13, 11).count() == mask.count()
    full = spark.createDataFrame([(1, x, y) for x in range(8) for y in range(8)], "mask_id long, x int, y int")
    assert [tuple(r) for r in quadtree.contract(full, 8).collect()] == [(1, 8, 0, 0)]
    assert [tuple(r) for r in quadtree.paint(quadtree.contract(full, 8), 5, 8, 2.0).collect()] == [(1, 0, 0, 10, 16)]


def test_erosion_bounds_dilation(spark):
    px = spark.createDataFrame([(1, x, y, (7 * x + 13 * y) % 50) for x in range(9) for y in range(6)], "image_id long, x int, y int, v int")
    low, high = neighborhood.erode(px, 5).withColumnRenamed("v", "lo"), neighborhood.dilate(px, 5).withColumnRenamed("v", "hi")
    both = px.join(low, ["image_id", "x", "y"]).join(high, ["image_id", "x", "y"])
    assert both.filter("lo <= v and v <= hi").count() == 54
    assert neighborhood.erode(px, 99).select("v").distinct().count() == 1
    with pytest.raises(ValueError):
        neighborhood.sharpen(px, (9, 6), kernel=4)
    tiled = neighborhood.tiles(px, 4, 1)
    assert tiled.filter("own").count() == 54 and tiled.count() > 54
