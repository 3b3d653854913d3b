"""Codecs by round trip, headers, containers, the data sources and a stream."""

import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry, headers
from rasterloom.sources import files
from rasterloom.sources import formats as fm
from rasterloom.streaming import images


@pytest.mark.parametrize("shape", [(5, 7), (4, 9, 3), (3, 3, 4), (1, 1)])
@pytest.mark.parametrize("level", [-1, 0, 9])
def test_png(shape, level):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    data = fm.png_encode(image, level)
    assert (fm.png_decode(data) == image).all()
    assert fm.dimensions(data) == (shape[1], shape[0])


def test_png_filters_and_16_bits():
    """Each filter by an encoder of its own."""
    rng = np.random.default_rng(2)
    image = rng.integers(0, 65536, (6, 5)).astype(np.uint16)
    raw = image.astype(">u2").view(np.uint8).reshape(6, 10).astype(int)
    rows = b""
    for y in range(6):
        up = raw[y - 1] if y else np.zeros(10, int)
        left = np.concatenate([[0, 0], raw[y][:-2]])
        corner = np.concatenate([[0, 0], up[:-2]])
        p = left + up - corner
        da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        guess = [np.zeros(10, int), left, up, (left + up) // 2, paeth, left][y]
        rows += bytes([[0, 1, 2, 3, 4, 1][y]]) + ((raw[y] - guess) & 255).astype(np.uint8).tobytes()

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + b"\0\0\0\0"

    data = fm.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (fm.png_decode(data) == image).all()


def test_png_errors():
    with pytest.raises(fm.FormatError):
        fm.png_encode_raw(b"123", 2, 2, 1)
    with pytest.raises(fm.FormatError):
        fm.png_decode(b"no")
    with pytest.raises(fm.FormatError):
        fm.png_encode(np.zeros((2, 2), np.uint16))


def gif(image, interlaced=False, local=False):
    """An uncompressed GIF: codes of one size, cleared before they would grow."""
    h, w = image.shape
    order = [y for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, h, b)] if interlaced else range(h)
    acc = have = 0
    out = bytearray()

    def put(code):
        nonlocal acc, have
        acc |= code << have
        have += 9
        while have >= 8:
            out.append(acc & 255)
            acc >>= 8
            have -= 8

    for k, v in enumerate(image[list(order)].reshape(-1).tolist()):
        if k % 100 == 0:
            put(256)
        put(v)
    put(257)
    out.append(acc & 255)
    palette = b"".join(bytes([i, 255 - i, i // 2]) for i in range(256))
    other = bytes(768)
    blocks = b"".join(bytes([len(out[i : i + 255])]) + bytes(out[i : i + 255]) for i in range(0, len(out), 255)) + b"\0"
    head = b"GIF89a" + struct.pack("<HHBBB", w + 2, h + 1, 0xF7, 0, 0) + (other if local else palette) + b"\x21\xf9\x04\0\0\0\0\0"
    return head + b"," + struct.pack("<HHHHB", 1, 1, w, h, (0x40 if interlaced else 0) | (0x87 if local else 0)) + (palette if local else b"") + b"\x08" + blocks + b";"


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("local", [False, True])
def test_gif(interlaced, local):
    image = np.random.default_rng(3).integers(0, 256, (19, 11)).astype(np.uint8)
    data = gif(image, interlaced, local)
    out = fm.gif_decode(data)
    assert out.shape == (20, 13, 3) and (out[1:, 1:12, 0] == image).all() and not out[0].any()
    assert fm.dimensions(data) == (13, 20)


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize("orientation", range(1, 9))
def test_tiff(kind, tile, orientation):
    image = np.random.default_rng(4).integers(0, 255, (21, 18, 3)).astype(kind)
    data = fm.tiff_encode(image, orientation, tile)
    out = fm.tiff_decode(data)
    assert fm.tiff_dimensions(data) == (out.shape[1], out.shape[0])
    w, h = 18, 21
    seen = {1: (0, 0), 2: (w - 1, 0), 3: (w - 1, h - 1), 4: (0, h - 1), 5: (0, 0), 6: (h - 1, 0), 7: (h - 1, w - 1), 8: (0, w - 1)}[orientation]
    assert (out[seen[1], seen[0]] == image[0, 0]).all()
    with pytest.raises(fm.FormatError):
        fm.tiff_decode(b"MM\0\x2bxxxx")


def test_orientation_columns_agree(spark):
    grid = spark.range(12).select((F.col("id") % 4).cast("int").alias("x"), F.expr("cast(id div 4 as int)").alias("y"))
    image = np.arange(12).reshape(3, 4)
    for o in range(1, 9):
        x, y = headers.orient(F.col("x"), F.col("y"), 4, 3, F.lit(o))
        seen = fm.apply_orientation(image, o)
        for r in grid.select("x", "y", x.alias("sx"), y.alias("sy")).collect():
            assert seen[r["sy"], r["sx"]] == image[r["y"], r["x"]]


def test_container_is_read_once(spark, monkeypatch):
    """Thousands of files come out with one pass over the directories, and none is looked for by its name."""
    held = {str(k): bytes([k % 256]) * (k % 3000) for k in range(3000)}
    box = fm.container_write(held)
    passes, parse = [], fm.tiff_directories
    monkeypatch.setattr(fm, "tiff_directories", lambda data: passes.append(1) or parse(data))
    assert dict(fm.container_items(box)) == held and len(passes) == 1
    monkeypatch.undo()
    begin = time.monotonic()
    rows = files.container_entries(spark.createDataFrame([("a", box)], "path string, content binary")).collect()
    assert {r["name"]: bytes(r["content"]) for r in rows} == held and time.monotonic() - begin < 30


def test_container_and_embedded_masks():
    box = fm.container_write({"a": b"first", "b.bin": bytes(range(256)) * 9})
    assert fm.container_names(box) == ["a", "b.bin"] and fm.container_read(box, "b.bin") == bytes(range(256)) * 9
    box = fm.container_append(box, "a", b"other")
    assert fm.container_read(box, "a") == b"other" and len(fm.container_names(box)) == 2
    with pytest.raises(FileNotFoundError):
        fm.container_read(box, "c")
    tiff = fm.tiff_encode(np.zeros((4, 4, 3), np.uint8))
    one = fm.embedded_mask_write(tiff, b"mask one")
    two = fm.embedded_mask_write(one, b"mask two")
    assert fm.embedded_mask_read(two) == b"mask two" and (fm.tiff_decode(two) == 0).all()
    png = fm.embedded_mask_write(fm.png_encode(np.ones((3, 3), np.uint8)), b"m")
    assert fm.embedded_mask_read(png) == b"m" and (fm.png_decode(png) == 1).all()
    with pytest.raises(FileNotFoundError):
        fm.embedded_mask_read(b"\x89PNG")


@pytest.mark.parametrize("shape", [(1, 1), (5, 3), (8, 8), (11, 13)])
def test_masks(shape):
    rng = np.random.default_rng(5)
    for m in (rng.random(shape) < 0.5, np.ones(shape, bool), np.zeros(shape, bool)):
        assert (fm.bitmask_load(fm.bitmask_dump(m)) == m).all()
        assert (fm.treemask_load(fm.treemask_dump(m)) == m).all()
        for start in (0, 3):
            seen = np.zeros((16, 16), bool)
            for _, x, y, s, white in fm.mappedmask_leaves(fm.mappedmask_dump(m, start=start), start=start):
                seen[y : y + s, x : x + s] = white
            assert (seen[: shape[0], : shape[1]] == m).all()
    with pytest.raises(fm.FormatError):
        fm.treemask_load(b"XMASK")


def test_tiff_lzw_by_hand():
    """The format's own example: 7 7 7 8 8 7 7 6 6 is clear, 7, 258, 8, 8, 258, 6, 6, end."""
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert fm._tiff_lzw(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    # enough single codes for the width to grow to ten bits after 253 entries
    codes, width, text = [256, *[k % 256 for k in range(600)], 257], 9, ""
    n = 258
    for k, c in enumerate(codes):
        text += f"{c:0{width}b}"
        n += 1 if k > 1 else 0
        width = 9 if n < 511 else 10 if n < 1023 else 11
    data = int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    assert fm._tiff_lzw(data) == bytes(k % 256 for k in range(600))


def test_image_source_reads_jpeg(spark, tmp_path):
    from rasterloom.sources import files

    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(16, 8, 1)
    for x in range(16):
        for y in range(8):
            image.setRGB(x, y, 200 << 16 | 100 << 8 | 50)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "a.jpg")))
    px = files.pixels(files.read_images(spark, str(tmp_path)), "path").collect()
    assert len(px) == 128 and all(abs(a - b) < 8 for r in px for a, b in zip(r["px"], (200, 100, 50)))


def test_masks_by_hand():
    """Bytes written down from the formats: node codes 0 set, 1 not set, 2 mixed; a mapped tree's header holds depth and tree bytes."""
    tree = b"QMASK\0\0\0" + bytes([3, 0, 0, 0, 2, 0, 0, 0, 4, 0, 0, 0, 5, 0, 0, 0]) + bytes([2, 0, 2, 0, 1, 1, 1, 1, 1])
    want = np.array([[1, 1, 1], [1, 1, 0]], bool)
    assert (fm.treemask_load(tree) == want).all()
    assert fm.treemask_dump(want)[24:] == tree[24:]
    assert fm.treemask_dump(np.ones((2, 2), bool))[24:] == b"\0" and fm.treemask_dump(np.zeros((2, 2), bool))[24:] == b"\1"
    # root: set, mixed, not set, not set; two bytes to the next multiple of four, jump 1, the mixed quarter's byte: its upper left is set
    mapped = b"MQMASK\0\0" + bytes([2, 8, 0, 0, 0]) + bytes([0b11010000, 0, 0, 1, 0, 0, 0, 0b11000000])
    full = np.zeros((4, 4), bool)
    full[:2, :2] = full[0, 2] = True
    assert fm.mappedmask_dump(full) == mapped
    assert {(x, y, s) for _, x, y, s, white in fm.mappedmask_leaves(mapped) if white} == {(0, 0, 2), (2, 0, 1)}
    assert fm.mappedmask_dump(np.ones((4, 4), bool)) == b"MQMASK\0\0" + bytes([2, 1, 0, 0, 0, 255])


def test_random_mask_inverted(spark):
    """A large random mask and its inverse differ everywhere."""
    from rasterloom.operators import masks

    rng = random.Random(0)
    side = 256
    mask = spark.createDataFrame([(1, i % side, i // side) for i in range(side * side) if rng.random() < 0.5], "mask_id long, x int, y int")
    sizes = spark.createDataFrame([(1, side, side)], "mask_id long, width int, height int")
    other = masks.invert(mask, sizes)
    assert masks.intersect(mask, other).count() == 0 and mask.count() + other.count() == side * side
    assert masks.invert(other, sizes).exceptAll(mask).count() == 0


def test_mapped_subtree_and_pruning():
    m = np.zeros((8, 8), bool)
    m[0:4, 4:8] = True
    m[5, 5] = True
    data = fm.mappedmask_dump(m, 1, 1, 1)
    assert {(x, y) for _, x, y, s, w in fm.mappedmask_leaves(data) if w} == {(1, 1)}
    assert fm.mappedmask_dump(m, 1, 9, 9)[-1] == 0
    assert [w for *_, w in fm.mappedmask_leaves(fm.mappedmask_dump(m), 0)] == [None]
    assert len(fm.mappedmask_leaves(fm.mappedmask_dump(m), None, (4, 0, 7, 3))) == 1


def test_other_headers():
    with pytest.raises(fm.FormatError):
        fm.jpeg_dimensions(b"\xff\xd8\xff\xd9")
    with pytest.raises(fm.FormatError):
        fm.dimensions(b"????")
    tags = fm.exif_tags(fm.tiff_encode(np.zeros((2, 3), np.uint8), 6))
    assert tags["0112"] == "6" and tags["0100"] == "3"
    jpeg = b"\xff\xd8\xff\xe1\0\0Exif\0\0" + fm.tiff_encode(np.zeros((2, 3), np.uint8), 8)
    assert fm.exif_tags(jpeg)["0112"] == "8" and fm.exif_tags(b"\xff\xd8") == {}


def test_headers_raise(spark):
    bad = spark.createDataFrame([(bytearray(b"BM"),)], "content binary")
    for f in (headers.image_type, headers.png_size):
        with pytest.raises(Exception):
            bad.select(f(F.col("content"))).collect()
    assert bad.select(headers.path_type(F.lit("a/b.TIFF")), headers.path_type(F.lit("x.bmp"))).first()[:] == (".tiff", None)


def test_geometry_text(spark):
    row = spark.range(1).select(geometry.parse_crop(F.lit("12x7-3+4")).alias("a"), geometry.parse_crop(F.lit("12x7")).alias("b"), geometry.parse_georef(F.lit("1,2,3"), ["x", "y"]).alias("c")).first()
    assert tuple(row["a"]) == (12, 7, -3, 4) and row["b"] is None and row["c"] is None


def test_sources_and_stream(spark, tmp_path):
    files.register(spark)
    folder = tmp_path / "images"
    folder.mkdir()
    image = np.arange(12, dtype=np.uint8).reshape(3, 4)
    rows = [(str(folder / "a.png"), fm.png_encode(image)), (str(folder / "b.tif"), fm.tiff_encode(image.astype(np.uint16) * 257)), (str(folder / "c.gif"), gif(image)), (str(folder / "broken.png"), b"\x89PNG")]
    spark.createDataFrame(rows, "path string, content binary").write.format("image_files").mode("append").save()
    read = files.read_files(spark, str(folder))
    out = {r["path"].rpartition("/")[2]: r for r in files.decode_images(read, permissive=True).collect()}
    assert (out["a.png"]["width"], out["b.tif"]["depth"], out["broken.png"]["width"]) == (4, "uint16", None)
    with pytest.raises(Exception):
        files.decode_images(read).collect()
    eight = files.to_8bit(files.decode_images(read.filter("path like '%.tif'"))).first()
    assert eight["depth"] == "uint8" and bytes(eight["data"])[::3] == image.tobytes()
    box = str(tmp_path / "box.tif")
    spark.createDataFrame([(box, "m", b"123"), (box, "n", b"")], "path string, name string, content binary").coalesce(1).write.format("tiff_container").mode("append").save()
    got = {(r["name"], bytes(r["content"])) for r in spark.read.format("tiff_container").option("path", box).load().collect()}
    assert got == {("m", b"123"), ("n", b"")}
    assert files.container_entries(files.read_files(spark, box)).count() == 2
    query = images.sizes(images.image_stream(spark, str(folder), "[abc].*")).writeStream.format("memory").queryName("sizes").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["mime"], r["size"]["width"]) for r in spark.table("sizes").collect()} == {("image/png", 4), ("image/tiff", 4), ("image/gif", 6)}
