"""Readers and writers of image and mask formats, over bytes in memory; NumPy and the standard library only."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


class FormatError(ValueError):
    """The bytes are not what the format asks for."""


# ------------------------------------------------------------------ PNG


def png_encode(image: np.ndarray, level: int = -1) -> bytes:
    """8-bit gray (h, w), RGB or RGBA (h, w, 3 or 4) as PNG; levels 0 to 9, others as the library's default."""
    channels = 1 if image.ndim == 2 else image.shape[2]
    kind = {1: 0, 3: 2, 4: 6}.get(channels)
    if kind is None or image.dtype != np.uint8:
        raise FormatError("only 8-bit gray, RGB and RGBA images are written")
    h, w = image.shape[:2]
    rows = np.zeros((h, w * channels + 1), dtype=np.uint8)
    rows[:, 1:] = image.reshape(h, -1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    packed = zlib.compress(rows.tobytes(), level if 0 <= level <= 9 else -1)
    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")


def png_encode_raw(data: bytes, width: int, height: int, channels: int, level: int = -1) -> bytes:
    """PNG of interleaved bytes; an error if their number is not width * height * channels."""
    if len(data) != width * height * channels:
        raise FormatError("the number of bytes does not match the size")
    shape = (height, width) if channels == 1 else (height, width, channels)
    return png_encode(np.frombuffer(data, dtype=np.uint8).reshape(shape), level)


def png_decode(data: bytes) -> np.ndarray:
    """PNG without interlacing to (h, w) or (h, w, c); palettes become RGB, 16 bits stay 16."""
    if data[:8] != PNG_SIGNATURE:
        raise FormatError("not a PNG")
    at, packed, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed += body
        at += size + 12
    if head is None or head[6]:
        raise FormatError("no header, or interlaced")
    w, h, bits, kind = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    pixel, line = max(1, bits * channels // 8), -(-w * channels * bits // 8)
    raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(h, line + 1)
    out = np.zeros((h, line), dtype=np.uint8)
    above = np.zeros(line, dtype=np.uint8)
    for y in range(h):
        out[y] = _unfilter(raw[y, 0], raw[y, 1:], above, pixel)
        above = out[y]
    if bits == 16:
        image = out.view(">u2").astype(np.uint16)
    elif bits < 8:
        image = np.unpackbits(out, axis=1).reshape(h, -1, bits)
        image = (image * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, : w * channels]
    else:
        image = out
    image = image.reshape(h, w) if channels == 1 else image.reshape(h, w, channels)
    return palette[image] if kind == 3 else image


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, pixel: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    out = row.astype(np.int64)
    up = above.astype(np.int64)
    if kind == 1:
        n = len(out)
        cols = np.zeros((-(-n // pixel), pixel), dtype=np.int64)
        cols.reshape(-1)[:n] = out
        return (np.cumsum(cols, axis=0).reshape(-1)[:n] & 255).astype(np.uint8)
    for i in range(len(out)):
        left = out[i - pixel] if i >= pixel else 0
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            corner = up[i - pixel] if i >= pixel else 0
            p = left + up[i] - corner
            guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)


# ------------------------------------------------------------------ GIF


def gif_decode(data: bytes) -> np.ndarray:
    """First frame of a GIF on its screen, RGB; a frame's own palette counts before the global one."""
    if data[:3] != b"GIF":
        raise FormatError("not a GIF")
    sw, sh, flags = struct.unpack("<HHB", data[6:11])
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data[at : at + 3 * n], dtype=np.uint8).reshape(n, 3)
        at += 3 * n
    while at < len(data):
        if data[at] == 0x21:
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
        elif data[at] == 0x2C:
            left, top, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            if own & 0x80:
                n = 2 << (own & 7)
                palette = np.frombuffer(data[at : at + 3 * n], dtype=np.uint8).reshape(n, 3)
                at += 3 * n
            bits, at, packed = data[at], at + 1, bytearray()
            while data[at]:
                packed += data[at + 1 : at + 1 + data[at]]
                at += data[at] + 1
            if palette is None:
                raise FormatError("no palette")
            index = _lzw(bytes(packed), bits, w * h).reshape(h, w)
            if own & 0x40:
                rows = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
                seen = np.empty_like(index)
                seen[rows] = index
                index = seen
            screen = np.zeros((sh, sw, 3), dtype=np.uint8)
            part = palette[index][: max(0, sh - top), : max(0, sw - left)]
            screen[top : top + part.shape[0], left : left + part.shape[1]] = part
            return screen
        else:
            break
    raise FormatError("no image")


def _lzw(data: bytes, bits: int, n: int) -> np.ndarray:
    clear, end = 1 << bits, (1 << bits) + 1
    table: list[bytes] = []
    out, last, size, acc, have = bytearray(), None, bits + 1, 0, 0
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    for byte in data:
        acc |= byte << have
        have += 8
        while have >= size:
            code, acc, have = acc & ((1 << size) - 1), acc >> size, have - size
            if code == clear:
                table, size, last = table[: clear + 2], bits + 1, None
                continue
            if code == end or len(out) >= n:
                have = 0
                break
            if code < len(table):
                entry = table[code]
            elif last is not None and code == len(table):
                entry = last + last[:1]
            else:
                raise FormatError("broken code")
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            last = entry
    out = out[:n] + bytes(max(0, n - len(out)))
    return np.frombuffer(bytes(out), dtype=np.uint8)


# ------------------------------------------------------------------ TIFF

_TIFF_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_TIFF_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
# Tag numbers.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DOCUMENT_NAME, STRIPS, ORIENTATION, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 269, 273, 274, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 317, 322, 323, 324, 325


def tiff_directories(data: bytes) -> list[dict[int, tuple]]:
    """All directories: tag to (type, values). Rationals are (num, den) pairs, text is bytes."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise FormatError("not a TIFF")
    at, out, seen = struct.unpack(order + "I", data[4:8])[0], [], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
            size = _TIFF_SIZE.get(kind, 1) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
            raw = data[place : place + size]
            if kind in (2, 7):
                tags[tag] = (kind, raw)
            elif kind in (5, 10):
                v = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, raw)
                tags[tag] = (kind, tuple(zip(v[::2], v[1::2], strict=True)))
            else:
                tags[tag] = (kind, struct.unpack(order + _TIFF_CODE.get(kind, "B") * count, raw))
        out.append(tags)
        (at,) = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])
    return out


def _one(tags: dict, tag: int, default=None):
    return tags[tag][1][0] if tag in tags else default


def tiff_dimensions(data: bytes) -> tuple[int, int]:
    tags = tiff_directories(data)[0]
    w, h = _one(tags, WIDTH), _one(tags, HEIGHT)
    return (h, w) if _one(tags, ORIENTATION, 1) >= 5 else (w, h)


def apply_orientation(image: np.ndarray, orientation: int) -> np.ndarray:
    """The image as it is seen: 1 as stored, 2 to 4 mirrored or turned by half, 5 to 8 with axes swapped."""
    if orientation in (2, 3):
        image = image[:, ::-1]
    if orientation in (3, 4):
        image = image[::-1]
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
        if orientation in (6, 7):
            image = image[:, ::-1]
        if orientation in (7, 8):
            image = image[::-1]
    return np.ascontiguousarray(image)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def _tiff_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first: 256 clears, 257 ends; a code gets longer one entry before the table is full."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code > len(table) or not table:
            raise FormatError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
            width = min(12, (len(table) + 1).bit_length())
        last = entry
    return bytes(out)


def tiff_decode(data: bytes) -> np.ndarray:
    """Strips or tiles of 8 or 16 bits to (h, w, 3) RGB, oriented; plain, PackBits, LZW or deflated."""
    order = "<" if data[:2] == b"II" else ">"
    tags = tiff_directories(data)[0]
    w, h, bits, n = _one(tags, WIDTH), _one(tags, HEIGHT), _one(tags, BITS, 1), _one(tags, SAMPLES, 1)
    if bits not in (8, 16):
        raise FormatError(f"{bits} bits a sample are not read")
    kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
    unpack = {1: bytes, 5: _tiff_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}.get(_one(tags, COMPRESSION, 1))
    if unpack is None:
        raise FormatError("the compression is not read")
    tiled = TILES in tags
    tw, th = (_one(tags, TILE_WIDTH), _one(tags, TILE_HEIGHT)) if tiled else (w, min(h, _one(tags, ROWS_PER_STRIP, h)))
    across = -(-w // tw)
    image = np.zeros((h, w, n), dtype=kind.newbyteorder("="))
    for k, (at, size) in enumerate(zip(tags[TILES if tiled else STRIPS][1], tags[TILE_BYTES if tiled else STRIP_BYTES][1], strict=True)):
        x, y = k % across * tw, k // across * th
        rows = th if tiled else min(th, h - y)
        part = np.frombuffer(unpack(data[at : at + size]), dtype=kind)[: rows * tw * n].reshape(rows, tw, n)
        if _one(tags, PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        image[y : y + rows, x : x + tw] = part[: h - y, : w - x]
    if _one(tags, PHOTOMETRIC, 1) == 0:
        image = np.iinfo(image.dtype).max - image
    image = image[:, :, :3] if n >= 3 else np.repeat(image[:, :, :1], 3, axis=2)
    return apply_orientation(image, _one(tags, ORIENTATION, 1))


def tiff_encode(image: np.ndarray, orientation: int = 1, tile: int | None = None) -> bytes:
    """8- or 16-bit image (h, w[, c]) as an uncompressed TIFF in strips, or in square tiles."""
    image = image if image.ndim == 3 else image[:, :, None]
    h, w, n = image.shape
    bits = image.dtype.itemsize * 8
    if tile:
        blocks = [np.pad(image[y : y + tile, x : x + tile], ((0, max(0, y + tile - h)), (0, max(0, x + tile - w)), (0, 0))) for y in range(0, h, tile) for x in range(0, w, tile)]
    else:
        blocks = [image[y : y + 16] for y in range(0, h, 16)]
    body = [b.astype(image.dtype.newbyteorder("<")).tobytes() for b in blocks]
    starts = np.cumsum([8, *map(len, body)])
    tags = {WIDTH: [w], HEIGHT: [h], BITS: [bits] * n, COMPRESSION: [1], PHOTOMETRIC: [2 if n >= 3 else 1], ORIENTATION: [orientation], SAMPLES: [n]}
    tags |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILES: list(starts[:-1]), TILE_BYTES: [len(b) for b in body]} if tile else {STRIPS: list(starts[:-1]), ROWS_PER_STRIP: [16], STRIP_BYTES: [len(b) for b in body]}
    return _tiff_file(b"".join(body), [{t: (4, struct.pack(f"<{len(v)}I", *map(int, v)), len(v)) for t, v in tags.items()}])


def _tiff_file(body: bytes, directories: list[dict[int, tuple[int, bytes, int]]]) -> bytes:
    """Header, body, then directories of tag: (type, bytes, count)."""
    out = bytearray(b"II*\0\0\0\0\0" + body)
    link = 4
    for tags in directories:
        out += b"\0" * (len(out) % 2)
        at = len(out)
        out[link : link + 4] = struct.pack("<I", at)
        far = at + 2 + 12 * len(tags) + 4
        head, tail = struct.pack("<H", len(tags)), b""
        for tag in sorted(tags):
            kind, raw, count = tags[tag]
            if len(raw) <= 4:
                value = raw.ljust(4, b"\0")
            else:
                value = struct.pack("<I", far + len(tail))
                tail += raw + b"\0" * (len(raw) % 2)
            head += struct.pack("<HHI", tag, kind, count) + value
        link = at + len(head)
        out += head + b"\0\0\0\0" + tail
    return bytes(out)


# ------------------------------------------------------------------ files within a TIFF

_LINE = 1024


def _named(data: bytes) -> list[tuple[str, dict[int, tuple]]]:
    return [(t[DOCUMENT_NAME][1].split(b"\0")[0].decode(), t) for t in tiff_directories(data) if DOCUMENT_NAME in t]


def _content(data: bytes, tags: dict[int, tuple]) -> bytes:
    """Scan lines of bytes, the first four of them the file's length."""
    raw = b"".join(data[a : a + n] for a, n in zip(tags[STRIPS][1], tags[STRIP_BYTES][1], strict=True))
    (size,) = struct.unpack("<I", raw[:4])
    return raw[4 : 4 + size]


def container_names(data: bytes) -> list[str]:
    """Names of the files that a TIFF container holds."""
    return [name for name, _ in _named(data)]


def container_items(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Names and contents of all files of a TIFF container, its directories read once."""
    for name, tags in _named(data):
        yield name, _content(data, tags)


def container_read(data: bytes, name: str) -> bytes:
    """A named file of a TIFF container."""
    for own, tags in _named(data):
        if own == name:
            return _content(data, tags)
    raise FileNotFoundError(name)


def container_write(files: dict[str, bytes]) -> bytes:
    """A TIFF container of files."""
    body, directories, at = [], [], 8
    for name, content in files.items():
        raw = struct.pack("<I", len(content)) + content
        raw += b"\0" * (-len(raw) % _LINE)
        number = lambda v: (4, struct.pack("<I", v), 1)
        title = name.encode() + b"\0"
        directories.append({WIDTH: number(_LINE), HEIGHT: number(len(raw) // _LINE), BITS: number(8), COMPRESSION: number(1), PHOTOMETRIC: number(1), DOCUMENT_NAME: (2, title, len(title)), STRIPS: number(at), SAMPLES: number(1), ROWS_PER_STRIP: number(len(raw) // _LINE), STRIP_BYTES: number(len(raw))})
        body.append(raw)
        at += len(raw)
    return _tiff_file(b"".join(body), directories)


def container_append(data: bytes, name: str, content: bytes) -> bytes:
    """The container with a file added or replaced."""
    held: dict[str, bytes] = {}
    for own, found in container_items(data):
        held.setdefault(own, found)
    return container_write(held | {name: content})


MASK_ENTRY = "validity-mask.bin"


def embedded_mask_read(data: bytes) -> bytes:
    """The validity mask that an image file carries: a TIFF container's entry, else one of a ZIP archive behind the image."""
    if data[:1] in (b"I", b"M"):
        return container_read(data, MASK_ENTRY)
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return z.read(MASK_ENTRY)
    except (zipfile.BadZipFile, KeyError) as e:
        raise FileNotFoundError(MASK_ENTRY) from e


def embedded_mask_write(data: bytes, mask: bytes) -> bytes:
    """The image file with a validity mask; readers of the image itself are not disturbed."""
    if data[:1] in (b"I", b"M"):
        return _tiff_append(data, MASK_ENTRY, mask)
    out = io.BytesIO(data)
    with zipfile.ZipFile(out, "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr(MASK_ENTRY, mask)
    return out.getvalue()


def _tiff_append(data: bytes, name: str, content: bytes) -> bytes:
    """A directory with a file behind those of a little-endian TIFF; an earlier one of that name is renamed away."""
    if data[:2] != b"II":
        raise FormatError("only little-endian TIFF files are added to")
    out = bytearray(data)
    at, link = struct.unpack("<I", data[4:8])[0], 4
    while at:
        (n,) = struct.unpack("<H", out[at : at + 2])
        for k in range(n):
            tag, kind, count, place = struct.unpack("<HHII", out[at + 2 + 12 * k : at + 14 + 12 * k])
            place = at + 10 + 12 * k if count <= 4 else place
            if tag == DOCUMENT_NAME and bytes(out[place : place + count]).split(b"\0")[0].decode() == name:
                out[place] = 0
        link = at + 2 + 12 * n
        (at,) = struct.unpack("<I", out[link : link + 4])
    raw = struct.pack("<I", len(content)) + content
    raw += b"\0" * (-len(raw) % _LINE)
    out += b"\0" * (len(out) % 2)
    start = len(out)
    out += raw
    title = name.encode() + b"\0"
    title += b"\0" * max(0, 5 - len(title))
    where, at = len(out), len(out) + len(title) + len(title) % 2
    out += title + b"\0" * (len(title) % 2)
    tags = [(WIDTH, 4, 1, _LINE), (HEIGHT, 4, 1, len(raw) // _LINE), (BITS, 4, 1, 8), (COMPRESSION, 4, 1, 1), (PHOTOMETRIC, 4, 1, 1), (DOCUMENT_NAME, 2, len(title), where), (STRIPS, 4, 1, start), (SAMPLES, 4, 1, 1), (ROWS_PER_STRIP, 4, 1, len(raw) // _LINE), (STRIP_BYTES, 4, 1, len(raw))]
    out[link : link + 4] = struct.pack("<I", at)
    out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0"
    return bytes(out)


# ------------------------------------------------------------------ other headers


def jpeg_dimensions(data: bytes) -> tuple[int, int]:
    """From the first frame header among the segments."""
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            break
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind in (0x01, *range(0xD0, 0xD9)):
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise FormatError("no JPEG frame header")


def _boxes(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size, name = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            (size,) = struct.unpack(">Q", data[at + 8 : at + 16])
            head = 16
        size = size or end - at
        if size < head:
            raise FormatError("broken box")
        yield name, at + head, min(at + size, end)
        at += size


def jp2_dimensions(data: bytes) -> tuple[int, int]:
    """From the image header among the first boxes of the header box."""
    boxes = _boxes(data, 0, len(data))
    if next(boxes, (None,))[0] != b"jP  " or next(boxes, (None,))[0] != b"ftyp":
        raise FormatError("not a JP2")
    for name, a, e in boxes:
        if name == b"jp2h":
            for k, (inner, b, _) in enumerate(_boxes(data, a, e)):
                if inner == b"ihdr":
                    h, w = struct.unpack(">II", data[b : b + 8])
                    return w, h
                if k >= 10:
                    break
    raise FormatError("no image header")


def exr_dimensions(data: bytes) -> tuple[int, int]:
    """From the attribute dataWindow."""
    if data[:4] != b"v/1\x01":
        raise FormatError("not an EXR")
    at = 8
    while at < len(data) and data[at]:
        end = data.index(b"\0", at)
        name, at = data[at:end], end + 1
        end = data.index(b"\0", at)
        (size,) = struct.unpack("<i", data[end + 1 : end + 5])
        at = end + 5
        if name == b"dataWindow":
            x0, y0, x1, y1 = struct.unpack("<4i", data[at : at + 16])
            return x1 - x0 + 1, y1 - y0 + 1
        at += size
    raise FormatError("no data window")


def dimensions(data: bytes) -> tuple[int, int]:
    """Size by the first byte, of any format that is known."""
    first = data[:1]
    if first == b"\xff":
        return jpeg_dimensions(data)
    if first in (b"I", b"M"):
        return tiff_dimensions(data)
    if first == b"\0":
        return jp2_dimensions(data)
    if first == b"v":
        return exr_dimensions(data)
    if first == b"G":
        return struct.unpack("<HH", data[6:10])
    if data[:8] == PNG_SIGNATURE:
        return struct.unpack(">II", data[16:24])
    raise FormatError("unknown image type")


def exif_tags(data: bytes) -> dict[str, str]:
    """Tags of an EXIF block (in a JPEG, or a TIFF itself) as text, by number in hexadecimal; rationals as n/d."""
    if data[:2] == b"\xff\xd8":
        at = data.find(b"Exif\0\0")
        if at < 0:
            return {}
        data = data[at + 6 :]
    out: dict[str, str] = {}
    for tags in tiff_directories(data):
        for tag, (kind, values) in tags.items():
            if kind in (2, 7):
                text = values.split(b"\0")[0].decode("latin-1")
            elif kind in (5, 10):
                text = " ".join(f"{n}/{d}" for n, d in values)
            else:
                text = " ".join(str(v) for v in values)
            out.setdefault(f"{tag:04x}", text)
    return out


# ------------------------------------------------------------------ masks

BIT_MAGIC, TREE_MAGIC, MAPPED_MAGIC = b"RMASK", b"QMASK", b"MQMASK"
#: Node codes of a quadtree dump, as files hold them.
WHITE, BLACK, GRAY = 0, 1, 2


def bitmask_dump(mask: np.ndarray) -> bytes:
    """A boolean (h, w) array as bits, least significant first, row after row."""
    h, w = mask.shape
    return BIT_MAGIC + b"\0\0\0" + struct.pack("<II", w, h) + np.packbits(mask.reshape(-1), bitorder="little").tobytes()


def bitmask_load(data: bytes) -> np.ndarray:
    if data[:5] != BIT_MAGIC:
        raise FormatError("not a bit mask")
    w, h = struct.unpack("<II", data[8:16])
    bits = np.unpackbits(np.frombuffer(data[16:], dtype=np.uint8), bitorder="little")
    return bits[: w * h].reshape(h, w).astype(bool)


def _side(w: int, h: int) -> int:
    return 1 << max(0, (max(w, h, 1) - 1).bit_length())


def _square(mask: np.ndarray) -> np.ndarray:
    side = _side(mask.shape[1], mask.shape[0])
    return np.pad(mask, ((0, side - mask.shape[0]), (0, side - mask.shape[1])))


def _quarters(m: np.ndarray):
    k = len(m) // 2
    return m[:k, :k], m[:k, k:], m[k:, :k], m[k:, k:]


def treemask_dump(mask: np.ndarray) -> bytes:
    """A quadtree in preorder (upper left, upper right, lower left, lower right); the count is written as 0."""
    out = bytearray()

    def node(m):
        if m.all():
            out.append(WHITE)
        elif not m.any():
            out.append(BLACK)
        else:
            out.append(GRAY)
            for q in _quarters(m):
                node(q)

    square = _square(mask)
    node(square)
    return TREE_MAGIC + b"\0\0\0" + struct.pack("<IIII", mask.shape[1], mask.shape[0], len(square), 0) + bytes(out)


def treemask_leaves(data: bytes) -> tuple[tuple[int, int], list[tuple[int, int, int, bool]]]:
    """Size and leaves (x, y, side, white) of a quadtree dump."""
    if data[:5] != TREE_MAGIC:
        raise FormatError("not a quadtree mask")
    w, h, side, _ = struct.unpack("<IIII", data[8:24])
    leaves, at, todo = [], 24, [(0, 0, side)]
    while todo:
        x, y, s = todo.pop()
        kind, at = data[at], at + 1
        if kind == GRAY:
            k = s // 2
            todo += [(x + k, y + k, k), (x, y + k, k), (x + k, y, k), (x, y, k)]
        else:
            leaves.append((x, y, s, kind == WHITE))
    return (w, h), leaves


def treemask_load(data: bytes) -> np.ndarray:
    (w, h), leaves = treemask_leaves(data)
    mask = np.zeros((h, w), dtype=bool)
    for x, y, s, white in leaves:
        if white:
            mask[y : y + s, x : x + s] = True
    return mask


def mappedmask_dump(mask: np.ndarray, depth: int | None = None, x: int = 0, y: int = 0, start: int = 0) -> bytes:
    """A pointer-free tree of a mask, or of its quad (depth, x, y); places are aligned from `start`, the stream's position.

    Header: magic, two bytes of 0, the depth (u8; the side is 1 << depth) and the tree's bytes (u32).
    """
    square = _square(mask)
    if depth:
        side = len(square) >> depth
        square = square[y * side : (y + 1) * side, x * side : (x + 1) * side] if side and 0 <= x < 1 << depth and 0 <= y < 1 << depth else np.zeros((0, 0), bool)
    levels = max(0, len(square).bit_length() - 1)
    out = bytearray(MAPPED_MAGIC + b"\0\0" + struct.pack("<BI", levels, 0))
    tree = len(out)

    def node(m):
        place, grays, code = len(out), [], 0
        for shift, q in zip((6, 4, 2, 0), _quarters(m), strict=True):
            if q.all():
                code |= 3 << shift
            elif q.any():
                code |= 1 << shift
                grays.append(q)
        out.append(code)
        for k, q in enumerate(grays):
            out.extend(b"\0" * (-(start + len(out)) % 4))
            jump = len(out)
            out.extend(b"\0\0\0\0")
            node(q)
            out[jump : jump + 4] = struct.pack("<I", len(out) - jump - 4)
        return place

    if not square.size or not square.any():
        out.append(0)
    elif square.all():
        out.append(0xFF)
    else:
        node(square)
    out[tree - 4 : tree] = struct.pack("<I", len(out) - tree)
    return bytes(out)


def mappedmask_leaves(data: bytes, most_depth: int | None = None, extents: tuple[int, int, int, int] | None = None, start: int = 0):
    """Leaves (depth, x, y, side, white) of a pointer-free tree, white None where a quad is mixed at most_depth.

    x, y in pixels. Quads outside the closed extents (x0, y0, x1, y1) are jumped over.
    """
    if data[:6] != MAPPED_MAGIC:
        raise FormatError("not a mapped mask")
    levels, size = struct.unpack("<BI", data[8:13])
    data, side = data[: 13 + size], 1 << levels
    out: list[tuple] = []
    met = lambda x, y, s: extents is None or not (x > extents[2] or y > extents[3] or x + s <= extents[0] or y + s <= extents[1])

    def node(at, depth, x, y, s):
        code, at, k = data[at], at + 1, s // 2
        for n, shift in enumerate((6, 4, 2, 0)):
            qx, qy, kind = x + k * (n % 2), y + k * (n // 2), code >> shift & 3
            if kind != 1:
                if met(qx, qy, k):
                    out.append((depth + 1, qx, qy, k, kind == 3))
                continue
            at += -(start + at) % 4
            (jump,) = struct.unpack("<I", data[at : at + 4])
            if met(qx, qy, k):
                if most_depth is not None and depth + 1 >= most_depth:
                    out.append((depth + 1, qx, qy, k, None))
                else:
                    node(at + 4, depth + 1, qx, qy, k)
            at += 4 + jump

    first = data[13]
    if first in (0, 0xFF) or not levels:
        out.append((0, 0, 0, side, first == 0xFF))
    elif most_depth == 0:
        out.append((0, 0, 0, side, None))
    else:
        node(13, 0, 0, 0, side)
    return out
