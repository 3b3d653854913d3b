"""Command line: python -m rasterloom.cli COMMAND ...

imagesize FILE                   width and height
convert IN OUT                   any image that is read, as PNG (level 9)
container-save TIFF NAME FILE    put a file into a TIFF container
container-load TIFF NAME FILE    take it out
mask-copy IN OUT                 the validity mask of one image into another
mask-dump [--raw] IMAGE OUT      the validity mask as a PNG, or its bytes as they are
"""

from __future__ import annotations

import os
import sys

import numpy as np

from .sources import formats as fm
from .sources.files import decode


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    with open(path, "wb") as f:
        f.write(data)


def convert(source: str, target: str) -> None:
    if not target.lower().endswith(".png"):
        raise fm.FormatError("images are written as PNG")
    image = decode(_read(source), source)
    if image.dtype == np.uint16:
        image = np.rint(image * (255 / 65535)).astype(np.uint8)
    _write(target, fm.png_encode(image, 9))


def main(args: list[str]) -> int:
    match args:
        case ["imagesize", path]:
            print("{}x{}".format(*fm.dimensions(_read(path))))
        case ["convert", source, target]:
            convert(source, target)
        case ["container-save", tiff, name, path]:
            held = _read(tiff) if os.path.exists(tiff) else None
            _write(tiff, fm.container_append(held, name, _read(path)) if held else fm.container_write({name: _read(path)}))
        case ["container-load", tiff, name, path]:
            _write(path, fm.container_read(_read(tiff), name))
        case ["mask-copy", source, target]:
            _write(target, fm.embedded_mask_write(_read(target), fm.embedded_mask_read(_read(source))))
        case ["mask-dump", "--raw", image, target]:
            _write(target, fm.embedded_mask_read(_read(image)))
        case ["mask-dump", image, target]:
            _write(target, fm.png_encode(fm.treemask_load(fm.embedded_mask_read(_read(image))).astype(np.uint8) * 255, 9))
        case _:
            print(__doc__, file=sys.stderr)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
