"""Crops, georeferences and affine maps as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("ul", "ur", "lr", "ll")


def parse_crop(text: Column) -> Column:
    """`WxH+X-Y` as a struct of whole numbers; null if the text is no crop."""
    pattern = r"^(\d+)x(\d+)([+-]\d+)([+-]\d+)$"
    part = lambda i: F.regexp_extract(text, pattern, i).cast("int")
    return F.when(text.rlike(pattern), F.struct(part(1).alias("width"), part(2).alias("height"), part(3).alias("x"), part(4).alias("y")))


def format_crop(crop: Column) -> Column:
    return F.format_string("%dx%d%+d%+d", crop["width"], crop["height"], crop["x"], crop["y"])


def scale_crop(crop: Column, sx, sy) -> Column:
    """Sizes by the factors, the corner as a pixel centre by them too."""
    return F.struct((crop["width"] * sx).alias("width"), (crop["height"] * sy).alias("height"), ((crop["x"] + 0.5) * sx).alias("x"), ((crop["y"] + 0.5) * sy).alias("y"))


def extents(axes: list[str]) -> list[Column]:
    """Bounds of four corners ul, ur, lr, ll over the axes: x0, y0[, z0], x1, y1[, z1]."""
    return [F.least(*[F.col(f"{c}.{a}") for c in CORNERS]).alias(f"{a}0") for a in axes] + [F.greatest(*[F.col(f"{c}.{a}") for c in CORNERS]).alias(f"{a}1") for a in axes]


def format_georef(axes: list[str]) -> Column:
    return F.concat_ws(",", *[F.col(f"{c}.{a}").cast("string") for c in CORNERS for a in axes])


def parse_georef(text: Column, axes: list[str], kind: str = "double") -> Column:
    """Comma list of the corners' coordinates as a struct of structs; null if their number is wrong."""
    parts = F.split(text, ",")
    at = lambda i: F.try_element_at(parts, F.lit(i + 1)).try_cast(kind)
    corners = [F.struct(*[at(k * len(axes) + j).alias(a) for j, a in enumerate(axes)]).alias(c) for k, c in enumerate(CORNERS)]
    return F.when(F.size(parts) == 4 * len(axes), F.struct(*corners))


@dataclass
class Affine:
    """p -> offset + scale * p along one axis."""

    scale: Column
    offset: Column

    def map(self, p: Column) -> Column:
        return self.offset + self.scale * p

    @property
    def derivative(self) -> Column:
        return self.scale


def area_scaling(src: Column, dst: Column) -> Affine:
    """Pixels are areas: their centres lie half a pixel in."""
    s = dst / src
    return Affine(s, s * 0.5 - 0.5)


def grid_scaling(src: Column, dst: Column) -> Affine:
    """Pixels are points: first and last ones meet."""
    return Affine((dst - 1) / (src - 1), F.lit(0.0))


def crop_scaling(crop_size: Column, crop_at: Column, dst: Column) -> Affine:
    """From a scaled view back into the crop that it shows."""
    s = crop_size / dst
    return Affine(s, s * 0.5 - 0.5 + crop_at)


def inside(px: Column, py: Column, width, height) -> Column:
    """Within the closed range of pixel centres."""
    return px.between(0, F.lit(width) - 1) & py.between(0, F.lit(height) - 1)


def in_bounds(x: Column, y: Column, width, height) -> Column:
    """Whole coordinates of a pixel of the image."""
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def patch_map(shift: Column, p: Column) -> Column:
    return p + shift


def patch_inverse(shift: Column, p: Column) -> Column:
    return p - shift


def uv_pixels(low: Column, high: Column) -> tuple[Column, Column]:
    """First pixel and number of pixels of a range in texture space."""
    return F.floor(low), F.ceil(high) - F.floor(low) + 1


def patch_pixels(low: Column, high: Column) -> tuple[Column, Column]:
    """First pixel and number of pixels that sampling a range touches."""
    first = F.floor(low - 0.5)
    return first, F.ceil(high + 0.5) - first + 1


def adjust_uv(v: Column, first: Column, packed: Column) -> Column:
    """A texture coordinate after its rectangle moved from first to packed."""
    return v - first + packed


def clip_axis(at: Column, size: Column, limit: Column, shift: Column) -> tuple[Column, Column, Column]:
    """Clip [at, at + size) to [0, limit) and move the target by what was cut at its begin: (at, size, shift)."""
    begin = F.greatest(at, F.lit(0))
    end = F.least(at + size, limit)
    return begin, F.greatest(end - begin, F.lit(0)), shift + (begin - at)


def uv_contains(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether rectangle a (x0, y0, x1, y1) holds b."""
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def uv_valid(r: dict[str, Column]) -> Column:
    return (r["x0"] <= r["x1"]) & (r["y0"] <= r["y1"])


def bounds(x: Column, y: Column) -> list[Column]:
    """Bounds of points as aggregates: least x, least y, greatest x, greatest y; over a window they are running bounds."""
    return [F.min(x), F.min(y), F.max(x), F.max(y)]


def merge_pays(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether the bounds of both are smaller than the two together."""
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    both = (F.greatest(a["x1"], b["x1"]) - F.least(a["x0"], b["x0"])) * (F.greatest(a["y1"], b["y1"]) - F.least(a["y0"], b["y0"]))
    return both < area(a) + area(b)
