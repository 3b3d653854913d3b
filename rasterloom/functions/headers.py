"""Image type and size from a file's first bytes, as column expressions where the format allows.

Only the header is looked at; with a reader that cuts `content` to a few hundred bytes no image is loaded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# First byte, extension, media type.
KINDS = (("FF", ".jpg", "image/jpeg"), ("89", ".png", "image/png"), ("49", ".tif", "image/tiff"), ("4D", ".tif", "image/tiff"), ("47", ".gif", "image/gif"), ("00", ".jp2", "image/jp2"))
EXTENSIONS = (".jpg", ".jpeg", ".tif", ".tiff", ".png", ".exr", ".jp2", ".gif")


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """Unsigned number at a byte place counted from 0."""
    if little:
        parts = [F.conv(F.hex(F.substring(content, at + 1 + k, 1)), 16, 10).cast("long") * (256**k) for k in range(size)]
        return sum(parts[1:], parts[0])
    return F.conv(F.hex(F.substring(content, at + 1, size)), 16, 10).cast("long")


def _first(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 1))


def image_type(content: Column) -> Column:
    """Extension by the first byte; an error if it is none that is known."""
    out = F.when(F.lit(False), F.lit(""))
    for byte, ext, _ in KINDS:
        out = out.when(_first(content) == byte, ext)
    return out.otherwise(F.raise_error(F.lit("unknown image type")).cast("string"))


def image_mime(content: Column) -> Column:
    """Media type by the first byte; empty if unknown."""
    out = F.when(F.lit(False), F.lit(""))
    for byte, _, mime in KINDS:
        out = out.when(_first(content) == byte, mime)
    return out.otherwise("")


def path_type(path: Column) -> Column:
    """Lower-case extension of a path if it is one that is read; else null."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext.isin(*EXTENSIONS), ext)


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))


def png_size(content: Column) -> Column:
    """Size from the header chunk; an error if signature or chunk are not as they must be."""
    fine = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (_number(content, 8, 4) == 13) & (F.hex(F.substring(content, 13, 4)) == "49484452")
    return F.when(fine, _size(_number(content, 16, 4), _number(content, 20, 4))).otherwise(F.raise_error(F.lit("not a PNG header")).cast("struct<width:int,height:int>"))


def gif_size(content: Column) -> Column:
    return _size(_number(content, 6, 2, True), _number(content, 8, 2, True))


def _udf(f):
    """Size by a Python function over bytes, in Arrow batches."""

    @F.pandas_udf("width int, height int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            sizes = [f(bytes(c)) if c is not None else (None, None) for c in s]
            yield pd.DataFrame({"width": pd.array([x[0] for x in sizes], dtype="Int32"), "height": pd.array([x[1] for x in sizes], dtype="Int32")})

    return run


def jpeg_size(content: Column) -> Column:
    from ..sources.formats import jpeg_dimensions

    return _udf(jpeg_dimensions)(content)


def jp2_size(content: Column) -> Column:
    from ..sources.formats import jp2_dimensions

    return _udf(jp2_dimensions)(content)


def tiff_size(content: Column) -> Column:
    """Width and height as seen: swapped for orientations 5 to 8."""
    from ..sources.formats import tiff_dimensions

    return _udf(tiff_dimensions)(content)


def exr_size(content: Column) -> Column:
    from ..sources.formats import exr_dimensions

    return _udf(exr_dimensions)(content)


def image_size(content: Column) -> Column:
    """Size of an image of any known kind by its first byte; an error for others. Python runs once, for what SQL cannot read."""
    from ..sources.formats import dimensions

    first = _first(content)
    other = F.when(~first.isin("89", "47"), content)
    return F.when(first == "89", png_size(content)).when(first == "47", gif_size(content)).otherwise(_udf(dimensions)(other))


def image_size_by_path(path: Column, content: Column) -> Column:
    """Size by the extension of the path alone, `.tiff` not among them; an error for others."""
    from ..sources.formats import exr_dimensions, jp2_dimensions, jpeg_dimensions, tiff_dimensions

    ext = path_type(path)
    out = F.when(ext == ".png", png_size(content)).when(ext == ".gif", gif_size(content))
    for kinds, f in (((".jpg", ".jpeg"), jpeg_dimensions), ((".tif",), tiff_dimensions), ((".exr",), exr_dimensions), ((".jp2",), jp2_dimensions)):
        out = out.when(ext.isin(*kinds), _udf(f)(F.when(ext.isin(*kinds), content)))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown file format: "), path)).cast("struct<width:int,height:int>"))


def exif_tags(content: Column) -> Column:
    """All tags of an EXIF block (of a JPEG, or a TIFF itself) as a map of texts by number in hexadecimal."""
    from ..sources.formats import exif_tags as read

    @F.pandas_udf("map<string,string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([read(bytes(c)) if c is not None else None for c in s], index=s.index, dtype=object)

    return run(content)


# Names of the eight orientations, and lengths of resolution units in metres as fractions.
ORIENTATIONS = ("TopLeft", "TopRight", "BottomRight", "BottomLeft", "LeftTop", "RightTop", "RightBottom", "LeftBottom")
UNITS = {1: (1, 1), 2: (254, 10000), 3: (1, 100)}


def orientation_name(value: Column) -> Column:
    """Name of an orientation 1 to 8; an error for others."""
    names = F.array(*[F.lit(n) for n in ORIENTATIONS])
    return F.when(value.between(1, 8), F.try_element_at(names, value.cast("int"))).otherwise(F.raise_error(F.lit("invalid orientation")).cast("string"))


def orientation_value(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in ORIENTATIONS]), name), F.lit(0)).cast("int")


def orient(x: Column, y: Column, width, height, orientation: Column) -> tuple[Column, Column]:
    """Where a stored pixel is seen, by orientation; 5 to 8 swap the axes."""
    w, h = F.lit(width) - 1, F.lit(height) - 1
    seen_x = F.when(orientation.isin(2, 3), w - x).when(orientation.isin(5, 8), y).when(orientation.isin(6, 7), h - y).otherwise(x)
    seen_y = F.when(orientation.isin(3, 4), h - y).when(orientation.isin(5, 6), x).when(orientation.isin(7, 8), w - x).otherwise(y)
    return seen_x, seen_y


def resolution_unit(value: Column) -> Column:
    """Unit of length as a fraction of a metre (num, den); null if unknown."""
    out = F.when(F.lit(False), F.struct(F.lit(0).cast("long").alias("num"), F.lit(1).cast("long").alias("den")))
    for k, (n, d) in UNITS.items():
        out = out.when(value == k, F.struct(F.lit(n).cast("long").alias("num"), F.lit(d).cast("long").alias("den")))
    return out


def exif_entry(tags: Column, name: str, default: str | None = None) -> Column:
    """Text of a tag from a map; the default, or an error, if it is not there."""
    got = F.try_element_at(tags, F.lit(name))
    return F.coalesce(got, F.lit(default)) if default is not None else F.coalesce(got, F.raise_error(F.lit(f"no tag {name}")).cast("string"))


def exif_rational(text: Column) -> Column:
    """`n/d` (or `n`) as a double, null if d is 0."""
    parts = F.split(text, "/")
    den = F.coalesce(F.try_element_at(parts, F.lit(2)).cast("double"), F.lit(1.0))
    return F.try_divide(F.element_at(parts, 1).cast("double"), den)


def exif_as(text: Column, kind: str, place: int = 1) -> Column:
    """A tag's text as long, double, string or rational (num, den); of several values, parted by blanks, the one at `place`.

    Rationals become numbers by division, long ones truncated; a denominator of 0, a place that is not there and a text that
    is no number give null.
    """
    if kind == "string":
        return text
    one = F.try_element_at(F.split(F.trim(text), r"\s+"), F.lit(place))
    parts = F.split(one, "/")
    num, den = F.element_at(parts, 1), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1"))
    if kind == "rational":
        n, d = num.try_cast("long"), den.try_cast("long")
        return F.when(n.isNotNull() & (d != 0), F.struct(n.alias("num"), d.alias("den")))
    value = F.try_divide(num.try_cast("double"), den.try_cast("double"))
    if kind == "double":
        return value
    if kind == "long":
        whole = F.when(~one.contains("/"), num.try_cast("long"))
        return F.coalesce(whole, F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("long"))
    raise ValueError(f"unknown kind {kind}")
