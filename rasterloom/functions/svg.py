"""SVG text from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(v: Column) -> Column:
    """A number without a needless fraction."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def color(r, g, b) -> Column:
    return F.concat(F.lit("rgb("), F.concat_ws(",", *[F.lit(c).cast("int").cast("string") for c in (r, g, b)]), F.lit(")"))


def paint(kind: str, rgb: Column, alpha=None) -> Column:
    """`fill` or `stroke`, with its opacity if an alpha is given."""
    out = F.concat(F.lit(f"{kind}:"), rgb)
    return out if alpha is None else F.concat(out, F.lit(f";{kind}-opacity:"), number(F.lit(alpha)))


def points(ring: Column) -> Column:
    """`x,y ` for each point of an array of structs."""
    return F.array_join(F.transform(ring, lambda p: F.concat(number(p["x"]), F.lit(","), number(p["y"]), F.lit(" "))), "")


def polygon(ring: Column, rgb: Column, alpha=None) -> Column:
    """One polygon element; null for an empty ring."""
    text = F.concat(F.lit('<polygon points="'), points(ring), F.lit('" style="fill:none;'), paint("stroke", rgb, alpha), F.lit(';stroke-width:1" vector-effect="non-scaling-stroke" />\n'))
    return F.when(F.size(ring) > 0, text)


def tag(name: str, body: Column, attributes: str = "") -> Column:
    head = f"<{name} {attributes}>\n" if attributes else f"<{name}>\n"
    return F.concat(F.lit(head), body, F.lit(f"</{name}>\n"))


def document(body: Column, width, height) -> Column:
    """A whole SVG file around elements."""
    head = F.concat(F.lit('<?xml version="1.0"?>\n<svg xmlns="http://www.w3.org/2000/svg"\n     xmlns:xlink="http://www.w3.org/1999/xlink"\n     width="'), F.lit(width).cast("string"), F.lit('" height="'), F.lit(height).cast("string"), F.lit('">\n'))
    return F.concat(head, body, F.lit("</svg>\n"))
