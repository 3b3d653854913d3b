"""Colour and bit-depth conversion as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The colour matrices.
TO_YCC = ((0.299, 0.587, 0.114), (-0.169, -0.331, 0.5), (0.5, -0.419, -0.081))
TO_RGB = ((1.0, 9.2674e-4, 1.4017), (1.0, -0.34370, -0.7142), (1.0, 1.7722, 9.9022e-4))


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def to_8bit_256(v: Column) -> Column:
    """16 bits to 8 by 1/256, half to even, saturating."""
    return clamp(F.rint(v / 256.0), 0, 255).cast("int")


def to_8bit_257(v: Column) -> Column:
    """16 bits to 8 by 255/65535, half to even: the whole range meets the whole range."""
    return clamp(F.rint(v * F.lit(255.0 / 65535.0)), 0, 255).cast("int")


def unpack8(v: Column) -> Column:
    """A byte as 0..1."""
    return v / 255.0


def pack8(v: Column) -> Column:
    """0..1 as a byte, half away from zero, saturating."""
    return clamp(F.round(v * 255.0), 0, 255).cast("int")


def unpack_ycc8(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Bytes of luma and chroma as luma 0..1 and chroma -0.5..0.5; luma has no offset, so that packing gives the bytes back."""
    return unpack8(y), unpack8(cb) - 0.5, unpack8(cr) - 0.5


def pack_ycc8(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Luma and chroma as bytes, chroma moved up by a half."""
    return pack8(y), pack8(cb + 0.5), pack8(cr + 0.5)


def rgb_to_ycc(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Luma 0..1 and chroma -0.5..0.5."""
    return tuple(m[0] * r + m[1] * g + m[2] * b for m in TO_YCC)


def ycc_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    return [m[0] * y + m[1] * cb + m[2] * cr for m in TO_RGB]


def clip_chroma(y: Column, cb: Column, cr: Column) -> tuple[Column, Column]:
    """Chroma scaled toward gray until all of R, G, B lie in 0..1, one channel and bound after the other.

    Scaling by s moves a channel from gray (y) to y + s * d, where d is what the chroma adds; the bound that a channel
    exceeds gives s = (bound - y) / d. The next test sees the scaled chroma.
    """
    scale: Column = F.lit(1.0)
    for channel in range(3):
        d = TO_RGB[channel][1] * cb + TO_RGB[channel][2] * cr
        for bound in (0.0, 1.0):
            now = y + scale * d
            out = now < bound if bound == 0.0 else now > bound
            scale = F.when(out & (d != 0), (F.lit(bound) - y) / F.when(d != 0, d)).otherwise(scale)
    return cb * scale, cr * scale


def hue_diff(cb1: Column, cr1: Column, cb2: Column, cr2: Column) -> Column:
    """Angle between two chroma vectors, 0 to pi."""
    d = F.abs(F.atan2(cr1, cb1) - F.atan2(cr2, cb2))
    return F.least(d, F.lit(6.283185307179586) - d)


def _ramp(v: Column) -> Column:
    """0 to -0.75, up to 1 at -0.25, down from 0.25 to 0 at 0.75."""
    return F.when(v <= -0.75, 0.0).when(v <= -0.25, (v + 0.75) * 2).when(v <= 0.25, 1.0).when(v <= 0.75, 1 - (v - 0.25) * 2).otherwise(0.0)


def jet(v: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue (0..1) of the jet colour map for v in -1..1."""
    return _ramp(v - 0.5), _ramp(v), _ramp(v + 0.5)


def palette(index: Column) -> tuple[Column, Column, Column]:
    """256 distinct colours by rule: the index's bits spread over the three channels, highest first."""
    bit = lambda k: F.shiftright(index, k).bitwiseAND(F.lit(1))
    r = bit(0) * 146 + bit(3) * 73 + bit(6) * 36
    g = bit(1) * 146 + bit(4) * 73 + bit(7) * 36
    b = bit(2) * 170 + bit(5) * 85
    return r, g, b
