"""Colour contrast: luminance, ratios, and the crop of a picture that is measured."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import INSET, MIN_BOX
from .fills import half_up
from .parse import parse_hex


def channel(value: Column) -> Column:
    v = value / 255.0
    return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def relative_luminance(r: Column, g: Column, b: Column) -> Column:
    return channel(r) * 0.2126 + channel(g) * 0.7152 + channel(b) * 0.0722


def ratio_of(a: Column, b: Column) -> Column:
    """Contrast of two luminances, whichever is the lighter; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05))


def contrast_ratio(foreground: Column, background: Column) -> Column:
    """Contrast of two hex colours, null unless both are colours."""
    lum = lambda c: relative_luminance(c["r"], c["g"], c["b"])
    return ratio_of(lum(parse_hex(foreground)), lum(parse_hex(background)))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    part = lambda v: half_up(v.cast("double")).cast("int")
    return F.format_string("#%02x%02x%02x", part(r), part(g), part(b))


def clamp01(v: Column) -> Column:
    """Within 0 to 1; what is not a finite number is 0."""
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))).otherwise(0.0)


def crop(bounds: Column, width: Column, height: Column) -> Column:
    """struct<left, top, width, height int>: the part of a picture to measure, or null if it is too small or off it.

    Bounds over 1 are pixels, else shares of the picture. They are fitted to the picture, then drawn in on all sides.
    """
    pixels = (bounds["x"] > 1) | (bounds["y"] > 1) | (bounds["width"] > 1) | (bounds["height"] > 1)
    share = lambda name, whole: F.when(pixels, bounds[name] / whole).otherwise(bounds[name])
    x0, y0 = half_up(clamp01(share("x", width)) * width), half_up(clamp01(share("y", height)) * height)
    w = F.least(half_up(share("width", width) * width), width - x0)
    h = F.least(half_up(share("height", height) * height), height - y0)
    left, top = x0 + half_up(w * INSET), y0 + half_up(h * INSET)
    cw, ch = half_up(w * (1 - 2 * INSET)), half_up(h * (1 - 2 * INSET))
    ok = (cw >= MIN_BOX[0]) & (ch >= MIN_BOX[1]) & (left + cw <= width) & (top + ch <= height)
    return F.when(ok, F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), cw.cast("int").alias("width"), ch.cast("int").alias("height")))
