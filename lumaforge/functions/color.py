"""Per-pixel color expressions. Channels are integers 0..255; results are clamped, then truncated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")

# BT.601 luma weights in 16-bit fixed point.
LUMA_R, LUMA_G, LUMA_B, LUMA_HALF, LUMA_SHIFT = 19595, 38470, 7471, 32768, 16

# Sepia matrix rows for the red, green and blue outputs.
SEPIA = {
    "r": (0.393, 0.769, 0.189),
    "g": (0.349, 0.686, 0.168),
    "b": (0.272, 0.534, 0.131),
}


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(LUMA_R * r + LUMA_G * g + LUMA_B * b + F.lit(LUMA_HALF), LUMA_SHIFT)


def clamp(v: Column, lo=0, hi=255) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def to_channel(v: Column) -> Column:
    return F.floor(clamp(v.cast("double"), 0.0, 255.0)).cast("int")


def scaled(v: Column, factor: float) -> Column:
    return to_channel(v * F.lit(float(factor)))


def blend(base: Column, v: Column, factor: float) -> Column:
    """``base + factor * (v - base)``: 0 gives the base, 1 the value itself."""
    return to_channel(base + F.lit(float(factor)) * (v - base))


def sepia_channel(channel: str, r: Column, g: Column, b: Column) -> Column:
    kr, kg, kb = SEPIA[channel]
    return to_channel(F.lit(kr) * r + F.lit(kg) * g + F.lit(kb) * b)


def level(v: Column, in_black: float, in_white: float, gamma: float, out_black: float, out_white: float) -> Column:
    unit = clamp((v - F.lit(float(in_black))) / F.lit(float(in_white) - float(in_black)), 0.0, 1.0)
    curved = F.pow(unit, F.lit(1.0 / gamma)) * F.lit(float(out_white) - float(out_black)) + F.lit(float(out_black))
    return F.floor(clamp(curved, 0.0, 255.0) + F.lit(1e-9)).cast("int")


def over_white(v: Column, alpha: Column) -> Column:
    """Composite a channel on a white background."""
    return _idiv(v * alpha + 255 * (255 - alpha) + 127, 255)


def white_over(v: Column, alpha: Column) -> Column:
    """Composite white with the given alpha over a channel."""
    return _idiv(v * (255 - alpha) + 255 * alpha + 127, 255)


def _idiv(num: Column, den: int) -> Column:
    return F.floor(num / F.lit(float(den))).cast("int")
