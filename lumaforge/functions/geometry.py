"""Sizes and positions computed from width and height, without touching pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MARGIN = 10


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _set(v: Column) -> Column:
    """A target counts as given when it is neither null nor zero."""
    return v.isNotNull() & (v != 0)


def _trunc(v: Column) -> Column:
    return F.floor(v).cast("int")


def fit_size(w: Column, h: Column, width=None, height=None, maintain_aspect: bool = True) -> Column:
    """Struct ``(width, height, error)``: fit inside the given bounds; nothing given is an error."""
    tw, th = _col(width).cast("int"), _col(height).cast("int")
    ratio = F.try_divide(w, h)
    scale = F.least(F.try_divide(tw, w), F.try_divide(th, h))
    has_w, has_h = F.coalesce(_set(tw), F.lit(False)), F.coalesce(_set(th), F.lit(False))
    none = ~(has_w | has_h)
    if maintain_aspect:
        out_w = F.when(has_w & has_h, _trunc(w * scale)).when(has_w, tw).when(has_h, _trunc(th * ratio))
        out_h = F.when(has_w & has_h, _trunc(h * scale)).when(has_w, _trunc(F.try_divide(tw, ratio))).when(has_h, th)
    else:
        out_w = F.when(none, None).otherwise(F.when(has_w, tw).otherwise(w))
        out_h = F.when(none, None).otherwise(F.when(has_h, th).otherwise(h))
    error = F.when(none, F.lit("Must specify at least one target dimension")).when(
        (w < 1) | (h < 1), F.lit("Image has no pixels")
    )
    return F.struct(out_w.cast("int").alias("width"), out_h.cast("int").alias("height"), error.alias("error"))


def resize_target(w: Column, h: Column, width=None, height=None, maintain_aspect=True) -> dict[str, Column]:
    """Target size of the resize operator. Unlike :func:`fit_size` it compares ratios and never fails."""
    tw, th = _col(width).cast("int"), _col(height).cast("int")
    has_w, has_h = F.coalesce(_set(tw), F.lit(False)), F.coalesce(_set(th), F.lit(False))
    keep = _col(maintain_aspect).cast("boolean")
    ratio = F.try_divide(w, h)
    both = keep & has_w & has_h
    wide = F.try_divide(tw, th) > ratio
    out_w = (
        F.when(both, F.when(wide, _trunc(th * ratio)).otherwise(tw))
        .when(has_w, tw)
        .when(keep & has_h, _trunc(th * ratio))
        .otherwise(w)
    )
    out_h = (
        F.when(both, F.when(wide, th).otherwise(_trunc(F.try_divide(tw, ratio))))
        .when(keep & has_w, _trunc(F.try_divide(tw, ratio)))
        .when(has_h, th)
        .otherwise(h)
    )
    return {"w": out_w.cast("int"), "h": out_h.cast("int")}


def crop_error(w: Column, h: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """First broken crop rule, or null."""
    return (
        F.when(x < 0, F.lit("Crop X position cannot be negative"))
        .when(y < 0, F.lit("Crop Y position cannot be negative"))
        .when(width <= 0, F.lit("Crop width must be positive"))
        .when(height <= 0, F.lit("Crop height must be positive"))
        .when(x + width > w, F.lit("Crop area extends beyond image width"))
        .when(y + height > h, F.lit("Crop area extends beyond image height"))
    )


def centered_crop(w: Column, h: Column, tw: Column, th: Column) -> Column:
    """Struct ``(x, y, width, height, error)``."""
    bad = (tw > w) | (th > h)
    error = F.when(bad, F.lit("Target crop size is larger than image"))

    def guarded(c: Column) -> Column:
        return F.when(~bad, c.cast("int"))

    return F.struct(
        guarded(F.floor((w - tw) / 2)).alias("x"),
        guarded(F.floor((h - th) / 2)).alias("y"),
        guarded(tw).alias("width"),
        guarded(th).alias("height"),
        error.alias("error"),
    )


def watermark_origin(w: Column, h: Column, tw: Column, th: Column, position) -> tuple[Column, Column]:
    """Top-left corner of an overlay; an unknown anchor means bottom right."""
    right, bottom = w - tw - MARGIN, h - th - MARGIN
    where = _col(position)
    x = (
        F.when(where.isin("top_left", "bottom_left"), F.lit(MARGIN))
        .when(where == "center", F.floor((w - tw) / 2))
        .otherwise(right)
    )
    y = (
        F.when(where.isin("top_left", "top_right"), F.lit(MARGIN))
        .when(where == "center", F.floor((h - th) / 2))
        .otherwise(bottom)
    )
    return x.cast("int"), y.cast("int")


def rotated_canvas_for(w: Column, h: Column, angle: float) -> dict[str, Column]:
    """Canvas that holds the whole rotated image; quarter turns are exact."""
    turned = angle % 360
    if turned in (0, 180):
        return {"w": w.cast("int"), "h": h.cast("int")}
    if turned in (90, 270):
        return {"w": h.cast("int"), "h": w.cast("int")}
    cos, sin = abs(math.cos(math.radians(angle))), abs(math.sin(math.radians(angle)))
    return {
        "w": F.ceil(w * cos + h * sin - 1e-9).cast("int"),
        "h": F.ceil(w * sin + h * cos - 1e-9).cast("int"),
    }
