"""Pointwise pixel operators.

Every operator maps a pixel table ``(img_id, w, h, x, y, r, g, b[, a])`` to one of the same shape. ``w``
and ``h`` ride along as constant columns of an image (they cost nothing in a columnar file), so that
geometry needs no join. All operators here are narrow except :func:`contrast`, which needs one
aggregate per image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaforge.functions import color
from lumaforge.functions.color import CHANNELS

# Rows of an image per join key in contrast(): the work of one image is spread over its strips.
STRIP_ROWS = 64


def _map_channels(px: DataFrame, fn) -> DataFrame:
    return px.withColumns({c: fn(c) for c in CHANNELS})


def _luma() -> Column:
    return color.luma(F.col("r"), F.col("g"), F.col("b"))


def strip_of(y: Column) -> Column:
    return F.floor(y / STRIP_ROWS).cast("int")


def per_strip(per_image: DataFrame, rows: Column) -> DataFrame:
    """Repeat a per-image row once for every strip of an image with that many pixel rows."""
    strips = F.sequence(F.lit(0), strip_of(rows - 1))
    return per_image.withColumn("_strip", F.explode(strips))


def attach_per_image(px: DataFrame, per_image: DataFrame) -> DataFrame:
    """Left join columns of ``per_image(img_id, ...)`` to every pixel.

    The join key is ``(img_id, strip)``, so the pixels of one huge image are spread over many keys.
    """
    heights = px.where("x = 0 AND y = 0").select("img_id", "h")
    spread = per_strip(heights.join(per_image, "img_id"), F.col("h")).drop("h")
    return px.withColumn("_strip", strip_of(F.col("y"))).join(spread, ["img_id", "_strip"], "left").drop("_strip")


def grayscale(px: DataFrame) -> DataFrame:
    return px.withColumn("_l", _luma()).withColumns({c: F.col("_l") for c in CHANNELS}).drop("_l")


def brightness(px: DataFrame, factor: float = 1.0) -> DataFrame:
    return _map_channels(px, lambda c: color.scaled(F.col(c), factor))


def contrast(px: DataFrame, factor: float = 1.0) -> DataFrame:
    """Blend with the mean luma of the image.

    The means are joined back on ``(img_id, strip)``: an image contributes one row per strip, so no
    join key carries more than ``STRIP_ROWS`` rows of one image, however large that image is.
    """
    stats = px.groupBy("img_id").agg(
        F.sum(_luma().cast("long")).alias("_s"), F.count(F.lit(1)).alias("_n"), F.max("y").alias("_y")
    )
    means = per_strip(stats, F.col("_y") + 1).select(
        "img_id", "_strip", F.floor((2 * F.col("_s") + F.col("_n")) / (2.0 * F.col("_n"))).alias("_m")
    )
    joined = px.withColumn("_strip", strip_of(F.col("y"))).join(means, ["img_id", "_strip"])
    out = _map_channels(joined, lambda c: color.blend(F.col("_m"), F.col(c), factor))
    return out.select(px.columns)


def saturation(px: DataFrame, factor: float = 1.0) -> DataFrame:
    staged = px.withColumn("_l", _luma())
    return _map_channels(staged, lambda c: color.blend(F.col("_l"), F.col(c), factor)).drop("_l")


def hue(px: DataFrame, shift: float = 0.0) -> DataFrame:
    """Turn the hue by ``shift`` degrees in the hexagon (HSV) model, components in 0..1."""
    unit = px.withColumns({f"_{c}": F.col(c) / F.lit(255.0) for c in CHANNELS})
    r, g, b = (F.col(f"_{c}") for c in CHANNELS)
    hi, lo = F.col("_hi"), F.col("_lo")
    unit = unit.withColumns({"_hi": F.greatest(r, g, b), "_lo": F.least(r, g, b)})
    span = F.nullif(hi - lo, F.lit(0.0))
    rc, gc, bc = ((hi - c) / span for c in (r, g, b))
    sextant = F.when(r == hi, bc - gc).when(g == hi, 2.0 + rc - bc).otherwise(4.0 + gc - rc) / 6.0
    turned = unit.withColumn("_t", F.coalesce(sextant - F.floor(sextant), F.lit(0.0)) + F.lit(shift / 360.0))
    turned = turned.withColumns(
        {
            "_t": (F.col("_t") - F.floor("_t")) * 6.0,
            "_s": F.coalesce((hi - lo) / F.nullif(hi, F.lit(0.0)), F.lit(0.0)),
        }
    )
    placed = turned.withColumns({"_k": F.floor("_t"), "_f": F.col("_t") - F.floor("_t")})
    s, f = F.col("_s"), F.col("_f")
    placed = placed.withColumns(
        {"_p": hi * (1.0 - s), "_q": hi * (1.0 - s * f), "_u": hi * (1.0 - s * (1.0 - f))}
    )
    p, q, u = F.col("_p"), F.col("_q"), F.col("_u")
    wheel = {"r": (hi, q, p, p, u, hi), "g": (u, hi, hi, q, p, p), "b": (p, p, u, hi, hi, q)}

    def pick(choices) -> Column:
        sector = F.col("_k") % 6
        out = F.when(sector == 0, choices[0])
        for k in range(1, 6):
            out = out.when(sector == k, choices[k])
        return color.to_channel(out * 255.0)

    return placed.withColumns({c: pick(wheel[c]) for c in CHANNELS}).select(px.columns)


def levels(
    px: DataFrame,
    input_black: float = 0,
    input_white: float = 255,
    gamma: float = 1.0,
    output_black: float = 0,
    output_white: float = 255,
) -> DataFrame:
    return _map_channels(
        px, lambda c: color.level(F.col(c), input_black, input_white, gamma, output_black, output_white)
    )


def sepia(px: DataFrame, intensity: float = 1.0) -> DataFrame:
    toned = px.withColumns({f"_{c}": color.sepia_channel(c, F.col("r"), F.col("g"), F.col("b")) for c in CHANNELS})
    return _map_channels(toned, lambda c: color.blend(F.col(c), F.col(f"_{c}"), intensity)).select(px.columns)


def outside_crop(px: DataFrame, x: int = 0, y: int = 0) -> DataFrame:
    """``(img_id, w, h)`` of the images that a crop at ``x, y`` leaves without a pixel."""
    return px.where("x = 0 AND y = 0").where((F.col("w") <= x) | (F.col("h") <= y)).select("img_id", "w", "h")


def crop(px: DataFrame, x: int = 0, y: int = 0, width: int | None = None, height: int | None = None) -> DataFrame:
    """Keep a rectangle and shift it to the origin; a missing size reaches to the image edge.

    The rectangle is cut at the image border, so the result is never larger than the source. An image that lies
    outside it altogether has no pixel left and so no row: :func:`outside_crop` names those, and runs report them.
    """
    right = F.col("w") if width is None else F.least(F.lit(x + width), F.col("w"))
    bottom = F.col("h") if height is None else F.least(F.lit(y + height), F.col("h"))
    kept = px.where(F.col("x") >= x).where(F.col("y") >= y)
    if width is not None:
        kept = kept.where(F.col("x") < x + width)
    if height is not None:
        kept = kept.where(F.col("y") < y + height)
    return kept.withColumns(
        {
            "w": (right - x).cast("int"),
            "h": (bottom - y).cast("int"),
            "x": (F.col("x") - x).cast("int"),
            "y": (F.col("y") - y).cast("int"),
        }
    )


def _transposes() -> dict[str, tuple[Column, Column, bool]]:
    w, h, x, y = F.col("w"), F.col("h"), F.col("x"), F.col("y")
    return {
        "FLIP_LEFT_RIGHT": (w - 1 - x, y, False),
        "FLIP_TOP_BOTTOM": (x, h - 1 - y, False),
        "ROTATE_90": (y, w - 1 - x, True),
        "ROTATE_180": (w - 1 - x, h - 1 - y, False),
        "ROTATE_270": (h - 1 - y, x, True),
        "TRANSPOSE": (y, x, True),
        "TRANSVERSE": (h - 1 - y, w - 1 - x, True),
    }


# The action spells the two flips differently from the processor; both are accepted.
TRANSPOSE_ALIASES = {"FLIP_HORIZONTAL": "FLIP_LEFT_RIGHT", "FLIP_VERTICAL": "FLIP_TOP_BOTTOM"}


def transpose(px: DataFrame, method: str) -> DataFrame:
    name = method.upper()
    name = TRANSPOSE_ALIASES.get(name, name)
    table = _transposes()
    if name not in table:
        raise ValueError(f"Invalid transpose method: {method}")
    tx, ty, swapped = table[name]
    w, h = (F.col("h"), F.col("w")) if swapped else (F.col("w"), F.col("h"))
    return px.withColumns({"w": w, "h": h, "x": tx.cast("int"), "y": ty.cast("int")})


def flatten_alpha(px: DataFrame) -> DataFrame:
    """Composite on white and drop alpha, before a format without transparency."""
    return _map_channels(px, lambda c: color.over_white(F.col(c), F.col("a"))).drop("a")
