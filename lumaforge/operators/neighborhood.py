"""Resampling and neighborhood operators.

All of them *scatter*: a source pixel emits the target pixels it takes part in together with its weight,
worked out by arithmetic from its own row, and one ``groupBy`` over the target pixel adds them up. There is
no weight table to ship and no gather join.

What is shuffled is the narrow source pixel, not its contributions: pixels are dealt by line
(``img_id, y`` or ``img_id, x``) or by strip of lines first, so the ``groupBy`` finds its rows in place. A line
or strip has a bounded size, so one huge image spreads over all tasks. Only the horizontal resize pass
aggregates before its shuffle, since it usually shrinks the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaforge.functions import color
from lumaforge.functions import templates as tpl
from lumaforge.functions.color import CHANNELS
from lumaforge.functions.geometry import resize_target, rotated_canvas_for, watermark_origin
from lumaforge.operators.lines import FIXED_POINT, gaussian_blur, gaussian_weights, median_filter
from lumaforge.operators.pointwise import STRIP_ROWS, attach_per_image

__all__ = ["gaussian_blur", "gaussian_weights", "median_filter"]  # these live in lines


# --- resizing -----------------------------------------------------------------------------------


def _bilinear(t: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(t))


def _bicubic(t: Column) -> Column:
    a = -0.5
    t = F.abs(t)
    near = ((a + 2.0) * t - (a + 3.0)) * t * t + 1.0
    far = (((t - 5.0) * t + 8.0) * t - 4.0) * a
    return F.when(t < 1.0, near).when(t < 2.0, far).otherwise(0.0)


def _sinc(t: Column) -> Column:
    arg = t * F.lit(math.pi)
    return F.when(t == 0.0, 1.0).otherwise(F.sin(arg) / arg)


def _lanczos(t: Column) -> Column:
    return F.when(F.abs(t) < 3.0, _sinc(t) * _sinc(t / 3.0)).otherwise(0.0)


KERNELS = {"BILINEAR": (_bilinear, 1.0), "BICUBIC": (_bicubic, 2.0), "LANCZOS": (_lanczos, 3.0)}


def _targets(px: DataFrame, pos: str, lo: Column, hi: Column) -> DataFrame:
    """One row per candidate target position ``_o`` in ``lo..hi`` of each source pixel."""
    lo, hi = lo.cast("int"), hi.cast("int")
    return px.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_lo") <= F.col("_hi")).withColumn(
        "_o", F.explode(F.sequence("_lo", "_hi"))
    ).drop("_lo", "_hi")


def _scaled_axis(px: DataFrame, axis: str, out_n: Column, kernel: str, values: list[str]) -> DataFrame:
    """Resize one axis (``x`` or ``y``) to ``out_n``, which may differ from image to image."""
    size = "w" if axis == "x" else "h"
    other = "y" if axis == "x" else "x"
    i, n, out = F.col(axis), F.col(size), F.col("_out")
    px = px.withColumn("_out", out_n.cast("int"))

    if kernel == "NEAREST":
        # Candidates from the inverse relation, then the exact test floor((o + 0.5) * in / out) == i.
        lo = F.greatest(F.lit(0), F.floor(i * out / n - 0.5))
        hi = F.least(out - 1, F.ceil((i + 1) * out / n + 0.5))
        picked = _targets(px, axis, lo, hi).where(F.floor(F.try_divide((F.col("_o") + 0.5) * n, out)) == i)
        return picked.withColumns({axis: F.col("_o"), size: out}).drop("_o", "_out")

    fn, support = KERNELS[kernel]
    # A target without pixels gives no rows. Such images are reported by the run; see plans.steps.
    scale = F.when(out > 0, F.greatest(F.try_divide(n, out), F.lit(1.0)))
    center = i + 0.5
    same = n == out
    lo = F.when(same, i).otherwise(
        F.greatest(F.lit(0), F.ceil((center - support * scale) * out / n - 0.5 - 1e-9).cast("int"))
    )
    hi = F.when(same, i).otherwise(
        F.least(out - 1, F.floor((center + support * scale) * out / n - 0.5 + 1e-9).cast("int"))
    )
    t = (center - F.try_divide((F.col("_o") + 0.5) * n, out)) / scale
    # No filter on zero weights: it would be pushed below and compute every weight twice.
    spread = _targets(px, axis, lo, hi).withColumn("_t", t)
    spread = spread.withColumn("_wt", F.floor(fn(F.col("_t")) * FIXED_POINT + 0.5))
    keys = ["img_id", F.col("_out").alias(size), "h" if axis == "x" else "w", F.col("_o").alias(axis), other]
    summed = spread.groupBy(*keys).agg(
        F.sum("_wt").alias("_wt"), *[F.sum(F.col("_wt") * F.col(c)).alias(c) for c in values]
    )
    return summed.withColumns({c: _rounded(F.col(c), F.col("_wt")) for c in values}).drop("_wt")


def _rounded(total: Column, weight: Column) -> Column:
    return color.clamp(F.floor((2 * total + weight) / (2.0 * weight))).cast("int")


def scale_to(
    px: DataFrame, out_w: Column, out_h: Column, resample: str = "LANCZOS", gather: bool = False
) -> DataFrame:
    """Resize to per-image target columns, horizontal pass first.

    Between the passes pixels are dealt by column. With ``gather`` they are dealt by image, so that any
    later aggregate by image needs no further shuffle. Use it only when the new width is small: an image
    then has ``out_w * h`` rows.
    """
    kernel = resample.upper() if resample.upper() in (*KERNELS, "NEAREST") else "LANCZOS"
    values = [c for c in ("r", "g", "b", "a", "l") if c in px.columns]
    order = px.columns
    px = px.withColumns({"_tw": out_w.cast("int"), "_th": out_h.cast("int")})
    if kernel == "NEAREST":
        px = _scaled_axis(px, "x", F.col("_tw"), kernel, values)
        return _scaled_axis(px, "y", F.col("_th"), kernel, values).select(order)
    # The target height must survive the first groupBy: it is a function of the image, so it rides in the key.
    px = px.withColumn("h", F.struct(F.col("h").alias("n"), F.col("_th").alias("t"))).drop("_th")
    px = _scaled_axis(px, "x", F.col("_tw"), kernel, values)
    px = px.repartition("img_id") if gather else px.repartition("img_id", "x")
    px = px.withColumns({"_th": F.col("h.t"), "h": F.col("h.n")})
    return _scaled_axis(px, "y", F.col("_th"), kernel, values).select(order)


def resize(
    px: DataFrame,
    width: int | None = None,
    height: int | None = None,
    maintain_aspect: bool = True,
    resample: str = "LANCZOS",
) -> DataFrame:
    target = resize_target(F.col("w"), F.col("h"), width, height, maintain_aspect)
    return scale_to(px, target["w"], target["h"], resample)


# --- 3x3 kernels --------------------------------------------------------------------------------


def _in_strips(px: DataFrame, reach: int) -> DataFrame:
    """Deal pixels by strip of lines, with a copy of the ``reach`` lines around each strip.

    Adds ``_strip`` and the bounds ``_top, _bottom`` of the target lines a pixel serves in that strip.
    """
    size = STRIP_ROWS
    first, last = f"greatest(0, y - {reach})", f"least(h - 1, y + {reach})"
    strips = F.expr(f"sequence(cast({first} div {size} AS int), cast({last} div {size} AS int))")
    dealt = px.withColumn("_strip", F.explode(strips)).repartition("img_id", "_strip")
    return dealt.withColumns(
        {
            "_top": F.expr(f"greatest({first}, _strip * {size})"),
            "_bottom": F.expr(f"least({last}, _strip * {size} + {size - 1})"),
        }
    )


def _kernel3(px: DataFrame, center: int, around: int, divisor: int) -> DataFrame:
    """3x3 filter with equal weights around the center; adds ``_r, _g, _b`` next to the originals.

    Border pixels keep their value.
    """
    x, y, w, h = F.col("_ox"), F.col("_oy"), F.col("w"), F.col("h")
    spread = _in_strips(px, 1).withColumn("_oy", F.explode(F.sequence("_top", "_bottom"))).withColumn(
        "_ox", F.explode(F.sequence(F.greatest(F.lit(0), F.col("x") - 1), F.least(F.col("w") - 1, F.col("x") + 1)))
    )
    own = (F.col("_ox") == F.col("x")) & (F.col("_oy") == F.col("y"))
    border = (x == 0) | (y == 0) | (x == w - 1) | (y == h - 1)
    spread = spread.withColumns({"_own": own, "_border": border}).where(F.col("_own") | ~F.col("_border"))
    factor = F.when(F.col("_own"), F.when(F.col("_border"), divisor).otherwise(center)).otherwise(around)
    out = spread.withColumn("_k", factor).groupBy(
        "img_id", "_strip", "w", "h", F.col("_ox").alias("x"), F.col("_oy").alias("y")
    ).agg(
        *[F.max(F.when(F.col("_own"), F.col(c))).alias(c) for c in CHANNELS],
        *[F.sum(F.col("_k") * F.col(c)).alias(f"_{c}") for c in CHANNELS],
    )
    return out.withColumns(
        {f"_{c}": F.floor(color.clamp(F.col(f"_{c}") / float(divisor) + 0.5, 0.0, 255.0)).cast("int") for c in CHANNELS}
    )


def sharpen(px: DataFrame, factor: float = 1.0) -> DataFrame:
    """Blend towards the sharpened image: 1.0 is the full filter."""
    out = _kernel3(px, center=32, around=-2, divisor=16)
    order = [c for c in px.columns if c != "a"]
    return out.withColumns({c: color.blend(F.col(c), F.col(f"_{c}"), factor) for c in CHANNELS}).select(order)


def sharpness(px: DataFrame, factor: float = 1.0) -> DataFrame:
    """Blend from a smoothed image: 0 is smooth, 1 the original, more exaggerates detail."""
    out = _kernel3(px, center=5, around=1, divisor=13)
    order = [c for c in px.columns if c != "a"]
    return out.withColumns({c: color.blend(F.col(f"_{c}"), F.col(c), factor) for c in CHANNELS}).select(order)


# --- median -------------------------------------------------------------------------------------


def noise_reduction(px: DataFrame, strength: float = 1.0) -> DataFrame:
    """Median whose window grows with strength, then a light blur when strength is above one half."""
    size = max(3, int(strength * 3))
    size += 1 - size % 2
    out = median_filter(px, size)
    return gaussian_blur(out, (strength - 0.5) * 2) if strength > 0.5 else out


# --- rotation -----------------------------------------------------------------------------------


def _trig(angle: float) -> tuple[float, float]:
    quarter = {0: (1.0, 0.0), 90: (0.0, 1.0), 180: (-1.0, 0.0), 270: (0.0, -1.0)}
    turned = angle % 360
    if turned in quarter:
        return quarter[turned]
    return math.cos(math.radians(angle)), math.sin(math.radians(angle))


def rotate(
    px: DataFrame, angle: float, expand: bool = False, fill: tuple[int, int, int] = (0, 0, 0)
) -> DataFrame:
    """Rotate counter-clockwise, nearest sample.

    A source pixel proposes the few target pixels around its forward image and keeps those whose inverse
    image falls into it. Target pixels without a source are listed by the image's own rows: the first
    pixel of row ``y`` also stands for the canvas rows ``y, y + h, ...``. One narrow pass, no join.
    """
    cos, sin = _trig(angle)
    canvas = rotated_canvas_for(F.col("w"), F.col("h"), angle) if expand else {"w": F.col("w"), "h": F.col("h")}
    order = px.columns
    w, h, cw, ch, grid = (F.col(c) for c in ("w", "h", "_cw", "_ch", "_grid"))
    px = px.withColumns({"_cw": canvas["w"].cast("int"), "_ch": canvas["h"].cast("int")})
    px = px.withColumn("_grid", F.explode(F.expr("if(x = 0 AND y < _ch, array(false, true), array(false))")))

    sx, sy = F.col("x") + 0.5 - w / 2.0, F.col("y") + 0.5 - h / 2.0
    px = px.withColumns({"_fx": cos * sx + sin * sy + cw / 2.0, "_fy": cos * sy - sin * sx + ch / 2.0})
    # A target center lies within half a diagonal of the forward image of its source center.
    reach = 1.2072

    def near(center: str, limit: Column) -> Column:
        lo = F.greatest(F.lit(0), F.ceil(F.col(center) - reach).cast("int"))
        hi = F.least(limit - 1, F.floor(F.col(center) + reach - 1).cast("int"))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    spread = px.withColumn("_ty", F.explode(F.when(grid, F.sequence(F.col("y"), ch - 1, h)).otherwise(near("_fy", ch))))
    spread = spread.withColumn(
        "_tx", F.explode(F.when(grid, F.sequence(F.lit(0), cw - 1)).otherwise(near("_fx", cw)))
    )
    dx, dy = F.col("_tx") + 0.5 - cw / 2.0, F.col("_ty") + 0.5 - ch / 2.0
    spread = spread.withColumns(
        {"_ix": F.floor(cos * dx - sin * dy + w / 2.0), "_iy": F.floor(sin * dx + cos * dy + h / 2.0)}
    )
    outside = F.expr("_ix < 0 OR _iy < 0 OR _ix >= w OR _iy >= h")
    kept = spread.where(F.when(grid, outside).otherwise((F.col("_ix") == F.col("x")) & (F.col("_iy") == F.col("y"))))
    blank = {c: F.when(grid, F.lit(v)).otherwise(F.col(c)) for c, v in zip(CHANNELS, fill)}
    if "a" in order:
        blank["a"] = F.when(grid, F.lit(255)).otherwise(F.col("a"))
    return kept.withColumns(blank | {"x": F.col("_tx"), "y": F.col("_ty"), "w": cw, "h": ch}).select(order)


# --- watermark ----------------------------------------------------------------------------------

# 3x5 glyphs, one octal digit per row from the top, leftmost dot is the high bit.
GLYPHS = {
    "0": 0o75557, "1": 0o26227, "2": 0o71747, "3": 0o71717, "4": 0o55711,
    "5": 0o74717, "6": 0o74757, "7": 0o71111, "8": 0o75757, "9": 0o75717,
    "A": 0o75755, "B": 0o65656, "C": 0o34443, "D": 0o65556, "E": 0o74647,
    "F": 0o74644, "G": 0o34553, "H": 0o55755, "I": 0o72227, "J": 0o11152,
    "K": 0o55655, "L": 0o44447, "M": 0o57555, "N": 0o65555, "O": 0o25552,
    "P": 0o65644, "Q": 0o25563, "R": 0o65655, "S": 0o34216, "T": 0o72222,
    "U": 0o55557, "V": 0o55552, "W": 0o55575, "X": 0o55255, "Y": 0o55222,
    "Z": 0o71247, "-": 0o00700, "_": 0o00007, ".": 0o00002, "/": 0o11244,
    ":": 0o02020, "#": 0o57575, "(": 0o12221, ")": 0o42224, "©": 0o74447, ",": 0o00024, "+": 0o02720,
    "!": 0o22202, "?": 0o71202, "&": 0o25253, "'": 0o22000, "=": 0o07070, "@": 0o25543, "%": 0o51245,
}
#: Drawn for a character without a glyph, so that none is lost unseen.
NO_GLYPH = 0o77777
GLYPH_W, GLYPH_H, GLYPH_STEP = 3, 5, 4


#: Words of 32 cells that an overlay may put into the plan.
OVERLAY_WORDS = 1 << 18


def alpha_composite(
    px: DataFrame,
    overlay: DataFrame,
    text_w: int,
    text_h: int,
    position: str = "bottom_right",
    opacity: float = 0.5,
) -> DataFrame:
    """Blend white over the cells of one overlay ``(ox, oy)`` placed at an anchor of every image.

    The overlay is packed into words of 32 cells, which the plan carries as an array: pixels look their cell up by
    row and word, and no pixel is joined. An overlay whose bounding box needs more than ``OVERLAY_WORDS`` words is joined
    instead, by those pixels that lie in the box.
    """
    alpha = int(255 * opacity)
    left, top = watermark_origin(F.col("w"), F.col("h"), F.lit(text_w), F.lit(text_h), position)
    placed = px.withColumns({"_ox": (F.col("x") - left).cast("int"), "_oy": (F.col("y") - top).cast("int")})
    cells = overlay.where("ox IS NOT NULL AND oy IS NOT NULL").select(F.col("ox").cast("int"), F.col("oy").cast("int"))
    box = cells.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("ox", "oy") for f in (F.min, F.max)]).first()
    if box["min_ox"] is None:
        return px
    wide = (box["max_ox"] - box["min_ox"]) // 32 + 1
    high = box["max_oy"] - box["min_oy"] + 1
    inside = F.col("_ox").between(box["min_ox"], box["max_ox"]) & F.col("_oy").between(box["min_oy"], box["max_oy"])
    if wide * high > OVERLAY_WORDS:
        marks = cells.distinct().select(F.col("ox").alias("_ox"), F.col("oy").alias("_oy"), F.lit(alpha).alias("_a"))
        drawn = placed.where(inside).join(marks, ["_ox", "_oy"], "left")
        rest = placed.where(~inside).withColumn("_a", F.lit(0))
        both = drawn.unionByName(rest)
        return both.withColumns(_whitened(F.coalesce("_a", F.lit(0)))).select(px.columns)
    x, y = F.col("ox") - box["min_ox"], F.col("oy") - box["min_oy"]
    word = (y * wide + F.floor(x / 32)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(32)).cast("int"))
    words = [0] * (wide * high)
    for at, bits in cells.groupBy(word.alias("at")).agg(F.bit_or(bit)).collect():
        words[at] = bits
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    x, y = F.col("_ox") - box["min_ox"], F.col("_oy") - box["min_oy"]
    at = (y * wide + F.floor(x / 32) + 1).cast("int")
    found = F.element_at(table, F.when(inside, at).otherwise(1))
    lit_cell = inside & (F.call_function("shiftright", found, F.pmod(x, F.lit(32)).cast("int")).bitwiseAND(1) == 1)
    return placed.withColumns(_whitened(F.when(lit_cell, alpha).otherwise(0))).select(px.columns)


def _whitened(alpha: Column) -> dict[str, Column]:
    return {c: F.when(alpha > 0, color.white_over(F.col(c), alpha)).otherwise(F.col(c)) for c in CHANNELS}


def watermark(
    px: DataFrame,
    text: Column,
    position: str = "bottom_right",
    opacity: float = 50.0,
    font_size: int = 5,
) -> DataFrame:
    """Draw a text column with the dot font; opacity in percent, as users give it. Narrow."""
    alpha = int(255 * (opacity / 100.0))
    dot = max(1, font_size // GLYPH_H)
    staged = px.withColumn("_text", F.upper(text))
    cols = F.char_length("_text") * GLYPH_STEP - 1
    left, top = watermark_origin(F.col("w"), F.col("h"), cols * dot, F.lit(GLYPH_H * dot), position)
    staged = staged.withColumns(
        {"_ox": F.floor((F.col("x") - left) / dot).cast("int"), "_oy": F.floor((F.col("y") - top) / dot).cast("int")}
    )
    font = F.create_map(*[F.lit(v) for pair in GLYPHS.items() for v in pair])
    letter = F.substring(F.col("_text"), (F.floor(F.col("_ox") / GLYPH_STEP) + 1).cast("int"), F.lit(1))
    inside = (
        (F.col("_ox") >= 0) & (F.col("_ox") < cols) & (F.col("_oy") >= 0) & (F.col("_oy") < GLYPH_H)
        & (F.col("_ox") % GLYPH_STEP < GLYPH_W)
    )
    bits = F.when(letter == " ", 0).otherwise(F.coalesce(F.try_element_at(font, letter), F.lit(NO_GLYPH)))
    staged = staged.withColumn("_bits", F.when(inside, bits).otherwise(0)).withColumn(
        "_pos", F.when(inside, (GLYPH_H - 1 - F.col("_oy")) * 3 + 2 - F.col("_ox") % GLYPH_STEP).otherwise(0)
    )
    lit_dot = F.expr("(shiftright(_bits, _pos) & 1) = 1")
    return staged.withColumns(_whitened(F.when(lit_dot, alpha).otherwise(0))).select(px.columns)


def watermark_template(
    px: DataFrame,
    assets: DataFrame,
    template: str,
    variables: dict[str, Column],
    position: str = "bottom_right",
    opacity: float = 75,
    font_size: int = 5,
    optional: set[str] = frozenset(),
) -> DataFrame:
    """Watermark whose text is a naming template over the catalog; images it cannot be rendered for stay as
    they are."""
    texts = tpl.render(assets, template, variables, optional).where(F.col("rendered").isNotNull()).select(
        F.col("asset_id").alias("img_id"), F.col("rendered").alias("_label")
    )
    marked = watermark(attach_per_image(px, texts), F.coalesce("_label", F.lit("")), position, opacity, font_size)
    return marked.select(px.columns)
