"""Pixel operators over the 8x8 images made from the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaforge.operators import neighborhood as nb
from lumaforge.operators import pointwise as pw
from lumaforge.operators.catalog import base_variables
from lumaforge.workload import tables as t
from lumaforge.workload.registry import query

OUT = ["img_id", "x", "y", "r", "g", "b"]
LUMA = "((19595 * r + 38470 * g + 7471 * b + 32768) >> 16)"
CH = ("r", "g", "b")


def clamp(e: str) -> str:
    return f"CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, {e}))) AS INTEGER)"


def _per_channel(expr: str) -> str:
    """``SELECT`` list with ``{v}`` replaced by each channel."""
    return ", ".join(f"{expr.replace('{v}', c)} AS {c}" for c in CH)


def _point(expr: str, source: str = "rgb") -> str:
    return t.with_tables("rgb", f"SELECT img_id, x, y, {_per_channel(expr)} FROM {source}")


@query("X1", _point(LUMA))
def grayscale(spark, sf):
    return pw.grayscale(t.px_rgb(spark, sf)).select(OUT)


@query("X2", _point(clamp("{v} * 1.3::DOUBLE")))
def brightness(spark, sf):
    return pw.brightness(t.px_rgb(spark, sf), 1.3).select(OUT)


@query(
    "X3",
    _point(
        clamp("m + 1.5::DOUBLE * ({v} - m)"),
        f"""(SELECT *, floor((2 * sum({LUMA}) OVER (PARTITION BY img_id) + count(*) OVER (PARTITION BY img_id))
             / (2.0::DOUBLE * count(*) OVER (PARTITION BY img_id))) AS m FROM rgb)""",
    ),
)
def contrast(spark, sf):
    return pw.contrast(t.px_rgb(spark, sf), 1.5).select(OUT)


@query("X4", _point(clamp(f"{LUMA} + 0.4::DOUBLE * ({{v}} - {LUMA})")))
def saturation(spark, sf):
    return pw.saturation(t.px_rgb(spark, sf), 0.4).select(OUT)


@query(
    "X5",
    t.with_tables(
        "rgb",
        """
        , u AS (SELECT img_id, x, y, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM rgb),
        m AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM u),
        s AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN r = hi THEN ((hi - b) / d - (hi - g) / d) / 6.0::DOUBLE
          WHEN g = hi THEN (2.0::DOUBLE + (hi - r) / d - (hi - b) / d) / 6.0::DOUBLE
          ELSE (4.0::DOUBLE + (hi - g) / d - (hi - r) / d) / 6.0::DOUBLE END AS h0,
          CASE WHEN hi = 0 THEN 0.0::DOUBLE ELSE d / hi END AS sat FROM m),
        q AS (SELECT *, h0 - floor(h0) + 60 / 360.0::DOUBLE AS h1 FROM s),
        k AS (SELECT *, (h1 - floor(h1)) * 6.0::DOUBLE AS h6 FROM q),
        p AS (SELECT *, CAST(floor(h6) AS INTEGER) % 6 AS i, h6 - floor(h6) AS f FROM k),
        w AS (SELECT *, hi * (1.0::DOUBLE - sat) AS lo, hi * (1.0::DOUBLE - sat * f) AS q2,
          hi * (1.0::DOUBLE - sat * (1.0::DOUBLE - f)) AS t2 FROM p)
        SELECT img_id, x, y,
          CAST(floor([hi, q2, lo, lo, t2, hi][i + 1] * 255.0::DOUBLE) AS INTEGER) AS r,
          CAST(floor([t2, hi, hi, q2, lo, lo][i + 1] * 255.0::DOUBLE) AS INTEGER) AS g,
          CAST(floor([lo, lo, t2, hi, hi, q2][i + 1] * 255.0::DOUBLE) AS INTEGER) AS b FROM w
        """,
    ),
)
def hue(spark, sf):
    return pw.hue(t.px_rgb(spark, sf), 60).select(OUT)


@query(
    "X6",
    _point(
        "CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, pow(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({v} - 20.0::DOUBLE) / 210.0::DOUBLE)),"
        " 1 / 1.4::DOUBLE) * 230.0::DOUBLE + 10.0::DOUBLE)) + 1e-9) AS INTEGER)"
    ),
)
def levels(spark, sf):
    return pw.levels(t.px_rgb(spark, sf), 20, 230, 1.4, 10, 240).select(OUT)


_SEPIA = {
    "r": "0.393::DOUBLE * r + 0.769::DOUBLE * g + 0.189::DOUBLE * b",
    "g": "0.349::DOUBLE * r + 0.686::DOUBLE * g + 0.168::DOUBLE * b",
    "b": "0.272::DOUBLE * r + 0.534::DOUBLE * g + 0.131::DOUBLE * b",
}


@query(
    "X7",
    t.with_tables(
        "rgb",
        "SELECT img_id, x, y, "
        + ", ".join(f"{clamp(f'{c} + 0.6::DOUBLE * ({clamp(_SEPIA[c])} - {c})')} AS {c}" for c in CH)
        + " FROM rgb",
    ),
)
def sepia(spark, sf):
    return pw.sepia(t.px_rgb(spark, sf), 0.6).select(OUT)


@query(
    "X8",
    t.with_tables(
        "rgb", "SELECT img_id, 5 AS w, 3 AS h, x - 2 AS x, y - 1 AS y, r, g, b FROM rgb WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 3"
    ),
)
def crop(spark, sf):
    return pw.crop(t.px_rgb(spark, sf), 2, 1, 5, 3).select("img_id", "w", "h", "x", "y", "r", "g", "b")


@query(
    "X8",
    t.with_tables("rgb", "SELECT img_id, 6 AS w, 3 AS h, x - 2 AS x, y - 5 AS y, r, g, b FROM rgb WHERE x >= 2 AND y >= 5"),
)
def crop_to_edge(spark, sf):
    return pw.crop(t.px_rgb(spark, sf), 2, 5).select("img_id", "w", "h", "x", "y", "r", "g", "b")


# The pixels of an image dealt anew to sixteen columns and four lines, so that width and height differ.
_WIDE = """wide AS (SELECT img_id, CAST((y * 8 + x) % 16 AS INTEGER) AS x, CAST((y * 8 + x) // 16 AS INTEGER) AS y, r, g, b FROM rgb)"""


def _wide(spark, sf):
    return t.px_rgb(spark, sf).selectExpr(
        "img_id", "16 AS w", "4 AS h", "cast((y * 8 + x) % 16 AS int) AS x", "cast((y * 8 + x) div 16 AS int) AS y", "r", "g", "b"
    )


_MAPS = {
    "flip_horizontal": "15 - x, y", "FLIP_TOP_BOTTOM": "x, 3 - y", "ROTATE_90": "y, 15 - x",
    "ROTATE_180": "15 - x, 3 - y", "ROTATE_270": "3 - y, x", "TRANSPOSE": "y, x", "TRANSVERSE": "3 - y, 15 - x",
}


@query(
    "X9",
    t.with_tables(
        "rgb",
        f", {_WIDE} " + " UNION ALL ".join(
            f"SELECT '{m}' AS method, img_id, {e.split(', ')[0]} AS x, {e.split(', ')[1]} AS y, r, g, b FROM wide"
            for m, e in _MAPS.items()
        ),
    ),
)
def transpose(spark, sf):
    px = _wide(spark, sf)
    out = None
    for m in _MAPS:
        part = pw.transpose(px, m).select(F.lit(m).alias("method"), *OUT)
        out = part if out is None else out.unionByName(part)
    return out


@query("S13", _point("(({v} * a + 255 * (255 - a) + 127) // 255)"))
def flatten_alpha(spark, sf):
    return pw.flatten_alpha(t.px_rgb(spark, sf, alpha=True)).select(OUT)


# --- resampling ---------------------------------------------------------------------------------

KERNEL_SQL = {
    "BILINEAR": ("greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(t))", 1),
    "BICUBIC": (
        "CASE WHEN abs(t) < 1 THEN (1.5::DOUBLE * abs(t) - 2.5::DOUBLE) * abs(t) * abs(t) + 1.0::DOUBLE"
        " WHEN abs(t) < 2 THEN (((abs(t) - 5.0::DOUBLE) * abs(t) + 8.0::DOUBLE) * abs(t) - 4.0::DOUBLE) * -0.5::DOUBLE ELSE 0 END",
        2,
    ),
    "LANCZOS": (
        "CASE WHEN abs(t) < 3 THEN (CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE sin(t * pi()) / (t * pi()) END)"
        " * (CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE sin(t / 3 * pi()) / (t / 3 * pi()) END) ELSE 0 END",
        3,
    ),
}


def _weights(name: str, n: int, out: int, kernel: str) -> str:
    """CTE with the weight of source ``i`` in target ``o``."""
    expr, _ = KERNEL_SQL[kernel]
    scale = max(n / out, 1.0)
    return (
        f"{name} AS (SELECT o, i, CAST(floor({expr} * 1048576 + 0.5) AS BIGINT) AS wt FROM (SELECT o, i,"
        f" ((i + 0.5::DOUBLE) - (o + 0.5::DOUBLE) * {n} / {out}.0::DOUBLE) / {scale}::DOUBLE AS t FROM range({out}) a(o), range({n}) b(i)))"
    )


def _mean(c: str) -> str:
    return f"CAST(greatest(0, least(255, floor((2 * sum(wt * {c}) + sum(wt)) / (2.0::DOUBLE * sum(wt))))) AS INTEGER) AS {c}"


def _passes(source: str, wx: str, wy: str) -> str:
    cols = ", ".join(_mean(c) for c in CH)
    return f"""
      hz AS (SELECT img_id, CAST(o AS INTEGER) AS x, y, {cols} FROM {source} s JOIN {wx} k ON k.i = s.x GROUP BY img_id, o, y),
      vt AS (SELECT img_id, x, CAST(o AS INTEGER) AS y, {cols} FROM hz s JOIN {wy} k ON k.i = s.y GROUP BY img_id, x, o)"""


def _resize_sql(out_w: int, out_h: int, kernel: str) -> str:
    return t.with_tables(
        "rgb",
        f", {_weights('kx', 8, out_w, kernel)}, {_weights('ky', 8, out_h, kernel)}, {_passes('rgb', 'kx', 'ky')} SELECT * FROM vt",
    )


def _resized(spark, sf, w, h, kernel):
    return nb.resize(t.px_rgb(spark, sf), w, h, maintain_aspect=False, resample=kernel).select(OUT)


@query("N1", _resize_sql(4, 4, "BILINEAR"))
def resize_bilinear(spark, sf):
    return _resized(spark, sf, 4, 4, "BILINEAR")


@query("N1", _resize_sql(4, 4, "BICUBIC"))
def resize_bicubic(spark, sf):
    return _resized(spark, sf, 4, 4, "BICUBIC")


@query("N1", _resize_sql(5, 3, "LANCZOS"))
def resize_lanczos(spark, sf):
    return _resized(spark, sf, 5, 3, "LANCZOS")


@query("N1", _resize_sql(13, 11, "LANCZOS"))
def resize_enlarge(spark, sf):
    return _resized(spark, sf, 13, 11, "LANCZOS")


@query(
    "N1",
    t.with_tables(
        "rgb",
        """SELECT img_id, CAST(ox AS INTEGER) AS x, CAST(oy AS INTEGER) AS y, r, g, b FROM rgb, range(5) p(ox), range(11) q(oy)
        WHERE floor((ox + 0.5::DOUBLE) * 8 / 5) = x AND floor((oy + 0.5::DOUBLE) * 8 / 11) = y""",
    ),
)
def resize_nearest(spark, sf):
    return _resized(spark, sf, 5, 11, "NEAREST")


def _blur_sql(radius: float) -> str:
    weights = nb.gaussian_weights(radius)
    reach = len(weights) - 1
    offsets = ", ".join(f"({d}, {weights[abs(d)]})" for d in range(-reach, reach + 1))
    return t.with_tables(
        "rgb",
        f"""
        , off(d, wt0) AS (VALUES {offsets}),
        kk AS (SELECT o, greatest(0, least(7, o + d)) AS i, wt0 AS wt FROM range(8) a(o), off),
        {_passes('rgb', 'kk', 'kk')} SELECT * FROM vt
        """,
    )


@query("N2", _blur_sql(1.0))
def gaussian_blur(spark, sf):
    return nb.gaussian_blur(t.px_rgb(spark, sf), 1.0).select(OUT)


@query("N2", _blur_sql(3.5))
def gaussian_blur_wide(spark, sf):
    """The kernel reaches beyond both edges of the image."""
    return nb.gaussian_blur(t.px_rgb(spark, sf), 3.5).select(OUT)


def _kernel_sql(center: int, around: int, divisor: int, blend: str) -> str:
    sums = ", ".join(
        f"sum(CASE WHEN n.x = s.x AND n.y = s.y THEN {center} ELSE {around} END * n.{c}) AS k{c}" for c in CH
    )
    cols = ", ".join(
        f"CASE WHEN s.x IN (0, 7) OR s.y IN (0, 7) THEN s.{c} ELSE {clamp(blend.format(v=f's.{c}', k=clamp(f'k{c} / {divisor}.0::DOUBLE + 0.5')))} END AS {c}"
        for c in CH
    )
    return t.with_tables(
        "rgb",
        f"""
        , k AS (SELECT s.img_id, s.x, s.y, {sums} FROM rgb s JOIN rgb n ON n.img_id = s.img_id
            AND abs(n.x - s.x) <= 1 AND abs(n.y - s.y) <= 1 GROUP BY s.img_id, s.x, s.y)
        SELECT s.img_id, s.x, s.y, {cols} FROM rgb s JOIN k USING (img_id, x, y)
        """,
    )


@query("N3", _kernel_sql(32, -2, 16, "{v} + 0.8::DOUBLE * ({k} - {v})"))
def sharpen(spark, sf):
    return nb.sharpen(t.px_rgb(spark, sf), 0.8).select(OUT)


@query("N4", _kernel_sql(5, 1, 13, "{k} + 1.7::DOUBLE * ({v} - {k})"))
def sharpness(spark, sf):
    return nb.sharpness(t.px_rgb(spark, sf), 1.7).select(OUT)


def _median_ctes(size: int) -> str:
    reach = size // 2
    cols = ", ".join(f"list_sort(list(n.{c}))[{(size * size + 1) // 2}] AS {c}" for c in CH)
    return f"""
      d AS (SELECT dx, dy FROM range({-reach}, {reach + 1}) a(dx), range({-reach}, {reach + 1}) b(dy)),
      med AS (SELECT s.img_id, s.x, s.y, {cols} FROM rgb s, d JOIN rgb n ON n.img_id = s.img_id
        AND n.x = greatest(0, least(7, s.x + dx)) AND n.y = greatest(0, least(7, s.y + dy)) GROUP BY s.img_id, s.x, s.y)"""


@query("N5", t.with_tables("rgb", f", {_median_ctes(3)} SELECT * FROM med"))
def median(spark, sf):
    return nb.median_filter(t.px_rgb(spark, sf), 3).select(OUT)


def _noise_sql(size: int, radius: float) -> str:
    weights = nb.gaussian_weights(radius)
    reach = len(weights) - 1
    offsets = ", ".join(f"({o}, {weights[abs(o)]})" for o in range(-reach, reach + 1))
    return t.with_tables(
        "rgb",
        f""", {_median_ctes(size)}, off(d, wt0) AS (VALUES {offsets}),
        kk AS (SELECT o, greatest(0, least(7, o + off.d)) AS i, wt0 AS wt FROM range(8) a(o), off),
        {_passes('med', 'kk', 'kk')} SELECT * FROM vt""",
    )


@query("N5", _noise_sql(3, 1.0))
def noise_reduction(spark, sf):
    return nb.noise_reduction(t.px_rgb(spark, sf), 1.0).select(OUT)


@query("N5", _noise_sql(5, 2.4))
def noise_reduction_strong(spark, sf):
    return nb.noise_reduction(t.px_rgb(spark, sf), 1.7).select(OUT)


# --- rotation and watermark ---------------------------------------------------------------------


def _rotate_sql(cos: str, sin: str, cw: int, ch: int) -> str:
    """Gather form: every canvas pixel looks up its source in a 16x4 image."""
    sx = f"CAST(floor({cos} * (tx + 0.5::DOUBLE - {cw} / 2.0::DOUBLE) - {sin} * (ty + 0.5::DOUBLE - {ch} / 2.0::DOUBLE) + 16 / 2.0::DOUBLE) AS INTEGER)"
    sy = f"CAST(floor({sin} * (tx + 0.5::DOUBLE - {cw} / 2.0::DOUBLE) + {cos} * (ty + 0.5::DOUBLE - {ch} / 2.0::DOUBLE) + 4 / 2.0::DOUBLE) AS INTEGER)"
    return t.with_tables(
        "rgb",
        f"""
        , {_WIDE}, c AS (SELECT img_id, tx, ty, {sx} AS sx, {sy} AS sy FROM (SELECT DISTINCT img_id FROM rgb), range({cw}) a(tx), range({ch}) b(ty))
        SELECT c.img_id, CAST(tx AS INTEGER) AS x, CAST(ty AS INTEGER) AS y, coalesce(r, 9) AS r, coalesce(g, 8) AS g, coalesce(b, 7) AS b
        FROM c LEFT JOIN wide s ON s.img_id = c.img_id AND s.x = sx AND s.y = sy
        """,
    )


def _rotated(spark, sf, angle, expand):
    return nb.rotate(_wide(spark, sf), angle, expand, (9, 8, 7)).select(OUT)


@query("N6", _rotate_sql("0.0::DOUBLE", "1.0::DOUBLE", 4, 16))
def rotate_quarter(spark, sf):
    return _rotated(spark, sf, 90, True)


@query("N6", _rotate_sql("0.0::DOUBLE", "-1.0::DOUBLE", 16, 4))
def rotate_same_canvas(spark, sf):
    return _rotated(spark, sf, 270, False)


@query("N6", _rotate_sql("0.8660254037844387::DOUBLE", "0.49999999999999994::DOUBLE", 16, 12))
def rotate_free(spark, sf):
    return _rotated(spark, sf, 30, True)


_WHITE = "CASE WHEN on_dot THEN ({v} * (255 - 127) + 255 * 127 + 127) // 255 ELSE {v} END"


@query(
    "N7",
    t.with_tables(
        "rgb",
        f""", z AS (SELECT *, x * 3 + i AS zx, y * 3 + j AS zy FROM rgb, range(3) a(i), range(3) b(j)),
        m AS (SELECT *, (zx - (24 - 7 - 10)) BETWEEN 0 AND 6 AND (zy - (24 - 3 - 10)) BETWEEN 0 AND 2
            AND ((zx - 7) + (zy - 11)) % 2 = 0 AS on_dot FROM z)
        SELECT img_id, CAST(zx AS INTEGER) AS x, CAST(zy AS INTEGER) AS y, {_per_channel(_WHITE)} FROM m""",
    ),
)
def alpha_composite(spark, sf):
    """A checkered 7x3 overlay on images enlarged to 24x24."""
    px = nb.resize(t.px_rgb(spark, sf), 24, 24, maintain_aspect=False, resample="NEAREST")
    cells = px.where("x < 7 AND y < 3 AND (x + y) % 2 = 0").selectExpr("x AS ox", "y AS oy").distinct()
    return nb.alpha_composite(px, cells, 7, 3, "bottom_right", 0.5).select(OUT)


@query(
    "N7 T1",
    t.with_tables(
        "rgb",
        f""", z AS (SELECT *, x * 3 + i AS zx, y * 3 + j AS zy FROM rgb, range(3) a(i), range(3) b(j)),
        glyphs(ch, rows) AS (VALUES ('0', 'XXXX.XX.XX.XXXX'), ('1', '.X.XX..X..X.XXX'), ('2', 'XXX..XXXXX..XXX'),
          ('3', 'XXX..XXXX..XXXX'), ('4', 'X.XX.XXXX..X..X'), ('5', 'XXXX..XXX..XXXX'), ('6', 'XXXX..XXXX.XXXX'),
          ('7', 'XXX..X..X..X..X'), ('8', 'XXXX.XXXXX.XXXX'), ('9', 'XXXX.XXXX..XXXX')),
        n AS (SELECT *, CAST(img_id % 1000 AS VARCHAR) AS txt, length(CAST(img_id % 1000 AS VARCHAR)) * 4 - 1 AS tw,
            zx - 10 AS ox, zy - 10 AS oy FROM z),
        m AS (SELECT n.*, coalesce(substr(rows, CAST(oy * 3 + ox % 4 + 1 AS BIGINT), 1) = 'X', false) AS on_dot FROM n LEFT JOIN glyphs
            ON ox >= 0 AND ox < tw AND oy BETWEEN 0 AND 4 AND ox % 4 < 3 AND ch = substr(txt, CAST(ox // 4 + 1 AS BIGINT), 1))
        SELECT img_id, CAST(zx AS INTEGER) AS x, CAST(zy AS INTEGER) AS y, {_per_channel(_WHITE)} FROM m""",
    ),
)
def watermark_text(spark, sf):
    """Each image carries its own number in the top left corner."""
    px = nb.resize(t.px_rgb(spark, sf), 24, 24, maintain_aspect=False, resample="NEAREST")
    images = t.read(spark, sf, "embeddings").selectExpr(
        "vec_id AS asset_id", "concat('/x/', cast(vec_id % 1000 AS string), '.png') AS path", "24 AS width", "24 AS height",
        "'PNG' AS format", "'RGB' AS mode", "0L AS size_bytes", "72 AS dpi_x", "72 AS dpi_y",
        "cast(NULL AS string) AS color_profile", "cast(NULL AS string) AS original_path",
    )
    return nb.watermark_template(px, images, "<filename>", base_variables(), "top_left", 50).select(OUT)
