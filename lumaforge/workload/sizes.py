"""Geometry over widths and heights."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaforge.functions import geometry as g
from lumaforge.workload import tables as t
from lumaforge.workload.registry import query

def _size():
    return F.col("width"), F.col("height")


@query(
    "G1",
    t.with_tables(
        "cat",
        """
        , c AS (SELECT *, CASE WHEN asset_id % 4 IN (0, 2) THEN 100 + asset_id % 900 END AS tw,
            CASE WHEN asset_id % 4 IN (1, 2) THEN 150 + asset_id % 700 END AS th FROM cat)
        SELECT asset_id,
          CAST(CASE WHEN tw IS NOT NULL AND th IS NOT NULL THEN floor(width * least(tw / width::DOUBLE, th / height::DOUBLE))
            WHEN tw IS NOT NULL THEN tw WHEN th IS NOT NULL THEN floor(th * (width / height::DOUBLE)) END AS INTEGER) AS fit_w,
          CAST(CASE WHEN tw IS NOT NULL AND th IS NOT NULL THEN floor(height * least(tw / width::DOUBLE, th / height::DOUBLE))
            WHEN tw IS NOT NULL THEN floor(tw / (width / height::DOUBLE)) WHEN th IS NOT NULL THEN th END AS INTEGER) AS fit_h,
          CASE WHEN asset_id % 4 <> 3 THEN CAST(coalesce(tw, width) AS INTEGER) END AS free_w,
          CASE WHEN asset_id % 4 <> 3 THEN CAST(coalesce(th, height) AS INTEGER) END AS free_h,
          CASE WHEN asset_id % 4 = 3 THEN 'Must specify at least one target dimension' END AS error
        FROM c
        """,
    ),
)
def fit_size(spark, sf):
    w, h = _size()
    c = t.catalog(spark, sf).selectExpr(
        "*", "if(asset_id % 4 IN (0, 2), 100 + asset_id % 900, NULL) AS tw",
        "if(asset_id % 4 IN (1, 2), 150 + asset_id % 700, NULL) AS th",
    )
    fit, free = (g.fit_size(w, h, F.col("tw"), F.col("th"), keep) for keep in (True, False))
    return c.select("asset_id", fit.alias("a"), free.alias("b")).select(
        "asset_id", F.col("a.width").alias("fit_w"), F.col("a.height").alias("fit_h"),
        F.col("b.width").alias("free_w"), F.col("b.height").alias("free_h"), "a.error",
    )


@query(
    "G2",
    t.with_tables(
        "cat",
        """
        , c AS (SELECT *, CASE WHEN asset_id % 4 IN (0, 2) THEN 100 + asset_id % 900 END AS tw,
            CASE WHEN asset_id % 4 IN (1, 2) THEN 150 + asset_id % 700 END AS th, asset_id % 7 <> 0 AS keep,
            width / height::DOUBLE AS ratio FROM cat)
        SELECT asset_id,
          CAST(CASE WHEN keep AND tw > 0 AND th > 0 THEN CASE WHEN tw / th::DOUBLE > ratio THEN floor(th * ratio) ELSE tw END
            WHEN tw > 0 THEN tw WHEN keep AND th > 0 THEN floor(th * ratio) ELSE width END AS INTEGER) AS w,
          CAST(CASE WHEN keep AND tw > 0 AND th > 0 THEN CASE WHEN tw / th::DOUBLE > ratio THEN th ELSE floor(tw / ratio) END
            WHEN keep AND tw > 0 THEN floor(tw / ratio) WHEN th > 0 THEN th ELSE height END AS INTEGER) AS h
        FROM c
        """,
    ),
)
def resize_target(spark, sf):
    w, h = _size()
    c = t.catalog(spark, sf).selectExpr(
        "*", "if(asset_id % 4 IN (0, 2), 100 + asset_id % 900, NULL) AS tw",
        "if(asset_id % 4 IN (1, 2), 150 + asset_id % 700, NULL) AS th", "asset_id % 7 <> 0 AS keep",
    )
    size = g.resize_target(w, h, F.col("tw"), F.col("th"), F.col("keep"))
    return c.select("asset_id", size["w"].alias("w"), size["h"].alias("h"))


@query(
    "G3",
    t.with_tables(
        "cat",
        """
        SELECT asset_id, CASE WHEN x < 0 THEN 'Crop X position cannot be negative' WHEN y < 0 THEN 'Crop Y position cannot be negative'
          WHEN cw <= 0 THEN 'Crop width must be positive' WHEN ch <= 0 THEN 'Crop height must be positive'
          WHEN x + cw > width THEN 'Crop area extends beyond image width'
          WHEN y + ch > height THEN 'Crop area extends beyond image height' END AS error
        FROM (SELECT *, asset_id % 50 - 3 AS x, asset_id % 37 - 2 AS y, asset_id % 900 - 5 AS cw, asset_id % 700 - 4 AS ch FROM cat)
        """,
    ),
)
def crop_bounds(spark, sf):
    w, h = _size()
    c = t.catalog(spark, sf).selectExpr(
        "*", "asset_id % 50 - 3 AS x", "asset_id % 37 - 2 AS y", "asset_id % 900 - 5 AS cw", "asset_id % 700 - 4 AS ch"
    )
    error = g.crop_error(w, h, F.col("x"), F.col("y"), F.col("cw"), F.col("ch"))
    return c.select("asset_id", error.alias("error"))


@query(
    "G4",
    t.with_tables(
        "cat",
        """
        SELECT asset_id, CASE WHEN ok THEN (width - 801) // 2 END AS x, CASE WHEN ok THEN (height - 600) // 2 END AS y,
          CASE WHEN ok THEN 801 END AS width, CASE WHEN ok THEN 600 END AS height,
          CASE WHEN NOT ok THEN 'Target crop size is larger than image' END AS error
        FROM (SELECT *, width >= 801 AND height >= 600 AS ok FROM cat)
        """,
    ),
)
def centered_crop(spark, sf):
    w, h = _size()
    c = t.catalog(spark, sf)
    return c.select("asset_id", g.centered_crop(w, h, F.lit(801), F.lit(600)).alias("c")).select("asset_id", "c.*")


@query(
    "G5",
    t.with_tables(
        "cat",
        """
        , c AS (SELECT *, ['top_left', 'top_right', 'bottom_left', 'bottom_right', 'center', 'other'][asset_id % 6 + 1] AS p,
            40 + asset_id % 30 AS tw, 12 AS th FROM cat)
        SELECT asset_id, p, CAST(CASE WHEN p IN ('top_left', 'bottom_left') THEN 10 WHEN p = 'center' THEN floor((width - tw) / 2.0::DOUBLE)
            ELSE width - tw - 10 END AS INTEGER) AS x,
          CAST(CASE WHEN p IN ('top_left', 'top_right') THEN 10 WHEN p = 'center' THEN floor((height - th) / 2.0::DOUBLE)
            ELSE height - th - 10 END AS INTEGER) AS y FROM c
        """,
    ),
)
def watermark_position(spark, sf):
    w, h = _size()
    c = t.catalog(spark, sf).selectExpr(
        "*", "element_at(array('top_left','top_right','bottom_left','bottom_right','center','other'), cast(asset_id % 6 AS int) + 1) AS p",
        "40 + asset_id % 30 AS tw",
    )
    x, y = g.watermark_origin(w, h, F.col("tw"), F.lit(12), F.col("p"))
    return c.select("asset_id", "p", x.alias("x"), y.alias("y"))


@query(
    "G6",
    t.with_tables(
        "cat",
        """
        SELECT asset_id, 90 AS angle, height AS w, width AS h FROM cat
        UNION ALL SELECT asset_id, 180, width, height FROM cat
        UNION ALL SELECT asset_id, 30,
          CAST(ceil(width * 0.8660254037844387::DOUBLE + height * 0.49999999999999994::DOUBLE - 1e-9) AS INTEGER),
          CAST(ceil(width * 0.49999999999999994::DOUBLE + height * 0.8660254037844387::DOUBLE - 1e-9) AS INTEGER) FROM cat
        """,
    ),
)
def rotated_canvas(spark, sf):
    w, h = _size()
    c = t.catalog(spark, sf)
    sizes = F.array(
        *[
            F.struct(F.lit(a).alias("angle"), s["w"].alias("w"), s["h"].alias("h"))
            for a in (90, 180, 30)
            for s in [g.rotated_canvas_for(w, h, a)]
        ]
    )
    return c.select("asset_id", F.explode(sizes).alias("s")).select("asset_id", "s.*")
