"""Scans, derived columns, checks and updates of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaforge.functions import derived as d
from lumaforge.operators import catalog as cat
from lumaforge.operators.metadata import with_metadata
from lumaforge.operators.pointwise import crop
from lumaforge.workload import tables as t
from lumaforge.workload.registry import query


def assets(spark, sf):
    """Catalog rows with their tag records."""
    return with_metadata(t.catalog(spark, sf), t.exif_tags(spark, sf), t.iptc_tags(spark, sf))


SQL_NAME = "regexp_extract(path, '[^/]*$')"
SQL_STEM = f"regexp_replace({SQL_NAME}, '\\.[^.]+$', '')"
SQL_PARENT = "regexp_replace(path, '/[^/]*$', '')"


@query(
    "S1",
    t.with_tables("cat", "SELECT asset_id, path FROM cat WHERE lower(path) SIMILAR TO '.*\\.(jpg|jpeg|png|bmp|tiff|webp)'"),
)
def scan_recursive(spark, sf):
    return cat.scan_recursive(t.catalog(spark, sf)).select("asset_id", "path")


@query("S2", t.with_tables("cat", "SELECT asset_id, path FROM cat WHERE path GLOB '/photos/src4/en/*.jpg'"))
def scan_pattern(spark, sf):
    return cat.scan_pattern(t.catalog(spark, sf), "/photos/src4/en", "*.jpg").select("asset_id", "path")


@query("S2", t.with_tables("cat", f"SELECT asset_id, path FROM cat WHERE {SQL_NAME} GLOB 'IMG_*[0-4].?*g'"))
def scan_glob_classes(spark, sf):
    return cat.scan_pattern(t.catalog(spark, sf), None, "IMG_*[0-4].?*g").select("asset_id", "path")


@query(
    "S12",
    t.with_tables(
        "cat",
        f"""
        SELECT asset_id, {SQL_PARENT} || '/' || {SQL_STEM} || '_processed' || regexp_extract(path, '\\.[^.]+$') AS single,
          {SQL_PARENT} || '_processed/' || {SQL_NAME} AS batch FROM cat
        """,
    ),
)
def output_paths(spark, sf):
    path = F.col("path")
    return t.catalog(spark, sf).select(
        "asset_id", d.output_path(path).alias("single"), d.batch_output_path(path).alias("batch")
    )


@query(
    "P1 P2 P3",
    t.with_tables(
        "cat",
        """
        SELECT asset_id, width / height::DOUBLE AS ratio, round_even(width / height::DOUBLE, 2) AS aspect_ratio,
          width::BIGINT * height / 1000000.0::DOUBLE AS mp,
          round_even(width::BIGINT * height / 1000000.0::DOUBLE, 1) AS megapixels,
          coalesce(CASE WHEN asset_id % 13 <> 0 THEN size_bytes END / 1048576.0::DOUBLE, 0) AS file_size_mb
        FROM cat
        """,
    ),
)
def image_measures(spark, sf):
    w, h = F.col("width"), F.col("height")
    return t.catalog(spark, sf).select(
        "asset_id",
        d.aspect_ratio(w, h).alias("ratio"),
        F.bround(d.aspect_ratio(w, h), 2).alias("aspect_ratio"),
        d.megapixels(w, h).alias("mp"),
        F.bround(d.megapixels(w, h), 1).alias("megapixels"),
        d.file_size_mb(F.when(F.col("asset_id") % 13 != 0, F.col("size_bytes"))).alias("file_size_mb"),
    )


@query(
    "P4",
    t.with_tables(
        "cat",
        f"""
        SELECT asset_id, {SQL_STEM} AS filename, {SQL_NAME} AS basename,
          regexp_extract(path, '\\.([^.]+)$', 1) AS extension,
          string_split(path, '/')[-2] AS parent, {SQL_PARENT} AS parent_path FROM cat
        """,
    ),
)
def path_parts(spark, sf):
    path = F.col("path")
    return t.catalog(spark, sf).select(
        "asset_id",
        d.stem(path).alias("filename"),
        d.basename(path).alias("basename"),
        d.extension(path).alias("extension"),
        d.parent_name(path).alias("parent"),
        d.parent_path(path).alias("parent_path"),
    )


@query(
    "P5",
    t.with_tables(
        "cat",
        f"""
        SELECT asset_id, format, lower(format) AS format_lower, mode, dpi_x AS dpi_horizontal, dpi_y AS dpi_vertical,
          coalesce(color_profile, '') AS color_profile,
          coalesce('DSC_' || CASE WHEN original_path IS NOT NULL THEN asset_id END, {SQL_STEM}) AS original_filename
        FROM cat
        """,
    ),
)
def format_fields(spark, sf):
    v = cat.base_variables()
    names = ["format", "format_lower", "mode", "dpi_horizontal", "dpi_vertical", "color_profile", "original_filename"]
    return t.catalog(spark, sf).select("asset_id", *[v[n].alias(n) for n in names])


_EXIF_VARS = """
exif_vars AS (
  SELECT asset_id, coalesce(datetime, datetime_original, '') AS date_taken,
    make AS camera_make, model AS camera_model, coalesce(lens_model, '') AS lens_model,
    CASE WHEN fl_num IS NULL THEN '' ELSE fl_num || 'mm' END AS focal_length,
    CASE WHEN fn_den = 0 THEN '(' || fn_num || ', 0)' ELSE 'f/' || printf('%.1f', fn_num / 10.0::DOUBLE) END AS aperture,
    CAST(iso_speed AS VARCHAR) AS iso,
    CASE WHEN exp_num = 1 THEN '1/' || exp_den || 's' ELSE printf('%.2fs', exp_num / exp_den::DOUBLE) END AS exposure_time
  FROM exif)
"""


@query(
    "P6 P7 P8 P9 P10",
    t.with_tables("cat exif", f", {_EXIF_VARS} SELECT cat.asset_id, exif_vars.* EXCLUDE asset_id FROM cat LEFT JOIN exif_vars USING (asset_id)"),
)
def exif_labels(spark, sf):
    return assets(spark, sf).select("asset_id", *[v.alias(n) for n, v in cat.exif_variables().items()])


@query(
    "P11",
    t.with_tables(
        "cat iptc",
        """
        SELECT cat.asset_id, title, description, array_to_string(keywords, ', ') AS keywords,
          CASE WHEN title IS NOT NULL THEN coalesce(copyright_notice, '') END AS copyright,
          CASE WHEN title IS NOT NULL THEN coalesce(byline, '') END AS creator
        FROM cat LEFT JOIN iptc USING (asset_id)
        """,
    ),
)
def iptc_labels(spark, sf):
    return assets(spark, sf).select("asset_id", *[v.alias(n) for n, v in cat.iptc_variables().items()])


def _processing(df):
    """Processing notes: absent, empty, partial or complete, by id."""
    return df.withColumn(
        "processing",
        F.expr(
            "CASE asset_id % 4 WHEN 0 THEN NULL WHEN 1 THEN cast(map() AS map<string,string>)"
            " WHEN 2 THEN map('processed_date', concat('2024-', cast(asset_id AS string)))"
            " ELSE map('processed_date', '2024', 'pipeline', concat('web-', format), 'version', '1.0') END"
        ),
    )


_PROC = """
  CASE asset_id % 4 WHEN 2 THEN '2024-' || asset_id WHEN 3 THEN '2024' END AS processing_date,
  CASE asset_id % 4 WHEN 2 THEN '' WHEN 3 THEN coalesce('web-' || format, '') END AS pipeline_name,
  CASE asset_id % 4 WHEN 2 THEN '' WHEN 3 THEN '1.0' END AS processing_version
"""


@query("P12", t.with_tables("cat", f"SELECT asset_id, {_PROC} FROM cat"))
def processing_labels(spark, sf):
    return _processing(t.catalog(spark, sf)).select(
        "asset_id", *[v.alias(n) for n, v in cat.processing_variables().items()]
    )


@query(
    "P13",
    t.with_tables(
        "cat exif iptc",
        f"""
        , {_EXIF_VARS}
        , wide AS (
          SELECT cat.asset_id, CAST(width AS VARCHAR) AS width, CAST(height AS VARCHAR) AS height,
            CAST(round_even(width / height::DOUBLE, 2) AS VARCHAR) AS aspect_ratio,
            CAST(round_even(width::BIGINT * height / 1000000.0::DOUBLE, 1) AS VARCHAR) AS megapixels,
            format, lower(format) AS format_lower, mode, {SQL_STEM} AS filename, {SQL_NAME} AS basename,
            regexp_extract(path, '\\.([^.]+)$', 1) AS extension, string_split(path, '/')[-2] AS parent,
            {SQL_PARENT} AS parent_path, CAST(round_even(size_bytes / 1048576.0::DOUBLE, 2) AS VARCHAR) AS file_size_mb,
            CAST(dpi_x AS VARCHAR) AS dpi_horizontal, CAST(dpi_y AS VARCHAR) AS dpi_vertical,
            '' AS color_profile,
            CASE WHEN original_path IS NULL THEN {SQL_STEM} ELSE 'DSC_' || cat.asset_id END AS original_filename,
            v.* EXCLUDE asset_id,
            title, description, array_to_string(keywords, ', ') AS keywords,
            CASE WHEN title IS NOT NULL THEN coalesce(copyright_notice, '') END AS copyright,
            CASE WHEN title IS NOT NULL THEN coalesce(byline, '') END AS creator, {_PROC}
          FROM cat LEFT JOIN exif_vars v USING (asset_id) LEFT JOIN iptc USING (asset_id))
        UNPIVOT wide ON COLUMNS(* EXCLUDE asset_id) INTO NAME name VALUE value
        """,
    ),
)
def template_context(spark, sf):
    full = cat.template_context(_processing(assets(spark, sf)))
    return full.select("asset_id", F.explode("context").alias("name", "value"))


@query(
    "R1",
    t.with_tables(
        "cat",
        """
        , broken AS (SELECT asset_id, CASE WHEN asset_id % 10 = 0 THEN NULL ELSE width END AS width,
            CASE WHEN asset_id % 15 = 1 THEN 0 ELSE height END AS height, format,
            CASE WHEN asset_id % 11 = 2 THEN '' ELSE mode END AS mode FROM cat)
        SELECT asset_id, concat_ws('; ',
          CASE WHEN width IS NULL OR height IS NULL THEN 'size values must be integers' END,
          CASE WHEN width <= 0 OR height <= 0 THEN 'size dimensions must be positive' END,
          CASE WHEN coalesce(format, '') = '' THEN 'format cannot be empty' END,
          CASE WHEN coalesce(mode, '') = '' THEN 'mode cannot be empty' END) AS errors
        FROM broken
        """,
    ),
)
def check_assets(spark, sf):
    broken = t.catalog(spark, sf).selectExpr(
        "asset_id", "if(asset_id % 10 = 0, NULL, width) AS width", "if(asset_id % 15 = 1, 0, height) AS height",
        "format", "if(asset_id % 11 = 2, '', mode) AS mode",
    )
    return cat.with_errors(broken).select("asset_id", F.concat_ws("; ", "errors").alias("errors"))


@query(
    "R2",
    t.with_tables(
        "cat",
        """
        , pairs AS (
          SELECT asset_id, 'format' AS name, format AS value, 0 AS new FROM cat WHERE format IS NOT NULL
          UNION ALL SELECT asset_id, 'mode', mode, 0 FROM cat
          UNION ALL SELECT doc_id, 'mode', 'q' || quality, 1 FROM labels
          UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR), 1 FROM labels)
        SELECT asset_id, name, arg_max(value, new) AS value FROM pairs
        WHERE asset_id IN (SELECT asset_id FROM cat) GROUP BY asset_id, name
        """,
    ),
)
def merge_metadata(spark, sf):
    base = t.catalog(spark, sf).selectExpr(
        "asset_id", "map_filter(map('format', format, 'mode', mode), (k, v) -> v IS NOT NULL) AS metadata"
    )
    updates = t.read(spark, sf, "labels").selectExpr(
        "doc_id AS asset_id", "map('mode', concat('q', cast(quality AS string)), 'toxic', cast(toxic AS string)) AS metadata"
    )
    return cat.merge_metadata(base, updates).select("asset_id", F.explode("metadata").alias("name", "value"))


@query(
    "R3",
    t.with_tables(
        "cat",
        """
        SELECT asset_id, path, format, CASE WHEN vec_id IS NULL THEN width ELSE 5 END AS width,
          CASE WHEN vec_id IS NULL THEN height ELSE 6 END AS height, CASE WHEN vec_id IS NULL THEN mode ELSE 'RGBA' END AS mode,
          coalesce(dpi_x, 72) AS dpi_x, coalesce(dpi_y, 72) AS dpi_y, original_path
        FROM cat LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) AS e ON vec_id = asset_id
        """,
    ),
)
def assets_from_pixels(spark, sf):
    px = crop(t.px_rgb(spark, sf, alpha=True), x=1, y=2, width=5, height=6)
    return cat.assets_from_pixels(t.catalog(spark, sf), px).select(
        "asset_id", "path", "format", "width", "height", "mode", "dpi_x", "dpi_y", "original_path"
    )
