"""Scans, checks and updates of the asset catalog, and the variables it offers to templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaforge.functions import derived as d

# The suffixes a directory scan accepts, compared in lower case.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")


def glob_to_regex(pattern: str) -> str:
    """Regular expression for a file-name glob with ``*``, ``?`` and ``[...]``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def scan_recursive(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.lower(d.suffix(F.col("path"))).isin(*IMAGE_SUFFIXES))


def scan_pattern(catalog: DataFrame, directory: str | None = None, pattern: str = "*.jpg") -> DataFrame:
    """Files whose name matches a case-sensitive glob, in one directory or anywhere."""
    found = catalog.where(d.basename(F.col("path")).rlike(glob_to_regex(pattern)))
    return found if directory is None else found.where(d.parent_path(F.col("path")) == directory.rstrip("/"))


def with_errors(catalog: DataFrame) -> DataFrame:
    """Add ``errors``: the broken record rules, empty for a sound row."""
    w, h = F.col("width"), F.col("height")

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    rules = [
        F.when(w.isNull() | h.isNull(), "size values must be integers"),
        F.when((w <= 0) | (h <= 0), "size dimensions must be positive"),
        F.when(blank("format"), "format cannot be empty"),
        F.when(blank("mode"), "mode cannot be empty"),
    ]
    return catalog.withColumn("errors", F.array_compact(F.array(*rules)))


def merge_maps(old: Column, new: Column) -> Column:
    """Map with the keys of both; the new value wins."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def merge_metadata(catalog: DataFrame, updates: DataFrame, column: str = "metadata") -> DataFrame:
    """Merge the ``updates(asset_id, column)`` map into the catalog's map of the same name."""
    new = updates.select("asset_id", F.col(column).alias("_new"))
    joined = catalog.join(new, "asset_id", "left")
    return joined.withColumn(column, merge_maps(F.col(column), F.col("_new"))).drop("_new")


def assets_from_pixels(catalog: DataFrame, px: DataFrame) -> DataFrame:
    """Bring size and mode of catalog rows in line with processed pixels; everything else is kept.

    A row without pixels stays as it is.
    """
    mode = "RGBA" if "a" in px.columns else "RGB"
    sizes = px.groupBy(F.col("img_id").alias("asset_id")).agg(
        (F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h")
    )
    joined = catalog.join(sizes, "asset_id", "left")
    here = F.col("_w").isNotNull()
    # Gray images keep their mode: their channels are equal by construction.
    gray = F.col("mode").isin("L", "1") & F.lit(mode == "RGB")
    out = joined.withColumns({
        "width": F.coalesce("_w", "width"), "height": F.coalesce("_h", "height"),
        "mode": F.when(here & ~F.coalesce(gray, F.lit(False)), F.lit(mode)).otherwise(F.col("mode")),
    })
    return out.withColumns(
        {"dpi_x": F.coalesce("dpi_x", F.lit(72)), "dpi_y": F.coalesce("dpi_y", F.lit(72))}
    ).select(catalog.columns)


# --- template variables -------------------------------------------------------------------------


def base_variables() -> dict[str, Column]:
    """Variables every image has; expects the catalog's columns."""
    path, w, h = F.col("path"), F.col("width"), F.col("height")
    return {
        "width": w,
        "height": h,
        "aspect_ratio": F.bround(d.aspect_ratio(w, h), 2),
        "megapixels": F.bround(d.megapixels(w, h), 1),
        "format": F.col("format"),
        "format_lower": F.lower("format"),
        "mode": F.col("mode"),
        "filename": d.stem(path),
        "basename": d.basename(path),
        "extension": d.extension(path),
        "parent": d.parent_name(path),
        "parent_path": d.parent_path(path),
        "file_size_mb": F.bround(d.file_size_mb(F.col("size_bytes")), 2),
        "dpi_horizontal": F.col("dpi_x"),
        "dpi_vertical": F.col("dpi_y"),
        "color_profile": F.coalesce("color_profile", F.lit("")),
        "original_filename": F.coalesce(d.stem(F.col("original_path")), d.stem(path)),
    }


def exif_variables() -> dict[str, Column]:
    """Variables of an image with an EXIF block; all null when ``exif`` is null."""

    def have(v: Column) -> Column:
        return F.when(F.col("exif").isNotNull(), v)

    def text(field: str) -> Column:
        return have(F.coalesce(F.col(f"exif.{field}").cast("string"), F.lit("")))

    def ratio(name: str) -> tuple[Column, Column]:
        return F.col(f"ratios.{name}.num"), F.col(f"ratios.{name}.den")

    return {
        "date_taken": have(
            d.first_filled(*(F.col(f"exif.{f}") for f in ("datetime", "datetime_original", "datetime_digitized")))
        ),
        "camera_make": text("make"),
        "camera_model": text("model"),
        "lens_model": text("lens_model"),
        "focal_length": have(d.focal_length_label(*ratio("focal_length"))),
        "aperture": have(d.aperture_label(*ratio("f_number"), *ratio("aperture_value"))),
        "iso": text("iso_speed"),
        "exposure_time": have(d.exposure_label(*ratio("exposure_time"))),
    }


def iptc_variables() -> dict[str, Column]:
    def text(field: str) -> Column:
        return F.when(F.col("iptc").isNotNull(), F.coalesce(F.col(f"iptc.{field}"), F.lit("")))

    return {
        "title": text("title"),
        "description": text("description"),
        "keywords": F.when(F.col("iptc").isNotNull(), F.concat_ws(", ", "iptc.keywords")),
        "copyright": text("copyright_notice"),
        "creator": text("byline"),
    }


# Variable name -> key of the processing map.
PROCESSING_KEYS = {"processing_date": "processed_date", "pipeline_name": "pipeline", "processing_version": "version"}


def processing_variables() -> dict[str, Column]:
    notes = F.col("processing")
    have = notes.isNotNull() & (F.size(notes) > 0)
    return {
        name: F.when(have, F.coalesce(F.try_element_at(notes, F.lit(key)), F.lit("")))
        for name, key in PROCESSING_KEYS.items()
    }


def template_variables(columns: list[str]) -> dict[str, Column]:
    """All variables that a table with these columns can offer."""
    out = base_variables()
    if "exif" in columns and "ratios" in columns:
        out |= exif_variables()
    if "iptc" in columns:
        out |= iptc_variables()
    if "processing" in columns:
        out |= processing_variables()
    return out


def template_context(assets: DataFrame) -> DataFrame:
    """Add ``context``: variable -> text, holding only the variables the row has."""
    entries = F.array(
        *[
            F.when(v.isNotNull(), F.struct(F.lit(name).alias("key"), v.cast("string").alias("value")))
            for name, v in template_variables(assets.columns).items()
        ]
    )
    return assets.withColumn("context", F.map_from_entries(F.array_compact(entries)))
