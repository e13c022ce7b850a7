"""Processed images out: as a pixel table, or as PNG files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaforge.functions.derived import suffix
from lumaforge.sources.png_sink import NAME, SCHEMA, PngFiles

# Pixels per compressed strip: bounds the group one Python call sees, however large the image.
STRIP_PIXELS = 1 << 16
# Formats written with a quality setting; images with alpha are flattened for JPEG.
LOSSY = ("JPEG", "JPG", "WEBP")


def save_format(path: Column, given: Column | None = None) -> Column:
    """Format from an explicit value, else from the suffix, else JPEG."""
    from_name = F.upper(F.regexp_replace(suffix(path), r"^\.", ""))
    named = F.coalesce(F.nullif(from_name, F.lit("")), F.lit("JPEG"))
    return named if given is None else F.upper(F.coalesce(given, named))


def save_pixels(px: DataFrame, folder: str, buckets: int = 64) -> None:
    """Pixel table as Parquet, split by a hash bucket of the image, rows of an image in scan order.

    Rows are dealt by ranges of bucket, image and line, so files are of like size whatever the sizes of the images.
    """
    keyed = px.withColumn("bucket", F.pmod(F.xxhash64("img_id"), F.lit(buckets)).cast("int"))
    (
        keyed.repartitionByRange("bucket", "img_id", "y")
        .sortWithinPartitions("bucket", "img_id", "y", "x")
        .write.mode("errorifexists")
        .partitionBy("bucket")
        .parquet(folder)
    )


def png_strips(px: DataFrame) -> DataFrame:
    """Compress each strip of rows on its own: ``(img_id, w, h, channels, strip, adler, size, bytes)``.

    Spark gathers the bytes of a strip, Python only compresses them. Strips end on a byte boundary (sync
    flush), so an image is its strips put one after another.
    """
    channels = 4 if "a" in px.columns else 3
    value = "(r * 65536L + g * 256 + b)" + (" * 256 + a" if channels == 4 else "")
    # Each line starts with filter type 0.
    cell = f"concat(if(s.x = 0, '00', ''), lpad(hex(s.v), {2 * channels}, '0'))"
    strips = (
        px.withColumn("strip", F.expr(f"cast(floor(y / greatest(1, floor({STRIP_PIXELS} / w))) AS int)"))
        .groupBy("img_id", "w", "h", "strip")
        .agg(F.expr(f"sort_array(collect_list(struct(y, x, {value} AS v)))").alias("cells"))
        .selectExpr(
            "img_id", "w", "h", f"{channels} AS channels", "strip",
            f"unhex(array_join(transform(cells, s -> {cell}), '')) AS bytes",
        )
    )

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = batch["bytes"]
            yield batch.assign(
                adler=[zlib.adler32(b) for b in raw], size=[len(b) for b in raw], bytes=[_deflate(b) for b in raw]
            )

    return strips.mapInPandas(compress, SCHEMA)


def _deflate(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(raw) + z.flush(zlib.Z_SYNC_FLUSH)


def export_png(px: DataFrame, folder: str) -> DataFrame:
    """Write ``<folder>/<img_id>.png`` for every image; returns ``(img_id, path, size_bytes)`` of the images in the folder.

    ``folder`` is a path or a URI whose file system the executors reach; see :mod:`lumaforge.sources.png_sink`.
    """
    spark = px.sparkSession
    spark.dataSource.register(PngFiles)
    # One task per image, the image's strips in order; they are compressed already, so no group is larger than a file.
    strips = png_strips(px).repartition("img_id").sortWithinPartitions("img_id", "strip")
    strips.write.format(NAME).mode("append").option("path", folder).save()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    return files.select(
        F.regexp_extract("path", r"([^/]*)\.png$", 1).cast("long").alias("img_id"), "path", F.col("length").alias("size_bytes")
    )
