"""Image files as catalog rows and pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaforge.functions.derived import suffix
from lumaforge.operators.catalog import IMAGE_SUFFIXES
from lumaforge.sources.records import read_records, readable, with_records

# Leading bytes (hex) of each format.
MAGIC = {
    "JPEG": "FFD8FF",
    "PNG": "89504E470D0A1A0A",
    "GIF": "474946383",
    "BMP": "424D",
    "TIFF": "49492A00",
    "TIFF_BE": "4D4D002A",
}

DEFAULT_DPI = 72
#: Formats that the decoder does not know.
UNDECODED = ("WEBP",)
UNIDENTIFIED = "cannot identify image file"
#: Pixels that leave a task in one batch, if a line is not longer.
PIXELS_AT_ONCE = 1 << 17
CELL_SCHEMA = "img_id long, w int, h int, y int, cells array<int>"

# Schema of Spark's image source.
IMAGE_SCHEMA = (
    "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
)


def format_of(content: Column) -> Column:
    """Format by leading bytes; ``UNKNOWN`` for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & head.endswith("57454250"), "WEBP")
    for name, magic in MAGIC.items():
        out = out.when(head.startswith(magic), "TIFF" if name == "TIFF_BE" else name)
    return out.otherwise("UNKNOWN")


def with_format(files: DataFrame) -> DataFrame:
    return files.withColumn("format", format_of(F.col("content")))


def scan(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Files of a folder tree (or one folder, by glob) as ``(path, modified, size_bytes, content)``.

    Spark's file sources leave out files without a single byte.
    """
    reader = spark.read.format("binaryFile")
    if pattern is None:
        files = reader.option("recursiveFileLookup", "true").load(folder)
        files = image_files(files)
    else:
        files = reader.option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"), "content")


def load_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Decoded images ``(path, width, height, channels, data)``; an image file that cannot be read has width -1.

    Other files of the folder are no images and are left out.
    """
    reader = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true")
    return image_files(decoded(reader.load(paths)))


def image_files(files: DataFrame) -> DataFrame:
    """Rows whose path has the suffix of an image format."""
    return files.where(F.lower(suffix(F.col("path"))).isin(*IMAGE_SUFFIXES))


def decoded(files: DataFrame) -> DataFrame:
    """Flatten the image source's struct."""
    # This source writes file:///x and percent-encodes names where the binary file source writes file:/x and
    # names as they are. A plus sign is no space in a path.
    plain = F.url_decode(F.replace(F.regexp_replace("image.origin", "^file:/+", "file:/"), F.lit("+"), F.lit("%2B")))
    return files.select(
        plain.alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )


def split_decoded(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)``: unreadable files go aside with a message instead of stopping the job.

    A format without a decoder here has a message of its own: such a file may be a sound one, with a catalog row.
    """
    bad = F.col("width") < 1
    undecoded = F.lower(suffix(F.col("path"))).isin(*(f".{f.lower()}" for f in UNDECODED))
    why = F.when(undecoded, "no decoder for this format").otherwise(UNIDENTIFIED)
    return images.where(~bad), images.where(bad).select("path", why.alias("error"))


def image_id(path: Column) -> Column:
    """Stable id of an image: the 64-bit hash of its path."""
    return F.xxhash64(path)


def load_assets(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(assets, rejected)`` of scanned files, from one read of each.

    Size, mode and resolution come from the header, without decoding a pixel; the ``exif``, ``ratios`` and ``iptc`` records
    hang on the row, null where the file has none. A file whose header cannot be read is rejected with a message.
    """
    found = with_records(read_records(with_format(files)))
    assets = found.where(readable()).select(
        image_id(F.col("path")).alias("asset_id"), "path", "format", "head.width", "head.height",
        F.coalesce("head.mode", F.lit("RGB")).alias("mode"), "size_bytes",
        *[F.coalesce(f"head.{c}", F.lit(DEFAULT_DPI)).alias(c) for c in ("dpi_x", "dpi_y")],
        F.lit(None).cast("string").alias("color_profile"), F.col("path").alias("original_path"), "exif", "ratios", "iptc",
    )
    return assets, found.where(~F.coalesce(readable(), F.lit(False))).select("path", F.lit(UNIDENTIFIED).alias("error"))


def explode_pixels(images: DataFrame, spread: bool = False) -> DataFrame:
    """Decoded images as a pixel table, in row-major order.

    A file is decoded in one task. With ``spread`` its lines are dealt to all tasks before they become
    pixels, for corpora where a few images hold much of the data. The byte array is cut into lines first; batches of lines
    then become one integer a pixel, ``PIXELS_AT_ONCE`` or one line at a time. The decoder
    stores blue first; gray images repeat their value in all channels.
    """
    lines = F.expr(
        "transform(sequence(0, height - 1), y -> substring(data, y * width * channels + 1, width * channels))"
    )
    rows = images.select(
        image_id(F.col("path")).alias("img_id"), F.col("width").alias("w"), F.col("height").alias("h"), "channels",
        F.posexplode(lines).alias("y", "line"),
    )
    if spread:
        rows = rows.repartition("img_id", "y")
    cells = rows.mapInArrow(_cells_of_lines, CELL_SCHEMA).select("img_id", "w", "h", "y", F.posexplode("cells").alias("x", "_v"))

    def part(shift: int) -> Column:
        return F.shiftrightunsigned("_v", shift).bitwiseAND(255).cast("int")

    return cells.select(
        "img_id", "w", "h", "x", "y", part(0).alias("r"), part(8).alias("g"), part(16).alias("b"), part(24).alias("a")
    )


def _cells_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        widths = batch.column("w").to_numpy()
        ends = np.cumsum(widths, dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            after = max(first + 1, int(np.searchsorted(ends, done + PIXELS_AT_ONCE, side="right")))
            yield _cells(batch.slice(first, after - first))
            first = after


def _cells(lines: pa.RecordBatch) -> pa.RecordBatch:
    """Lines as integers of R, G, B and A, lowest byte first. The bytes of a cell are B G R [A], or one gray value."""
    widths, channels = lines.column("w").to_numpy(), lines.column("channels").to_numpy()
    ends = np.cumsum(widths, dtype=np.int64)
    packed = np.empty((int(ends[-1]), 4), dtype=np.uint8)
    for line, width, step, end in zip(lines.column("line"), widths, channels, ends):
        cells = np.frombuffer(line.as_buffer(), dtype=np.uint8).reshape(width, step)
        out = packed[end - width : end]
        out[:, :3] = cells[:, 2::-1] if step >= 3 else cells
        out[:, 3] = cells[:, 3] if step == 4 else 255
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    found = {name: lines.column(name) for name in ("img_id", "w", "h", "y")}
    found["cells"] = pa.ListArray.from_arrays(offsets, pa.array(packed.view("<i4").ravel()))
    return pa.RecordBatch.from_arrays(list(found.values()), names=list(found))
