"""Columns derived from a catalog row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aspect_ratio(w: Column, h: Column) -> Column:
    return F.when(h > 0, w / h).otherwise(0.0)


def megapixels(w: Column, h: Column) -> Column:
    return w.cast("long") * h / 1000000.0


def file_size_mb(size_bytes: Column) -> Column:
    return F.coalesce(size_bytes / 1048576.0, F.lit(0.0))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_path(path: Column) -> Column:
    """Everything before the last slash; ``/`` for a file in the root, ``.`` without any slash."""
    head = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), ".").when(head == "", "/").otherwise(head)


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """Base name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    """Last suffix with its dot, or empty."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def extension(path: Column) -> Column:
    return F.regexp_replace(suffix(path), r"^\.", "")


def output_path(path: Column) -> Column:
    return F.concat(parent_path(path), F.lit("/"), stem(path), F.lit("_processed"), suffix(path))


def batch_output_path(path: Column) -> Column:
    return F.concat(parent_path(path), F.lit("_processed/"), basename(path))


# --- labels from EXIF rationals -----------------------------------------------------------------


def _whole(v: Column) -> Column:
    return F.bround(v, 0).cast("long").cast("string")


def _fixed(v: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(v, digits))


def _pair(num: Column, den: Column) -> Column:
    """Text of a rational that cannot be divided."""
    return F.concat(F.lit("("), num.cast("string"), F.lit(", "), den.cast("string"), F.lit(")"))


def focal_length_label(num: Column, den: Column) -> Column:
    ok = F.concat(_whole(num / F.nullif(den, F.lit(0))), F.lit("mm"))
    return F.when(num.isNull() | den.isNull(), "").when(den == 0, _pair(num, den)).otherwise(ok)


def aperture_label(num: Column, den: Column, alt_num: Column | None = None, alt_den: Column | None = None) -> Column:
    """``f/2.8`` from FNumber, else from ApertureValue."""
    if alt_num is not None:
        have = num.isNotNull() & den.isNotNull()
        num, den = F.when(have, num).otherwise(alt_num), F.when(have, den).otherwise(alt_den)
    ok = F.concat(F.lit("f/"), _fixed(num / F.nullif(den, F.lit(0)), 1))
    return F.when(num.isNull() | den.isNull(), "").when(den == 0, _pair(num, den)).otherwise(ok)


def exposure_label(num: Column, den: Column) -> Column:
    ratio = F.concat(_fixed(num / F.nullif(den, F.lit(0)), 2), F.lit("s"))
    return (
        F.when(num.isNull() | den.isNull(), "")
        .when(num == 1, F.concat(F.lit("1/"), den.cast("string"), F.lit("s")))
        .when(den == 0, _pair(num, den))
        .otherwise(ratio)
    )


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))
