"""Decoding of single EXIF / IPTC values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code -> label.
WHITE_BALANCE = {0: "Auto", 1: "Manual"}
COLOR_SPACE = {1: "sRGB", 2: "Adobe RGB", 65535: "Uncalibrated"}

# Image-library key -> catalog key for facts about the file encoding.
SOURCE_INFO = {
    "dpi": "DPI",
    "quality": "Quality",
    "optimize": "Optimize",
    "progressive": "Progressive",
    "transparency": "Transparency",
}


def rational_to_float(num: Column, den: Column) -> Column:
    return F.try_divide(num, F.nullif(den, F.lit(0)))


def rational_to_string(num: Column, den: Column) -> Column:
    return F.when(den == 1, num.cast("string")).otherwise(
        F.concat(num.cast("string"), F.lit("/"), den.cast("string"))
    )


def flash_label(value: Column) -> Column:
    fired = F.when(value.bitwiseAND(1) == 1, "Flash fired").otherwise("Flash did not fire")
    return F.when(value.isNotNull(), fired)


def _label(value: Column, table: dict[int, str]) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for code, label in table.items():
        out = out.when(value == code, label)
    return out.otherwise("Unknown")


def white_balance_label(value: Column) -> Column:
    return _label(value, WHITE_BALANCE)


def color_space_label(value: Column) -> Column:
    return _label(value, COLOR_SPACE)


def gps_decimal(parts: Column, ref: Column) -> Column:
    """Decimal degrees of a degree/minute/second array; 0.0 when it has not three parts."""

    def part(i: int) -> Column:
        p = F.get(parts, F.lit(i))
        return F.coalesce(rational_to_float(p["num"], p["den"]), F.lit(0.0))

    total = part(0) + part(1) / 60.0 + part(2) / 3600.0
    signed = F.when(ref.isin("S", "W"), -total).otherwise(total)
    known = parts.isNotNull() & ref.isNotNull() & (ref != "")
    return F.when(known, F.when(F.size(parts) != 3, 0.0).otherwise(signed))


def gps_altitude(num: Column, den: Column, ref: Column) -> Column:
    meters = rational_to_float(num, den)
    return F.when(ref == 1, -meters).otherwise(meters)


def gps_timestamp(parts: Column, date: Column) -> Column:
    def part(i: int) -> Column:
        p = F.get(parts, F.lit(i))
        return F.coalesce(F.floor(rational_to_float(p["num"], p["den"])), F.lit(0).cast("long"))

    clock = F.format_string("%02d:%02d:%02d", part(0), part(1), part(2))
    return F.when(F.size(parts) == 3, F.concat_ws(" ", F.nullif(date, F.lit("")), clock))


def clean_tag_value(raw: Column) -> Column:
    """Text of a binary tag value without NULs at the end; hex digits when it is not UTF-8."""
    text = F.try_validate_utf8(raw.cast("string"))
    return F.when(text.isNull(), F.lower(F.hex(raw))).otherwise(F.regexp_replace(text, r"\x00+$", ""))


def printable_text(text: Column) -> Column:
    """The text itself, or null when it holds no printable ASCII character."""
    return F.when(text.rlike(r"[\x20-\x7E]"), text)


def exif_datetime(ts: Column) -> Column:
    return F.date_format(ts, "yyyy:MM:dd HH:mm:ss")


def source_info(info: Column) -> Column:
    """Keep the encoding facts of an image-info map under their catalog names."""
    table = F.create_map(*[F.lit(v) for pair in SOURCE_INFO.items() for v in pair])
    known = F.map_filter(info, lambda k, _: k.isin(*SOURCE_INFO))
    return F.transform_keys(known, lambda k, _: F.element_at(table, k))
