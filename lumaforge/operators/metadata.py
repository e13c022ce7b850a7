"""Structured EXIF and IPTC records from long tag tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaforge.functions import tagvalues as tv
from lumaforge.schemas import EXIF_FIELDS, IPTC_FIELDS

# Fixed values: (directory, tag number) of the tags that become record fields.
EXIF_TEXT = {
    "make": ("0th", 271),
    "model": ("0th", 272),
    "software": ("0th", 305),
    "datetime": ("0th", 306),
    "creator": ("0th", 315),
    "copyright": ("0th", 33432),
    "processing_software": ("0th", 11),
    "datetime_original": ("Exif", 36867),
    "datetime_digitized": ("Exif", 36868),
    "lens_make": ("Exif", 42035),
    "lens_model": ("Exif", 42036),
}
EXIF_INT = {
    "orientation": ("0th", 274),
    "resolution_unit": ("0th", 296),
    "iso_speed": ("Exif", 34855),
    "width": ("Exif", 40962),
    "height": ("Exif", 40963),
}
EXIF_RATIO = {"x_resolution": ("0th", 282), "y_resolution": ("0th", 283)}
EXPOSURE_TIME, F_NUMBER, APERTURE_VALUE, FOCAL_LENGTH = (("Exif", n) for n in (33434, 33437, 37378, 37386))
FLASH, WHITE_BALANCE, COLOR_SPACE = (("Exif", n) for n in (37385, 41987, 40961))
GPS_LAT_REF, GPS_LAT, GPS_LON_REF, GPS_LON, GPS_ALT_REF, GPS_ALT, GPS_TIME, GPS_DATE = (
    ("GPS", n) for n in (1, 2, 3, 4, 5, 6, 7, 29)
)

# IPTC dataset numbers of the record fields.
IPTC_TEXT = {
    "title": 5,
    "category": 15,
    "instructions": 40,
    "byline": 80,
    "byline_title": 85,
    "city": 90,
    "location": 92,
    "state": 95,
    "country": 101,
    "copyright_notice": 116,
    "caption": 120,
    "description": 120,
}
IPTC_KEYWORDS, IPTC_DATE = 25, 55


def _pick(key: tuple[str, int], value: str) -> Column:
    ifd, no = key
    return F.expr(f"max(if(tag = {no} AND ifd = '{ifd}', {value}, NULL))")


def _exif_wanted(pick) -> dict[str, Column]:
    """The values that records are made of; ``pick(key, value)`` finds one in a group of tags or in a row's."""
    wanted: dict[str, Column] = {}
    for name, key in EXIF_TEXT.items():
        wanted[name] = F.nullif(F.trim(pick(key, "str_val")), F.lit(""))
    for name, key in EXIF_INT.items():
        wanted[name] = pick(key, "int_val").cast("int")
    for name, key in {
        **EXIF_RATIO,
        "exposure": EXPOSURE_TIME,
        "fnumber": F_NUMBER,
        "apvalue": APERTURE_VALUE,
        "focal": FOCAL_LENGTH,
        "lat": GPS_LAT,
        "lon": GPS_LON,
        "alt": GPS_ALT,
        "clock": GPS_TIME,
    }.items():
        wanted[f"_{name}"] = pick(key, "rationals")
    for name, key in {"lat_ref": GPS_LAT_REF, "lon_ref": GPS_LON_REF, "day": GPS_DATE}.items():
        wanted[f"_{name}"] = pick(key, "str_val")
    for name, key in {"flash": FLASH, "wb": WHITE_BALANCE, "cs": COLOR_SPACE, "alt_ref": GPS_ALT_REF}.items():
        wanted[f"_{name}"] = pick(key, "int_val")
    return wanted


def exif_records(tags: DataFrame) -> DataFrame:
    """``(asset_id, exif, ratios)``: one pass of conditional aggregates over the tag table.

    ``ratios`` keeps the undivided rationals that display labels need.
    """
    wanted = _exif_wanted(_pick)
    flat = tags.groupBy("asset_id").agg(*[c.alias(f"f_{n}") for n, c in wanted.items()])
    record, ratios = _exif_structs({n: F.col(f"f_{n}") for n in wanted})
    return flat.select("asset_id", record.alias("exif"), ratios.alias("ratios"))


def exif_of_row(tags: Column) -> tuple[Column, Column]:
    """The same from an array of tags on the row, without a shuffle."""

    def pick(key: tuple[str, int], value: str) -> Column:
        ifd, no = key
        return F.array_max(F.transform(F.filter(tags, lambda t: (t["tag"] == no) & (t["ifd"] == ifd)), lambda t: t[value]))

    return _exif_structs(_exif_wanted(pick))


def _exif_structs(found: dict[str, Column]) -> tuple[Column, Column]:
    def parts(name: str) -> tuple[Column, Column]:
        p = F.get(found[f"_{name}"], F.lit(0))
        return p["num"], p["den"]

    ratio = {name: tv.rational_to_float(*parts(name)) for name in ("fnumber", "focal", *EXIF_RATIO)}
    values = {name: found[name] for name in (*EXIF_TEXT, *EXIF_INT)}
    values |= {name: ratio[name] for name in EXIF_RATIO}
    values |= {
        "exposure_time": tv.rational_to_string(*parts("exposure")),
        "f_number": F.concat(F.lit("f/"), ratio["fnumber"].cast("string")),
        "aperture": ratio["fnumber"],
        "focal_length": ratio["focal"].cast("string"),
        "flash": tv.flash_label(found["_flash"]),
        "white_balance": tv.white_balance_label(found["_wb"]),
        "color_space": tv.color_space_label(found["_cs"]),
        "gps_latitude": tv.gps_decimal(found["_lat"], found["_lat_ref"]),
        "gps_longitude": tv.gps_decimal(found["_lon"], found["_lon_ref"]),
        "gps_altitude": tv.gps_altitude(*parts("alt"), found["_alt_ref"]),
        "gps_timestamp": tv.gps_timestamp(found["_clock"], found["_day"]),
    }
    record = F.struct(*[values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in EXIF_FIELDS.items()])
    ratios = F.struct(
        *[
            F.struct(parts(src)[0].alias("num"), parts(src)[1].alias("den")).alias(out)
            for out, src in {
                "exposure_time": "exposure",
                "f_number": "fnumber",
                "aperture_value": "apvalue",
                "focal_length": "focal",
            }.items()
        ]
    )
    return record, ratios


def iptc_records(tags: DataFrame) -> DataFrame:
    """``(asset_id, iptc)``; keywords in record order, trimmed, blanks dropped."""

    def text(no: int) -> Column:
        return F.expr(f"max(if(dataset = {no}, value, NULL))")

    word = F.when(F.col("dataset") == IPTC_KEYWORDS, F.struct("ord", F.trim("value").alias("word")))
    flat = tags.groupBy("asset_id").agg(
        *[text(no).alias(f"f_{n}") for n, no in IPTC_TEXT.items()],
        text(IPTC_DATE).alias("f_date"),
        F.sort_array(F.collect_list(word)).alias("f_words"),
    )
    record = _iptc_struct({n: F.col(f"f_{n}") for n in IPTC_TEXT}, F.col("f_date"), F.col("f_words"))
    return flat.select("asset_id", record.alias("iptc"))


def iptc_of_row(tags: Column) -> Column:
    """The same from an array of records on the row, without a shuffle."""

    def text(no: int) -> Column:
        return F.array_max(F.transform(F.filter(tags, lambda t: t["dataset"] == no), lambda t: t["value"]))

    words = F.transform(
        F.filter(tags, lambda t: t["dataset"] == IPTC_KEYWORDS), lambda t: F.struct(t["ord"].alias("ord"), F.trim(t["value"]).alias("word"))
    )
    return _iptc_struct({n: text(no) for n, no in IPTC_TEXT.items()}, text(IPTC_DATE), F.sort_array(words))


def _iptc_struct(found: dict[str, Column], date: Column, words: Column) -> Column:
    kept = F.filter(F.transform(words, lambda s: s["word"]), lambda v: v != "")
    values = found | {"date_created": F.when(F.char_length(date) == 8, date), "keywords": kept}
    return F.struct(*[values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in IPTC_FIELDS.items()])


def with_metadata(catalog: DataFrame, exif_tags: DataFrame, iptc_tags: DataFrame) -> DataFrame:
    """Catalog rows with their ``exif``, ``ratios`` and ``iptc`` records (null when absent).

    Both records are aggregated by ``asset_id``, so the joins reuse that partitioning and only the
    catalog itself is shuffled.
    """
    return catalog.join(exif_records(exif_tags), "asset_id", "left").join(iptc_records(iptc_tags), "asset_id", "left")
