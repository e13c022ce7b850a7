"""Fixed schemas of the catalog and its side tables."""

from __future__ import annotations

from pyspark.sql import types as T

# name:type lists, in the order the structs are declared.
EXIF_FIELDS = {
    "make": "string",
    "model": "string",
    "lens_make": "string",
    "lens_model": "string",
    "exposure_time": "string",
    "f_number": "string",
    "aperture": "double",
    "shutter_speed": "double",
    "iso_speed": "int",
    "focal_length": "string",
    "flash": "string",
    "width": "int",
    "height": "int",
    "orientation": "int",
    "resolution_unit": "int",
    "x_resolution": "double",
    "y_resolution": "double",
    "datetime_original": "string",
    "datetime_digitized": "string",
    "datetime": "string",
    "color_space": "string",
    "white_balance": "string",
    "gps_latitude": "double",
    "gps_longitude": "double",
    "gps_altitude": "double",
    "gps_timestamp": "string",
    "creator": "string",
    "copyright": "string",
    "software": "string",
    "processing_software": "string",
    "datetime_modified": "string",
}

IPTC_FIELDS = {
    "title": "string",
    "description": "string",
    "caption": "string",
    "keywords": "array<string>",
    "category": "string",
    "supplemental_categories": "array<string>",
    "byline": "string",
    "byline_title": "string",
    "credit": "string",
    "source": "string",
    "copyright_notice": "string",
    "usage_terms": "string",
    "location": "string",
    "city": "string",
    "state": "string",
    "country": "string",
    "country_code": "string",
    "date_created": "string",
    "digital_creation_date": "string",
    "headline": "string",
    "instructions": "string",
    "transmission_reference": "string",
    "urgency": "int",
    "raw_iptc": "map<string,string>",
}


def _struct(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{name}:{kind}" for name, kind in fields.items()) + ">"


EXIF_TYPE = _struct(EXIF_FIELDS)
IPTC_TYPE = _struct(IPTC_FIELDS)

EXIF_TAGS = (
    "asset_id bigint, ifd string, tag int, str_val string, int_val bigint, "
    "rationals array<struct<num:bigint,den:bigint>>"
)
IPTC_TAGS = "asset_id bigint, dataset int, ord int, value string"
PIXEL_KEYS = ["img_id", "w", "h", "x", "y"]

ACTION_TYPE = "struct<name:string,parameters:map<string,string>,enabled:boolean,description:string>"
RECIPES = f"name string, actions array<{ACTION_TYPE}>, metadata map<string,string>"


def recipe_schema(with_corrupt: bool = False) -> T.StructType:
    ddl = RECIPES + (", _corrupt_record string" if with_corrupt else "")
    return T.StructType.fromDDL(ddl)
