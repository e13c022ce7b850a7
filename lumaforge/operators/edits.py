"""Metadata edits: write, remove, copy and inspect, as joins and struct updates over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaforge.operators.skew import join_counted
from lumaforge.schemas import EXIF_FIELDS, EXIF_TYPE, IPTC_FIELDS, IPTC_TYPE
from lumaforge.session import cut_lineage

# Edit column -> record fields it sets.
WRITE_EXIF = {"creator": "creator", "copyright": "copyright"}
WRITE_IPTC = {
    "title": "title",
    "caption": "description",
    "creator": "byline",
    "copyright": "copyright_notice",
    "location": "location",
    "city": "city",
    "state": "state",
    "country": "country",
    "credit": "credit",
    "source": "source",
}
EDIT_FIELDS = (*WRITE_IPTC, "keywords")

# Fields cleared by the partial removals.
GPS_FIELDS = ("gps_latitude", "gps_longitude", "gps_altitude", "gps_timestamp")
PERSONAL_EXIF = ("creator", "copyright", "gps_latitude", "gps_longitude", "gps_altitude")
PERSONAL_IPTC = ("byline", "byline_title", "copyright_notice", "location", "city", "state", "country")

# Fields taken over by the partial copies.
CAMERA_FIELDS = (
    "make", "model", "lens_make", "lens_model", "focal_length", "f_number", "exposure_time", "iso_speed",
)
LOCATION_IPTC = ("location", "city", "state", "country")


def _filled(v: Column, kind: str) -> Column:
    """Whether a value counts as present: not null, not empty, not zero."""
    if kind == "string":
        return F.coalesce(v != "", F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(v) > 0, F.lit(False))
    return F.coalesce(v != 0, F.lit(False))


def _empty_if_null(column: str, kind: str) -> Column:
    """The record, or one with every field null, so that fields can be set on it."""
    fields = EXIF_FIELDS if kind == EXIF_TYPE else IPTC_FIELDS
    blank = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in fields.items()])
    return F.coalesce(F.col(column), blank)


def _note(column: str, notes: dict[str, Column]) -> Column:
    pairs = F.create_map(*[c for k, v in notes.items() for c in (F.lit(k), v.cast("string"))])
    old = F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(*notes)), pairs)


def split_keywords(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda v: F.trim(v)), lambda v: v != "")


def write_metadata(assets: DataFrame, edits: DataFrame, overwrite: bool = True) -> DataFrame:
    """Apply ``edits(asset_id, title, caption, ...)``; with ``overwrite`` off only gaps are filled.

    Missing edit columns are fine. Rows without an edit pass through unchanged.
    """
    given = [c for c in EDIT_FIELDS if c in edits.columns]
    new = edits.select("asset_id", F.struct(*[F.col(c) for c in given]).alias("_new"))
    joined = assets.join(new, "asset_id", "left")

    def patched(record: Column, targets: dict[str, str], fields: dict[str, str]) -> Column:
        out = record
        for source, target in targets.items():
            if source not in given:
                continue
            value = F.col(f"_new.{source}")
            if fields[target].startswith("array"):
                value = split_keywords(value)
            take = _filled(F.col(f"_new.{source}"), "string")
            if not overwrite:
                take = take & ~_filled(record[target], fields[target])
            out = out.withField(target, F.when(take, value).otherwise(record[target]))
        return out

    touched = F.col("_new").isNotNull()
    exif = patched(_empty_if_null("exif", EXIF_TYPE), WRITE_EXIF, EXIF_FIELDS)
    iptc = patched(_empty_if_null("iptc", IPTC_TYPE), WRITE_IPTC | {"keywords": "keywords"}, IPTC_FIELDS)
    out = joined.withColumns(
        {
            "exif": F.when(touched, exif).otherwise(F.col("exif")),
            "iptc": F.when(touched, iptc).otherwise(F.col("iptc")),
        }
    )
    if "metadata" in assets.columns:
        notes = _note(
            "metadata",
            {"metadata_written": F.lit("true"), "last_metadata_update": F.lit("write_metadata_action")},
        )
        out = out.withColumn("metadata", F.when(touched, notes).otherwise(F.col("metadata")))
    return out.select(assets.columns)


def _cleared(column: str, fields: tuple[str, ...], kinds: dict[str, str]) -> Column:
    out = F.col(column)
    for name in fields:
        out = out.withField(name, F.lit(None).cast(kinds[name]))
    return F.when(F.col(column).isNotNull(), out)


def remove_metadata(assets: DataFrame, metadata_type: str = "all", preserve_basic: bool = True) -> DataFrame:
    if metadata_type not in ("all", "exif", "iptc", "gps", "personal"):
        raise ValueError(f"unknown metadata type: {metadata_type}")
    change: dict[str, Column] = {}
    if metadata_type in ("all", "exif"):
        change["exif"] = F.lit(None).cast(EXIF_TYPE)
    if metadata_type in ("all", "iptc"):
        change["iptc"] = F.lit(None).cast(IPTC_TYPE)
    if metadata_type in ("all", "exif") and "ratios" in assets.columns:
        change["ratios"] = F.lit(None).cast(assets.schema["ratios"].dataType)
    if metadata_type == "all" and not preserve_basic:
        change |= {"dpi_x": F.lit(72), "dpi_y": F.lit(72)}
    if metadata_type == "gps":
        change["exif"] = _cleared("exif", GPS_FIELDS, EXIF_FIELDS)
    if metadata_type == "personal":
        change["exif"] = _cleared("exif", PERSONAL_EXIF, EXIF_FIELDS)
        change["iptc"] = _cleared("iptc", PERSONAL_IPTC, IPTC_FIELDS)
    if "metadata" in assets.columns:
        change["metadata"] = _note(
            "metadata",
            {"metadata_removed": F.lit(metadata_type), "last_metadata_update": F.lit("remove_metadata_action")},
        )
    return assets.withColumns(change)


def copy_metadata(
    assets: DataFrame, requests: DataFrame, metadata_type: str = "all", overwrite: bool = True
) -> DataFrame:
    """Copy records between images; ``requests(asset_id, source_path)`` names the source of each target.

    Returns the targets with an ``error`` column, set when the source is not in the catalog. One source
    may serve most targets; such a source is joined apart (:func:`join_counted`).
    """
    if metadata_type not in ("all", "exif", "iptc", "camera", "location"):
        raise ValueError(f"unknown metadata type: {metadata_type}")
    # Undivided rationals go wherever the EXIF fields go that they belong to.
    has_ratios = "ratios" in assets.columns
    targets = assets.join(requests.select("asset_id", "source_path"), "asset_id")
    wanted = requests.groupBy(F.col("source_path").alias("path")).agg(F.count(F.lit(1)).alias("_targets"))
    sources = assets.join(wanted, "path").select(
        F.col("path").alias("source_path"), F.col("exif").alias("_exif"), F.col("iptc").alias("_iptc"),
        F.lit(True).alias("_found"), "_targets", *([F.col("ratios").alias("_ratios")] if has_ratios else []),
    )
    joined = join_counted(targets, cut_lineage(sources), ["source_path"], "_targets", "left")

    def taken(mine: Column, theirs: Column, fields, kinds) -> Column:
        out = mine
        for name in fields:
            take = F.lit(True) if overwrite else ~_filled(mine[name], kinds[name])
            out = out.withField(name, F.when(take, theirs[name]).otherwise(mine[name]))
        return out

    exif, iptc = _empty_if_null("exif", EXIF_TYPE), _empty_if_null("iptc", IPTC_TYPE)
    new_exif, new_iptc, new_ratios = F.col("exif"), F.col("iptc"), F.col("ratios") if has_ratios else None
    if metadata_type in ("all", "exif"):
        new_exif = F.col("_exif")
        new_ratios = F.col("_ratios") if has_ratios else None
    if metadata_type in ("all", "iptc"):
        new_iptc = F.col("_iptc")
    if metadata_type == "camera":
        new_exif = taken(exif, F.col("_exif"), CAMERA_FIELDS, EXIF_FIELDS)
        if has_ratios:
            new_ratios = _taken_ratios(assets, exif, overwrite)
    if metadata_type == "location":
        # The four GPS fields move together, decided by the latitude.
        take = F.lit(True) if overwrite else ~_filled(exif["gps_latitude"], "double")
        moved = exif
        for name in GPS_FIELDS:
            moved = moved.withField(name, F.when(take, F.col(f"_exif.{name}")).otherwise(exif[name]))
        new_exif = moved
        new_iptc = taken(iptc, F.col("_iptc"), LOCATION_IPTC, IPTC_FIELDS)
    found = F.col("_found").isNotNull()
    ratios = {"ratios": F.when(found, new_ratios).otherwise(F.col("ratios"))} if has_ratios else {}
    out = joined.withColumns(
        ratios
        | {
            "exif": F.when(found, new_exif).otherwise(F.col("exif")),
            "iptc": F.when(found, new_iptc).otherwise(F.col("iptc")),
            "error": F.when(~found, F.concat(F.lit("Source image not found: "), F.col("source_path"))),
        }
    )
    if "metadata" in assets.columns:
        notes = _note(
            "metadata",
            {
                "metadata_copied_from": F.col("source_path"),
                "metadata_copy_type": F.lit(metadata_type),
                "last_metadata_update": F.lit("copy_metadata_action"),
            },
        )
        out = out.withColumn("metadata", F.when(found, notes).otherwise(F.col("metadata")))
    return out.select(*assets.columns, "source_path", "error")


def _taken_ratios(assets: DataFrame, exif: Column, overwrite: bool) -> Column:
    out = F.coalesce("ratios", F.from_json(F.lit("{}"), assets.schema["ratios"].dataType))
    for name in ("focal_length", "f_number", "exposure_time"):
        take = F.lit(True) if overwrite else ~_filled(exif[name], "string")
        out = out.withField(name, F.when(take, F.col(f"_ratios.{name}")).otherwise(F.col(f"ratios.{name}")))
    return out


# --- reading out --------------------------------------------------------------------------------


def _as_text(record: str, name: str, kind: str) -> Column:
    value = F.col(f"{record}.{name}")
    if kind.startswith("array"):
        return F.when(F.size(value) > 0, F.concat(F.lit("["), F.concat_ws(", ", value), F.lit("]")))
    if kind.startswith("map"):
        return F.when(F.size(value) > 0, F.to_json(value))
    return value.cast("string")


def inspect_fields(assets: DataFrame, sections: tuple[str, ...] = ("exif", "iptc")) -> DataFrame:
    """``(asset_id, section, pos, field, value)`` for every present field, in declared order."""
    entries = []
    for section in sections:
        kinds = EXIF_FIELDS if section == "exif" else IPTC_FIELDS
        for pos, (name, kind) in enumerate(kinds.items()):
            text = _as_text(section, name, kind)
            entries.append(
                F.when(
                    text.isNotNull(),
                    F.struct(
                        F.lit(section).alias("section"), F.lit(pos).alias("pos"),
                        F.lit(name).alias("field"), text.alias("value"),
                    ),
                )
            )
    return assets.select("asset_id", F.explode(F.array_compact(F.array(*entries))).alias("_e")).select(
        "asset_id", "_e.section", "_e.pos", "_e.field", "_e.value"
    )


def display_fields(assets: DataFrame) -> DataFrame:
    """Human-readable labels of one image's records; null where there is nothing to show."""

    def filled(path: str) -> Column:
        return F.nullif(F.col(path).cast("string"), F.lit(""))

    def joined(sep: str, *paths: str) -> Column:
        return F.nullif(F.trim(F.concat_ws(sep, *[filled(p) for p in paths])), F.lit(""))

    lat, lon, alt = (F.col(f"exif.gps_{n}") for n in ("latitude", "longitude", "altitude"))
    has_gps = F.coalesce((lat != 0) & (lon != 0), F.lit(False))
    size = F.col("exif.width").isNotNull() & F.col("exif.height").isNotNull()
    return assets.select(
        "asset_id",
        joined(" ", "exif.make", "exif.model").alias("camera"),
        joined(" ", "exif.lens_make", "exif.lens_model").alias("lens"),
        filled("exif.focal_length").alias("focal_length"),
        filled("exif.f_number").alias("aperture"),
        filled("exif.exposure_time").alias("shutter_speed"),
        filled("exif.iso_speed").alias("iso"),
        F.when(size, F.concat_ws(" x ", filled("exif.width"), filled("exif.height"))).alias("dimensions"),
        F.when(has_gps, F.format_string("%s, %s", _digits(lat, 6), _digits(lon, 6))).alias("gps"),
        F.when(F.coalesce(alt != 0, F.lit(False)), F.concat(_digits(alt, 1), F.lit("m"))).alias("gps_altitude"),
        filled("iptc.title").alias("title"),
        filled("iptc.description").alias("caption"),
        F.nullif(F.concat_ws(", ", "iptc.keywords"), F.lit("")).alias("keywords"),
        filled("iptc.byline").alias("photographer"),
        joined(", ", "iptc.location", "iptc.city", "iptc.state", "iptc.country").alias("location"),
        filled("iptc.date_created").alias("date_created"),
        F.when(
            F.coalesce(F.col("iptc.urgency") != 0, F.lit(False)),
            F.concat(F.col("iptc.urgency").cast("string"), F.lit("/8")),
        ).alias("urgency"),
        filled("iptc.instructions").alias("instructions"),
    )


def _digits(v: Column, n: int) -> Column:
    return F.format_string(f"%.{n}f", F.bround(v, n))
