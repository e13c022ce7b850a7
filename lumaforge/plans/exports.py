"""Reports and metadata exports as tables of finished text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaforge.functions import derived
from lumaforge.operators.edits import inspect_fields
from lumaforge.operators.ranking import number_within
from lumaforge.operators.skew import join_counted
from lumaforge.schemas import EXIF_FIELDS, IPTC_FIELDS
from lumaforge.session import cut_lineage


def _located(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Members with their group's running number and catalog entry."""
    groups = cut_lineage(groups)
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("_members"))
    numbered = cut_lineage(number_within(sizes, [], ["group_id"], "group_no"))
    return (
        join_counted(groups, numbered, ["group_id"], "_members")
        .join(catalog.withColumnRenamed("asset_id", "member_id"), "member_id")
        .withColumn("group_no", F.col("group_no").cast("long"))
    )


def duplicates_table(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    path = F.col("path")
    return _located(groups, catalog).select(
        "group_no",
        derived.basename(path).alias("name"),
        F.bround(derived.file_size_mb(F.col("size_bytes")), 1).alias("size_mb"),
        derived.parent_path(path).alias("parent"),
    )


def duplicates_json(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """JSON lines, one per member, so that a group of any size stays spread over tasks."""
    return _located(groups, catalog).select(
        F.to_json(F.struct(F.col("group_no").alias("group"), "path")).alias("line")
    )


def duplicates_paths(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    return groups.join(catalog.withColumnRenamed("asset_id", "member_id"), "member_id").select("path")


# --- metadata exports ---------------------------------------------------------------------------


def metadata_json(assets: DataFrame) -> DataFrame:
    """``(asset_id, line)``: one JSON document per image, fields without a value left out."""
    doc = F.struct(F.col("path").alias("image_path"), _without_empties("exif"), _without_empties("iptc"))
    return assets.select("asset_id", F.to_json(doc).alias("line"))


def _without_empties(section: str):
    """The record with empty lists and maps as null, and an absent record as an empty object."""
    kinds = EXIF_FIELDS if section == "exif" else IPTC_FIELDS
    fields = []
    for name, kind in kinds.items():
        value = F.col(f"{section}.{name}")
        fields.append((F.when(F.size(value) > 0, value) if kind.startswith(("array", "map")) else value).alias(name))
    return F.struct(*fields).alias(section)


def metadata_columns(assets: DataFrame) -> DataFrame:
    """Flat text columns ``exif_make`` ... for a CSV file with one header for all images."""
    flat = [F.col("asset_id"), F.col("path").alias("image_path")]
    for section, kinds in (("exif", EXIF_FIELDS), ("iptc", IPTC_FIELDS)):
        for name, kind in kinds.items():
            value = F.col(f"{section}.{name}")
            if kind.startswith("array"):
                value = F.when(F.size(value) > 0, F.concat(F.lit("["), F.concat_ws(", ", value), F.lit("]")))
            elif kind.startswith("map"):
                value = F.when(F.size(value) > 0, F.to_json(value))
            flat.append(value.cast("string").alias(f"{section}_{name}"))
    return assets.select(*flat)


def _section_lines(assets: DataFrame, indent: str, by_name: bool) -> DataFrame:
    """Per image the ``key: value`` lines of both records; the number of fields bounds each list."""
    rank = "field" if by_name else "pos"
    line = F.concat(F.lit(indent), F.col("field"), F.lit(": "), F.col("value"))
    fields = inspect_fields(assets).withColumn("_l", F.struct(F.col(rank).alias("k"), line.alias("line")))

    def lines(section: str):
        picked = F.sort_array(F.collect_list(F.when(F.col("section") == section, F.col("_l"))))
        return F.transform(picked, lambda s: s["line"]).alias(f"{section}_lines")

    grouped = fields.groupBy("asset_id").agg(lines("exif"), lines("iptc"))
    none = F.array().cast("array<string>")
    return assets.select("asset_id", "path").join(grouped, "asset_id", "left").withColumns(
        {c: F.coalesce(c, none) for c in ("exif_lines", "iptc_lines")}
    )


def metadata_text(assets: DataFrame) -> DataFrame:
    """``(asset_id, document)``: headed ``key: value`` lists in declared order."""
    parts = F.concat(
        F.array(F.concat(F.lit("Metadata for: "), F.col("path")), F.lit("=" * 50), F.lit(""), F.lit("EXIF Data:"), F.lit("-" * 20)),
        F.col("exif_lines"),
        F.array(F.lit(""), F.lit("IPTC Data:"), F.lit("-" * 20)),
        F.col("iptc_lines"),
    )
    return _section_lines(assets, "", by_name=False).select(
        "asset_id", F.concat(F.array_join(parts, "\n"), F.lit("\n")).alias("document")
    )


def metadata_yaml(assets: DataFrame) -> DataFrame:
    """``(asset_id, document)``: block style, keys sorted, lists in flow style."""

    def block(section: str):
        head = F.when(F.size(f"{section}_lines") > 0, f"{section}:").otherwise(f"{section}: {{}}")
        return F.concat(F.array(head), F.col(f"{section}_lines"))

    parts = F.concat(block("exif"), F.array(F.concat(F.lit("image_path: "), F.col("path"))), block("iptc"))
    return _section_lines(assets, "  ", by_name=True).select(
        "asset_id", F.concat(F.array_join(parts, "\n"), F.lit("\n")).alias("document")
    )
