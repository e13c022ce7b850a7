"""Step lists over a catalog and its pixels: pixel operators, metadata steps, template watermarks, export and save."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaforge.functions import templates as tpl
from lumaforge.operators import edits
from lumaforge.operators.catalog import assets_from_pixels, template_variables
from lumaforge.operators.neighborhood import watermark_template
from lumaforge.operators.registry import ANCHORS, OPERATORS, Operator, OperatorError, Param, Registry
from lumaforge.plans import exports
from lumaforge.plans.steps import actions_literal, step_failure
from lumaforge.sources.sinks import save_pixels
from lumaforge.session import cut_lineage

DEFAULT_MARK = "© <creator>"
REPORTS = {
    "json": exports.metadata_json, "csv": exports.metadata_columns, "txt": exports.metadata_text, "yaml": exports.metadata_yaml,
}


@dataclass
class State:
    """What the steps hand on; ``reports`` are the tables of extract steps, ``saved`` the folders of save steps.

    ``failed(asset_id, path, message)`` are the images that the list cannot be run on; ``left_out`` are their catalog rows.
    """

    catalog: DataFrame
    pixels: DataFrame
    failed: DataFrame
    left_out: DataFrame
    reports: list[DataFrame] = field(default_factory=list)
    saved: list[str] = field(default_factory=list)


def _watermark(state: State, text, position, opacity, font_size) -> None:
    names = template_variables(state.catalog.columns)
    state.pixels = watermark_template(
        state.pixels, state.catalog, text, names, position, opacity, font_size, optional=set(names)
    )


def _write_metadata(state: State, /, overwrite, **fields) -> None:
    """Field values are templates, too; rows for which one cannot be rendered keep that field."""
    names = template_variables(state.catalog.columns)
    given = {k: v for k, v in fields.items() if v is not None}
    scope = tpl.scope_of(state.catalog, names, set(names))
    values = []
    for name, template in given.items():
        text, error = tpl.compile_template(template, scope)
        values.append(F.when(error.isNull(), text).alias(name))
    wanted = state.catalog.select("asset_id", *values)
    state.catalog = edits.write_metadata(state.catalog, wanted, overwrite)


def _remove_metadata(state: State, metadata_type, preserve_basic) -> None:
    state.catalog = edits.remove_metadata(state.catalog, metadata_type, preserve_basic)


def _copy_metadata(state: State, source_path, metadata_type, overwrite) -> None:
    """Copy from one image to all others; where the source is missing nothing changes. It may be one that failed."""
    known = state.catalog.unionByName(state.left_out.where(F.col("path") == source_path))
    requests = state.catalog.where(F.col("path") != source_path).select("asset_id", F.lit(source_path).alias("source_path"))
    changed = edits.copy_metadata(known, requests, metadata_type, overwrite).drop("error")
    rest = state.catalog.where(~F.coalesce(F.col("path") != source_path, F.lit(False)))
    state.catalog = cut_lineage(changed.select(state.catalog.columns).unionByName(rest))


def _extract_metadata(state: State, format) -> None:
    state.reports.append(REPORTS[format](state.catalog))


def _save(state: State, folder) -> None:
    state.catalog = assets_from_pixels(state.catalog, state.pixels)
    save_pixels(state.pixels, folder)
    state.saved.append(folder)


STEPS = Registry()


def _add(name, label, apply, tags, description, **params):
    STEPS.register(Operator(name, label, apply, params, tuple(tags.split()), description))


_add("watermark", "Add Watermark", _watermark, "text branding watermark effect", "Draw a text that may hold variables",
     text=Param("str", DEFAULT_MARK), position=Param("choice", "bottom_right", choices=ANCHORS),
     opacity=Param("int", 75, 1, 100), font_size=Param("int", 5, 5, 500))
_add("write_metadata", "Write Metadata", _write_metadata, "metadata", "Set descriptive fields",
     overwrite=Param("bool", True), **{name: Param("str") for name in edits.EDIT_FIELDS})
_add("remove_metadata", "Remove Metadata", _remove_metadata, "metadata privacy", "Clear records or groups of fields",
     metadata_type=Param("choice", "all", choices=("all", "exif", "iptc", "gps", "personal")), preserve_basic=Param("bool", True))
_add("copy_metadata", "Copy Metadata", _copy_metadata, "metadata", "Copy records from another image",
     source_path=Param("str", required=True),
     metadata_type=Param("choice", "all", choices=("all", "exif", "iptc", "camera", "location")), overwrite=Param("bool", True))
_add("extract_metadata", "Extract Metadata", _extract_metadata, "metadata export", "Report the records",
     format=Param("choice", "json", choices=tuple(REPORTS)))
_add("save", "Save Image", _save, "output", "Write pixels and bring the catalog in line", folder=Param("str", required=True))


def _without_failing(catalog: DataFrame, px: DataFrame, actions: list[dict]) -> State:
    """The state before the first step: images that a step would leave without pixels are taken out, with a message.

    Rows without pixels fail, too, unless the list has metadata steps only.
    """
    sizes = px.where("x = 0 AND y = 0").select(
        F.col("img_id").alias("asset_id"), F.lit(True).alias("_read"),
        (step_failure(actions_literal(actions), F.col("w"), F.col("h")) if actions else F.lit(None).cast("string")).alias("message"),
    )
    message = F.col("message")
    if any(a["name"] not in STEPS.names() or a["name"] in ("watermark", "save") for a in actions):
        message = F.coalesce(message, F.when(F.col("_read").isNull(), F.lit("image has no pixels")))
    joined = catalog.select("asset_id", "path").join(sizes, "asset_id", "full")
    failed = cut_lineage(joined.select("asset_id", "path", message.alias("message")).where("message IS NOT NULL"))
    ids = failed.select("asset_id")
    if failed.isEmpty():
        return State(catalog, px, failed, catalog.limit(0))
    good = px.join(ids.withColumnRenamed("asset_id", "img_id"), "img_id", "left_anti").select(px.columns)
    return State(catalog.join(ids, "asset_id", "left_anti").select(catalog.columns), good, failed, catalog.join(ids, "asset_id", "left_semi").select(catalog.columns))


def run_recipe(catalog: DataFrame, px: DataFrame, actions: list[dict]) -> State:
    """Apply enabled actions ``{name, parameters, enabled}`` in order to a catalog and its pixels.

    Names and parameters are checked before anything runs. Images that the list cannot be run on are neither in the
    catalog nor among the pixels that come out, but in ``failed``, with the reason.
    """
    wanted = [a for a in actions if a.get("enabled", True)]
    for a in wanted:
        op = STEPS.get(a["name"]) if a["name"] in STEPS.names() else OPERATORS.get(a["name"])
        op.validated(a.get("parameters", {}))
        if a["name"] == "copy_metadata" and not a.get("parameters", {}).get("source_path"):
            raise OperatorError("source_path: a value is required")
    state = _without_failing(catalog, px, wanted)
    before = state.pixels
    for a in wanted:
        if a["name"] in STEPS.names():
            STEPS.get(a["name"])(state, **a.get("parameters", {}))
            continue
        op = OPERATORS.get(a["name"])
        if op.rereads and state.pixels is not before:
            state.pixels = cut_lineage(state.pixels)
        state.pixels = op(state.pixels, **a.get("parameters", {}))
    return state
