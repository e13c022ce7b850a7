"""Ordered lists of operations: parsing, editing, describing and running them over a corpus."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lumaforge.functions import derived as d
from lumaforge.functions.validation import TRUE_WORDS
from lumaforge.operators.registry import run_steps
from lumaforge.operators.skew import join_counted
from lumaforge.session import cut_lineage

# --- operation strings --------------------------------------------------------------------------


def parse_action(text: Column) -> Column:
    """Struct ``(name, parameters)`` of ``name:k=v,k2=v2``.

    The first ``:`` and the first ``=`` of a pair split; pairs without ``=`` are dropped; a repeated key
    keeps its last value.
    """
    pieces = F.split(text, ":", 2)
    pairs = F.filter(F.split(F.coalesce(F.get(pieces, F.lit(1)), F.lit("")), ","), lambda p: p.contains("="))
    split = F.transform(pairs, lambda p: F.split(p, "=", 2))
    last = F.filter(
        F.transform(split, lambda kv, i: F.struct(kv[0].alias("key"), kv[1].alias("value"), i.alias("i"))),
        lambda e: ~F.exists(
            F.slice(split, e["i"] + 2, F.greatest(F.size(split) - e["i"] - 1, F.lit(0))), lambda o: o[0] == e["key"]
        ),
    )
    entries = F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return F.struct(pieces[0].alias("name"), F.map_from_entries(entries).alias("parameters"))


def parameter_type(value: Column) -> Column:
    """``bool``, ``int``, ``float`` or ``str`` as the text would be read."""
    digits = F.regexp_replace(value, r"\.", "")
    return (
        F.when(F.lower(value).isin("true", "false"), "bool")
        .when(value.rlike("^[0-9]+$"), "int")
        .when(digits.rlike("^[0-9]+$"), "float")
        .otherwise("str")
    )


def typed_parameters(rows: DataFrame, value: str = "value") -> DataFrame:
    """Add ``kind`` and one typed column per kind."""
    v, kind = F.col(value), F.col("kind")
    return rows.withColumn("kind", parameter_type(v)).withColumns(
        {
            "bool_value": F.when(kind == "bool", F.lower(v) == "true"),
            "int_value": F.when(kind == "int", v.try_cast("bigint")),
            "float_value": F.when(kind == "float", v.try_cast("double")),
        }
    )


def name_error(name: Column) -> Column:
    """Why an operation name is not acceptable, or null."""
    bare = F.replace(name, F.lit("_"), F.lit(""))
    return F.when(F.coalesce(name, F.lit("")) == "", "Action name cannot be empty").when(
        ~bare.rlike(r"^[\p{L}\p{N}]+$"), "Action name must be alphanumeric with underscores"
    )


# --- editing a list of actions ------------------------------------------------------------------


def enabled_actions(actions: Column) -> Column:
    return F.filter(actions, lambda a: a["enabled"])


def action_count(actions: Column) -> Column:
    return F.size(actions)


def insert_action(actions: Column, index: Column, action: Column) -> Column:
    """Struct ``(actions, error)``; index 0..n, where n appends."""
    n = F.size(actions)
    bad = (index < 0) | (index > n)
    out = F.concat(F.slice(actions, F.lit(1), F.greatest(index, F.lit(0))), F.array(action),
                   F.slice(actions, F.greatest(index, F.lit(0)) + 1, n))
    return _edited(out, bad, index)


def remove_action(actions: Column, index: Column) -> Column:
    return _edited(F.filter(actions, lambda a, i: i != index), (index < 0) | (index >= F.size(actions)), index)


def replace_action(actions: Column, index: Column, action: Column) -> Column:
    out = F.transform(actions, lambda a, i: F.when(i == index, action).otherwise(a))
    return _edited(out, (index < 0) | (index >= F.size(actions)), index)


def _edited(out: Column, bad: Column, index: Column) -> Column:
    message = F.concat(F.lit("Index "), index.cast("string"), F.lit(" out of range"))
    return F.struct(F.when(~bad, out).alias("actions"), F.when(bad, message).alias("error"))


def with_parameter(params: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(params, lambda k, _: k != key), F.create_map(key, value))


def without_parameter(params: Column, key: Column) -> Column:
    return F.map_filter(params, lambda k, _: k != key)


# --- describing a run ---------------------------------------------------------------------------


def plan_rows(catalog: DataFrame, recipes: DataFrame, assigned: DataFrame) -> DataFrame:
    """What would be done: one row per file, step and parameter.

    ``assigned(asset_id, name)`` says which recipe runs on which image; rows appear for enabled steps
    only. A step without parameters keeps one row.
    """
    steps = recipes.select("name", F.posexplode(enabled_actions(F.col("actions"))).alias("_pos", "_a")).select(
        "name", (F.col("_pos") + 1).alias("step_no"), F.col("_a.name").alias("action"), F.col("_a.parameters").alias("_p")
    )
    # One recipe may run on most images.
    uses = assigned.groupBy("name").agg(F.count(F.lit(1)).alias("_images"))
    counted = cut_lineage(steps.join(uses, "name"))
    jobs = catalog.select("asset_id", "path").join(assigned.select("asset_id", "name"), "asset_id")
    return (
        join_counted(jobs, counted, ["name"], "_images")
        .select("asset_id", "name", "path", "step_no", "action", F.explode_outer("_p").alias("param", "value"))
        .withColumn("output", d.batch_output_path(F.col("path")))
    )


def size_after(actions: Column, w: Column, h: Column) -> Column:
    """Array of ``(step, action, w, h)`` sizes after each enabled step, as one fold over the list.

    Only geometry changes a size: resize, crop, rotate with expand, and the quarter-turn transposes.
    """
    start = F.struct(
        w.cast("int").alias("w"), h.cast("int").alias("h"),
        F.array().cast("array<struct<step:int,action:string,w:int,h:int>>").alias("trail"),
    )

    def step(acc: Column, a: Column) -> Column:
        size = _next_size(acc["w"], acc["h"], a)
        entry = F.struct(
            (F.size(acc["trail"]) + 1).alias("step"), a["name"].alias("action"), size["w"].alias("w"), size["h"].alias("h")
        )
        return F.struct(size["w"].alias("w"), size["h"].alias("h"), F.concat(acc["trail"], F.array(entry)).alias("trail"))

    return F.aggregate(enabled_actions(actions), start, step, lambda acc: acc["trail"])


def _next_size(w: Column, h: Column, a: Column) -> Column:
    def num(key: str) -> Column:
        return F.try_element_at(a["parameters"], F.lit(key)).try_cast("int")

    def flag(key: str, default: str) -> Column:
        return F.lower(F.coalesce(F.try_element_at(a["parameters"], F.lit(key)), F.lit(default))).isin(*TRUE_WORDS)

    def pair(cw: Column, ch: Column) -> Column:
        return F.struct(cw.cast("int").alias("w"), ch.cast("int").alias("h"))

    tw, th = F.nullif(num("width"), F.lit(0)), F.nullif(num("height"), F.lit(0))
    keep = flag("maintain_aspect", "true")
    scaled = (
        F.when(keep & tw.isNotNull(), pair(tw, F.floor(F.try_divide(tw, F.try_divide(w, h)))))
        .when(keep & th.isNotNull(), pair(F.floor(th * F.try_divide(w, h)), th))
        .otherwise(pair(F.coalesce(tw, w), F.coalesce(th, h)))
    )
    left, top = F.coalesce(num("x"), F.lit(0)), F.coalesce(num("y"), F.lit(0))
    cropped = pair(
        F.least(F.coalesce(num("width"), w - left), w - left), F.least(F.coalesce(num("height"), h - top), h - top)
    )
    angle = F.coalesce(F.try_element_at(a["parameters"], F.lit("angle")).try_cast("double"), F.lit(90.0))
    turned = F.pmod(angle, F.lit(360.0))
    cos, sin = F.abs(F.cos(F.radians(angle))), F.abs(F.sin(F.radians(angle)))
    rotated = (
        F.when(~flag("expand", "true") | turned.isin(0.0, 180.0), pair(w, h))
        .when(turned.isin(90.0, 270.0), pair(h, w))
        .otherwise(pair(F.ceil(w * cos + h * sin - 1e-9), F.ceil(w * sin + h * cos - 1e-9)))
    )
    method = F.upper(F.coalesce(F.try_element_at(a["parameters"], F.lit("method")), F.lit("")))
    flipped = F.when(method.isin("ROTATE_90", "ROTATE_270", "TRANSPOSE", "TRANSVERSE"), pair(h, w)).otherwise(pair(w, h))
    return (
        F.when(a["name"] == "resize", scaled)
        .when(a["name"] == "crop", cropped)
        .when(a["name"] == "rotate", rotated)
        .when(a["name"] == "transpose", flipped)
        .otherwise(pair(w, h))
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Counts per status of ``results(asset_id, path, error)``; a file has exactly one status."""
    status = F.when(F.col("error").isNull(), "successful").otherwise("failed")
    return results.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def failed_files(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNotNull()).select("asset_id", "path", F.col("error").alias("message"))


def lineage(sizes: DataFrame, version: str = "1.0.0") -> DataFrame:
    """``(img_id, step, action, version, params, width, height)`` of every step run on every image.

    ``sizes`` holds ``(img_id, width, height, actions)``.
    """
    trail = size_after(F.col("actions"), F.col("width"), F.col("height"))
    steps = F.arrays_zip(trail.alias("t"), enabled_actions(F.col("actions")).alias("a"))
    return sizes.select("img_id", F.explode(steps).alias("_s")).select(
        "img_id", F.col("_s.t.step").alias("step"), F.col("_s.t.action").alias("action"),
        F.lit(version).alias("version"), F.col("_s.a.parameters").alias("params"),
        F.col("_s.t.w").alias("width"), F.col("_s.t.h").alias("height"),
    )


def latest_step(lineage_rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("step", "action", "version", "width", "height"), F.col("step"))
    return lineage_rows.groupBy("img_id").agg(last.alias("_l")).select(
        "img_id", F.col("_l.step").alias("steps"), F.col("_l.action").alias("last_action"),
        F.col("_l.version").alias("last_action_version"), F.col("_l.width").alias("width"),
        F.col("_l.height").alias("height"),
    )




def actions_literal(actions: list[dict]) -> Column:
    """A Python list of actions as an array column."""

    def text(v) -> Column:
        return F.lit(str(v).lower() if isinstance(v, bool) else str(v))

    def params(p: dict) -> Column:
        pairs = [c for k, v in p.items() for c in (F.lit(k), text(v))]
        return F.create_map(*pairs).cast("map<string,string>")

    return F.array(
        *[
            F.struct(
                F.lit(a["name"]).alias("name"), params(a.get("parameters", {})).alias("parameters"),
                F.lit(bool(a.get("enabled", True))).alias("enabled"), F.lit(a.get("description", "")).alias("description"),
            )
            for a in actions
        ]
    )


def run_with_lineage(px: DataFrame, actions: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Processed pixels, and one lineage row per image and step."""
    sizes = px.where("x = 0 AND y = 0").select(
        "img_id", F.col("w").alias("width"), F.col("h").alias("height"), actions_literal(actions).alias("actions")
    )
    return run_steps(px, actions), lineage(sizes)


def step_failure(actions: Column, width: Column, height: Column) -> Column:
    """Message of the first step that would leave an image without pixels, or null."""
    trail = size_after(actions, width, height)
    empty = F.filter(trail, lambda s: F.coalesce((s["w"] < 1) | (s["h"] < 1), F.lit(True)))
    first = F.get(empty, F.lit(0))
    return F.when((width < 1) | (height < 1), F.lit("image has no pixels")).when(
        F.size(empty) > 0, F.concat(F.lit("step "), first["step"].cast("string"), F.lit(" ("), first["action"], F.lit(") leaves no pixels"))
    )


def run_with_outcomes(catalog: DataFrame, px: DataFrame, actions: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pixels, outcomes, lineage)`` of a run in which a failing image stops nothing.

    ``outcomes(asset_id, path, error)`` has every row of ``catalog(asset_id, path)``, with the reason if the image
    was not processed; it is what :func:`batch_summary` and :func:`failed_files` take. Pixels and lineage hold the
    other images.
    """
    sizes = px.where("x = 0 AND y = 0").select("img_id", F.col("w").alias("width"), F.col("h").alias("height"))
    sizes = sizes.withColumn("actions", actions_literal(actions))
    checked = cut_lineage(sizes.select("img_id", step_failure(F.col("actions"), F.col("width"), F.col("height")).alias("error")))
    failed = checked.where("error IS NOT NULL").select("img_id")
    good = px if failed.isEmpty() else px.join(failed, "img_id", "left_anti")
    known = checked.select(F.col("img_id").alias("asset_id"), "error", F.lit(True).alias("_read"))
    joined = catalog.select("asset_id", "path").join(known, "asset_id", "left")
    missing = F.when(F.col("_read").isNull(), F.lit("image has no pixels"))
    outcomes = joined.select("asset_id", "path", F.coalesce("error", missing).alias("error"))
    return run_steps(good, actions), outcomes, lineage(sizes.join(failed, "img_id", "left_anti"))


def run_to_folder(catalog: DataFrame, px: DataFrame, actions: list[dict], folder: str) -> DataFrame:
    """Run the actions, write the pixels to ``folder`` as Parquet and return ``outcomes(asset_id, path, error)``.

    Images are counted while they are written, so the outcomes are those of the run and need no second pass. Only when fewer
    images arrived than were expected, since an operator left some without a pixel, are their names looked up.
    """
    pixels, outcomes, _ = run_with_outcomes(catalog, px, actions)
    outcomes = cut_lineage(outcomes)
    expected = outcomes.where("error IS NULL").count()
    seen = Observation("images")
    first_pixel = (F.col("x") == 0) & (F.col("y") == 0)
    pixels.observe(seen, F.count_if(first_pixel).alias("written")).write.mode("errorifexists").parquet(folder)
    if seen.get["written"] >= expected:
        return outcomes
    arrived = px.sparkSession.read.parquet(folder).where("x = 0 AND y = 0").select(F.col("img_id").alias("asset_id"), F.lit(True).alias("_in"))
    found = outcomes.join(arrived.distinct(), "asset_id", "left")
    lost = F.when(F.col("_in").isNull(), F.lit("no pixels left after the run"))
    return found.select("asset_id", "path", F.coalesce("error", lost).alias("error"))
