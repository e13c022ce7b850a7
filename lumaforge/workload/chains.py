"""Ordered operation lists: editing, describing, predicting and running them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumaforge.operators import pointwise as pw
from lumaforge.operators.registry import run_steps
from lumaforge.plans import steps
from lumaforge.session import ensure_checkpoint_dir
from lumaforge.workload import tables as t
from lumaforge.workload.pixels import CH, LUMA, OUT, _mean, _weights, clamp
from lumaforge.workload.registry import query

_ACTION = "named_struct('name', {n}, 'parameters', {p}, 'enabled', {e}, 'description', '')"


def _action(name: str, params: str, enabled: str = "true") -> str:
    return _ACTION.format(n=name, p=f"cast({params} AS map<string,string>)", e=enabled)


def recipes(spark, sf):
    """One recipe per user: resize, an optional crop, and a step named after the segment."""
    actions = ", ".join(
        [
            _action("'resize'", "map('width', cast(100 + c_custkey % 900 AS string))"),
            _action("'crop'", "map('x', '5', 'width', cast(40 + c_nationkey AS string))", "c_custkey % 3 <> 0"),
            _action("'rotate'", "map('angle', '90', 'expand', 'true')", "c_custkey % 2 = 0"),
            _action("lower(c_mktsegment)", "map()"),
        ]
    )
    return t.read(spark, sf, "customer").selectExpr(
        "c_custkey", "c_nationkey", "c_name AS name", f"array({actions}) AS actions",
        "map('segment', c_mktsegment) AS metadata",
    )


SQL_RECIPES = """
rec AS (SELECT c_custkey, c_nationkey, c_name AS name, [
  {'name': 'resize', 'k': ['width'], 'v': [CAST(100 + c_custkey % 900 AS VARCHAR)], 'on': true},
  {'name': 'crop', 'k': ['x', 'width'], 'v': ['5', CAST(40 + c_nationkey AS VARCHAR)], 'on': c_custkey % 3 <> 0},
  {'name': 'rotate', 'k': ['angle', 'expand'], 'v': ['90', 'true'], 'on': c_custkey % 2 = 0},
  {'name': lower(c_mktsegment), 'k': [], 'v': [], 'on': true}] AS actions FROM customer)
"""


def _names(actions):
    return F.array_join(F.transform(actions, lambda a: a["name"]), ",")


_LIST = "array_to_string(list_transform({}, lambda a: a.name), ',')"


@query(
    "L1 L2",
    f"WITH {SQL_RECIPES} SELECT c_custkey, {_LIST.format('list_filter(actions, lambda a: a.on)')} AS enabled, 4 AS n,"
    " len(list_filter(actions, lambda a: a.on)) AS n_enabled FROM rec",
)
def enabled_actions(spark, sf):
    on = steps.enabled_actions(F.col("actions"))
    return recipes(spark, sf).select(
        "c_custkey", _names(on).alias("enabled"), steps.action_count(F.col("actions")).alias("n"), F.size(on).alias("n_enabled")
    )


@query(
    "L3",
    f"""
    WITH {SQL_RECIPES}, i AS (SELECT *, c_custkey % 8 - 2 AS pos FROM rec)
    SELECT c_custkey,
      CASE WHEN pos BETWEEN 0 AND 4 THEN {_LIST.format("actions[:pos] || [{'name': 'sepia', 'k': [], 'v': [], 'on': true}] || actions[pos + 1:]")} END AS inserted,
      CASE WHEN pos BETWEEN 0 AND 3 THEN {_LIST.format("actions[:pos] || actions[pos + 2:]")} END AS removed,
      CASE WHEN pos BETWEEN 0 AND 3 THEN {_LIST.format("actions[:pos] || [{'name': 'sepia', 'k': [], 'v': [], 'on': true}] || actions[pos + 2:]")} END AS replaced,
      CASE WHEN pos NOT BETWEEN 0 AND 3 THEN 'Index ' || pos || ' out of range' END AS error
    FROM i
    """.replace("actions[:pos]", "actions[1:pos]"),
)
def edited_actions(spark, sf):
    at = F.col("at")
    actions = F.col("actions")
    new = F.expr(_action("'sepia'", "map()"))
    rows = recipes(spark, sf).withColumn("at", F.expr("cast(c_custkey % 8 - 2 AS int)")).select(
        "c_custkey", steps.insert_action(actions, at, new).alias("i"), steps.remove_action(actions, at).alias("d"),
        steps.replace_action(actions, at, new).alias("r"),
    )
    return rows.select(
        "c_custkey", _names(F.col("i.actions")).alias("inserted"), _names(F.col("d.actions")).alias("removed"),
        _names(F.col("r.actions")).alias("replaced"), F.col("d.error").alias("error"),
    )


@query(
    "L4",
    """
    SELECT c_custkey, 'with' AS edit, unnest(['x', 'width']) AS name, unnest([c_mktsegment, CAST(40 + c_nationkey AS VARCHAR)]) AS value FROM customer
    UNION ALL SELECT c_custkey, 'without', 'x', '5' FROM customer
    """,
)
def edited_parameters(spark, sf):
    crop = recipes(spark, sf).withColumn("p", F.col("actions")[1]["parameters"])
    both = F.array(
        F.struct(F.lit("with").alias("edit"), steps.with_parameter(F.col("p"), F.lit("x"), F.col("metadata")["segment"]).alias("p")),
        F.struct(F.lit("without").alias("edit"), steps.without_parameter(F.col("p"), F.lit("width")).alias("p")),
    )
    return crop.select("c_custkey", F.explode(both).alias("e")).select(
        "c_custkey", "e.edit", F.explode("e.p").alias("name", "value")
    )


@query(
    "L5",
    t.with_tables(
        "rgb",
        f"""
        , {_weights('k', 8, 4, 'BICUBIC')},
        hz AS (SELECT img_id, CAST(o AS INTEGER) AS x, y, {', '.join(_mean(c) for c in CH)} FROM rgb s JOIN k ON k.i = s.x GROUP BY img_id, o, y),
        vt AS (SELECT img_id, x, CAST(o AS INTEGER) AS y, {', '.join(_mean(c) for c in CH)} FROM hz s JOIN k ON k.i = s.y GROUP BY img_id, x, o),
        br AS (SELECT img_id, x, y, {', '.join(clamp(f'{c} * 1.2::DOUBLE') + f' AS {c}' for c in CH)} FROM vt)
        SELECT img_id, 3 - x AS x, y, {', '.join(clamp(f'{LUMA} + 0.5::DOUBLE * ({c} - {LUMA})') + f' AS {c}' for c in CH)} FROM br
        """,
    ),
)
def run_step_list(spark, sf):
    """Resize, brighten, desaturate and flip every image in one lazy plan; a disabled step is left out."""
    actions = [
        {"name": "resize", "parameters": {"width": "4", "resample": "BICUBIC"}},
        {"name": "brightness", "parameters": {"factor": 1.2}},
        {"name": "sepia", "enabled": False},
        {"name": "saturation", "parameters": {"factor": "0.5"}},
        {"name": "transpose", "parameters": {"method": "flip_horizontal"}},
    ]
    return run_steps(t.px_rgb(spark, sf), actions).select(OUT)


# Every image gets the recipe of one customer of the same residue.
_ASSIGN = "asg AS (SELECT cat.asset_id, r.name, r.actions FROM cat JOIN rec r ON r.c_custkey = cat.asset_id % (SELECT count(*) FROM rec))"


def _assigned(spark, sf, keep=("name",)):
    r = recipes(spark, sf)
    pairs = t.catalog(spark, sf).select("asset_id", (F.col("asset_id") % r.count()).alias("c_custkey"))
    return pairs.join(r.select("c_custkey", *keep), "c_custkey").drop("c_custkey")


@query(
    "L6",
    t.with_tables(
        "cat",
        f"""
        , {SQL_RECIPES}, {_ASSIGN},
        on_steps AS (SELECT asset_id, name, list_filter(actions, lambda a: a.on) AS acts FROM asg),
        st AS (SELECT asset_id, name, unnest(acts) AS a, generate_subscripts(acts, 1) AS step_no FROM on_steps),
        pr AS (SELECT asset_id, name, step_no, a.name AS action, unnest(a.k) AS param, unnest(a.v) AS value FROM st
          UNION ALL SELECT asset_id, name, step_no, a.name, NULL, NULL FROM st WHERE len(a.k) = 0)
        SELECT pr.asset_id, name, path, step_no, action, param, value,
          regexp_replace(path, '/[^/]*$', '') || '_processed/' || regexp_extract(path, '[^/]*$') AS output
        FROM pr JOIN cat USING (asset_id)
        """,
    ),
)
def dry_run(spark, sf):
    return steps.plan_rows(t.catalog(spark, sf), recipes(spark, sf), _assigned(spark, sf))


_SIZES = f"""
, {SQL_RECIPES}, {_ASSIGN},
s0 AS (SELECT cat.asset_id, width AS w, height AS h, actions FROM cat JOIN asg USING (asset_id)),
s1 AS (SELECT *, CAST(actions[1].v[1] AS INTEGER) AS w1, CAST(floor(CAST(actions[1].v[1] AS INTEGER) / (w / h::DOUBLE)) AS INTEGER) AS h1 FROM s0),
s2 AS (SELECT *, CASE WHEN actions[2].on THEN least(CAST(actions[2].v[2] AS INTEGER), w1 - 5) ELSE w1 END AS w2, h1 AS h2 FROM s1),
s3 AS (SELECT *, CASE WHEN actions[3].on THEN h2 ELSE w2 END AS w3, CASE WHEN actions[3].on THEN w2 ELSE h2 END AS h3 FROM s2),
trail AS (
  SELECT asset_id, 1 AS step, 'resize' AS action, w1 AS w, h1 AS h FROM s3
  UNION ALL SELECT asset_id, 2, 'crop', w2, h2 FROM s3 WHERE actions[2].on
  UNION ALL SELECT asset_id, 2 + actions[2].on::INTEGER, 'rotate', w3, h3 FROM s3 WHERE actions[3].on
  UNION ALL SELECT asset_id, 2 + actions[2].on::INTEGER + actions[3].on::INTEGER, actions[4].name, w3, h3 FROM s3)
"""


def _sized(spark, sf):
    sizes = t.catalog(spark, sf).select("asset_id", "width", "height")
    return sizes.join(_assigned(spark, sf, ("actions",)), "asset_id")


@query("L7", t.with_tables("cat", _SIZES + " SELECT asset_id, step, action, w, h FROM trail"))
def predicted_sizes(spark, sf):
    trail = steps.size_after(F.col("actions"), F.col("width"), F.col("height"))
    return _sized(spark, sf).select("asset_id", F.explode(trail).alias("s")).select("asset_id", "s.*")


_RESULT = """
res AS (SELECT asset_id, path, CASE WHEN vec_id IS NULL THEN 'image has no pixels'
  WHEN asset_id % 3 = 0 THEN 'step 2 (crop) leaves no pixels' END AS error FROM cat LEFT JOIN embeddings ON vec_id = asset_id)
"""

_RUN = [{"name": "brightness", "parameters": {"factor": 1.2}}, {"name": "crop", "parameters": {"x": 4, "width": 3}}]


def _results(spark, sf):
    """Outcomes of a run over images of which every third is too narrow for its crop."""
    px = t.px_rgb(spark, sf)
    narrow = F.col("img_id") % 3 == 0
    px = pw.crop(px.where(narrow), width=3).unionByName(px.where(~narrow))
    folder = f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
    return steps.run_to_folder(t.catalog(spark, sf), px, _RUN, folder)


@query(
    "L5 L8",
    t.with_tables("cat", f", {_RESULT} SELECT CASE WHEN error IS NULL THEN 'successful' ELSE 'failed' END AS status, count(*) AS n FROM res GROUP BY 1"),
)
def batch_summary(spark, sf):
    return steps.batch_summary(_results(spark, sf))


@query("L5 L8", t.with_tables("cat", f", {_RESULT} SELECT asset_id, path, error AS message FROM res WHERE error IS NOT NULL"))
def failed_files(spark, sf):
    return steps.failed_files(_results(spark, sf))


def _lineage(spark, sf):
    return steps.lineage(_sized(spark, sf).withColumnRenamed("asset_id", "img_id"))


@query(
    "L9",
    t.with_tables(
        "cat",
        _SIZES
        + """
        SELECT t.asset_id AS img_id, step, action, '1.0.0' AS version, t.w AS width, t.h AS height,
          CASE action WHEN 'resize' THEN 'width=' || actions[1].v[1] WHEN 'crop' THEN 'width=' || actions[2].v[2] || ',x=5'
            WHEN 'rotate' THEN 'angle=90,expand=true' ELSE '' END AS params
        FROM trail t JOIN s0 USING (asset_id)
        """,
    ),
)
def lineage(spark, sf):
    pairs = F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return _lineage(spark, sf).withColumn("params", F.array_join(pairs, ","))


@query(
    "L9",
    t.with_tables(
        "cat",
        _SIZES
        + """
        SELECT asset_id AS img_id, max(step) AS steps, arg_max(action, step) AS last_action, '1.0.0' AS last_action_version,
          arg_max(w, step) AS width, arg_max(h, step) AS height FROM trail GROUP BY asset_id
        """,
    ),
)
def latest_step(spark, sf):
    return steps.latest_step(_lineage(spark, sf))
