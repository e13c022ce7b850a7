"""Naming templates rendered over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaforge.functions import templates as tpl
from lumaforge.functions.derived import parent_path
from lumaforge.operators import catalog as cat
from lumaforge.operators.ranking import number_within
from lumaforge.workload import tables as t
from lumaforge.workload.catalog import SQL_NAME, SQL_PARENT, SQL_STEM, assets
from lumaforge.workload.registry import query


def _render(spark, sf, template, extra=None):
    c = t.catalog(spark, sf)
    if extra:
        c = c.withColumns({k: F.expr(v) for k, v in extra.items()})
    variables = cat.base_variables() | {k: F.col(k) for k in extra or {}}
    return tpl.render(c, template, variables).select("asset_id", "rendered")


def _sql(body: str) -> str:
    return t.with_tables("cat", f"SELECT asset_id, {body} AS rendered FROM (SELECT *, {SQL_STEM} AS stem, {SQL_NAME} AS base, string_split(path, '/')[-2] AS parent FROM cat)")


@query("T1", _sql("stem || '_' || width || 'x' || height || '.' || coalesce(lower(format), '')"))
def render_names(spark, sf):
    return _render(spark, sf, "<filename>_<width>x<height>.<format_lower>")


@query(
    "T1 T11",
    t.with_tables(
        "cat exif",
        """
        SELECT cat.asset_id, CASE WHEN make IS NOT NULL THEN make || '_' || model || '_' ||
            CASE WHEN fl_num IS NULL THEN '' ELSE fl_num || 'mm' END END AS rendered,
          CASE WHEN make IS NULL THEN 'Variable ''camera_make'' not found' END AS template_error
        FROM cat LEFT JOIN exif USING (asset_id)
        """,
    ),
)
def render_camera_names(spark, sf):
    variables = cat.base_variables() | cat.exif_variables()
    out = tpl.render(
        assets(spark, sf), "<camera_make>_<camera_model>_<focal_length>", variables, set(cat.exif_variables())
    )
    return out.select("asset_id", "rendered", "template_error")


@query("T2", _sql("width || '/' || lower(mode) || '/' || dpi_x"))
def render_nested(spark, sf):
    extra = {"image": "struct(struct(width AS w, height AS h) AS size, mode)", "res": "struct(dpi_x AS x)"}
    return _render(spark, sf, "<image.size.w>/lower(<image.mode>)/<res.x>", extra)


@query(
    "T3",
    _sql(
        "(width * 2) || '_' || CASE WHEN width < 2000 THEN width ELSE 2000 END || '_' || (width // 7 % 5 - 3) || '_' ||"
        " (width / 4.0::DOUBLE + 0.5) || '_' || CASE WHEN width > height AND NOT (mode = 'L') THEN 'True' ELSE 'False' END"
    ).replace("width > height AND", "height < width AND"),
)
def render_expressions(spark, sf):
    return _render(
        spark, sf,
        "<width*2>_<width if width < 2000 else 2000>_<width//7%5 - 3>_<width/4 + 0.5>_<height < width and not mode == 'L'>",
    )


@query(
    "T3 T11",
    t.with_tables(
        "cat",
        """
        SELECT asset_id, CASE WHEN asset_id % 4 <> 0 THEN CAST(width::DOUBLE / (asset_id % 4) AS VARCHAR) || 'px' END AS rendered,
          CASE WHEN asset_id % 4 = 0 THEN 'division by zero' END AS template_error FROM cat
        """,
    ),
)
def render_division(spark, sf):
    c = t.catalog(spark, sf).withColumn("copies", F.expr("asset_id % 4"))
    out = tpl.render(c, "<width / copies>px", cat.base_variables() | {"copies": F.col("copies")})
    return out.select("asset_id", "rendered", "template_error")


@query(
    "T4",
    _sql(
        "upper(stem) || '|' || lower(base) || '|' || upper(parent[1]) || parent[2:] || '|' || replace(stem, 'IMG', 'P')"
        " || '|' || length(stem) || '|' || height || '|' || trim('  x ') || '|' || upper(mode[1]) || lower(mode[2:])"
    ),
)
def render_string_functions(spark, sf):
    return _render(
        spark, sf,
        "upper(<filename>)|lower(<basename>)|title(<parent>)|replace(<filename>, IMG, P)|len(<filename>)|str(<height>)"
        "|strip('  x ')|capitalize(<mode>)",
    )


@query(
    "T5",
    _sql(
        "abs(width - 3000) || '|' || CAST(trunc(width / 7.0::DOUBLE) AS BIGINT) || '|' || CAST(width::DOUBLE AS VARCHAR) || '|' ||"
        " least(width, 1000) || '|' || greatest(width, height) || '|' || CAST(round_even(height / 8.0::DOUBLE, 0) AS BIGINT) || '|' ||"
        " round_even(width / 8.0::DOUBLE, 1) || '|' || CAST(pow(width, 2) AS BIGINT) || '|(' || width // 100 || ', ' || width % 100 || ')|' ||"
        " 30 || '|' || 5"
    ),
)
def render_number_functions(spark, sf):
    return _render(
        spark, sf,
        "<abs(width - 3000)>|<int(width / 7)>|float(<width>)|<min(width, 1000)>|max(<width>, <height>)|<round(height / 8)>"
        "|<round(width / 8, 1)>|pow(<width>, 2)|divmod(width, 100)|max(10, 20, 30)|abs(-5)",
    )


@query(
    "T6",
    _sql(
        "CASE WHEN asset_id % 3 <> 0 THEN 'True' ELSE 'False' END || '|' || (width + height + asset_id % 3) || '|[' ||"
        " array_to_string(list_sort([width, height, asset_id % 3]), ', ') || ']|[' || (asset_id % 3) || ', ' || height || ', ' || width || ']'"
    ),
)
def render_list_functions(spark, sf):
    extra = {"rest": "asset_id % 3", "sizes": "array(cast(width AS bigint), cast(height AS bigint), asset_id % 3)"}
    return _render(spark, sf, "bool(<rest>)|sum(<sizes>)|sorted(<sizes>)|reversed(<sizes>)", extra)


@query("T8", _sql("stem || '_%03d_%05d.jpg'"))
def render_counters(spark, sf):
    return _render(spark, sf, "<filename>_###_#####.jpg")


@query(
    "T8",
    t.with_tables(
        "cat",
        f"""SELECT asset_id, printf('%03d', row_number() OVER (PARTITION BY {SQL_PARENT} ORDER BY path)) AS number FROM cat""",
    ),
)
def numbered_names(spark, sf):
    c = t.catalog(spark, sf).select("asset_id", "path").withColumn("parent", parent_path(F.col("path")))
    return number_within(c, ["parent"], ["path"], "n").select("asset_id", F.format_string("%03d", "n").alias("number"))


def _template_rows(spark, sf):
    """A template per event, assembled from its values."""
    return t.read(spark, sf, "events").selectExpr(
        "event_id", "user_id",
        "CASE event_id % 5 WHEN 0 THEN concat('<', event_type, '>_<width*', cast(user_id AS string), '>')"
        " WHEN 1 THEN concat('upper(<', event_type, '>)_###')"
        " WHEN 2 THEN concat('<min(', event_type, ', height)>_<', event_type, '>')"
        " WHEN 3 THEN concat('<image.size>_<upper(mode) if width < 10 else \"', event_type, '\">')"
        " ELSE concat('plain ', event_type) END AS template",
    )


_TEMPLATES = """
v AS (SELECT event_id, user_id, unnest(CASE event_id % 5 WHEN 0 THEN [event_type, 'width'] WHEN 1 THEN [event_type]
  WHEN 2 THEN [event_type, 'height'] WHEN 3 THEN ['image', 'mode', 'width'] ELSE [] END) AS name FROM events)
"""


@query("T9", f"WITH {_TEMPLATES} SELECT event_id, name FROM v")
def template_variables(spark, sf):
    rows = _template_rows(spark, sf)
    return rows.select("event_id", F.explode(tpl.used_variables(F.col("template"))).alias("name"))


@query(
    "T10",
    f"WITH {_TEMPLATES} SELECT event_id, name FROM v WHERE NOT (name IN ('width', 'click') OR (name = 'view' AND user_id % 2 = 0))",
)
def missing_variables(spark, sf):
    rows = _template_rows(spark, sf).withColumn(
        "context", F.expr("map_concat(map('width', '1', 'click', '2'), if(user_id % 2 = 0, map('view', ''), cast(map() AS map<string,string>)))")
    )
    missing = tpl.missing_variables(F.col("template"), F.col("context"))
    return rows.select("event_id", F.explode(missing).alias("name"))
