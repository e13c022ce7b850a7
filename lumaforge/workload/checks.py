"""Typed parameter checks and the parsing of operation strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaforge.functions import validation as v
from lumaforge.plans import steps
from lumaforge.workload import tables as t
from lumaforge.workload.registry import query

NUM = "'[+-]?[0-9]+'"
FLT = "'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'"
AS_INT = f"CASE WHEN regexp_full_match(trim(raw), {NUM}) THEN CAST(trim(raw) AS BIGINT) END"
AS_FLT = f"CASE WHEN regexp_full_match(trim(raw), {FLT}) THEN CAST(trim(raw) AS DOUBLE) END"


def _flat(df, column, *keys):
    """Value and the parts of the error next to the key columns."""
    return df.select(*keys, column.alias("_r")).select(
        *keys, F.col("_r.value").alias("value"), F.col("_r.error.field").alias("field"),
        F.col("_r.error.expected").alias("expected"), F.col("_r.error.message").alias("message"),
    )


def _rule_sql(value: str, field: str, cases: list[tuple[str, str, str]]) -> str:
    """Oracle of a rule: cases are (condition on raw and val, expected, message)."""
    index = "CASE " + " ".join(f"WHEN {c} THEN {i}" for i, (c, _, _) in enumerate(cases)) + " END"
    expected = "CASE k " + " ".join(f"WHEN {i} THEN '{e}'" for i, (_, e, _) in enumerate(cases)) + " END"
    message = "CASE k " + " ".join(f"WHEN {i} THEN '{m}'" for i, (_, _, m) in enumerate(cases)) + " END"
    return t.with_tables(
        "raw",
        f"""
        SELECT event_id, CASE WHEN k IS NULL THEN val END AS value, CASE WHEN k IS NOT NULL THEN '{field}' END AS field,
          {expected} AS expected, {message} AS message
        FROM (SELECT event_id, val, {index} AS k FROM (SELECT event_id, raw, {value} AS val FROM raw))
        """,
    )


def _rule(spark, sf, rule):
    return _flat(t.raw_params(spark, sf), rule(F.col("raw")), "event_id")


BAD = "raw IS NOT NULL AND val IS NULL"


@query(
    "V1",
    _rule_sql("raw", "name", [("val IS NULL", "non-null value", "Field is required but no value provided")]),
)
def required_value(spark, sf):
    return _rule(spark, sf, lambda c: v.required(c, field="name"))


@query("V1", t.with_tables("raw", "SELECT event_id, coalesce(raw, 'default') AS value FROM raw"))
def default_value(spark, sf):
    return t.raw_params(spark, sf).select("event_id", v.required(F.col("raw"), "default")["value"].alias("value"))


@query(
    "V2",
    _rule_sql(AS_INT, "integer_field", [
        (BAD, "integer number", "Value must be convertible to integer"),
        ("val < 0", "integer >= 0", "Value must be at least 0"),
        ("val > 200", "integer <= 200", "Value must be at most 200"),
    ]),
)
def integer_values(spark, sf):
    return _rule(spark, sf, lambda c: v.integer(c, 0, 200))


@query(
    "V3",
    _rule_sql(AS_FLT, "float_field", [
        (BAD, "numeric value", "Value must be convertible to number"),
        ("val < 0.5", "number >= 0.5", "Value must be at least 0.5"),
        ("val > 99.5", "number <= 99.5", "Value must be at most 99.5"),
    ]),
)
def float_values(spark, sf):
    return _rule(spark, sf, lambda c: v.floating(c, 0.5, 99.5))


@query(
    "V4",
    _rule_sql(
        "CASE WHEN lower(raw) IN ('true', 'yes', '1', 'on', 'enabled') THEN true"
        " WHEN lower(raw) IN ('false', 'no', '0', 'off', 'disabled') THEN false END",
        "boolean_field",
        [(BAD, "boolean value (true/false)", "String value not recognized as boolean")],
    ),
)
def boolean_values(spark, sf):
    return _rule(spark, sf, v.boolean)


@query(
    "V5",
    _rule_sql("raw", "string_field", [
        ("length(val) < 3", "string with at least 3 characters", "String must be at least 3 characters long"),
        ("length(val) > 4", "string with at most 4 characters", "String must be at most 4 characters long"),
    ]),
)
def string_lengths(spark, sf):
    return _rule(spark, sf, lambda c: v.string_length(c, 3, 4))


@query(
    "V6",
    """
    SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS value,
      CASE WHEN event_type NOT IN ('click', 'view') THEN 'choice_field' END AS field,
      CASE WHEN event_type NOT IN ('click', 'view') THEN 'one of: click, view' END AS expected,
      CASE WHEN event_type NOT IN ('click', 'view') THEN 'Value is not a valid choice' END AS message,
      CASE event_type WHEN 'click' THEN 'A click' WHEN 'view' THEN 'A view' ELSE event_type END AS label
    FROM events
    """,
)
def choice_values(spark, sf):
    choices = {"view": "A view", "click": "A click"}
    e = t.read(spark, sf, "events").select("event_id", "event_type")
    rows = e.withColumn("label", v.choice_label(F.col("event_type"), choices))
    return _flat(rows, v.choice(F.col("event_type"), choices), "event_id", "label")


@query(
    "V7",
    t.with_tables(
        "cat",
        """
        , c AS (SELECT asset_id, mode, CASE WHEN asset_id % 7 = 0 THEN 'CMYK' WHEN asset_id % 7 = 1 THEN '1' ELSE mode END AS m,
            coalesce(format, 'SVG') AS f FROM cat)
        SELECT asset_id, m IN ('RGB', 'RGBA', 'L', 'LA', 'CMYK', 'P') AS mode_ok,
          f IN ('JPEG', 'PNG', 'WebP', 'TIFF', 'BMP', 'GIF') AS format_ok,
          CASE m WHEN 'RGB' THEN 'RGB Color (24-bit)' WHEN 'RGBA' THEN 'RGB with Alpha (32-bit)' WHEN 'L' THEN 'Grayscale (8-bit)'
            WHEN 'CMYK' THEN 'CMYK (32-bit)' ELSE m END AS mode_label,
          CASE f WHEN 'JPEG' THEN 'JPEG (lossy compression)' WHEN 'PNG' THEN 'PNG (lossless, supports transparency)'
            WHEN 'TIFF' THEN 'TIFF (uncompressed, professional)' ELSE f END AS format_label
        FROM c
        """,
    ),
)
def mode_format_choices(spark, sf):
    c = t.catalog(spark, sf).selectExpr(
        "asset_id", "CASE WHEN asset_id % 7 = 0 THEN 'CMYK' WHEN asset_id % 7 = 1 THEN '1' ELSE mode END AS m",
        "coalesce(format, 'SVG') AS f",
    )
    m, f = F.col("m"), F.col("f")
    return c.select(
        "asset_id",
        v.choice(m, v.MODE_CHOICES)["error"].isNull().alias("mode_ok"),
        v.choice(f, v.FORMAT_CHOICES)["error"].isNull().alias("format_ok"),
        v.choice_label(m, v.MODE_CHOICES).alias("mode_label"),
        v.choice_label(f, v.FORMAT_CHOICES).alias("format_label"),
    )


@query("V8", t.with_tables("raw", "SELECT event_id, lower(raw) IN ('true', 'yes', '1', 'on') AS value FROM raw"))
def lenient_booleans(spark, sf):
    return t.raw_params(spark, sf).select("event_id", v.lenient_boolean(F.col("raw")).alias("value"))


@query("V9", t.with_tables("raw", "SELECT event_id, regexp_matches(raw, '^(?:[0-9]+\\.|abc)') AS value FROM raw"))
def pattern_matches(spark, sf):
    return t.raw_params(spark, sf).select("event_id", v.matches_pattern(F.col("raw"), r"[0-9]+\.|abc").alias("value"))


@query(
    "V10",
    _rule_sql(AS_INT, "size", [
        (BAD, "int", "Parameter ''size'' must be an integer"),
        ("val < 10", ">= 10", "Parameter ''size'' must be >= 10"),
        ("val > 250", "<= 250", "Parameter ''size'' must be <= 250"),
        ("val NOT IN (10, 20, 40, 80, 160)", "[10, 20, 40, 80, 160]", "Parameter ''size'' must be one of [10, 20, 40, 80, 160]"),
    ]),
)
def constrained_values(spark, sf):
    return _rule(spark, sf, lambda c: v.constrained(c, "int", 10, 250, [10, 20, 40, 80, 160], name="size"))


@query(
    "V11",
    """
    SELECT event_id, action, name, value FROM (
      SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'resize' ELSE 'save' END AS action, event_id % 3 = 0 AS keep,
        CASE event_id % 5 WHEN 0 THEN 'PNG' WHEN 1 THEN 'WebP' WHEN 2 THEN 'TIFF' ELSE 'JPEG' END AS fmt,
        unnest(['width', 'height', 'maintain_aspect', 'quality', 'format']) AS name,
        unnest([CAST(user_id AS VARCHAR), '20', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'False' END, '90',
          CASE event_id % 5 WHEN 0 THEN 'PNG' WHEN 1 THEN 'WebP' WHEN 2 THEN 'TIFF' ELSE 'JPEG' END]) AS value
      FROM events)
    WHERE NOT (action = 'resize' AND name = 'height' AND keep)
      AND NOT (action = 'save' AND name = 'quality' AND fmt NOT IN ('JPEG', 'WebP'))
    """,
)
def relevant_parameters(spark, sf):
    e = t.read(spark, sf, "events").selectExpr(
        "event_id", "if(event_id % 2 = 0, 'resize', 'save') AS action",
        "map('width', cast(user_id AS string), 'height', '20', 'maintain_aspect', if(event_id % 3 = 0, 'true', 'False'),"
        " 'quality', '90', 'format', CASE event_id % 5 WHEN 0 THEN 'PNG' WHEN 1 THEN 'WebP' WHEN 2 THEN 'TIFF' ELSE 'JPEG' END) AS p",
    )
    kept = v.relevant_parameters(F.col("action"), F.col("p"))
    return e.select("event_id", "action", F.explode(kept).alias("name", "value"))


@query(
    "V12",
    _rule_sql(AS_INT, "width", [
        (BAD, "integer", "Width must be an integer"),
        ("val < 1", "integer >= 1", "Width must be at least 1"),
        ("val > 50000", "integer <= 50000", "Width must be at most 50000"),
    ]),
)
def dimensions(spark, sf):
    return _rule(spark, sf, lambda c: v.dimension(c, "width"))


_PCT = [
    (BAD, "numeric percentage value", "Percentage must be a number"),
    ("val < 0", "non-negative percentage", "Percentage cannot be negative"),
    ("val > 100", "percentage <= 100", "Percentage cannot exceed 100%"),
]


@query("V13", _rule_sql(AS_FLT, "percentage", _PCT))
def percentages(spark, sf):
    return _rule(spark, sf, v.percentage)


@query("V13", _rule_sql(AS_FLT, "percentage", _PCT[:2]))
def percentages_over(spark, sf):
    return _rule(spark, sf, lambda c: v.percentage(c, allow_over=True))


@query(
    "V14",
    _rule_sql(AS_FLT, "factor", [
        (BAD, "numeric factor value", "Factor must be a number"),
        ("val < 0.0", "factor >= 0.0", "Factor must be at least 0.0"),
        ("val > 3.0", "factor <= 3.0", "Factor must be at most 3.0"),
    ]),
)
def factors(spark, sf):
    return _rule(spark, sf, lambda c: v.factor(c, 0.0, 3.0))


def _modes(spark, sf):
    return t.catalog(spark, sf).selectExpr(
        "asset_id",
        "element_at(array('RGB','RGBA','L','LA','CMYK','P','1','HSV'), cast(asset_id % 8 AS int) + 1) AS m",
        "array(size_bytes % 300 - 20.5D, width % 256 + 0.9D, height % 260 + 0.0D) AS parts",
    )


_MODES = """
m AS (SELECT asset_id, ['RGB', 'RGBA', 'L', 'LA', 'CMYK', 'P', '1', 'HSV'][asset_id % 8 + 1] AS m,
  [size_bytes % 300 - 20.5, width % 256 + 0.9, height % 260 + 0.0]::DOUBLE[] AS parts FROM cat)
"""


@query(
    "V15 V17",
    t.with_tables(
        "cat",
        f"""
        , {_MODES}
        SELECT asset_id, m IN ('RGB', 'RGBA', 'L', 'LA', 'CMYK', 'P', '1') AS known,
          CASE WHEN m = 'HSV' THEN 'Color mode ''HSV'' not supported for this operation' END AS message,
          CASE WHEN m = 'HSV' THEN 'Unknown mode: HSV' ELSE ['RGB Color (24-bit)', 'RGB with Alpha (32-bit)', 'Grayscale (8-bit)',
            'Grayscale with Alpha (16-bit)', 'CMYK (32-bit)', 'Palette (8-bit)', 'Bitmap (1-bit)'][asset_id % 8 + 1] END AS description,
          [3, 4, 1, 2, 4, 1, 1, 1][asset_id % 8 + 1] AS channels, m IN ('RGBA', 'LA', 'P') AS has_alpha,
          m IN ('RGB', 'RGBA', 'L') AS web_safe,
          CASE WHEN m IN ('RGB', 'RGBA') THEN 'RGB,RGBA,L,LA' WHEN m IN ('L', 'LA') THEN 'L,LA,RGB,RGBA'
            WHEN m = 'CMYK' THEN 'CMYK,RGB' WHEN m = 'P' THEN 'P,RGB,RGBA' ELSE 'RGB,L' END AS compatible
        FROM m
        """,
    ),
)
def color_modes(spark, sf):
    rows = _modes(spark, sf).select(
        "asset_id", v.color_mode(F.col("m")).alias("r"), v.mode_info(F.col("m")).alias("i")
    )
    return rows.select(
        "asset_id", F.col("r.error").isNull().alias("known"), F.col("r.error.message").alias("message"),
        "i.description", "i.channels", "i.has_alpha", "i.web_safe", F.concat_ws(",", "i.compatible").alias("compatible"),
    )


@query(
    "V16",
    t.with_tables(
        "cat",
        f"""
        , {_MODES}
        , c AS (SELECT asset_id, m, CASE m WHEN 'L' THEN parts[1:1] WHEN 'LA' THEN parts[1:2] ELSE parts END AS color FROM m)
        , k AS (SELECT asset_id, m, list_transform(color, lambda x: CAST(trunc(x) AS INTEGER)) AS ints,
            CASE WHEN m IN ('L', '1') THEN 1 WHEN m IN ('RGBA', 'CMYK') THEN 4 WHEN m = 'LA' THEN 2 ELSE 3 END AS want FROM c)
        , b AS (SELECT *, list_position(list_transform(ints, lambda x: x < 0 OR x > 255), true) AS bad FROM k)
        SELECT asset_id, CASE WHEN len(ints) = want AND bad IS NULL THEN array_to_string(ints, ',') END AS color,
          CASE WHEN len(ints) <> want AND m IN ('L', '1') THEN 'Grayscale modes require single color value'
            WHEN len(ints) <> want THEN m || ' mode requires ' || want || ' color components'
            WHEN bad IS NOT NULL AND m IN ('L', '1') THEN 'Color value out of range'
            WHEN bad IS NOT NULL THEN 'Color component ' || (bad - 1) || ' out of range' END AS message
        FROM b
        """,
    ),
)
def color_values(spark, sf):
    rows = _modes(spark, sf).withColumn(
        "color", F.expr("CASE m WHEN 'L' THEN slice(parts, 1, 1) WHEN 'LA' THEN slice(parts, 1, 2) ELSE parts END")
    )
    checked = rows.select("asset_id", v.color_value(F.col("color"), F.col("m")).alias("r"))
    return checked.select(
        "asset_id",
        F.when(F.col("r.value").isNotNull(), F.array_join(F.col("r.value").cast("array<string>"), ",")).alias("color"),
        F.col("r.error.message").alias("message"),
    )


@query(
    "V18 V19",
    """
    SELECT event_id, greatest(10.0, least(60.0, value)) AS clamped,
      CASE WHEN user_id % 10 = 0 THEN 0.0 ELSE 0.0 + (value - user_id) / (user_id % 10) * 255.0 END AS mapped
    FROM events
    """,
)
def clamp_normalize(spark, sf):
    e = t.read(spark, sf, "events")
    lo = F.col("user_id").cast("double")
    return e.select(
        "event_id", v.clamp(F.col("value"), 10.0, 60.0).alias("clamped"),
        v.normalize(F.col("value"), lo, lo + F.col("user_id") % 10, 0, 255).alias("mapped"),
    )


# --- operation strings --------------------------------------------------------------------------


def _action_strings(spark, sf):
    return t.read(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_id % 6 WHEN 0 THEN concat('resize:width=', cast(user_id AS string), ',maintain_aspect=True')"
        " WHEN 1 THEN concat('brightness:factor=', format_string('%.2f', value)) WHEN 2 THEN 'sepia:'"
        " WHEN 3 THEN concat('bad-name ', event_type)"
        " WHEN 4 THEN concat('watermark:text=a=b:c,', event_type, ',position=center,position=', event_type)"
        " ELSE concat('my_', event_type, ':x=1.2.3,y=,,z=-4') END AS txt",
    )


_STRINGS = """
s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'resize:width=' || user_id || ',maintain_aspect=True'
  WHEN 1 THEN 'brightness:factor=' || printf('%.2f', value) WHEN 2 THEN 'sepia:'
  WHEN 3 THEN 'bad-name ' || event_type
  WHEN 4 THEN 'watermark:text=a=b:c,' || event_type || ',position=center,position=' || event_type
  ELSE 'my_' || event_type || ':x=1.2.3,y=,,z=-4' END AS txt FROM events),
p AS (SELECT event_id, split_part(txt, ':', 1) AS action,
    string_split(CASE WHEN contains(txt, ':') THEN substr(txt, strpos(txt, ':') + 1) ELSE '' END, ',') AS parts FROM s),
q AS (SELECT event_id, action, part, i FROM (SELECT event_id, action, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p)
  WHERE contains(part, '=')),
kv AS (SELECT event_id, action, split_part(part, '=', 1) AS name, arg_max(substr(part, strpos(part, '=') + 1), i) AS value
  FROM q GROUP BY ALL)
"""


@query("A1", f"WITH {_STRINGS} SELECT event_id, action, name, value FROM kv")
def parse_action_strings(spark, sf):
    parsed = _action_strings(spark, sf).select("event_id", steps.parse_action(F.col("txt")).alias("a"))
    return parsed.select("event_id", F.col("a.name").alias("action"), F.explode("a.parameters").alias("name", "value"))


@query(
    "A2",
    f"""
    WITH {_STRINGS}, k AS (SELECT *, CASE WHEN lower(value) IN ('true', 'false') THEN 'bool'
        WHEN regexp_full_match(value, '[0-9]+') THEN 'int'
        WHEN regexp_full_match(replace(value, '.', ''), '[0-9]+') THEN 'float' ELSE 'str' END AS kind FROM kv)
    SELECT event_id, name, kind, CASE WHEN kind = 'bool' THEN lower(value) = 'true' END AS bool_value,
      CASE WHEN kind = 'int' THEN TRY_CAST(value AS BIGINT) END AS int_value,
      CASE WHEN kind = 'float' THEN TRY_CAST(value AS DOUBLE) END AS float_value FROM k
    """,
)
def parameter_types(spark, sf):
    params = parse_action_strings(spark, sf)
    return steps.typed_parameters(params).select("event_id", "name", "kind", "bool_value", "int_value", "float_value")


@query(
    "A3",
    f"""
    WITH {_STRINGS} SELECT event_id, action, CASE WHEN NOT regexp_full_match(replace(action, '_', ''), '[\\p{{L}}\\p{{N}}]+')
      THEN 'Action name must be alphanumeric with underscores' END AS error FROM p
    """,
)
def action_names(spark, sf):
    names = _action_strings(spark, sf).select("event_id", steps.parse_action(F.col("txt"))["name"].alias("action"))
    return names.select("event_id", "action", steps.name_error(F.col("action")).alias("error"))
