"""Catalog, tag and pixel tables derived from the driver tables, in Spark and in SQL.

The SQL halves are ``WITH`` fragments; :func:`with_tables` puts the ones a query needs in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS_PER_IMAGE = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- catalog ------------------------------------------------------------------------------------


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.selectExpr(
        "doc_id AS asset_id",
        "concat('/photos/', source, '/', lang, '/IMG_', format_string('%06d', doc_id), '.',"
        " element_at(array('jpg','JPG','png','tiff','webp','txt'), cast(doc_id % 6 AS int) + 1)) AS path",
        "element_at(array('JPEG','JPEG','PNG','TIFF','WEBP',NULL), cast(doc_id % 6 AS int) + 1) AS format",
        "cast(200 + doc_id * 7919 % 6000 AS int) AS width",
        "cast(200 + doc_id * 104729 % 4500 AS int) AS height",
        "element_at(array('RGB','RGBA','L'), cast(doc_id % 3 AS int) + 1) AS mode",
        "n_chars * 1024 AS size_bytes",
        "if(doc_id % 5 = 0, 300, 72) AS dpi_x",
        "if(doc_id % 5 = 0, 300, 72) AS dpi_y",
        "cast(NULL AS string) AS color_profile",
        "if(doc_id % 7 = 0, concat('/raw/', source, '/DSC_', cast(doc_id AS string), '.nef'), NULL) AS original_path",
    )


SQL_CATALOG = """
cat AS (
  SELECT doc_id AS asset_id,
    '/photos/' || source || '/' || lang || '/IMG_' || printf('%06d', doc_id) || '.' ||
      CASE doc_id % 6 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPG' WHEN 2 THEN 'png' WHEN 3 THEN 'tiff'
        WHEN 4 THEN 'webp' ELSE 'txt' END AS path,
    CASE doc_id % 6 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'PNG' WHEN 3 THEN 'TIFF'
      WHEN 4 THEN 'WEBP' END AS format,
    CAST(200 + doc_id * 7919 % 6000 AS INTEGER) AS width,
    CAST(200 + doc_id * 104729 % 4500 AS INTEGER) AS height,
    CASE doc_id % 3 WHEN 0 THEN 'RGB' WHEN 1 THEN 'RGBA' ELSE 'L' END AS mode,
    n_chars * 1024 AS size_bytes,
    CASE WHEN doc_id % 5 = 0 THEN 300 ELSE 72 END AS dpi_x,
    CASE WHEN doc_id % 5 = 0 THEN 300 ELSE 72 END AS dpi_y,
    CAST(NULL AS VARCHAR) AS color_profile,
    CASE WHEN doc_id % 7 = 0 THEN '/raw/' || source || '/DSC_' || CAST(doc_id AS VARCHAR) || '.nef' END
      AS original_path
  FROM documents)
"""


# --- tags ---------------------------------------------------------------------------------------


def exif_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tag table; one array of tag structs per document, exploded, so documents are read once."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").where("doc_id % 4 <> 0")

    def tag(ifd: str, no: int, str_val="NULL", int_val="NULL", rationals="NULL", cond="true") -> str:
        return (
            f"if({cond}, named_struct('ifd', '{ifd}', 'tag', {no}, 'str_val', cast({str_val} AS string),"
            f" 'int_val', cast({int_val} AS bigint), 'rationals',"
            f" cast({rationals} AS array<struct<num:bigint,den:bigint>>)), NULL)"
        )

    def ratio(*pairs: tuple[str, str]) -> str:
        return "array(" + ",".join(f"named_struct('num', {n}, 'den', {d})" for n, d in pairs) + ")"

    gps = "doc_id % 3 = 0"
    tags = [
        tag("0th", 271, "element_at(array('Canon','Nikon','Sony'), cast(doc_id % 3 AS int) + 1)"),
        tag("0th", 272, "concat('Model ', source)"),
        tag("0th", 305, "concat('fw', lang)", cond="doc_id % 2 = 1"),
        tag("0th", 306, "format_string('2024:%02d:%02d %02d:00:00', 1 + doc_id % 12, 1 + doc_id % 28, doc_id % 24)",
            cond="doc_id % 10 <> 3"),
        tag("0th", 274, int_val="1 + doc_id % 8"),
        tag("0th", 282, rationals=ratio(("72 + doc_id % 3", "1"))),
        tag("0th", 315, "concat('artist ', lang)", cond="doc_id % 6 = 1"),
        tag("0th", 33432, "concat('(c) ', source)", cond="doc_id % 6 <> 2"),
        tag("Exif", 36867, "format_string('2023:%02d:01 00:00:00', 1 + doc_id % 12)", cond="doc_id % 5 <> 2"),
        tag("Exif", 33434, rationals=ratio(("if(doc_id % 11 = 0, 3, 1)", "if(doc_id % 11 = 0, 2, shiftleft(1L, cast(doc_id % 10 AS int)))"))),
        tag("Exif", 33437, rationals=ratio(("14 + doc_id % 80", "if(doc_id % 17 = 0, 0, 10)"))),
        tag("Exif", 34855, int_val="100 * (1 + doc_id % 32)"),
        tag("Exif", 37386, rationals=ratio(("10 + doc_id % 190", "1")), cond="doc_id % 9 <> 0"),
        tag("Exif", 37385, int_val="doc_id % 2"),
        tag("Exif", 41987, int_val="doc_id % 3"),
        tag("Exif", 40961, int_val="element_at(array(1, 2, 65535, 7), cast(doc_id % 4 AS int) + 1)"),
        tag("Exif", 42036, "concat('Lens ', lang)", cond="doc_id % 2 = 0"),
        tag("GPS", 1, "if(doc_id % 2 = 0, 'N', 'S')", cond=gps),
        tag("GPS", 2, rationals=ratio(("doc_id % 90", "1"), ("doc_id % 60", "1"), ("doc_id % 3600", "60")), cond=gps),
        tag("GPS", 3, "if(doc_id % 4 < 2, 'E', 'W')", cond=gps),
        tag("GPS", 4, rationals=ratio(("doc_id % 180", "1"), ("doc_id % 59", "1"), ("doc_id % 1800", "30")), cond=gps),
        tag("GPS", 5, int_val="doc_id % 2", cond=gps),
        tag("GPS", 6, rationals=ratio(("doc_id % 9000", "4")), cond=gps),
        tag("GPS", 7, rationals=ratio(("doc_id % 24", "1"), ("doc_id % 60", "1"), ("doc_id % 600", "10")), cond=gps),
        tag("GPS", 29, "format_string('2024:%02d:01', 1 + doc_id % 12)", cond="doc_id % 6 = 3"),
    ]
    return d.selectExpr(
        "doc_id AS asset_id", "explode(array_compact(array(" + ",".join(tags) + "))) AS t"
    ).selectExpr("asset_id", "t.ifd", "t.tag", "t.str_val", "t.int_val", "t.rationals")


# The SQL half keeps the tags as columns: one row per document that has a block.
SQL_EXIF_WIDE = """
tagw AS (
  SELECT doc_id AS asset_id,
    CASE doc_id % 3 WHEN 0 THEN 'Canon' WHEN 1 THEN 'Nikon' ELSE 'Sony' END AS make,
    'Model ' || source AS model,
    CASE WHEN doc_id % 2 = 1 THEN 'fw' || lang END AS software,
    CASE WHEN doc_id % 10 <> 3 THEN printf('2024:%02d:%02d %02d:00:00', 1 + doc_id % 12, 1 + doc_id % 28, doc_id % 24)
      END AS datetime,
    CAST(1 + doc_id % 8 AS INTEGER) AS orientation,
    (72 + doc_id % 3) / 1.0::DOUBLE AS x_resolution,
    CASE WHEN doc_id % 6 = 1 THEN 'artist ' || lang END AS creator,
    CASE WHEN doc_id % 6 <> 2 THEN '(c) ' || source END AS copyright,
    CASE WHEN doc_id % 5 <> 2 THEN printf('2023:%02d:01 00:00:00', 1 + doc_id % 12) END AS datetime_original,
    CASE WHEN doc_id % 11 = 0 THEN 3 ELSE 1 END AS exp_num,
    CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1::BIGINT << (doc_id % 10) END AS exp_den,
    14 + doc_id % 80 AS fn_num,
    CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 10 END AS fn_den,
    CAST(100 * (1 + doc_id % 32) AS INTEGER) AS iso_speed,
    CASE WHEN doc_id % 9 <> 0 THEN 10 + doc_id % 190 END AS fl_num,
    doc_id % 2 AS flash_val,
    doc_id % 3 AS wb_val,
    CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 65535 ELSE 7 END AS cs_val,
    CASE WHEN doc_id % 2 = 0 THEN 'Lens ' || lang END AS lens_model,
    doc_id % 3 = 0 AS has_gps,
    doc_id
  FROM documents WHERE doc_id % 4 <> 0),
exif AS (
  SELECT asset_id, make, model, lens_model, software, datetime, orientation, x_resolution, creator, copyright,
    datetime_original, iso_speed, exp_num, exp_den, fn_num, fn_den, fl_num,
    CASE WHEN exp_den = 1 THEN CAST(exp_num AS VARCHAR) ELSE exp_num || '/' || exp_den END AS exposure_time,
    CASE WHEN fn_den <> 0 THEN fn_num / fn_den::DOUBLE END AS aperture,
    CASE WHEN fn_den <> 0 THEN 'f/' || CAST(fn_num / fn_den::DOUBLE AS VARCHAR) END AS f_number,
    CAST(fl_num / 1.0::DOUBLE AS VARCHAR) AS focal_length,
    CASE WHEN flash_val % 2 = 1 THEN 'Flash fired' ELSE 'Flash did not fire' END AS flash,
    CASE wb_val WHEN 0 THEN 'Auto' WHEN 1 THEN 'Manual' ELSE 'Unknown' END AS white_balance,
    CASE cs_val WHEN 1 THEN 'sRGB' WHEN 2 THEN 'Adobe RGB' WHEN 65535 THEN 'Uncalibrated' ELSE 'Unknown' END
      AS color_space,
    CASE WHEN has_gps THEN (doc_id % 90 + doc_id % 60 / 60.0::DOUBLE + (doc_id % 3600 / 60.0::DOUBLE) / 3600.0::DOUBLE)
      * CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END END AS gps_latitude,
    CASE WHEN has_gps THEN (doc_id % 180 + doc_id % 59 / 60.0::DOUBLE + (doc_id % 1800 / 30.0::DOUBLE) / 3600.0::DOUBLE)
      * CASE WHEN doc_id % 4 < 2 THEN 1 ELSE -1 END END AS gps_longitude,
    CASE WHEN has_gps THEN doc_id % 9000 / 4.0::DOUBLE * CASE WHEN doc_id % 2 = 1 THEN -1 ELSE 1 END END AS gps_altitude,
    CASE WHEN has_gps THEN CASE WHEN doc_id % 6 = 3 THEN printf('2024:%02d:01 ', 1 + doc_id % 12) ELSE '' END ||
      printf('%02d:%02d:%02d', doc_id % 24, doc_id % 60, doc_id % 600 // 10) END AS gps_timestamp
  FROM tagw)
"""


def iptc_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").where("doc_id % 5 <> 0")

    def rec(dataset: int, value: str, order: int = 0, cond: str = "true") -> str:
        return f"if({cond}, named_struct('dataset', {dataset}, 'ord', {order}, 'value', {value}), NULL)"

    records = [
        rec(5, "concat('Title ', source)"),
        rec(15, "upper(lang)", cond="doc_id % 4 = 1"),
        rec(25, "concat(' ', lang, ' ')", 1),
        rec(25, "source", 2),
        rec(25, "'  '", 3),
        rec(25, "concat('k', cast(doc_id % 7 AS string))", 4),
        rec(40, "'handle with care'", cond="doc_id % 8 = 2"),
        rec(55, "if(doc_id % 9 = 4, '2024', format_string('2024%02d%02d', 1 + doc_id % 12, 1 + doc_id % 28))"),
        rec(80, "concat('by ', lang)", cond="doc_id % 3 <> 2"),
        rec(90, "concat('City ', source)"),
        rec(92, "concat('Spot ', lang)", cond="doc_id % 2 = 0"),
        rec(95, "'State'", cond="doc_id % 3 = 0"),
        rec(101, "upper(lang)"),
        rec(116, "concat('(c) ', lang)", cond="doc_id % 4 <> 3"),
        rec(120, "concat('Caption ', cast(doc_id AS string))"),
    ]
    return d.selectExpr(
        "doc_id AS asset_id", "explode(array_compact(array(" + ",".join(records) + "))) AS t"
    ).selectExpr("asset_id", "t.dataset", "t.ord", "t.value")


SQL_IPTC = """
iptc AS (
  SELECT doc_id AS asset_id, 'Title ' || source AS title, 'Caption ' || doc_id AS description,
    'Caption ' || doc_id AS caption,
    [lang, source, 'k' || (doc_id % 7)] AS keywords,
    CASE WHEN doc_id % 4 = 1 THEN upper(lang) END AS category,
    CASE WHEN doc_id % 3 <> 2 THEN 'by ' || lang END AS byline,
    CASE WHEN doc_id % 4 <> 3 THEN '(c) ' || lang END AS copyright_notice,
    CASE WHEN doc_id % 8 = 2 THEN 'handle with care' END AS instructions,
    CASE WHEN doc_id % 2 = 0 THEN 'Spot ' || lang END AS location,
    'City ' || source AS city,
    CASE WHEN doc_id % 3 = 0 THEN 'State' END AS state,
    upper(lang) AS country,
    CASE WHEN doc_id % 9 <> 4 THEN printf('2024%02d%02d', 1 + doc_id % 12, 1 + doc_id % 28) END AS date_created
  FROM documents WHERE doc_id % 5 <> 0)
"""


# --- pixels -------------------------------------------------------------------------------------


def _quantized(embedding: str) -> str:
    return (
        f"transform({embedding}, e -> cast(greatest(0, least(255, floor((cast(e AS double) + 0.5D) * 255))) AS int))"
    )


def _gray_rows(images: DataFrame) -> DataFrame:
    """Rows of ``(img_id, v)`` with 64 values each, as an 8x8 gray pixel table."""
    cells = images.selectExpr("img_id", "v", "explode(sequence(0, 63)) AS idx").selectExpr("img_id", "idx", "v[idx] AS g0")
    return cells.selectExpr(
        "img_id", "8 AS w", "8 AS h", "idx % 8 AS x", "cast(idx div 8 AS int) AS y", "g0 AS r", "g0 AS g", "g0 AS b"
    )


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return _gray_rows(e.selectExpr("vec_id AS img_id", _quantized("embedding") + " AS v"))


def px_rgb(spark: SparkSession, sf_dir: str, alpha: bool = False) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").selectExpr("vec_id AS img_id", _quantized("embedding") + " AS v")
    cols = [
        "img_id", "8 AS w", "8 AS h", "idx % 8 AS x", "cast(idx div 8 AS int) AS y",
        "v[idx] AS r", "v[(idx + 21) % 64] AS g", "v[(idx + 42) % 64] AS b",
    ]
    if alpha:
        cols.append("255 - (idx % 4) * 60 AS a")
    return e.selectExpr("img_id", "v", "explode(sequence(0, 63)) AS idx").selectExpr(*cols)


def px_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images plus near copies with one element negated."""
    e = read(spark, sf_dir, "embeddings")
    flipped = "transform(embedding, (e, i) -> if(i = vec_id % 64, -e, e))"
    copies = e.where("vec_id % 5 = 0").selectExpr("1000000 + vec_id AS img_id", _quantized(flipped) + " AS v")
    return _gray_rows(e.selectExpr("vec_id AS img_id", _quantized("embedding") + " AS v").unionByName(copies))


_Q = "CAST(greatest(0, least(255, floor((CAST({e} AS DOUBLE) + 0.5) * 255))) AS INTEGER)"

SQL_PX = f"""
px AS (
  SELECT vec_id AS img_id, 8 AS w, 8 AS h, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y,
    {_Q.format(e='embedding[i + 1]')} AS v, i AS idx
  FROM embeddings, range(64) t(i))
"""

SQL_PX_RGB = f"""
rgb AS (
  SELECT vec_id AS img_id, 8 AS w, 8 AS h, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y,
    {_Q.format(e='embedding[i + 1]')} AS r,
    {_Q.format(e='embedding[(i + 21) % 64 + 1]')} AS g,
    {_Q.format(e='embedding[(i + 42) % 64 + 1]')} AS b,
    CAST(255 - (i % 4) * 60 AS INTEGER) AS a
  FROM embeddings, range(64) t(i))
"""

SQL_PX_DUP = f"""
dup AS (
  SELECT vec_id AS img_id, i AS idx, {_Q.format(e='embedding[i + 1]')} AS v FROM embeddings, range(64) t(i)
  UNION ALL
  SELECT 1000000 + vec_id, i, {_Q.format(e='(CASE WHEN i = vec_id % 64 THEN -1 ELSE 1 END * embedding[i + 1])')}
  FROM embeddings, range(64) t(i) WHERE vec_id % 5 = 0),
hashes AS (
  SELECT img_id, sum(CASE WHEN v * 64 >= s THEN 1::HUGEINT << (63 - idx)::INTEGER ELSE 0 END)::UBIGINT AS h
  FROM (SELECT *, sum(v) OVER (PARTITION BY img_id) AS s FROM dup) GROUP BY img_id)
"""


# --- raw parameters -----------------------------------------------------------------------------


def raw_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter text as users type it: numbers, words, blanks and nulls."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id",
        "event_type",
        "CASE event_id % 7 WHEN 0 THEN 'abc' WHEN 1 THEN NULL"
        " WHEN 2 THEN if(event_type IN ('click', 'purchase'), 'Yes', 'off')"
        " WHEN 3 THEN concat(' ', cast(cast(floor(value) AS bigint) - 20 AS string), ' ')"
        " WHEN 4 THEN cast(event_id % 300 AS string)"
        " ELSE format_string('%.2f', value - 5) END AS raw",
    )


SQL_RAW = """
raw AS (
  SELECT event_id, event_type,
    CASE event_id % 7 WHEN 0 THEN 'abc' WHEN 1 THEN NULL
      WHEN 2 THEN CASE WHEN event_type IN ('click', 'purchase') THEN 'Yes' ELSE 'off' END
      WHEN 3 THEN ' ' || (CAST(floor(value) AS BIGINT) - 20) || ' '
      WHEN 4 THEN CAST(event_id % 300 AS VARCHAR)
      ELSE printf('%.2f', value - 5) END AS raw
  FROM events)
"""


FRAGMENTS = {
    "cat": SQL_CATALOG,
    "exif": SQL_EXIF_WIDE,
    "iptc": SQL_IPTC,
    "px": SQL_PX,
    "rgb": SQL_PX_RGB,
    "dup": SQL_PX_DUP,
    "raw": SQL_RAW,
}


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    parts = ",".join(FRAGMENTS[n].strip() for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body.strip()}"
