"""File formats written from the driver tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumaforge.session import ensure_checkpoint_dir
from lumaforge.sources import images, recipes, sinks, tagscan
from lumaforge.sources.records import read_records, with_records
from lumaforge.workload import tables as t
from lumaforge.workload.chains import recipes as recipe_rows
from lumaforge.workload.registry import query


def _new_folder(spark, name):
    """A new folder beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "S3 S4 S5 S11",
    t.with_tables("rgb", "SELECT CAST(img_id AS VARCHAR) || '.png' AS file, x, y, r, g, b, a FROM rgb"),
)
def png_round_trip(spark, sf):
    """Export every image as PNG, decode the files again and list the pixels."""
    folder = _new_folder(spark, "png")
    sinks.export_png(t.px_rgb(spark, sf, alpha=True), folder)
    good, _ = images.split_decoded(images.load_images(spark, folder))
    names = good.select(images.image_id(F.col("path")).alias("img_id"), F.regexp_extract("path", "[^/]*$", 0).alias("file"))
    return images.explode_pixels(good).join(names, "img_id").select("file", "x", "y", "r", "g", "b", "a")


@query(
    "S3",
    """
    SELECT vec_id || '.png' AS file, 'PNG' AS format, 8 AS width, 8 AS height, 'RGB' AS mode, 72 AS dpi_x FROM embeddings
    """,
)
def loaded_assets(spark, sf):
    """Catalog rows of exported files."""
    folder = _new_folder(spark, "assets")
    sinks.export_png(t.px_rgb(spark, sf), folder)
    rows, _ = images.load_assets(images.scan(spark, folder))
    return rows.select(
        F.regexp_extract("path", "[^/]*$", 0).alias("file"), "format", "width", "height", "mode", "dpi_x"
    )


# --- tag blocks ---------------------------------------------------------------------------------

# A little-endian block with make (ASCII), orientation (SHORT), x resolution (RATIONAL) and, in a
# sub-block, the ISO value; offsets follow from the fixed layout.
_LE2 = "lpad(hex(cast(({v}) % 256 AS bigint)), 2, '0') || lpad(hex(cast(({v}) div 256 % 256 AS bigint)), 2, '0')"


def _le2(v: str) -> str:
    return "concat(" + _LE2.format(v=v).replace(" || ", ", ") + ")"


_TIFF = (
    "concat('49492A0008000000', '0400',"
    " '0F010200', '10000000', '3E000000',"
    f" '12010300', '01000000', {_le2('1 + doc_id % 8')}, '0000',"
    " '1A010500', '01000000', '4E000000',"
    " '69870400', '01000000', '56000000', '00000000',"
    " hex(cast(rpad(concat('Cam ', source), 15, ' ') AS binary)), '00',"
    f" {_le2('72 + doc_id % 200')}, '0000', '02000000',"
    f" '0100', '27880300', '01000000', {_le2('100 + doc_id % 400')}, '0000', '00000000')"
)


def _iim(dataset: str, value: str) -> str:
    return f"concat('1C02{dataset}', lpad(hex(cast(octet_length({value}) AS bigint)), 4, '0'), hex(cast({value} AS binary)))"


_RECORDS = "concat(" + ", ".join(
    [_iim("05", "concat('Title ', source)"), _iim("19", "lang"), _iim("19", "concat('k', cast(doc_id AS string))")]
) + ")"
_SEGMENT2 = f"concat('50686F746F73686F7020332E3000', '3842494D04040000', lpad(hex(cast(length({_RECORDS}) div 2 AS bigint)), 8, '0'), {_RECORDS})"


def _jpegs(spark, sf):
    """Header bytes of one JPEG per document; every ninth has its tag block cut off."""
    tiff = f"if(doc_id % 9 = 4, substring({_TIFF}, 1, 40), {_TIFF})"
    d = t.read(spark, sf, "documents").select("doc_id", "source", "lang")
    rows = d.selectExpr("doc_id AS asset_id", f"concat('457869660000', {tiff}) AS s1", f"{_SEGMENT2} AS s2")
    return rows.selectExpr(
        "asset_id",
        "unhex(concat('FFD8', 'FFE1', lpad(hex(cast(length(s1) div 2 + 2 AS bigint)), 4, '0'), s1,"
        " 'FFED', lpad(hex(cast(length(s2) div 2 + 2 AS bigint)), 4, '0'), s2, 'FFDA0000')) AS content",
    )


@query(
    "S6",
    """
    , d AS (SELECT * FROM documents WHERE doc_id % 9 <> 4)
    SELECT doc_id AS asset_id, '0th' AS ifd, 271 AS tag, substr(rpad('Cam ' || source, 15, ' '), 1, 15) AS str_val, NULL::BIGINT AS int_val, NULL AS ratio FROM d
    UNION ALL SELECT doc_id, '0th', 274, NULL, 1 + doc_id % 8, NULL FROM d
    UNION ALL SELECT doc_id, '0th', 282, NULL, NULL, (72 + doc_id % 200) || '/2' FROM d
    UNION ALL SELECT doc_id, 'Exif', 34855, NULL, 100 + doc_id % 400, NULL FROM d
    """.replace(", d AS", "WITH d AS", 1),
)
def scan_exif_tags(spark, sf):
    first = F.get("rationals", F.lit(0))
    return tagscan.scan_exif_tags(_jpegs(spark, sf)).select(
        "asset_id", "ifd", "tag", "str_val", "int_val",
        F.concat(first["num"].cast("string"), F.lit("/"), first["den"].cast("string")).alias("ratio"),
    )


@query(
    "S7",
    """
    SELECT doc_id AS asset_id, 5 AS dataset, 0 AS ord, 'Title ' || source AS value FROM documents
    UNION ALL SELECT doc_id, 25, 1, lang FROM documents
    UNION ALL SELECT doc_id, 25, 2, 'k' || doc_id FROM documents
    """,
)
def scan_iptc_tags(spark, sf):
    return tagscan.scan_iptc_tags(_jpegs(spark, sf))


@query(
    "S6 S7 M1 M9",
    """
    SELECT doc_id AS asset_id, trim('Cam ' || source) AS make, CAST(100 + doc_id % 400 AS INTEGER) AS iso_speed,
      (72 + doc_id % 200) / 2.0::DOUBLE AS x_resolution, 'Title ' || source AS title, lang || '|k' || doc_id AS keywords
    FROM documents WHERE doc_id % 9 <> 4
    """,
)
def scanned_records(spark, sf):
    """From bytes to structured records in one read of each file."""
    found = with_records(read_records(_jpegs(spark, sf))).where("exif IS NOT NULL AND iptc IS NOT NULL")
    return found.select(
        "asset_id", "exif.make", "exif.iso_speed", "exif.x_resolution", "iptc.title",
        F.concat_ws("|", "iptc.keywords").alias("keywords"),
    )


def _be4(v: str) -> str:
    return f"lpad(hex(cast({v} AS bigint)), 8, '0')"


def _le4(v: str) -> str:
    return f"concat({_le2(v)}, {_le2(f'({v}) div 65536')})"


# Color types of PNG headers with their bit depths, and the modes they stand for.
_PNG_KINDS = "array('0803', '0804', '0802', '0806', '0800', '0100', '0403', '1004')"


def _files(spark, sf):
    """Header bytes of one file per document: PNGs of all kinds, BMPs and broken files, some names odd."""
    w, h = "(1 + doc_id % 3000)", "(1 + n_chars % 2000)"
    kind = f"element_at({_PNG_KINDS}, cast(doc_id % 8 AS int) + 1)"
    phys = f"if(doc_id % 3 = 0, concat('00000009', '70485973', {_be4('11811')}, {_be4('5906')}, '01', '00000000'), '')"
    png = f"concat('89504E470D0A1A0A0000000D49484452', {_be4(w)}, {_be4(h)}, {kind}, '000000', '00000000', {phys}, '0000000049444154')"
    bmp = f"concat('424D', '000000000000000036000000', '28000000', {_le4(w)}, {_le4(h)}, '0100', '1800', '0000000000000000', {_le4('3780')}, {_le4('0')}, '0000000000000000')"
    return t.read(spark, sf, "documents").selectExpr(
        "doc_id", "concat('file:/in/', if(doc_id % 4 = 0, 'a + b %20#', 'img'), cast(doc_id AS string), if(doc_id % 10 = 9, '.bmp', '.png')) AS path",
        f"unhex(CASE WHEN doc_id % 17 = 5 THEN '89504E47' WHEN doc_id % 10 = 9 THEN {bmp} ELSE {png} END) AS content",
        "n_chars AS size_bytes",
    )


@query(
    "S3 S4",
    """
    WITH d AS (SELECT *, doc_id % 10 = 9 AS bmp, 'file:/in/' || CASE WHEN doc_id % 4 = 0 THEN 'a + b %20#' ELSE 'img' END || doc_id ||
        CASE WHEN doc_id % 10 = 9 THEN '.bmp' ELSE '.png' END AS path FROM documents)
    SELECT path, CASE WHEN doc_id % 17 = 5 THEN 'cannot identify image file' END AS error,
      CASE WHEN doc_id % 17 <> 5 THEN CASE WHEN bmp THEN 'BMP' ELSE 'PNG' END END AS format,
      CASE WHEN doc_id % 17 <> 5 THEN CAST(1 + doc_id % 3000 AS INTEGER) END AS width,
      CASE WHEN doc_id % 17 <> 5 THEN CAST(1 + n_chars % 2000 AS INTEGER) END AS height,
      CASE WHEN doc_id % 17 <> 5 THEN CASE WHEN bmp THEN 'RGB' ELSE ['P', 'LA', 'RGB', 'RGBA', 'L', '1', 'P', 'RGBA'][doc_id % 8 + 1] END END AS mode,
      CASE WHEN doc_id % 17 <> 5 THEN CASE WHEN bmp THEN 96 WHEN doc_id % 3 = 0 THEN 300 ELSE 72 END END AS dpi_x,
      CASE WHEN doc_id % 17 <> 5 THEN CASE WHEN NOT bmp AND doc_id % 3 = 0 THEN 150 ELSE 72 END END AS dpi_y
    FROM d
    """,
)
def file_headers(spark, sf):
    """Assets and rejected files from header bytes: true modes, resolutions and odd names."""
    good, bad = images.load_assets(_files(spark, sf))
    columns = ["path", "format", "width", "height", "mode", "dpi_x", "dpi_y"]
    return good.select(*columns).unionByName(bad, allowMissingColumns=True)


# --- recipe documents ---------------------------------------------------------------------------


def _doc_sql() -> str:
    def act(name: str, params: str, on: str) -> str:
        return f"'{{\"description\":\"\",\"enabled\":' || {on} || ',\"name\":\"' || {name} || '\",\"parameters\":{{' || {params} || '}}}}'"

    acts = " || ',' || ".join(
        [
            act("'resize'", "'\"width\":\"' || (100 + c_custkey % 900) || '\"'", "'true'"),
            act("'crop'", "'\"width\":\"' || (40 + c_nationkey) || '\",\"x\":\"5\"'", "CASE WHEN c_custkey % 3 <> 0 THEN 'true' ELSE 'false' END"),
            act("'rotate'", "'\"angle\":\"90\",\"expand\":\"true\"'", "CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END"),
            act("lower(c_mktsegment)", "''", "'true'"),
        ]
    )
    return f"'{{\"actions\":[' || {acts} || '],\"metadata\":{{\"segment\":\"' || c_mktsegment || '\"}},\"name\":\"' || c_name || '\"}}'"


@query("S10", f"SELECT c_custkey, {_doc_sql()} AS document FROM customer")
def recipe_documents(spark, sf):
    return recipes.to_document(recipe_rows(spark, sf)).select("c_custkey", "document")


def _texts(spark, sf):
    """Documents of which some are cut off, nameless, or hold a badly named action."""
    docs = recipes.to_document(recipe_rows(spark, sf)).select("c_custkey", "document")
    return docs.selectExpr(
        "c_custkey",
        "CASE c_custkey % 5 WHEN 1 THEN left(document, length(document) - 3)"
        " WHEN 2 THEN regexp_replace(document, '\"name\":\"Customer[^\"]*\"', '\"name\":\"\"')"
        " WHEN 3 THEN replace(document, '\"name\":\"crop\"', '\"name\":\"cr op\"') ELSE document END AS document",
    )


@query(
    "S8 S9",
    """
    SELECT c_custkey, c_custkey % 5 IN (0, 4) AS valid, CASE c_custkey % 5 WHEN 1 THEN 'Error loading: not a valid document'
      WHEN 2 THEN 'Pipeline name cannot be empty' WHEN 3 THEN 'Action name must be alphanumeric with underscores' END AS error
    FROM customer
    """,
)
def validate_recipes(spark, sf):
    rows = recipes.recipes_from_text(_texts(spark, sf), "document")
    return rows.select("c_custkey", F.col("error").isNull().alias("valid"), "error")


@query(
    "S8",
    """
    SELECT c_custkey, c_name AS name, i AS pos, ['resize', 'crop', 'rotate', lower(c_mktsegment)][i + 1] AS action,
      [CAST(100 + c_custkey % 900 AS VARCHAR), CAST(40 + c_nationkey AS VARCHAR)][i + 1] AS width
    FROM customer, range(4) t(i) WHERE c_custkey % 5 IN (0, 4)
    """,
)
def read_recipes(spark, sf):
    rows = recipes.recipes_from_text(_texts(spark, sf), "document").where("error IS NULL")
    return rows.select("c_custkey", "name", F.posexplode("actions").alias("pos", "a")).select(
        "c_custkey", "name", F.col("pos").cast("long").alias("pos"), F.col("a.name").alias("action"),
        F.try_element_at("a.parameters", F.lit("width")).alias("width"),
    )


@query(
    "S11",
    t.with_tables(
        "cat",
        """SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN 'PNG' WHEN path LIKE '%.%' THEN upper(regexp_extract(path, '\\.([^.]+)$', 1)) END AS format
        FROM cat""",
    ),
)
def save_formats(spark, sf):
    given = F.when(F.col("asset_id") % 4 == 0, "png")
    return t.catalog(spark, sf).select("asset_id", sinks.save_format(F.col("path"), given).alias("format"))
