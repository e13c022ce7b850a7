"""Tag decoding, metadata edits and metadata exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaforge.functions import tagvalues as tv
from lumaforge.operators import edits, metadata
from lumaforge.plans import exports
from lumaforge.schemas import EXIF_FIELDS, IPTC_FIELDS
from lumaforge.workload import tables as t
from lumaforge.workload.catalog import assets
from lumaforge.workload.registry import query

# Record fields as flat SQL columns, so that whole records can be compared.
SQL_EXIF_KNOWN = {
    "make", "model", "lens_model", "exposure_time", "f_number", "aperture", "iso_speed", "focal_length", "flash",
    "orientation", "x_resolution", "datetime_original", "datetime", "color_space", "white_balance", "gps_latitude",
    "gps_longitude", "gps_altitude", "gps_timestamp", "creator", "copyright", "software",
}
SQL_IPTC_KNOWN = {
    "title", "description", "caption", "keywords", "category", "byline", "copyright_notice", "location", "city",
    "state", "country", "date_created", "instructions",
}
_TYPES = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER"}


def _exif_select(prefix: str = "", alias: str = "") -> str:
    return ", ".join(
        (f"{prefix}{n}" if n in SQL_EXIF_KNOWN else f"CAST(NULL AS {_TYPES[k]})") + f" AS {alias}{n}"
        for n, k in EXIF_FIELDS.items()
    )


@query("M1", t.with_tables("exif", f"SELECT asset_id, {_exif_select()} FROM exif"))
def exif_struct(spark, sf):
    return metadata.exif_records(t.exif_tags(spark, sf)).select("asset_id", "exif.*")


@query(
    "M2 M3",
    t.with_tables(
        "exif",
        """
        , gps AS (SELECT * FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 = 0),
        r AS (SELECT asset_id, 33434 AS tag, 0 AS place, exp_num AS num, exp_den AS den FROM exif
          UNION ALL SELECT asset_id, 33437, 0, fn_num, fn_den FROM exif
          UNION ALL SELECT asset_id, 37386, 0, fl_num, 1 FROM exif WHERE fl_num IS NOT NULL
          UNION ALL SELECT doc_id, 282, 0, 72 + doc_id % 3, 1 FROM documents WHERE doc_id % 4 <> 0
          UNION ALL SELECT doc_id, 2, i, [doc_id % 90, doc_id % 60, doc_id % 3600][i + 1], [1, 1, 60][i + 1] FROM gps, range(3) a(i)
          UNION ALL SELECT doc_id, 4, i, [doc_id % 180, doc_id % 59, doc_id % 1800][i + 1], [1, 1, 30][i + 1] FROM gps, range(3) a(i)
          UNION ALL SELECT doc_id, 6, 0, doc_id % 9000, 4 FROM gps
          UNION ALL SELECT doc_id, 7, i, [doc_id % 24, doc_id % 60, doc_id % 600][i + 1], [1, 1, 10][i + 1] FROM gps, range(3) a(i))
        SELECT asset_id, tag, place::BIGINT AS place, CASE WHEN den <> 0 THEN num / den::DOUBLE END AS value,
          CASE WHEN den = 1 THEN CAST(num AS VARCHAR) ELSE num || '/' || den END AS txt FROM r
        """,
    ),
)
def rationals(spark, sf):
    """Every quotient of every rational tag."""
    r = t.exif_tags(spark, sf).select("asset_id", "tag", F.posexplode("rationals").alias("place", "q")).select(
        "asset_id", "tag", F.col("place").cast("long").alias("place"), "q.num", "q.den"
    )
    num, den = F.col("num"), F.col("den")
    return r.select(
        "asset_id", "tag", "place", tv.rational_to_float(num, den).alias("value"), tv.rational_to_string(num, den).alias("txt")
    )


@query("M4", t.with_tables("exif", "SELECT asset_id, flash, white_balance, color_space FROM exif"))
def tag_labels(spark, sf):
    codes = t.exif_tags(spark, sf).groupBy("asset_id").pivot("tag", [37385, 41987, 40961]).agg(F.max("int_val"))
    return codes.select(
        "asset_id",
        tv.flash_label(F.col("37385")).alias("flash"),
        tv.white_balance_label(F.col("41987")).alias("white_balance"),
        tv.color_space_label(F.col("40961")).alias("color_space"),
    )


@query(
    "M5 M6 M7",
    t.with_tables(
        "exif", "SELECT asset_id, gps_latitude, gps_longitude, gps_altitude, gps_timestamp FROM exif WHERE gps_latitude IS NOT NULL"
    ),
)
def gps_fields(spark, sf):
    gps = t.exif_tags(spark, sf).where("ifd = 'GPS'")

    def pick(no: int, value: str):
        return F.max(F.when(F.col("tag") == no, F.col(value)))

    g = gps.groupBy("asset_id").agg(
        pick(1, "str_val").alias("lat_ref"), pick(2, "rationals").alias("lat"), pick(3, "str_val").alias("lon_ref"),
        pick(4, "rationals").alias("lon"), pick(5, "int_val").alias("alt_ref"), pick(6, "rationals").alias("alt"),
        pick(7, "rationals").alias("clock"), pick(29, "str_val").alias("day"),
    )
    return g.select(
        "asset_id",
        tv.gps_decimal(F.col("lat"), F.col("lat_ref")).alias("gps_latitude"),
        tv.gps_decimal(F.col("lon"), F.col("lon_ref")).alias("gps_longitude"),
        tv.gps_altitude(F.col("alt")[0]["num"], F.col("alt")[0]["den"], F.col("alt_ref")).alias("gps_altitude"),
        tv.gps_timestamp(F.col("clock"), F.col("day")).alias("gps_timestamp"),
    )


@query(
    "M8",
    """
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lower(hex(encode(text))) || 'fe00' ELSE text END AS cleaned,
      CASE WHEN regexp_matches(text, '[\\x20-\\x7E]') THEN text END AS printable
    FROM documents
    """,
)
def clean_tag_values(spark, sf):
    raw = "concat(cast(text AS binary), if(doc_id % 4 = 0, X'FE00', X'0000'))"
    d = t.read(spark, sf, "documents").select("doc_id", "text", F.expr(raw).alias("raw"))
    return d.select(
        "doc_id", tv.clean_tag_value(F.col("raw")).alias("cleaned"), tv.printable_text(F.col("text")).alias("printable")
    )


@query(
    "M9",
    t.with_tables(
        "iptc",
        """SELECT asset_id, title, description, caption, array_to_string(keywords, '|') AS keywords, category, byline,
          copyright_notice, location, city, state, country, date_created, instructions FROM iptc""",
    ),
)
def iptc_struct(spark, sf):
    r = metadata.iptc_records(t.iptc_tags(spark, sf))
    return r.select(
        "asset_id",
        *[
            (F.concat_ws("|", f"iptc.{n}") if n == "keywords" else F.col(f"iptc.{n}")).alias(n)
            for n in IPTC_FIELDS
            if n in SQL_IPTC_KNOWN
        ],
    )


@query("M10", "SELECT event_id, strftime(ts, '%Y:%m:%d %H:%M:%S') AS stamp FROM events")
def exif_datetime(spark, sf):
    return t.read(spark, sf, "events").select("event_id", tv.exif_datetime(F.col("ts")).alias("stamp"))


@query(
    "M11",
    """
    SELECT event_id, 'DPI' AS name, CAST(event_id % 300 AS VARCHAR) AS value FROM events
    UNION ALL SELECT event_id, 'Quality', event_type FROM events
    UNION ALL SELECT event_id, 'Optimize', 'true' FROM events WHERE event_id % 2 = 0
    """,
)
def source_info(spark, sf):
    info = t.read(spark, sf, "events").selectExpr(
        "event_id",
        "map_concat(map('dpi', cast(event_id % 300 AS string), 'quality', event_type, 'icc', props),"
        " if(event_id % 2 = 0, map('optimize', 'true'), cast(map() AS map<string,string>))) AS info",
    )
    return info.select("event_id", F.explode(tv.source_info(F.col("info"))).alias("name", "value"))


# --- edits --------------------------------------------------------------------------------------

_EDITS = """
ed AS (SELECT doc_id AS asset_id, CASE WHEN doc_id % 2 = 0 THEN 'New ' || doc_id ELSE '' END AS title,
  'Maker ' || quality AS creator, CASE WHEN toxic = 1 THEN 'reserved' END AS copyright,
  ' a, ,b' || quality || ',' AS keywords, 'Town' AS city FROM labels)
"""


def _edits(spark, sf):
    return t.read(spark, sf, "labels").selectExpr(
        "doc_id AS asset_id", "if(doc_id % 2 = 0, concat('New ', cast(doc_id AS string)), '') AS title",
        "concat('Maker ', cast(quality AS string)) AS creator", "if(toxic = 1, 'reserved', NULL) AS copyright",
        "concat(' a, ,b', cast(quality AS string), ',') AS keywords", "'Town' AS city",
    )


def _write_sql(overwrite: bool) -> str:
    def put(old: str, new: str) -> str:
        new, old_v = f"nullif({new}, '')", f"nullif({old}, '')"
        return f"coalesce({new}, {old})" if overwrite else f"coalesce({old_v}, {new}, {old})"

    words = "CASE WHEN ed.asset_id IS NOT NULL{} THEN 'a|b' || substr(ed.creator, 7) ELSE array_to_string(iptc.keywords, '|') END"
    words = words.format("" if overwrite else " AND iptc.keywords IS NULL")
    return t.with_tables(
        "cat exif iptc",
        f"""
        , {_EDITS}
        SELECT cat.asset_id, {put('exif.creator', 'ed.creator')} AS exif_creator,
          {put('exif.copyright', 'ed.copyright')} AS exif_copyright, exif.make,
          {put('iptc.title', 'ed.title')} AS title, {put('iptc.byline', 'ed.creator')} AS byline,
          {put('iptc.copyright_notice', 'ed.copyright')} AS copyright_notice,
          {put('iptc.city', 'ed.city')} AS city, coalesce({words}, '') AS keywords, iptc.description
        FROM cat LEFT JOIN exif USING (asset_id) LEFT JOIN iptc USING (asset_id) LEFT JOIN ed USING (asset_id)
        """,
    )


def _written(df):
    return df.select(
        "asset_id", F.col("exif.creator").alias("exif_creator"), F.col("exif.copyright").alias("exif_copyright"),
        "exif.make", "iptc.title", "iptc.byline", "iptc.copyright_notice", "iptc.city",
        F.concat_ws("|", "iptc.keywords").alias("keywords"), "iptc.description",
    )


@query("E1", _write_sql(True))
def write_metadata(spark, sf):
    return _written(edits.write_metadata(assets(spark, sf), _edits(spark, sf)))


@query("E1", _write_sql(False))
def write_metadata_fill(spark, sf):
    return _written(edits.write_metadata(assets(spark, sf), _edits(spark, sf), overwrite=False))


_SHOWN = ["make", "creator", "copyright", "gps_latitude", "gps_timestamp"]
_SHOWN_IPTC = ["title", "byline", "copyright_notice", "city", "state"]


def _remove_sql(exif_null: set[str], iptc_null: set[str]) -> str:
    def gone(kind: str) -> str:
        return f"CAST(NULL AS {_TYPES[kind]})"

    cols = [f"{gone(EXIF_FIELDS[n]) if n in exif_null else 'exif.' + n} AS {n}" for n in _SHOWN]
    cols += [f"{gone(IPTC_FIELDS[n]) if n in iptc_null else 'iptc.' + n} AS iptc_{n}" for n in _SHOWN_IPTC]
    return t.with_tables(
        "cat exif iptc",
        f"SELECT cat.asset_id, dpi_x, {', '.join(cols)} FROM cat LEFT JOIN exif USING (asset_id) LEFT JOIN iptc USING (asset_id)",
    )


def _removed(spark, sf, kind):
    out = edits.remove_metadata(assets(spark, sf), kind)
    return out.select(
        "asset_id", "dpi_x", *[F.col(f"exif.{n}").alias(n) for n in _SHOWN],
        *[F.col(f"iptc.{n}").alias(f"iptc_{n}") for n in _SHOWN_IPTC],
    )


@query("E2", _remove_sql(set(_SHOWN), set(_SHOWN_IPTC)))
def remove_all(spark, sf):
    return _removed(spark, sf, "all")


@query("E2", _remove_sql(set(_SHOWN), set()))
def remove_exif(spark, sf):
    return _removed(spark, sf, "exif")


@query("E2", _remove_sql(set(), set(_SHOWN_IPTC)))
def remove_iptc(spark, sf):
    return _removed(spark, sf, "iptc")


@query("E2", _remove_sql({"gps_latitude", "gps_timestamp"}, set()))
def remove_gps(spark, sf):
    return _removed(spark, sf, "gps")


@query("E2", _remove_sql({"creator", "copyright", "gps_latitude"}, {"byline", "copyright_notice", "city", "state"}))
def remove_personal(spark, sf):
    return _removed(spark, sf, "personal")


_COPY_SHOWN = ["make", "model", "lens_model", "f_number", "iso_speed", "creator", "gps_latitude", "gps_timestamp"]
_COPY_IPTC = ["title", "city", "location", "state", "byline"]


def _copy_sql(exif_from: dict[str, str], iptc_from: dict[str, str]) -> str:
    cols = []
    for n in _COPY_SHOWN:
        rule = exif_from.get(n, "t")
        cols.append(f"CASE WHEN s.asset_id IS NULL THEN te.{n} ELSE {rule.format(t='te.' + n, s='se.' + n)} END AS {n}")
    for n in _COPY_IPTC:
        rule = iptc_from.get(n, "t")
        cols.append(f"CASE WHEN s.asset_id IS NULL THEN ti.{n} ELSE {rule.format(t='ti.' + n, s='si.' + n)} END AS iptc_{n}")
    return t.with_tables(
        "cat exif iptc",
        f"""
        , req AS (SELECT a.doc_id AS asset_id, CASE WHEN a.doc_id % 9 = 0 THEN '/gone/' || a.doc_id || '.jpg' ELSE c.path END AS source_path
          FROM labels a JOIN cat c ON c.asset_id = CASE WHEN a.doc_id % 3 = 0 THEN 1 ELSE a.doc_id // 2 END)
        SELECT r.asset_id, r.source_path, CASE WHEN s.asset_id IS NULL THEN 'Source image not found: ' || r.source_path END AS error,
          {', '.join(cols)}
        FROM req r JOIN cat tc ON tc.asset_id = r.asset_id LEFT JOIN exif te ON te.asset_id = r.asset_id
          LEFT JOIN iptc ti ON ti.asset_id = r.asset_id LEFT JOIN cat s ON s.path = r.source_path
          LEFT JOIN exif se ON se.asset_id = s.asset_id LEFT JOIN iptc si ON si.asset_id = s.asset_id
        """,
    )


def _copied(spark, sf, kind, overwrite=True):
    paths = t.catalog(spark, sf).select(F.col("asset_id").alias("src"), "path")
    requests = (
        t.read(spark, sf, "labels")
        .selectExpr("doc_id AS asset_id", "if(doc_id % 3 = 0, 1, doc_id div 2) AS src")
        .join(paths, "src")
        .selectExpr(
            "asset_id", "if(asset_id % 9 = 0, concat('/gone/', cast(asset_id AS string), '.jpg'), path) AS source_path"
        )
    )
    out = edits.copy_metadata(assets(spark, sf), requests, kind, overwrite)
    return out.select(
        "asset_id", "source_path", "error", *[F.col(f"exif.{n}").alias(n) for n in _COPY_SHOWN],
        *[F.col(f"iptc.{n}").alias(f"iptc_{n}") for n in _COPY_IPTC],
    )


_SRC, _KEEP, _FILL = "{s}", "{t}", "coalesce({t}, {s})"
_ALL_E, _ALL_I = dict.fromkeys(_COPY_SHOWN, _SRC), dict.fromkeys(_COPY_IPTC, _SRC)
_KEEP_E, _KEEP_I = dict.fromkeys(_COPY_SHOWN, _KEEP), dict.fromkeys(_COPY_IPTC, _KEEP)
_CAMERA = ["make", "model", "lens_model", "f_number", "iso_speed"]


@query("E3", _copy_sql(_ALL_E, _ALL_I))
def copy_all(spark, sf):
    return _copied(spark, sf, "all")


@query("E3", _copy_sql(_ALL_E, _KEEP_I))
def copy_exif(spark, sf):
    return _copied(spark, sf, "exif")


@query("E3", _copy_sql(_KEEP_E, _ALL_I))
def copy_iptc(spark, sf):
    return _copied(spark, sf, "iptc")


@query("E3", _copy_sql(_KEEP_E | dict.fromkeys(_CAMERA, _SRC), _KEEP_I))
def copy_camera(spark, sf):
    return _copied(spark, sf, "camera")


@query("E3", _copy_sql(_KEEP_E | dict.fromkeys(_CAMERA, _FILL), _KEEP_I))
def copy_camera_fill(spark, sf):
    return _copied(spark, sf, "camera", overwrite=False)


@query(
    "E3",
    _copy_sql(
        _KEEP_E | dict.fromkeys(["gps_latitude", "gps_timestamp"], _SRC),
        _KEEP_I | dict.fromkeys(["city", "location", "state"], _SRC),
    ),
)
def copy_location(spark, sf):
    return _copied(spark, sf, "location")


def _long_sql(pos: bool) -> str:
    """Present record fields as rows, with their text."""
    sections = []
    for section, fields in (("exif", EXIF_FIELDS), ("iptc", IPTC_FIELDS)):
        known = SQL_EXIF_KNOWN if section == "exif" else SQL_IPTC_KNOWN
        for i, n in enumerate(fields):
            if n in known:
                value = "'[' || array_to_string(keywords, ', ') || ']'" if n == "keywords" else f"CAST({n} AS VARCHAR)"
                sections.append(f"SELECT asset_id, '{section}' AS section, {i} AS pos, '{n}' AS field, {value} AS value FROM {section}")
    return ", long AS (SELECT * FROM (" + " UNION ALL ".join(sections) + ") WHERE value IS NOT NULL)"


@query("E4", t.with_tables("exif iptc", _long_sql(True) + " SELECT asset_id, section, field, value FROM long"))
def inspect_fields(spark, sf):
    return edits.inspect_fields(assets(spark, sf)).select("asset_id", "section", "field", "value")


@query("E4", t.with_tables("exif iptc", _long_sql(True) + " SELECT asset_id, field, value FROM long WHERE section = 'iptc'"))
def inspect_iptc_only(spark, sf):
    return edits.inspect_fields(assets(spark, sf), ("iptc",)).select("asset_id", "field", "value")


@query(
    "E5",
    t.with_tables(
        "cat exif iptc",
        """
        SELECT cat.asset_id, make || ' ' || model AS camera, lens_model AS lens, focal_length, f_number AS aperture,
          exposure_time AS shutter_speed, CAST(iso_speed AS VARCHAR) AS iso, CAST(NULL AS VARCHAR) AS dimensions,
          CASE WHEN gps_latitude <> 0 AND gps_longitude <> 0 THEN
            printf('%.6f', round_even(gps_latitude, 6)) || ', ' || printf('%.6f', round_even(gps_longitude, 6)) END AS gps,
          CASE WHEN gps_altitude <> 0 THEN printf('%.1f', round_even(gps_altitude, 1)) || 'm' END AS gps_altitude,
          title, description AS caption, array_to_string(keywords, ', ') AS keywords, byline AS photographer,
          CASE WHEN title IS NOT NULL THEN concat_ws(', ', location, city, state, country) END AS location, date_created,
          CAST(NULL AS VARCHAR) AS urgency, instructions
        FROM cat LEFT JOIN exif USING (asset_id) LEFT JOIN iptc USING (asset_id)
        """,
    ),
)
def display_fields(spark, sf):
    return edits.display_fields(assets(spark, sf))


# --- exports ------------------------------------------------------------------------------------


def _json_object(section: str, fields: dict[str, str], known: set[str]) -> str:
    """JSON text of one record with its fields in declared order and nulls left out."""
    parts = []
    for n, kind in fields.items():
        if n not in known:
            continue
        if n == "keywords":
            value = "'[' || array_to_string(list_transform(iptc.keywords, lambda w: '\"' || w || '\"'), ',') || ']'"
        elif kind == "string":
            value = f"'\"' || replace({section}.{n}, '/', '/') || '\"'"
        else:
            value = f"CAST({section}.{n} AS VARCHAR)"
        parts.append(f"'\"{n}\":' || {value}")
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


@query(
    "S14",
    t.with_tables(
        "cat exif iptc",
        f"""
        SELECT cat.asset_id, '{{"image_path":"' || path || '","exif":' || {_json_object('exif', EXIF_FIELDS, SQL_EXIF_KNOWN)}
          || ',"iptc":' || {_json_object('iptc', IPTC_FIELDS, SQL_IPTC_KNOWN)} || '}}' AS line
        FROM cat LEFT JOIN exif USING (asset_id) LEFT JOIN iptc USING (asset_id)
        """,
    ),
)
def export_json(spark, sf):
    return exports.metadata_json(assets(spark, sf))


@query(
    "S15",
    t.with_tables(
        "cat exif iptc",
        "SELECT cat.asset_id, path AS image_path, "
        + ", ".join(
            (f"CAST(exif.{n} AS VARCHAR)" if n in SQL_EXIF_KNOWN else "CAST(NULL AS VARCHAR)") + f" AS exif_{n}" for n in EXIF_FIELDS
        )
        + ", "
        + ", ".join(
            ("'[' || array_to_string(iptc.keywords, ', ') || ']'" if n == "keywords"
             else f"CAST(iptc.{n} AS VARCHAR)" if n in SQL_IPTC_KNOWN else "CAST(NULL AS VARCHAR)") + f" AS iptc_{n}"
            for n in IPTC_FIELDS
        )
        + " FROM cat LEFT JOIN exif USING (asset_id) LEFT JOIN iptc USING (asset_id)",
    ),
)
def export_csv(spark, sf):
    return exports.metadata_columns(assets(spark, sf))


def _lines(section: str, order: str, indent: str) -> str:
    return (
        f"(SELECT string_agg('{indent}' || field || ': ' || value || chr(10), '' ORDER BY {order}) FROM long"
        f" WHERE long.asset_id = cat.asset_id AND section = '{section}')"
    )


@query(
    "S16",
    t.with_tables(
        "cat exif iptc",
        _long_sql(True)
        + f"""
        SELECT asset_id, 'Metadata for: ' || path || chr(10) || repeat('=', 50) || chr(10) || chr(10)
          || 'EXIF Data:' || chr(10) || repeat('-', 20) || chr(10) || coalesce({_lines('exif', 'pos', '')}, '')
          || chr(10) || 'IPTC Data:' || chr(10) || repeat('-', 20) || chr(10) || coalesce({_lines('iptc', 'pos', '')}, '')
          AS document FROM cat
        """,
    ),
)
def export_text(spark, sf):
    return exports.metadata_text(assets(spark, sf))


@query(
    "S17",
    t.with_tables(
        "cat exif iptc",
        _long_sql(True)
        + f"""
        SELECT asset_id, coalesce('exif:' || chr(10) || {_lines('exif', 'field', '  ')}, 'exif: {{}}' || chr(10))
          || 'image_path: ' || path || chr(10)
          || coalesce('iptc:' || chr(10) || {_lines('iptc', 'field', '  ')}, 'iptc: {{}}' || chr(10)) AS document FROM cat
        """,
    ),
)
def export_yaml(spark, sf):
    return exports.metadata_yaml(assets(spark, sf))
