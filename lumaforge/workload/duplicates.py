"""Hashes, pairs, groups and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaforge.operators import perceptual as ph
from lumaforge.plans import exports
from lumaforge.workload import tables as t
from lumaforge.workload.registry import query

HEX = "lpad(lower(to_hex(h)), 16, '0')"


def _hashes(spark, sf):
    return ph.average_hash(t.px_dup(spark, sf))


@query("H1 H2", t.with_tables("dup", f"SELECT img_id, {HEX} AS hash FROM hashes"))
def average_hash(spark, sf):
    return _hashes(spark, sf).select("img_id", ph.hash_hex(F.col("h")).alias("hash"))


@query(
    "H2",
    t.with_tables(
        "dup",
        f"""
        SELECT img_id, txt, length(txt) = 16 AS valid, CASE WHEN length(txt) = 16 THEN txt END AS parsed
        FROM (SELECT img_id, CASE WHEN img_id % 4 = 1 THEN substr({HEX}, 2) ELSE {HEX} END AS txt FROM hashes)
        """,
    ),
)
def hash_text(spark, sf):
    hexed = ph.hash_hex(F.col("h"))
    rows = _hashes(spark, sf).select(
        "img_id", F.when(F.col("img_id") % 4 == 1, F.substring(hexed, 2, 15)).otherwise(hexed).alias("txt")
    )
    parsed = ph.parse_hash(F.col("txt"))
    return rows.select("img_id", "txt", parsed.isNotNull().alias("valid"), ph.hash_hex(parsed).alias("parsed"))


@query(
    "H3 H4",
    t.with_tables(
        "dup",
        """
        SELECT c.img_id, CAST(bit_count(xor(o.h, c.h)) AS BIGINT) AS distance,
          1.0::DOUBLE - bit_count(xor(o.h, c.h)) / 64.0::DOUBLE AS similarity
        FROM hashes c JOIN hashes o ON o.img_id = c.img_id % 1000000 WHERE c.img_id >= 1000000
        """,
    ),
)
def copy_distance(spark, sf):
    h = _hashes(spark, sf)
    originals = h.select(F.col("img_id").alias("src"), F.col("h").alias("oh"))
    copies = h.where("img_id >= 1000000").withColumn("src", F.col("img_id") % 1000000)
    return copies.join(originals, "src").select(
        "img_id",
        ph.hamming_distance(F.col("oh"), F.col("h")).cast("long").alias("distance"),
        ph.similarity(F.col("oh"), F.col("h")).alias("similarity"),
    )


@query(
    "H5",
    t.with_tables(
        "dup",
        f"""
        SELECT {HEX} AS hash, min(img_id) OVER w AS first_id, count(*) OVER w AS n, img_id AS member_id
        FROM hashes WINDOW w AS (PARTITION BY h) QUALIFY count(*) OVER w >= 2
        """,
    ),
)
def exact_duplicates(spark, sf):
    return ph.exact_duplicates(ph.cut_lineage(_hashes(spark, sf))).select(
        ph.hash_hex(F.col("h")).alias("hash"), "first_id", "n", "member_id"
    )


def _pairs_sql(threshold: int) -> str:
    return t.with_tables(
        "dup",
        f"""
        , d AS (SELECT h, min(img_id) AS o FROM hashes GROUP BY h)
        SELECT p.o AS a, q.o AS b, CAST(bit_count(xor(p.h, q.h)) AS BIGINT) AS distance
        FROM d p JOIN d q ON p.o < q.o AND bit_count(xor(p.h, q.h)) <= {threshold}
        """,
    )


def _pairs(spark, sf, threshold):
    distinct = ph.cut_lineage(ph.distinct_hashes(_hashes(spark, sf)))
    return ph.similar_pairs(distinct, threshold).select("a", "b", F.col("distance").cast("long").alias("distance"))


@query("H6", _pairs_sql(5))
def similar_pairs(spark, sf):
    return _pairs(spark, sf, 5)


@query("H6", _pairs_sql(16))
def similar_pairs_wide(spark, sf):
    """A threshold far above the default: more bands, shorter keys, the same code."""
    return _pairs(spark, sf, 16)


def _groups_sql(threshold: int, tail: str) -> str:
    """Sequential greedy grouping as a recursive scan that carries the leaders found so far."""
    return t.with_tables(
        "dup",
        f"""
        , seq AS (SELECT img_id, h, row_number() OVER (ORDER BY img_id) AS rn FROM hashes),
        scan(rn, leads, hit) AS (
          SELECT 0::BIGINT, []::STRUCT(i BIGINT, h UBIGINT)[], NULL::BIGINT
          UNION ALL
          SELECT s.rn, CASE WHEN f.hit IS NULL THEN list_append(f.leads, {{'i': s.img_id, 'h': s.h}}) ELSE f.leads END,
            coalesce(f.hit, s.img_id)
          FROM (SELECT scan.rn AS prev, scan.leads,
                  list_filter(scan.leads, lambda l: bit_count(xor(l.h, n.h)) <= {threshold})[1].i AS hit
                FROM scan JOIN seq n ON n.rn = scan.rn + 1) f
          JOIN seq s ON s.rn = f.prev + 1),
        member AS (SELECT s.img_id AS member_id, s.h, scan.hit AS leader_id FROM scan JOIN seq s USING (rn)),
        grp AS (SELECT m.leader_id AS group_id, m.leader_id, m.member_id,
                  CAST(bit_count(xor(m.h, l.h)) AS BIGINT) AS distance
                FROM member m JOIN hashes l ON l.img_id = m.leader_id
                QUALIFY count(*) OVER (PARTITION BY m.leader_id) >= 2)
        {tail}
        """,
        recursive=True,
    )


def _flat(groups):
    return groups.select("group_id", "leader_id", "member_id", F.col("distance").cast("long").alias("distance"))


@query("H7", _groups_sql(5, "SELECT * FROM grp"))
def duplicate_groups(spark, sf):
    return _flat(ph.duplicate_groups(ph.cut_lineage(_hashes(spark, sf)), 5))


@query("H7", _groups_sql(22, "SELECT * FROM grp"))
def duplicate_groups_dense(spark, sf):
    """A dense pair graph, where the order of the scan decides who leads."""
    return _flat(ph.duplicate_groups(ph.cut_lineage(_hashes(spark, sf)), 22))


@query("H8", _groups_sql(5, "SELECT * FROM grp"))
def near_duplicates(spark, sf):
    return _flat(ph.near_duplicates(t.px_dup(spark, sf), 5))


_REPORT_TAIL = """
, named AS (SELECT group_id, member_id, '/photos/IMG_' || member_id || '.jpg' AS path, member_id * 1024 AS size_bytes FROM grp)
"""


def _named_groups(spark, sf):
    """Duplicate groups next to a catalog of the same images."""
    images = t.px_dup(spark, sf).where("x = 0 AND y = 0").selectExpr(
        "img_id AS asset_id", "concat('/photos/IMG_', cast(img_id AS string), '.jpg') AS path",
        "img_id * 1024 AS size_bytes",
    )
    return ph.near_duplicates(t.px_dup(spark, sf), 5), images


@query(
    "S18",
    _groups_sql(
        5,
        _REPORT_TAIL
        + """SELECT dense_rank() OVER (ORDER BY group_id) AS group_no, 'IMG_' || member_id || '.jpg' AS name,
          round_even(size_bytes / 1048576.0::DOUBLE, 1) AS size_mb, '/photos' AS parent FROM named""",
    ),
)
def report_duplicates_table(spark, sf):
    return exports.duplicates_table(*_named_groups(spark, sf))


@query(
    "S18",
    _groups_sql(
        5,
        _REPORT_TAIL
        + """SELECT '{"group":' || dense_rank() OVER (ORDER BY group_id) || ',"path":"' || path || '"}' AS line
             FROM named""",
    ),
)
def report_duplicates_json(spark, sf):
    return exports.duplicates_json(*_named_groups(spark, sf))


@query("S18", _groups_sql(5, _REPORT_TAIL + "SELECT path FROM named"))
def report_duplicates_paths(spark, sf):
    return exports.duplicates_paths(*_named_groups(spark, sf))
