"""What the optimizer makes of the operators: shuffles, pushed filters, pruned columns."""

import re

import pytest
from pyspark.sql import functions as F

from lumaforge.functions import templates as tpl
from lumaforge.operators import catalog as cat
from lumaforge.operators import neighborhood as nb
from lumaforge.operators import pointwise as pw
from lumaforge.operators.metadata import exif_records, with_metadata
from lumaforge.operators.perceptual import average_hash
from lumaforge.operators.ranking import number_within
from lumaforge.operators.registry import run_steps
from lumaforge.workload import tables as t

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def px(spark, tmp_path_factory):
    """A stored pixel table with an alpha channel."""
    path = str(tmp_path_factory.mktemp("px") / "px")
    t.px_rgb(spark, SF_DIR, alpha=True).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"\bExchange (hash|range|Round|Single)", plan(df)))


def test_pointwise_chain_is_one_stage(px):
    out = run_steps(px, [
        {"name": "brightness", "parameters": {"factor": 1.2}}, {"name": "hue", "parameters": {"shift": 20}},
        {"name": "levels", "parameters": {"shadows": 0.1}}, {"name": "sepia", "parameters": {"intensity": 0.3}},
        {"name": "transpose", "parameters": {"method": "rotate_90"}}, {"name": "watermark", "parameters": {"text": "x"}},
        {"name": "rotate", "parameters": {"angle": 12}}, {"name": "flatten_alpha"},
    ])
    assert shuffles(out) == 0 and "Python" not in plan(out)


def test_crop_reaches_the_scan(px, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(pw.crop(pw.brightness(px, 1.3), 2, 1, 5, 3))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text)[1]
    for part in ("GreaterThanOrEqual(x,2)", "LessThan(x,7)", "GreaterThanOrEqual(y,1)", "LessThan(y,4)"):
        assert part in pushed


def test_unused_channels_are_not_read(px):
    text = plan(pw.brightness(px, 2.0).select("img_id", "r"))
    assert re.search(r"ReadSchema: struct<img_id:bigint,r:int>", text)


@pytest.mark.parametrize(
    "build,count",
    [
        (lambda p: nb.resize(p, 4, 4, False, "BICUBIC"), 2),
        (lambda p: nb.resize(p, 4, 4, False, "NEAREST"), 0),
        (lambda p: nb.gaussian_blur(p, 1.0), 1),
        (lambda p: nb.gaussian_blur(p, 40.0), 1),
        (lambda p: nb.median_filter(p, 15), 1),
        (lambda p: nb.sharpen(p), 1),
        (lambda p: nb.median_filter(p), 1),
        (average_hash, 2),
    ],
)
def test_shuffles_of_neighborhood_operators(px, build, count):
    out = build(px)
    assert shuffles(out) == count
    assert "Join" not in plan(out) and "CartesianProduct" not in plan(out)


def test_contrast_joins_on_strips(px, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(pw.contrast(px, 1.5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"SortMergeJoin \[img_id#\d+L?, _strip#\d+\]", text)


def test_metadata_joins_reuse_the_aggregates_partitioning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = with_metadata(t.catalog(spark, SF_DIR), t.exif_tags(spark, SF_DIR), t.iptc_tags(spark, SF_DIR))
        assert shuffles(df) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_wanted_tags_are_aggregated(spark):
    text = plan(exif_records(t.exif_tags(spark, SF_DIR)).select("asset_id", "exif.make"))
    assert "max(" in text.lower() and text.count("partial_max(") == 1


def test_templates_are_projections(spark):
    df = t.catalog(spark, SF_DIR)
    out = tpl.render(df, "<filename>_<width*2>", cat.base_variables()).select("asset_id", "rendered")
    assert shuffles(out) == 0 and "Python" not in plan(out)
    assert "n_chars" not in re.search(r"ReadSchema: (\S+)", plan(out))[1]


def test_no_query_needs_a_cross_join(spark):
    from lumaforge.workload import QUERIES, load_all

    load_all()
    for name in ("similar_pairs", "copy_camera", "dry_run", "lineage", "watermark_text", "numbered_names"):
        text = plan(QUERIES[name](spark, SF_DIR))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_overlay_is_looked_up_not_joined(px, spark):
    for high in (1, 500):
        cells = spark.range(10 * high).selectExpr("id % 10 AS ox", "id div 10 AS oy")
        assert "Join" not in plan(nb.alpha_composite(px, cells, 10, high))


def test_numbering_shuffles_rows_once(spark):
    """What is read back after the checkpoint moves one row per range only."""
    df = spark.range(1000).selectExpr("id % 7 AS k", "id AS v")
    text = plan(number_within(df, ["k"], ["v"]))
    assert "SortMergeJoin" not in text and "rangepartitioning" not in text
