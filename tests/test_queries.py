"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect
from lumaforge.workload import ORACLES, QUERIES, load_all

SF_DIR = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    verdict, _ = compare(spark, con, SF_DIR, name)
    assert verdict in ("ok", "rows-only"), verdict


@pytest.mark.parametrize("name", ["assets_from_pixels", "merge_metadata", "check_assets", "batch_summary", "failed_files"])
def test_rows_without_counterpart(spark, name):
    """At this size half of the documents have no embedding."""
    sf_dir = "/root/testdata/sf0.01"
    verdict, _ = compare(spark, connect(sf_dir), sf_dir, name)
    assert verdict == "ok", verdict


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_driver_contract(spark):
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["group_id", "leader_id", "member_id", "distance"]
