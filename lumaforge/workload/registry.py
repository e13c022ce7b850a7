"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}

MODULES = ("duplicates", "catalog", "tags", "checks", "templates", "sizes", "pixels", "chains", "arrivals", "files")


def query(ids: str, sql: str | None = None):
    """Register the decorated function under its own name."""

    def wrap(fn):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        SURVEY_IDS[name] = ids
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"lumaforge.workload.{module}")
