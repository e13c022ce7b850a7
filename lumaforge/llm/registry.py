"""The operators' queries, and SQL where it can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("queries",)


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return wrap


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"lumaforge.llm.{module}")
