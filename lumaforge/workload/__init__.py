"""Registered queries over the driver tables, each with its ANSI SQL counterpart."""

from lumaforge.workload.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
