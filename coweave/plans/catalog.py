"""Name → query and name → oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, io_queries, stream_queries, tick_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for mod in _modules():
        out.update(mod.QUERIES)
    return out


def estimates() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries whose results are estimates, so that no SQL gives the same."""
    return dict(graph_queries.ESTIMATES)


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for mod in _modules():
        out.update(mod.ORACLES)
    return out


def _modules():
    return [graph_queries, tick_queries, io_queries, stream_queries]
