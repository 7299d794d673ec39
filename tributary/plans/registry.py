"""Named queries: ``name -> (spark, sf_dir) -> DataFrame`` and their oracles.

A query is registered with :func:`query`; the oracle, when one can be
written, is DuckDB SQL over the driver's raw tables, prefixed by the fixture
views it names (see :mod:`tributary.plans.oracle_views`).  Column names are
the same in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from . import (  # noqa: F401
        catalog_queries, forecast_queries, graph_queries, layout_queries,
        reach_queries, result_queries, source_queries, spatial_queries,
        stream_queries, verify_queries,
    )


def all_queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    load_all()
    return dict(ORACLES)
