"""All registered queries of the library, and their oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoexposure.plans.fixtures import Tables, oracle

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
MODULES = ("scalars", "sources", "raster", "vector", "stats", "scenes", "focal", "graph", "assess")


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name``, with the text of its oracle."""

    def register(function: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql:
            _ORACLES[name] = oracle(sql.strip())
        return function

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"geoexposure.plans.queries_{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
