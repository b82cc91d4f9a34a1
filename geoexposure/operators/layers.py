"""Putting layers together and comparing sets of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoexposure.functions import geometry as G


def append_layer(*parts: DataFrame) -> DataFrame:
    """The rows of all parts; a column that a part lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dedupe_ids(*searches: DataFrame, key: str = "id") -> DataFrame:
    """One row per id of the results of several searches; of rows that share an id any one."""
    return append_layer(*searches).dropDuplicates([key])


def missing_expected(expected: DataFrame, found: DataFrame, key: str = "tile") -> DataFrame:
    """The expected keys, each once, that were not found."""
    return expected.select(key).distinct().join(found.select(key), key, "left_anti")


def common_tiles(found: DataFrame, expected: DataFrame, key: str = "tile") -> DataFrame:
    """The keys, each once, that are on both sides; a null meets a null."""
    return found.select(key).intersect(expected.select(key))


def country_skip(rows: DataFrame, available: DataFrame, key: str = "iso") -> tuple[DataFrame, DataFrame]:
    """Rows of the countries that a source has, and the countries, each once, that it lacks."""
    there = available.select(key)
    return rows.join(there, key, "left_semi"), rows.select(key).distinct().join(there, key, "left_anti")


def order_by_area(zones: DataFrame) -> DataFrame:
    """Zones (zone_id, geom) with their area, the largest first, ties by zone_id."""
    return zones.withColumn("area", G.area(F.col("geom"))).orderBy(F.desc("area"), "zone_id")
