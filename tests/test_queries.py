"""Every registered query of the library against its oracle in DuckDB; without an oracle, that it runs."""

import math
import os

import duckdb
import pytest

from geoexposure.plans import registry
from geoexposure.plans.fixtures import TABLES

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(repr([_plain(v) for v in r]) for r in df.select(*columns).collect())
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(f"SELECT * FROM ({ORACLES[name]}) q")
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(repr([_plain(r[i]) for i in order]) for r in found.fetchall())


@pytest.mark.parametrize("name", ["agg1_zonal_stats", "jn1_point_in_polygon", "jn3_overlay_lines", "jn7_bbox_overlaps", "jn14_within_distance", "agg8_raster_sum_strict", "foc1_focal_mean", "assess_population"])
def test_plans_have_no_nested_loops(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_text_operators():
    root = os.path.dirname(registry.__file__) + "/.."
    for folder, _, files in os.walk(root):
        if "/llm" not in folder:
            assert not [f for f in files if f.endswith(".py") and "geoexposure.llm" in open(os.path.join(folder, f)).read()]
