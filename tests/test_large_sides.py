"""Sides that grow when rows unfold: their plans keep them out of the driver, and their results are those of plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from geoexposure.functions import geometry as G
from geoexposure.operators import raster, zonal
from geoexposure.plans import registry

WEIGHTED = ["agg12_class_area", "agg1_zonal_stats", "agg7_affected_pct", "assess_deprivation", "assess_gdp", "assess_landuse", "assess_ntl", "assess_population", "assess_rwi"]


def bilinear(cells, nrows, ncols, step):
    """Plain version of ``resample_bilinear``."""
    out = {}
    for row in range(nrows):
        for col in range(ncols):
            y, x = (row + 0.5) * step - 0.5, (col + 0.5) * step - 0.5
            corners = [(r, c, (1 - abs(y - r)) * (1 - abs(x - c))) for r in (math.floor(y), math.floor(y) + 1) for c in (math.floor(x), math.floor(x) + 1)]
            met = [(cells[r, c], w) for r, c, w in corners if w > 0 and (r, c) in cells]
            if met:
                out[row, col] = sum(v * w for v, w in met) / sum(w for _, w in met)
    return out


@pytest.mark.parametrize("step", [0.3, 0.5, 0.75, 1.0, 1.7, 2.0, 3.0])
def test_bilinear(spark, step):
    rng = random.Random(4)
    cells = {(r, c): rng.randrange(10**6) for r in range(9) for c in range(12) if rng.random() < 0.6}
    nrows, ncols = math.ceil(10 / step), math.floor(11 / step)  # one side reaches over the source, one stops within it
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "row int, col int, value long")
    found = raster.resample_bilinear(df, nrows, ncols, step)
    assert found.columns == ["row", "col", "value"] and found.dtypes[0][1] == found.dtypes[1][1] == "int"
    got, wanted = {(r.row, r.col): r.value for r in found.collect()}, bilinear(cells, nrows, ncols, step)
    assert got.keys() == wanted.keys() and all(math.isclose(got[k], wanted[k], rel_tol=1e-9) for k in wanted)


def test_bilinear_makes_no_table_of_targets(spark):
    """Spark takes a side that it unfolds for as small as what it unfolds, so a joined table of targets went to the driver as a broadcast."""
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 3)], "row int, col int, value long")
    found = raster.resample_bilinear(cells, 2 * 10**9, 4, 0.5)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Range" not in plan
    assert sorted((r.row, r.col, r.value) for r in found.collect()) == [(r, c, v) for r in (0, 1, 2) for c, v in ((0, 1.0), (1, 1.5), (2, 2.5), (3, 3.0))]


@pytest.mark.parametrize("name", WEIGHTED)
def test_weights_are_not_broadcast(spark, sf_dir, name):
    """Weights are unfolded from a few zones and grow with the grid; Spark knows nothing of that and must be told to shuffle them."""
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+) \[row#\d+, level#\d+, block#", plan)
    joins = [j for j in joins if j.endswith("Join")]
    assert joins and set(joins) == {"SortMergeJoin"}


def test_weights_cell_by_cell_are_not_broadcast(spark):
    cells = spark.range(400).selectExpr("cast(id div 20 as int) AS row", "cast(id % 20 as int) AS col", "id AS value")
    zones = spark.createDataFrame([(1, 0.5, 0.0, 20.0, 20.0), (2, 3.0, 4.0, 5.0, 4.5)], "zone_id long, xmin double, ymin double, xmax double, ymax double")
    zones = zones.select("zone_id", G.rectangle(*map(F.col, ("xmin", "ymin", "xmax", "ymax"))).alias("geom"))
    found = zonal.zonal_stats(cells, zonal.zone_cell_weights(zones, 20, 20), {"total": ("sum", "value", None), "n": ("count", "value", None)})
    joins = re.findall(r"(\w+Join) \[row#", found._jdf.queryExecution().executedPlan().toString())
    assert set(joins) == {"SortMergeJoin"}
    got = {r.zone_id: (r.total, r.n) for r in found.collect()}
    assert got == {1: (sum(range(400)) - sum(range(0, 400, 20)) / 2, 390.0), 2: ((83 + 84) / 2, 1.0)}
