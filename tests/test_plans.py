"""The catalog of variables, components by name, pushdown into scans."""

import pytest

from geoexposure.operators.stats import derive, formula
from geoexposure.plans import assess
from geoexposure.plans.catalog import CATALOG, Variable, in_order
from geoexposure.sources import readers


def test_catalog():
    assert {k: len(v) for k, v in CATALOG.items()} == {"population": 15, "buildings": 2, "roads": 14, "rwi": 3, "deprivation": 3, "elegrid": 2, "landuse": 2, "gdp": 4, "ntl": 3}
    names = [v.name for v in in_order(CATALOG["population"])]
    assert names.index("total") > names.index("male_total") and names.index("dependency") > names.index("child_total")
    with pytest.raises(ValueError):
        in_order([Variable("a", formula="b"), Variable("b", formula="a")])
    with pytest.raises(ValueError):
        assess.component("nope")


def test_window_and_box_reach_the_scan(spark, tmp_path):
    cells = spark.range(4000).selectExpr("cast(id div 100 as int) AS row", "cast(id % 100 as int) AS col", "id AS value")
    readers.write_cells(cells, str(tmp_path / "c"), tile=16)
    got = readers.read_cells(spark, str(tmp_path / "c"), 10, 5, 20, 9)
    assert got.count() == 5 * 11
    assert "GreaterThanOrEqual(row,5)" in got._jdf.queryExecution().toString()
    boxed = cells.selectExpr("struct(cast(col as double) AS xmin, cast(row as double) AS ymin, cast(col + 1 as double) AS xmax, cast(row + 1 as double) AS ymax) AS bbox", "'a' AS subtype")
    boxed.write.parquet(str(tmp_path / "b"))
    found = readers.bbox_filter(spark.read.parquet(str(tmp_path / "b")), 10, 5, 12, 7, subtype="a")
    assert found.count() == 4
    assert "PushedFilters" in found._jdf.queryExecution().toString() and "LessThan(bbox.xmin,12.0)" in found._jdf.queryExecution().toString()


def test_a_window_opens_few_files(spark, tmp_path):
    """A read of one part in a hundred of the grid opens three files in a hundred at most, whether or not the grid starts at zero."""
    cells = spark.range(320 * 320, numPartitions=8).selectExpr("cast(id div 320 as int) - 100 AS row", "cast(id % 320 as int) - 200 AS col", "id AS value")
    path = str(tmp_path / "c")
    readers.write_cells(cells, path, tile=8, files=800)
    assert spark.read.parquet(path).count() == 320 * 320 and len(list((tmp_path / "c").glob("*.parquet"))) == 800
    for x, y in ((-200, -100), (-140, 40), (60, 170), (-17, -3)):
        got = readers.read_cells(spark, path, x, y, x + 31.5, y + 31.5)
        assert got.count() == len({(r, c) for r in range(max(y, -100), min(y + 32, 220)) for c in range(max(x, -200), min(x + 32, 120))})
        assert len(got.inputFiles()) <= 24
    nothing = readers.read_cells(spark, path, 5000, 5000, 5001, 5001)
    assert nothing.count() == 0 and nothing.columns == ["row", "col", "value"]


def test_formulas_of_an_empty_zone_are_null(spark):
    """A zone without affected cells, and one without any people, have null ratios and end no job."""
    names = [v.source for v in CATALOG["population"] if not v.formula]
    cells = spark.createDataFrame([(0, 0, True, *[1.0] * 6), (0, 1, False, *[2.0] * 6), (0, 2, True, *[0.0] * 6)], ", ".join(["row int", "col int", "affected boolean", *[f"{n} double" for n in names]]))
    weights = spark.createDataFrame([(1, 0, 0, 1.0), (2, 0, 1, 1.0), (3, 0, 2, 1.0)], "zone_id long, row int, col int, w double")
    zones = spark.createDataFrame([(1,), (2,), (3,), (4,)], "zone_id long")
    got = {r.zone_id: r for r in assess.assess_raster("population", zones, weights, cells, True).collect()}
    assert (got[1].dependency, got[1].dependency_affected, got[1].total) == (200.0, 200.0, 6.0)
    assert (got[2].dependency, got[2].dependency_affected, got[2].total_affected) == (200.0, None, 0.0)
    assert got[3].dependency is None and got[4].total is None


def test_formulas(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0)], "a double, ab double, a_x double, ab_x double")
    r = derive(derive(df, "c", "-a + ab ** 2 * 3"), "c", "-a + ab ** 2 * 3", "_x").select("c", "c_x", formula("greatest(a, ab) / 4").alias("g"), formula("a / (ab - 2)").alias("n")).first()
    assert tuple(r) == (11.0, 72.0, 0.5, None)
    with pytest.raises(ValueError):
        formula("a if ab else 1")
