"""Exact quantiles against plain ones, with groups that are cut into bins, ties, nulls and NaN."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoexposure.operators import outage, vector
from geoexposure.operators.quantiles import exact_quantile


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_groups_of_every_kind(spark, q):
    draws = np.random.default_rng(3)
    rows = [("wide", float(x)) for x in draws.lognormal(0, 5, 1501)] + [("ties", float(x)) for x in draws.integers(0, 9, 400)] + [(None, float(x)) for x in (3, 1)] + [("one", 7.0), ("nothing", None), ("nan", float("nan")), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r.quantile for r in exact_quantile(df, ["g"], F.col("v"), q, few=40).collect()}
    groups = {g: [v for k, v in rows if k == g and v is not None and v == v] for g in {k for k, _ in rows}}
    assert got == {g: pytest.approx(np.quantile(v, q), rel=1e-12) for g, v in groups.items() if v}


def test_a_group_of_many_values(spark):
    """Two million values in one group, on either side of a gap: only distinct values near the middle are put in order."""
    df = spark.range(2_000_000, numPartitions=8).select((F.col("id") * 7919 % 2_000_003 * F.when(F.col("id") % 2 == 0, 1e-9).otherwise(1e9)).alias("v"))
    assert exact_quantile(df, [], F.col("v")).first()[0] == df.agg(F.percentile("v", 0.5)).first()[0]
    assert "percentile(" not in exact_quantile(df.limit(100), [], F.col("v"))._jdf.queryExecution().toString()


def test_medians_by_class_and_scene(spark):
    pieces = spark.createDataFrame([(1, "A", 2.0), (1, "A", 4.0), (1, "B", 9.0), (2, "B", 5.0)], "zone_id long, cls string, length double")
    zones = spark.createDataFrame([(1,), (2,), (3,)], "zone_id long")
    rows = vector.line_stats(pieces, zones, ("median", "sum"), {"a": F.col("cls") == "A", "all": F.lit(True)}).orderBy("zone_id").collect()
    assert [tuple(r) for r in rows] == [(1, 3.0, 6.0, 4.0, 15.0), (2, 0.0, 0.0, 5.0, 5.0), (3, 0.0, 0.0, 0.0, 0.0)]
    cells = spark.createDataFrame([(True, 1.0), (True, float("nan")), (True, None), (True, 4.0), (False, 9.0)], "valid boolean, v double")
    assert outage.scene_scalar(cells, F.col("v"), "median") == 2.5 and outage.scene_scalar(cells, F.col("v")) == 2.5
    assert outage.scene_scalar(cells.where("false"), F.col("v"), "median") is None
