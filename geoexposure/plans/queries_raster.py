"""Queries of cell-wise raster operators, zonal statistics included."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoexposure.operators import outage, raster, scenes, zonal
from geoexposure.plans.fixtures import Tables
from geoexposure.plans.queries_sources import zone_polygons
from geoexposure.plans.registry import query

W = "(least(z.xmax,p.col+1)-greatest(z.xmin,p.col))*(least(z.ymax,p.row+1)-greatest(z.ymin,p.row))"
MET = f"SELECT z.zone_id, p.*, {W} AS w FROM zones z JOIN px p ON p.col < z.xmax AND p.col+1 > z.xmin AND p.row < z.ymax AND p.row+1 > z.ymin"


def weights(t: Tables):
    return zonal.zone_runs(zone_polygons(t).select("zone_id", "geom"), t.nrows, 100)


def _integer(c: str):
    return F.round(F.col(c) * 16).cast("long").alias(c)


@query("agg1_zonal_stats", f"""
SELECT zone_id, name, CAST(round(sum(value*w)*16) AS BIGINT) AS total, round(sum(value*w)/sum(w), 3) AS mean, min(value) AS low, max(value) AS high, round(sum(w), 6) AS cells,
  CAST(round(sum(CASE WHEN mask=1 THEN value*w ELSE 0 END)*16) AS BIGINT) AS affected, round(sum(CASE WHEN mask=1 THEN value*w ELSE 0 END)/sum(value*w)*100, 6) AS pct
FROM ({MET}) q JOIN zones USING (zone_id) GROUP BY 1, 2""")
def agg1(t: Tables):
    on = F.col("mask") == 1
    wanted = {"total": ("sum", "value", None), "mean": ("mean", "value", None), "low": ("min", "value", None), "high": ("max", "value", None), "cells": ("count", "value", None), "affected": ("sum", "value", on)}
    stats = zonal.zonal_stats(t.px.select("row", "col", "value", "mask"), weights(t), wanted).withColumn("pct", zonal.affected_pct(F.col("affected"), F.col("total")))
    out = zonal.attach_stats(t.zones.select("zone_id", "name"), stats)
    return out.select("zone_id", "name", _integer("total"), F.round("mean", 3).alias("mean"), "low", "high", F.round("cells", 6).alias("cells"), _integer("affected"), F.round("pct", 6).alias("pct"))


@query("jn2_zone_cell_weights", f"SELECT zone_id, row, col, round(w, 9) AS w FROM ({MET}) q")
def jn2(t: Tables):
    found = zonal.zone_cell_weights(zone_polygons(t).select("zone_id", "geom"), t.nrows, 100)
    return found.select("zone_id", "row", "col", F.round("w", 9).alias("w"))


@query("agg7_affected_pct", f"SELECT zone_id, round(CASE WHEN sum(mask*w) = 0 THEN NULL ELSE sum(CASE WHEN mask = 1 AND cls = 2 THEN w ELSE 0 END)/sum(mask*w)*100 END, 6) AS pct FROM ({MET}) q GROUP BY 1")
def agg7(t: Tables):
    on = F.col("mask") == 1
    stats = zonal.zonal_stats(t.px.select("row", "col", "mask", "cls"), weights(t), {"part": ("count", "cls", on & (F.col("cls") == 2)), "whole": ("count", "cls", on)})
    return stats.select("zone_id", F.round(zonal.affected_pct(F.col("part"), F.col("whole")), 6).alias("pct"))


@query("agg12_class_area", f"SELECT zone_id, cls, round(sum(w)*100, 6) AS area FROM ({MET}) q GROUP BY 1, 2")
def agg12(t: Tables):
    return zonal.class_area(t.px.select("row", "col", "cls"), weights(t), 100.0).withColumn("area", F.round("area", 6))


@query("jn11_attach_stats", "SELECT zone_id, name, n FROM zones LEFT JOIN (SELECT iso, count(*) AS n FROM feats WHERE iso % 3 = 0 GROUP BY 1) s ON zone_id = iso")
def jn11(t: Tables):
    stats = t.feats.where("iso % 3 = 0").groupBy(F.col("iso").cast("long").alias("zone_id")).agg(F.count("*").alias("n"))
    return zonal.attach_stats(t.zones.select("zone_id", "name"), stats)


@query("itr3_rasterize", "SELECT zone_id, row, col FROM zones JOIN px ON col+5e-1 >= xmin AND col+5e-1 < xmax AND row+5e-1 >= ymin AND row+5e-1 < ymax")
def itr3(t: Tables):
    return zonal.rasterize(zone_polygons(t), t.nrows, 100)


@query("prj7_apply_mask", "SELECT row, col, value FROM px WHERE mask = 1")
def prj7(t: Tables):
    return raster.apply_mask(t.px.select("row", "col", "value"), t.px.where("mask = 1").select("row", "col"))


@query("prj8_clip_with_mask", "SELECT p.row, p.col, p.value FROM px p JOIN (SELECT row, col FROM px WHERE cls = 2 AND col < 50 AND row < (SELECT count(*)/200 FROM orders)) m ON p.row//2 = m.row AND p.col//2 = m.col")
def prj8(t: Tables):
    mask = t.px.where((F.col("col") < 50) & (F.col("row") < t.nrows / 2)).select("row", "col", F.col("cls").alias("value"))
    return raster.clip_with_mask(t.px.select("row", "col", "value"), mask, 2, ratio=2)


@query("prj27_resample_nearest", "SELECT t.row, t.col, p.value FROM px t JOIN px p ON p.row = CAST(floor((t.row+5e-1)*2) AS INTEGER) AND p.col = CAST(floor((t.col+5e-1)*2) AS INTEGER)")
def prj27(t: Tables):
    return raster.resample_nearest(t.px.select("row", "col", "value"), t.nrows // 2, 50, 2.0)


@query("prj28_resample_bilinear", """
SELECT row, col, round(sum(value*w)/sum(w), 4) AS value FROM (SELECT t.row, t.col, p.value, (1-abs((t.row+5e-1)/2-5e-1-p.row))*(1-abs((t.col+5e-1)/2-5e-1-p.col)) AS w
  FROM (SELECT 2*row+i AS row, 2*col+j AS col FROM px, (SELECT range AS i FROM range(2)) a, (SELECT range AS j FROM range(2)) b) t JOIN px p ON p.row IN (CAST(floor((t.row+5e-1)/2-5e-1) AS INTEGER), CAST(floor((t.row+5e-1)/2-5e-1) AS INTEGER)+1) AND p.col IN (CAST(floor((t.col+5e-1)/2-5e-1) AS INTEGER), CAST(floor((t.col+5e-1)/2-5e-1) AS INTEGER)+1)) q WHERE w > 0 GROUP BY 1, 2""")
def prj28(t: Tables):
    return raster.resample_bilinear(t.px.select("row", "col", "value"), t.nrows * 2, 200, 0.5).withColumn("value", F.round("value", 4))


@query("prj30_mask_clouds", "SELECT row, col, cls FROM px WHERE NOT (mask = 1 AND value % 10 = 0)")
def prj30(t: Tables):
    cloudy = t.px.where("mask = 1 AND value % 10 = 0").select("row", "col")
    share = cloudy.count() * 100 / (t.nrows * 100)
    return raster.mask_clouds(t.px.select("row", "col", "cls"), cloudy) if share >= 1 else t.px.select("row", "col", "cls")


BAND2 = "SELECT CAST(floor(l_orderkey/100) AS INT) AS row, CAST(l_orderkey % 100 AS INT) AS col, CAST(sum(round(l_quantity)) AS BIGINT) AS value FROM {lineitem} GROUP BY 1, 2"


@query("jn12_align", f"SELECT row, col, p.value AS a, b.value AS b FROM px p JOIN ({BAND2.format(lineitem='lineitem')}) b USING (row, col)")
def jn12(t: Tables):
    return raster.align(t.px.select("row", "col", F.col("value").alias("a")), t.sql(BAND2).withColumnRenamed("value", "b"))


@query("agg8_raster_sum_strict", f"SELECT row, col, CAST(p.value + b.value AS BIGINT) AS value FROM px p JOIN ({BAND2.format(lineitem='lineitem')}) b USING (row, col)")
def agg8(t: Tables):
    return raster.raster_sum([t.px, t.sql(BAND2)])


@query("agg9_raster_sum_lenient", "SELECT row, col, CAST(sum(v) AS REAL) AS value FROM (SELECT row, col, value % 1000 AS v FROM px WHERE cls <= 3 UNION ALL SELECT row, col, value % 777 FROM px WHERE cls >= 3) q GROUP BY 1, 2")
def agg9(t: Tables):
    a = t.px.where("cls <= 3").withColumn("value", F.col("value") % 1000)
    return raster.raster_sum([a, t.px.where("cls >= 3").withColumn("value", F.col("value") % 777)], strict=False)


@query("agg16_interpolate_years", "SELECT row, col, round(value + (value*3 - value)*2/5e0, 4) AS value FROM px WHERE cls <> 4")
def agg16(t: Tables):
    years = [t.px.select("row", "col", F.lit(2030).alias("year"), F.col("value").cast("double").alias("value")), t.px.where("cls <> 4").select("row", "col", F.lit(2035).alias("year"), (F.col("value") * 3.0).alias("value"))]
    return raster.interpolate_years(years[0].unionByName(years[1]), 2032).withColumn("value", F.round("value", 4))


STACK = "SELECT row, col, k, CASE WHEN (value+k) % 4 = 0 THEN 255 ELSE (value*k) % 9 END AS value, (cls*k) % 5 AS cloud FROM px, (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) kk"


def _stack(t: Tables):
    rows = t.px.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    value = F.when((F.col("value") + F.col("k")) % 4 == 0, 255).otherwise(F.col("value") * F.col("k") % 9)
    return rows.select("row", "col", "k", value.alias("value"), (F.col("cls") * F.col("k") % 5).alias("cloud"))


@query("win1_mosaic_last", f"SELECT row, col, value FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY k DESC, cloud DESC) AS n FROM ({STACK}) s WHERE value <> 255) q WHERE n = 1")
def win1(t: Tables):
    return raster.mosaic_last(_stack(t), ["k", "cloud"])


@query("win2_fill_holes", f"SELECT row, col, value FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY cloud, k) AS n FROM ({STACK}) s WHERE value <> 255) q WHERE n = 1")
def win2(t: Tables):
    return raster.fill_holes(_stack(t), ["cloud", "k"])


@query("win3_first_clear_observation", f"SELECT row, col, k, value, cloud FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY k) AS n FROM ({STACK}) s WHERE cloud < 3 AND value <> 255) q WHERE n = 1")
def win3(t: Tables):
    return raster.first_clear_observation(_stack(t), ["k"], F.expr("cloud < 3 AND value <> 255")).select("row", "col", "k", "value", "cloud")


@query("agg11_cloud_pct", "SELECT cls AS granule, CASE WHEN count(CASE WHEN c < 2 THEN 1 END) = 0 THEN NULL ELSE CAST(floor(count(CASE WHEN c = 1 THEN 1 END)*100e0/count(CASE WHEN c < 2 THEN 1 END)) AS INTEGER) END AS cloud_pct FROM (SELECT cls, value % 4 + CASE WHEN cls = 5 THEN 5 ELSE 0 END AS c FROM px) q GROUP BY 1")
def agg11(t: Tables):
    return outage.cloud_pct(t.px.select(F.col("cls").alias("granule"), (F.col("value") % 4 + F.when(F.col("cls") == 5, 5).otherwise(0)).alias("cloud")))


@query("agg19_scene_scalar_stats", "SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median FROM (SELECT ln(1+value) AS v FROM px WHERE mask = 1) q")
def agg19(t: Tables):
    cells = t.px.select((F.col("mask") == 1).alias("valid"), F.log1p("value").alias("v"))
    median = outage.scene_scalar(cells, F.col("v"), "median")
    return cells.where("valid").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.lit(median), 6).alias("median"))


@query("agg20_invalid_share_gate", "SELECT cls AS granule, round(avg(CASE WHEN mask = 1 OR cls > 3 THEN 1e0 ELSE 0e0 END)*100) < 95 AS use_mask, round(avg(CASE WHEN value % 100 < 97 THEN 1e0 ELSE 0e0 END)*100) < 97 AS keep FROM px GROUP BY 1")
def agg20(t: Tables):
    return outage.invalid_share_gate(t.px.withColumnRenamed("cls", "granule"), (F.col("mask") == 1) | (F.col("granule") > 3), F.col("value") % 100 < 97)


@query("agg21_dynamic_threshold", "SELECT round(avg(l)+stddev_pop(l), 6) AS threshold FROM (SELECT (value % 2000)/1e3 - 5e-1 AS l FROM px) q WHERE l > 1e-2")
def agg21(t: Tables):
    return outage.dynamic_threshold(t.px.select((F.col("value") % 2000 / 1e3 - 0.5).alias("loss"))).withColumn("threshold", F.round("threshold", 6))


@query("geo6_coverage_pct", "SELECT round(count(CASE WHEN mask = 1 AND cls <= 2 THEN 1 END)*100e0/count(CASE WHEN cls <= 2 THEN 1 END), 6) AS coverage, round(count(CASE WHEN mask = 1 AND cls <= 2 THEN 1 END)*100e0/count(CASE WHEN mask = 1 OR cls <= 2 THEN 1 END), 6) AS similarity FROM px")
def geo6(t: Tables):
    cell = t.px.withColumn("cell", F.col("row") * 100 + F.col("col"))
    return scenes.coverage_pct(cell.where("mask = 1"), cell.where("cls <= 2")).select(F.round("coverage", 6).alias("coverage"), F.round("similarity", 6).alias("similarity"))
