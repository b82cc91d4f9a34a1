"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoexposure.functions import geometry as G
from geoexposure.operators import vector
from geoexposure.plans.fixtures import Tables
from geoexposure.plans.registry import query
from geoexposure.sources import readers as R
from geoexposure.sources.workspace import fresh_path


def zone_polygons(t: Tables):
    """The fixture's rectangles as polygons; all their attributes stay."""
    return t.zones.withColumn("geom", G.rectangle(*map(F.col, ("xmin", "ymin", "xmax", "ymax"))))


@query("src1_read_zones", "SELECT zone_id, name, xmin, ymin, xmax, ymax, (xmax-xmin)*(ymax-ymin) AS area FROM zones WHERE zone_id % 7 <> 3")
def src1(t: Tables):
    some = zone_polygons(t).withColumn("geom", F.when(F.col("zone_id") % 7 != 3, F.col("geom")))
    return R.read_zones(some).select("zone_id", "name", *[F.col(f"bbox.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], "area")


@query("src2_read_cells", "SELECT row, col, value FROM px WHERE row BETWEEN 5 AND 25 AND col BETWEEN 10 AND 40")
def src2(t: Tables):
    path = fresh_path(t.spark, "cells")
    R.write_cells(t.px.select("row", "col", "value"), path)
    return R.read_cells(t.spark, path, 10.5, 5.5, 40.5, 25.5).select("row", "col", "value")


@query("src3_read_features", "SELECT f.fid, min(zone_id) AS zone_id FROM feats f JOIN zones z ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax GROUP BY 1")
def src3(t: Tables):
    return vector.read_features(t.feats, zone_polygons(t)).select("fid", "zone_id")


def _boxed(t: Tables):
    box = F.struct(*[(F.col(c) + s * F.col("side") / 2).alias(n) for n, c, s in (("xmin", "x", -1), ("ymin", "y", -1), ("xmax", "x", 1), ("ymax", "y", 1))])
    return t.feats.select("fid", box.alias("bbox"), F.when(F.col("sex") == 1, "country").otherwise("region").alias("subtype"))


@query("src4_read_bbox_struct", "SELECT fid FROM feats WHERE x-side/2 < 60 AND x+side/2 > 20 AND y-side/2 < 30 AND y+side/2 > 10 AND sex = 1")
def src4(t: Tables):
    return R.bbox_filter(_boxed(t), 20, 10, 60, 30, subtype="country").select("fid")


@query("prj6_clip_to_bbox", """
SELECT fid, greatest(x-side/2, 20) AS xmin, greatest(y-side/2, 10) AS ymin, least(x+side/2, 60) AS xmax, least(y+side/2, 30) AS ymax FROM feats
WHERE x-side/2 < 60 AND x+side/2 > 20 AND y-side/2 < 30 AND y+side/2 > 10""")
def prj6(t: Tables):
    return R.clip_to_bbox(R.bbox_filter(_boxed(t), 20, 10, 60, 30).select("fid", "bbox.*"), 20.0, 10.0, 60.0, 30.0)


@query("src5_read_geojson", """
SELECT CAST(fid AS VARCHAR) AS id, CASE WHEN fid % 3 = 0 THEN 'Point' ELSE 'LineString' END AS type, CASE WHEN fid % 2 = 0 THEN 'hospital' ELSE 'school' END AS amenity,
  CASE WHEN fid % 3 = 0 THEN x ELSE x + 5e-1 END AS lon, CASE WHEN fid % 3 = 0 THEN y ELSE y - 25e-2 END AS lat FROM feats""")
def src5(t: Tables):
    amenity = F.when(F.col("fid") % 2 == 0, "hospital").otherwise("school")
    shape = F.when(F.col("fid") % 3 == 0, F.format_string('"Point","coordinates":[%s, %s]', F.col("x").cast("string"), F.col("y").cast("string")))
    shape = shape.otherwise(F.format_string('"LineString","coordinates":[[%s,%s],[%s,%s]]', *[c.cast("string") for c in (F.col("x"), F.col("y"), F.col("x") + 1.0, F.col("y") - 0.5)]))
    one = F.format_string('{"type":"Feature","id":"%s","properties":{"tags":{"amenity":"%s","name":"n"}},"geometry":{"type":%s}}', F.col("fid").cast("string"), amenity, shape)
    texts = t.feats.groupBy(F.floor(F.col("fid") / 1000).alias("g")).agg(F.array_join(F.collect_list(one), ",").alias("f"))
    texts = texts.select(F.format_string('{"type":"FeatureCollection","features":[%s]}', "f").alias("text"))
    return R.read_geojson(texts).select("id", "type", F.col("tags")["amenity"].alias("amenity"), "lon", "lat")


@query("src6_parse_catalog", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'VNP46A' || (event_id % 4 + 1) ELSE 'SVDNB_j01' END AS product, CAST(ts AS DATE) AS day,
  CASE WHEN event_id % 2 = 0 THEN printf('h%02dv%02d', event_id % 36, event_id % 18) END AS tile, CASE WHEN event_id % 2 = 0 THEN '002' END AS version,
  CASE WHEN event_id % 2 = 1 THEN CAST(hour(ts)*3600 + minute(ts)*60 + second(ts) AS DOUBLE) + 5e-1 END AS second_of_day FROM events""")
def src6(t: Tables):
    day = F.date_format("ts", "yyyyDDD")
    archive = F.format_string("VNP46A%d.A%s.h%02dv%02d.002.2026100000000.h5", F.col("event_id") % 4 + 1, day, F.col("event_id") % 36, F.col("event_id") % 18)
    swath = F.concat(F.lit("SVDNB_j01_s"), day, F.date_format("ts", "HHmmss"), F.lit("5_e1_c2.nc"))
    names = t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, archive).otherwise(swath).alias("name"))
    return names.select("event_id", "name").join(R.parse_catalog(names.select("name").distinct()), "name").drop("name")


@query("src7_write_stats", "SELECT zone_id, name, zone_id*1e0 AS kept, CASE WHEN zone_id % 2 = 0 THEN zone_id*2e0 END AS total FROM zones")
def src7(t: Tables):
    old = t.zones.select("zone_id", "name", F.col("zone_id").cast("double").alias("kept"), F.lit(-1.0).alias("total"))
    new = t.zones.where("zone_id % 2 = 0").select("zone_id", (F.col("zone_id") * 2.0).alias("total"))
    path = fresh_path(t.spark, "stats")
    R.write_stats(old, new, path)
    return t.spark.read.parquet(path)


@query("src8_write_bands", "SELECT row, col, 'mask' AS band, CAST(mask AS REAL) AS value FROM px UNION ALL SELECT row, col, 'value', CAST(value AS REAL) FROM px")
def src8(t: Tables):
    path = fresh_path(t.spark, "bands")
    R.write_bands(t.px, ["value", "mask"], path)
    return t.spark.read.parquet(path).select("row", "col", "band", "value")
