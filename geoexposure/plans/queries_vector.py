"""Queries of geometry and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoexposure.functions import geometry as G
from geoexposure.operators import layers
from geoexposure.operators import vector as V
from geoexposure.plans.fixtures import Tables
from geoexposure.plans.queries_sources import zone_polygons
from geoexposure.plans.registry import query

IN_ZONE = "SELECT f.*, zone_id FROM feats f JOIN zones z ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax"
# Clip of a segment to a rectangle: the range of its parameter between the four sides. A segment along a side belongs to the left or lower one.
PIECES = """SELECT fid, cls, zone_id, hypot(x2-x1, y2-y1)*(hi-lo) AS length, hypot(x2-x1, y2-y1) AS whole FROM (SELECT *,
  greatest(0, CASE WHEN x2=x1 THEN 0 ELSE least((xmin-x1)/(x2-x1), (xmax-x1)/(x2-x1)) END, CASE WHEN y2=y1 THEN 0 ELSE least((ymin-y1)/(y2-y1), (ymax-y1)/(y2-y1)) END) AS lo,
  least(1, CASE WHEN x2=x1 THEN 1 ELSE greatest((xmin-x1)/(x2-x1), (xmax-x1)/(x2-x1)) END, CASE WHEN y2=y1 THEN 1 ELSE greatest((ymin-y1)/(y2-y1), (ymax-y1)/(y2-y1)) END) AS hi
  FROM lines JOIN zones ON least(x1,x2) < xmax AND greatest(x1,x2) >= xmin AND least(y1,y2) < ymax AND greatest(y1,y2) >= ymin) p WHERE hi - lo > 1e-12 AND hypot(x2-x1, y2-y1) > 0
"""


SQUARES = "SELECT fid AS zone_id, x-side/2 AS xmin, x+side/2 AS xmax, y-side/2 AS ymin, y+side/2 AS ymax FROM feats"


def segments(t: Tables):
    return t.lines.withColumn("geom", G.segment(*map(F.col, ("x1", "y1", "x2", "y2"))))


def polygons(t: Tables):
    return zone_polygons(t).select("zone_id", "geom")


@query("geo1_area", "SELECT zone_id, (xmax-xmin)*(ymax-ymin) - 1e0 AS area FROM zones")
def geo1(t: Tables):
    hole = F.array(*[G.point(F.col("xmin") + dx, F.col("ymin") + dy) for dx, dy in ((1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0))])
    return zone_polygons(t).select("zone_id", F.round(G.area(F.concat("geom", F.array(hole))), 9).alias("area"))


@query("geo2_length", "SELECT fid, round(hypot(x2-x1, y2-y1), 9) AS length FROM lines")
def geo2(t: Tables):
    return segments(t).select("fid", F.round(G.length(F.col("geom")), 9).alias("length"))


@query("geo3_centroid_bbox", "SELECT zone_id, (xmin+xmax)/2 AS x, round((ymin+ymax)/2, 6) AS y, xmin, ymax FROM zones")
def geo3(t: Tables):
    out = zone_polygons(t).select("zone_id", G.centroid(F.col("geom")).alias("c"), G.bbox(F.flatten("geom")).alias("b"))
    return out.select("zone_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), "b.xmin", "b.ymax")


@query("geo4_clip_rect", """
SELECT zone_id, row, round(sum(w), 6) AS area FROM (SELECT zone_id, p.row, (least(xmax,p.col+1)-greatest(xmin,p.col))*(least(ymax,p.row+1)-greatest(ymin,p.row)) AS w
  FROM zones JOIN px p ON p.col < xmax AND p.col+1 > xmin AND p.row < ymax AND p.row+1 > ymin) q GROUP BY 1, 2""")
def geo4(t: Tables):
    pieces = V.polygons_to_grid_pieces(polygons(t), 1.0)
    return pieces.groupBy("zone_id", F.col("cy").cast("int").alias("row")).agg(F.round(F.sum("area"), 6).alias("area"))


@query("geo5_clip_segments", f"SELECT fid, zone_id, round(length, 6) AS length FROM ({PIECES}) q")
def geo5(t: Tables):
    return V.overlay_lines(segments(t).select("fid", "geom"), polygons(t)).select("fid", "zone_id", F.round("length", 6).alias("length"))


@query("jn1_point_in_polygon", f"SELECT fid, zone_id FROM ({IN_ZONE}) q")
def jn1(t: Tables):
    return V.point_in_polygon(t.feats.select("fid", "x", "y"), polygons(t)).select("fid", "zone_id")


@query("jn3_overlay_lines", f"SELECT zone_id, cls, count(*) AS n, round(sum(length), 4) AS length FROM ({PIECES}) q GROUP BY 1, 2")
def jn3(t: Tables):
    pieces = V.overlay_lines(segments(t).select("fid", "cls", "geom"), polygons(t))
    return pieces.groupBy("zone_id", "cls").agg(F.count("*").alias("n"), F.round(F.sum("length"), 4).alias("length"))


@query("jn4_lines_intersect_zones", f"SELECT fid, zone_id, round(whole, 6) AS length FROM ({PIECES}) q")
def jn4(t: Tables):
    return V.lines_intersect_zones(segments(t).select("fid", "geom"), polygons(t)).select("fid", "zone_id", F.round("length", 6).alias("length"))


@query("jn5_clip_lines", f"SELECT fid, round(sum(length), 6) AS length FROM ({PIECES}) q WHERE zone_id % 2 = 0 GROUP BY 1")
def jn5(t: Tables):
    pieces = V.overlay_lines(segments(t).select("fid", "geom"), polygons(t).where("zone_id % 2 = 0"))
    return pieces.groupBy("fid").agg(F.round(F.sum("length"), 6).alias("length"))


@query("jn6_features_on_mask", "SELECT fid FROM feats JOIN px ON CAST(floor(y) AS INTEGER) = row AND CAST(floor(x) AS INTEGER) = col WHERE mask = 1")
def jn6(t: Tables):
    return V.features_on_mask(t.feats, t.px.where("mask = 1")).select("fid")


@query("jn7_bbox_overlaps", "SELECT fid, zone_id FROM feats JOIN zones ON x-side/2 < xmax AND x+side/2 > xmin AND y-side/2 < ymax AND y+side/2 > ymin")
def jn7(t: Tables):
    a = t.feats.selectExpr("fid", "x-side/2 AS axmin", "x+side/2 AS axmax", "y-side/2 AS aymin", "y+side/2 AS aymax")
    b = t.zones.selectExpr("zone_id", "xmin AS bxmin", "xmax AS bxmax", "ymin AS bymin", "ymax AS bymax")
    return V.bbox_overlaps(a, b).select("fid", "zone_id")


@query("jn8_exclude_disputed", f"SELECT fid AS zone_id, age FROM feats WHERE fid NOT IN (SELECT zone_id FROM ({PIECES.replace('JOIN zones', 'JOIN (' + SQUARES + ') z')}) q)")
def jn8(t: Tables):
    half = F.col("side") / 2
    square = G.rectangle(F.col("x") - half, F.col("y") - half, F.col("x") + half, F.col("y") + half)
    return V.exclude_disputed(t.feats.select(F.col("fid").alias("zone_id"), "age", square.alias("geom")), segments(t).select("fid", "geom")).select("zone_id", "age")


@query("jn9_nearest_place", """
SELECT fid, place_id, round(d, 6) AS distance FROM (SELECT fid, place_id, d, row_number() OVER (PARTITION BY fid ORDER BY d, place_id) AS n FROM (
  SELECT f.fid, zone_id AS place_id, hypot(x-(xmin+xmax)/2, y-(ymin+ymax)/2) AS d FROM feats f, zones) p) q WHERE n = 1""")
def jn9(t: Tables):
    places = t.zones.selectExpr("zone_id AS place_id", "(xmin+xmax)/2 AS px", "(ymin+ymax)/2 AS py")
    return V.nearest_place(t.feats.select("fid", "x", "y"), places, step=4.0).select("fid", "place_id", F.round("distance", 6).alias("distance"))


@query("jn10_admin_hierarchy", f"SELECT fid, 'world' AS admin0_name, 'region ' || (zone_id % 5) AS admin1_name, name AS admin2_name FROM ({IN_ZONE}) q JOIN zones USING (zone_id)")
def jn10(t: Tables):
    world = t.zones.groupBy().agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).toDF("xmin", "ymin", "xmax", "ymax")
    world = world.select(F.lit(0).alias("level"), F.lit(2).alias("osm_level"), F.lit("world").alias("name"), G.rectangle(*map(F.col, ("xmin", "ymin", "xmax", "ymax"))).alias("geom"))
    z = zone_polygons(t)
    states = z.select(F.lit(1).alias("level"), F.lit(4).alias("osm_level"), F.concat(F.lit("region "), (F.col("zone_id") % 5).cast("string")).alias("name"), "geom")
    doubles = states.withColumn("osm_level", F.lit(3 + 1)).withColumn("name", F.concat(F.lit("z"), "name")).where("osm_level = 4")
    own = z.select(F.lit(2).alias("level"), F.lit(6).alias("osm_level"), "name", "geom")
    areas = world.unionByName(states).unionByName(doubles.withColumn("osm_level", F.lit(5))).unionByName(own)
    inside = V.admin_hierarchy(t.feats, areas)
    return inside.where("admin2_name IS NOT NULL")


@query("jn13_resample_swath", """
SELECT row, col, value FROM (SELECT t.row, t.col, f.age AS value, row_number() OVER (PARTITION BY t.row, t.col ORDER BY hypot(t.col+5e-1-x, t.row+5e-1-y), f.age) AS n
  FROM px t JOIN feats f ON abs(t.col+5e-1-x) <= 15e-1 AND abs(t.row+5e-1-y) <= 15e-1 WHERE hypot(t.col+5e-1-x, t.row+5e-1-y) <= 15e-1) q WHERE n = 1""")
def jn13(t: Tables):
    targets = t.px.select("row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    return V.resample_swath(t.feats.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("age").alias("value")), targets, 1.5)


@query("jn14_within_distance", """
SELECT DISTINCT fid FROM (SELECT f.fid, x, y, x1, y1, x2-x1 AS dx, y2-y1 AS dy, CASE WHEN x1=x2 AND y1=y2 THEN 0 ELSE greatest(0, least(1, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) END AS s
  FROM feats f JOIN lines l ON x BETWEEN least(x1,x2)-1 AND greatest(x1,x2)+1 AND y BETWEEN least(y1,y2)-1 AND greatest(y1,y2)+1) q WHERE hypot(x-x1-s*dx, y-y1-s*dy) <= 7e-1""")
def jn14(t: Tables):
    return V.within_distance(t.feats, t.lines, 0.7).select("fid")


def _gap(x: str, y: str, a: str, b: str) -> str:
    """SQL of the distance of a point to the segment from (ax, ay) to (bx, by)."""
    dx, dy = f"({b}x-{a}x)", f"({b}y-{a}y)"
    s = f"CASE WHEN {dx}=0 AND {dy}=0 THEN 0 ELSE greatest(0, least(1, (({x}-{a}x)*{dx}+({y}-{a}y)*{dy})/({dx}*{dx}+{dy}*{dy}))) END"
    return f"sqrt(power({x}-{a}x-({s})*{dx}, 2)+power({y}-{a}y-({s})*{dy}, 2))"


def _turn(a: str, b: str, c: str) -> str:
    return f"sign(({b}x-{a}x)*({c}y-{a}y)-({b}y-{a}y)*({c}x-{a}x))"


@query("jn14_barrier_edges", f"""
SELECT DISTINCT u FROM (SELECT l.fid AS u, l.x1 AS mx, l.y1 AS my, l.x2 AS nx, l.y2 AS ny, w.x1 AS px, w.y1 AS py, w.x2 AS qx, w.y2 AS qy FROM lines l JOIN lines w ON l.cls NOT LIKE 'PROMO%' AND w.cls LIKE 'PROMO%'
  AND least(l.x1,l.x2) <= greatest(w.x1,w.x2)+1 AND greatest(l.x1,l.x2) >= least(w.x1,w.x2)-1 AND least(l.y1,l.y2) <= greatest(w.y1,w.y2)+1 AND greatest(l.y1,l.y2) >= least(w.y1,w.y2)-1) q
WHERE ({_turn('m', 'n', 'p')}*{_turn('m', 'n', 'q')} < 0 AND {_turn('p', 'q', 'm')}*{_turn('p', 'q', 'n')} < 0)
  OR least({_gap('mx', 'my', 'p', 'q')}, {_gap('nx', 'ny', 'p', 'q')}, {_gap('px', 'py', 'm', 'n')}, {_gap('qx', 'qy', 'm', 'n')}) <= 7e-1""")
def jn14_barriers(t: Tables):
    edges = t.lines.where("cls NOT LIKE 'PROMO%'").select(F.col("fid").alias("u"), F.lit(0).alias("v"), "x1", "y1", "x2", "y2")
    return V.barrier_edges(edges, segments(t).where("cls LIKE 'PROMO%'"), d=0.7).select("u")


@query("jn16_polygons_to_grid_pieces", """
SELECT zone_id, cx, cy, round((least(xmax,(cx+1)*7)-greatest(xmin,cx*7))*(least(ymax,(cy+1)*7)-greatest(ymin,cy*7)), 6) AS area FROM zones, (SELECT range AS cx FROM range(16)) a, (SELECT range AS cy FROM range(3000)) b
WHERE xmin < (cx+1)*7 AND xmax > cx*7 AND ymin < (cy+1)*7 AND ymax > cy*7""")
def jn16(t: Tables):
    return V.polygons_to_grid_pieces(polygons(t), 7.0).withColumn("area", F.round("area", 6))


@query("jn17_country_skip", "SELECT fid, iso FROM feats WHERE iso IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def jn17(t: Tables):
    return layers.country_skip(t.feats.select("fid", "iso"), t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("iso")))[0]


OPS = ("sum", "max", "min", "mean", "median", "count")


@query("agg2_line_stats", f"""
SELECT zone_id, round(coalesce(sum(length),0), 4) AS sum, round(coalesce(max(length),0), 4) AS max, round(coalesce(min(length),0), 4) AS min, round(coalesce(avg(length),0), 4) AS mean,
  round(coalesce(quantile_cont(length, 0.5),0), 4) AS median, count(length) AS count FROM zones LEFT JOIN ({PIECES}) q USING (zone_id) GROUP BY 1""")
def agg2(t: Tables):
    stats = V.line_stats(V.overlay_lines(segments(t).select("fid", "geom"), polygons(t)), polygons(t), OPS)
    return stats.select("zone_id", *[F.round(c, 4).alias(c) for c in OPS[:-1]], "count")


@query("agg3_line_density", f"SELECT zone_id, round(sum(length)/max((xmax-xmin)*(ymax-ymin)), 6) AS density FROM zones LEFT JOIN ({PIECES}) q USING (zone_id) GROUP BY 1")
def agg3(t: Tables):
    return V.line_density(V.overlay_lines(segments(t).select("fid", "geom"), polygons(t)), polygons(t)).withColumn("density", F.round("density", 6))


@query("agg4_class_filtered_stats", f"""
SELECT zone_id, round(coalesce(sum(CASE WHEN cls LIKE 'E%' THEN length END),0), 4) AS e_sum, count(CASE WHEN cls LIKE 'E%' THEN 1 END) AS e_count,
  round(coalesce(sum(CASE WHEN cls LIKE 'S%' THEN length END),0), 4) AS s_sum, count(CASE WHEN cls LIKE 'S%' THEN 1 END) AS s_count FROM zones LEFT JOIN ({PIECES}) q USING (zone_id) GROUP BY 1""")
def agg4(t: Tables):
    pieces = V.overlay_lines(segments(t).select("fid", "cls", "geom"), polygons(t))
    stats = V.line_stats(pieces, polygons(t), ("sum", "count"), {c.lower(): F.col("cls").startswith(c) for c in ("E", "S")})
    return stats.select("zone_id", F.round("e_sum", 4).alias("e_sum"), "e_count", F.round("s_sum", 4).alias("s_sum"), "s_count")


@query("agg5_feature_count", f"SELECT zone_id, count(*) AS n FROM ({IN_ZONE}) q GROUP BY 1")
def agg5(t: Tables):
    return V.read_features(t.feats, polygons(t)).groupBy("zone_id").agg(F.count("*").alias("n"))


@query("agg6_feature_area", f"SELECT zone_id, sum(side*side) AS area FROM ({IN_ZONE}) q GROUP BY 1")
def agg6(t: Tables):
    half = F.col("side") / 2
    square = G.rectangle(F.col("x") - half, F.col("y") - half, F.col("x") + half, F.col("y") + half)
    tagged = V.read_features(t.feats.withColumn("own", G.area(square)), polygons(t))
    return tagged.groupBy("zone_id").agg(F.round(F.sum("own"), 6).alias("area"))


@query("ord1_order_by_area", "SELECT zone_id, round((xmax-xmin)*(ymax-ymin), 6) AS area FROM zones ORDER BY 2 DESC, 1")
def ord1(t: Tables):
    return layers.order_by_area(polygons(t)).select("zone_id", F.round("area", 6).alias("area"))
