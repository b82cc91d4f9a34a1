"""Queries of iterative jobs; their oracles are recursive."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoexposure.operators import graph
from geoexposure.plans.fixtures import Tables
from geoexposure.plans.registry import query

LABELS = """m AS (SELECT row, col, CAST(row AS BIGINT)*100+col AS id FROM px WHERE mask = 1),
n AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON b.row = a.row AND b.col = a.col+1 UNION ALL SELECT a.id, b.id FROM m a JOIN m b ON b.row = a.row+1 AND b.col = a.col),
s AS (SELECT a, b FROM n UNION ALL SELECT b, a FROM n),
r(a, b) AS (SELECT id, id FROM m UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b),
l AS (SELECT a, min(b) AS label FROM r GROUP BY 1 HAVING count(*) >= 2)"""


@query("itr1_connected_components", f"WITH {LABELS} SELECT row, col, label FROM l JOIN m ON a = id")
def itr1(t: Tables):
    return graph.clumps(t.px.where("mask = 1").select("row", "col"), 100, least=2, tile=32)


@query("itr2_mask_to_zones", f"""
WITH {LABELS} SELECT label AS zone_id, count(*) AS cells, CAST(count(*) AS DOUBLE) AS area, CAST(min(col) AS DOUBLE) AS xmin, CAST(max(col)+1 AS DOUBLE) AS xmax, CAST(min(row) AS DOUBLE) AS ymin, CAST(max(row)+1 AS DOUBLE) AS ymax FROM l JOIN m ON a = id GROUP BY 1""")
def itr2(t: Tables):
    zones, _ = graph.mask_to_zones(t.px.where("mask = 1").select("row", "col"), 100, least=2)
    return zones


CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "service")
COSTS = "e AS (SELECT u, v, CAST(ceil(length_m*36e-1/CASE length(cls) % 6 WHEN 0 THEN 105e0 WHEN 1 THEN 9e1 WHEN 2 THEN 75e0 WHEN 3 THEN 6e1 WHEN 4 THEN 5e1 ELSE 25e0 END) AS BIGINT) AS cost FROM edges)"


def times(name: str, on: str) -> str:
    return f"{name}(node, s) AS (SELECT u, CAST(0 AS BIGINT) FROM edges WHERE u % 50 = 0 UNION SELECT e.u, {name}.s + e.cost FROM {name} JOIN e ON e.v = {name}.node WHERE {name}.s + e.cost <= 3600 AND {on})"


def roads(t: Tables, mode: str = "drive"):
    named = F.element_at(F.array(*map(F.lit, CLASSES)), (F.length("cls") % 6 + 1).cast("int"))
    return graph.travel_seconds(t.edges.withColumn("cls", named), mode=mode)


@query("itr4_service_area", f"WITH {COSTS}, {times('w', 'true')} SELECT node, CASE WHEN min(s) <= 300 THEN 5 WHEN min(s) <= 900 THEN 15 WHEN min(s) <= 1800 THEN 30 ELSE 60 END AS contour FROM w GROUP BY 1")
def itr4(t: Tables):
    sites = t.edges.where("u % 50 = 0").select(F.col("u").alias("node"))
    return graph.service_area(graph.travel_times(roads(t), sites, 3600))


WALKS = "w0 AS (SELECT u, v, CAST(ceil(length_m*36e-1/51e-1) AS BIGINT) AS c FROM edges WHERE length(cls) % 6 > 1), e AS (SELECT u, v, c AS cost FROM w0 UNION ALL SELECT v, u, c FROM w0)"


@query("itr4_service_area_on_foot", f"""
WITH {WALKS}, w(node, s) AS (SELECT u, CAST(0 AS BIGINT) FROM edges WHERE u % 50 = 0 UNION SELECT e.u, w.s + e.cost FROM w JOIN e ON e.v = w.node WHERE w.s + e.cost <= 21600)
SELECT node, CASE WHEN min(s) <= 7200 THEN 120 WHEN min(s) <= 14400 THEN 240 ELSE 360 END AS contour FROM w GROUP BY 1""")
def itr4_walk(t: Tables):
    sites = t.edges.where("u % 50 = 0").select(F.col("u").alias("node"))
    return graph.service_area(graph.travel_times(roads(t, "walk"), sites, 21600), (120, 240, 360))


def people(name: str) -> str:
    return f"SELECT c AS contour, CAST(sum(n) AS BIGINT) AS people FROM (SELECT node, min(s) AS s FROM {name} GROUP BY 1) q JOIN (SELECT fid % 2000 AS node, count(*) AS n FROM feats GROUP BY 1) p USING (node) JOIN (SELECT 5 AS c UNION ALL SELECT 15 UNION ALL SELECT 30 UNION ALL SELECT 60) k ON s <= c*60 GROUP BY 1"


@query("itr5_service_area_exposure", f"WITH {COSTS}, {times('w', 'true')}, {times('x', 'e.u % 7 <> 0')} SELECT contour, a.people, b.people AS people_barrier, a.people - b.people AS people_difference FROM ({people('w')}) a LEFT JOIN ({people('x')}) b USING (contour)")
def itr5(t: Tables):
    from geoexposure.plans.assess import service_area_exposure

    edges = roads(t)
    sites = t.edges.where("u % 50 = 0").select(F.col("u").alias("node"))
    persons = t.feats.groupBy((F.col("fid") % 2000).alias("node")).agg(F.count("*").alias("people"))
    return service_area_exposure(edges, sites, persons, (5, 15, 30, 60), edges.where("u % 7 = 0").select("u", "v"))
