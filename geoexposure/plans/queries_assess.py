"""Queries of the end-to-end plans, one for each component."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoexposure.operators import raster
from geoexposure.plans import assess as A
from geoexposure.plans.catalog import GROUPS, ROAD_CLASSES, SEXES
from geoexposure.plans.fixtures import Tables
from geoexposure.plans.queries_focal import BOX3, smoothed, window
from geoexposure.plans.queries_raster import MET, weights
from geoexposure.plans.queries_sources import zone_polygons
from geoexposure.plans.queries_vector import IN_ZONE, PIECES, polygons, segments
from geoexposure.plans.registry import query


def _raster(t: Tables, component: str, sources: dict, digits: int = 4):
    cells = t.px.select("row", "col", (F.col("mask") == 1).alias("affected"), *[c.alias(n) for n, c in sources.items()])
    out = A.assess_raster(component, t.zones.select("zone_id"), weights(t), cells, True)
    return out.select("zone_id", *[F.round(c, digits).alias(c) for c in out.columns if c != "zone_id"])


POP = [(f"{s}_{g}", i * 3 + j) for i, s in enumerate(SEXES) for j, g in enumerate(GROUPS)]


def _pop_sql() -> str:
    inner = ", ".join(f"sum(CASE WHEN {on} THEN (value % {97 + k})*w ELSE 0 END) AS {n}{x}" for x, on in (("", "true"), ("_affected", "mask = 1")) for n, k in POP)
    out = []
    for x in ("", "_affected"):
        own = {n: f"{n}{x}" for n, _ in POP}
        own |= {f"{s}_total": "(" + "+".join(own[f"{s}_{g}"] for g in GROUPS) + ")" for s in SEXES}
        own |= {f"{g}_total": "(" + "+".join(own[f"{s}_{g}"] for s in SEXES) + ")" for g in GROUPS}
        own |= {"total": f"({own['male_total']}+{own['female_total']})"}
        own |= {"dependency": f"({own['child_total']}+{own['elderly_total']})/{own['active_total']}*100", "child_dependency": f"{own['child_total']}/{own['active_total']}*100", "elderly_dependency": f"{own['elderly_total']}/{own['active_total']}*100"}
        out += [f"round({e}, 4) AS {n}{x}" for n, e in own.items()]
    return f"SELECT zone_id, {', '.join(out)} FROM (SELECT zone_id, {inner} FROM ({MET}) q GROUP BY 1) a"


@query("assess_population", _pop_sql())
def population(t: Tables):
    return _raster(t, "population", {n: (F.col("value") % (97 + k)).cast("double") for n, k in POP})


def _means(name: str, value: str) -> str:
    parts = [f"round(sum(CASE WHEN {on} THEN {value}*w END)/sum(CASE WHEN {on} THEN w END), 4) AS {name}_mean{x}, round(min(CASE WHEN {on} THEN {value} END), 4) AS {name}_min{x}, round(max(CASE WHEN {on} THEN {value} END), 4) AS {name}_max{x}" for x, on in (("", "true"), ("_affected", "mask = 1"))]
    return f"SELECT zone_id, {', '.join(parts)} FROM ({MET}) q GROUP BY 1"


@query("assess_rwi", _means("rwi", "((value % 4001)/1e3-2)"))
def rwi(t: Tables):
    return _raster(t, "rwi", {"rwi": F.col("value") % 4001 / 1e3 - 2})


@query("assess_deprivation", _means("depriv", "((value % 1009)/1e1)"))
def deprivation(t: Tables):
    return _raster(t, "deprivation", {"deprivation": F.col("value") % 1009 / 1e1})


@query("assess_gdp", _means("gdp", "value").replace("SELECT zone_id,", "SELECT zone_id, round(sum(value*w), 4) AS gdp_sum, round(sum(CASE WHEN mask=1 THEN value*w ELSE 0 END), 4) AS gdp_sum_affected, round(sum(CASE WHEN mask=1 THEN value*w ELSE 0 END)/sum(value*w)*100, 4) AS gdp_sum_affected_percentage,").replace("round(min(CASE", "(min(CASE").replace("round(max(CASE", "(max(CASE").replace("THEN value END), 4)", "THEN value END))"))
def gdp(t: Tables):
    return _raster(t, "gdp", {"gdp": F.col("value")})


@query("assess_landuse", f"""
SELECT zone_id, round(c, 4) AS crops_area, round(b, 4) AS built_area, round(ca, 4) AS crops_area_affected, round(ba, 4) AS built_area_affected, round(ca/c*100, 4) AS crops_area_affected_percentage, round(ba/b*100, 4) AS built_area_affected_percentage FROM (
SELECT zone_id, sum(CASE WHEN cls = 4 THEN w ELSE 0 END) AS c, sum(CASE WHEN cls = 5 THEN w ELSE 0 END) AS b, sum(CASE WHEN cls = 4 AND mask = 1 THEN w ELSE 0 END) AS ca, sum(CASE WHEN cls = 5 AND mask = 1 THEN w ELSE 0 END) AS ba FROM ({MET}) q GROUP BY 1) a""")
def landuse(t: Tables):
    return _raster(t, "landuse", {"landuse": F.when(F.col("cls") == 5, 6).otherwise(F.col("cls"))})


@query("assess_ntl", "SELECT zone_id, " + ", ".join(f"round(t{k}, 4) AS {n}, round(a{k}, 4) AS {n}_affected, round(CASE WHEN t{k} = 0 THEN NULL ELSE a{k}/t{k}*100 END, 4) AS {n}_affected_percentage" for k, n in enumerate(("noaa_outage", "nasa_nrt_outage", "nasa_outage")))
       + " FROM (SELECT zone_id, " + ", ".join(f"sum(CASE WHEN value % {k + 3} = 0 THEN w ELSE 0 END) AS t{k}, sum(CASE WHEN value % {k + 3} = 0 AND mask = 1 THEN w ELSE 0 END) AS a{k}" for k in range(3)) + f" FROM ({MET}) q GROUP BY 1) a")
def ntl(t: Tables):
    return _raster(t, "ntl", {n: (F.col("value") % (k + 3) == 0).cast("double") for k, n in enumerate(("noaa_outage", "nasa_nrt_outage", "nasa_outage"))})


@query("assess_buildings", f"""
SELECT zone_id, n AS nbuildings, a AS buildings_area, na AS nbuildings_affected, aa AS buildings_area_affected, round(na/n*100, 6) AS nbuildings_affected_percentage, round(aa/a*100, 6) AS buildings_area_affected_percentage FROM (
SELECT zone_id, CAST(count(fid) AS DOUBLE) AS n, coalesce(sum(side*side), 0) AS a, CAST(count(CASE WHEN mask = 1 THEN 1 END) AS DOUBLE) AS na, coalesce(sum(CASE WHEN mask = 1 THEN side*side END), 0) AS aa
FROM zones LEFT JOIN ({IN_ZONE}) f USING (zone_id) LEFT JOIN px p ON p.row = CAST(floor(f.y) AS INTEGER) AND p.col = CAST(floor(f.x) AS INTEGER) GROUP BY 1) q""")
def buildings(t: Tables):
    features = t.feats.select("fid", "x", "y", (F.col("side") * F.col("side")).alias("area"))
    out = A.assess_buildings(zone_polygons(t).select("zone_id", "geom"), features, t.px.where("mask = 1")).drop("geom")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("percentage")})


LINE_ZONES = "zone_id % 2 = 0"


def _line_sql(names: list[tuple[str, str]]) -> str:
    inner = ", ".join(f"coalesce(sum(CASE WHEN {on} THEN length END), 0) AS s{k}, coalesce(sum(CASE WHEN {on} AND {LINE_ZONES} THEN length END), 0) AS a{k}, sum(CASE WHEN {on} THEN length END) AS n{k}, sum(CASE WHEN {on} AND {LINE_ZONES} THEN length END) AS m{k}" for k, (_, on) in enumerate(names))
    out = ", ".join(f"round(s{k}, 4) AS {n}_length, round(a{k}, 4) AS {n}_length_affected, round(CASE WHEN s{k} = 0 THEN NULL ELSE a{k}/s{k}*100 END, 4) AS {n}_length_affected_percentage, round(n{k}/za, 6) AS {n}_density, round(m{k}/za, 6) AS {n}_density_affected" for k, (n, _) in enumerate(names))
    return f"SELECT zone_id, {out} FROM (SELECT zone_id, max((xmax-xmin)*(ymax-ymin)) AS za, {inner} FROM zones LEFT JOIN ({PIECES}) q USING (zone_id) GROUP BY 1) a"


def _lines(t: Tables, component: str, lines):
    zones = polygons(t)
    out = A.assess_lines(component, zones, lines, zones.where(LINE_ZONES)).drop("geom")
    digits = lambda c: 6 if "density" in c else 4
    return out.select("zone_id", *[F.round(c, digits(c)).alias(c) for c in out.columns if c != "zone_id"])


ROADS = [("roads", "true"), *[(c.replace(" ", "").lower(), f"fid % 6 = {k}") for k, c in enumerate(ROAD_CLASSES)]]


@query("assess_roads", _line_sql(ROADS))
def roads(t: Tables):
    cls = F.element_at(F.array(*map(F.lit, ROAD_CLASSES)), (F.col("fid") % 6 + 1).cast("int"))
    return _lines(t, "roads", segments(t).select("fid", cls.alias("cls"), "geom"))


@query("assess_elegrid", _line_sql([("elegrid", "true")]))
def elegrid(t: Tables):
    return _lines(t, "elegrid", segments(t).select("fid", "cls", "geom"))


@query("out4_detect_outage")
def out4(t: Tables):
    seen = t.px.withColumn("granule", F.explode(F.array(F.lit(1), F.lit(2))))
    radiance = F.col("value") / 1e5 * F.when(F.col("col") % 40 < 12, 0.05).otherwise(1.0)
    seen = seen.select("row", "col", "granule", F.col("granule").alias("order"), radiance.alias("radiance"), F.when((F.col("value") + F.col("granule")) % 5 == 0, 192).otherwise(0).alias("quality"))
    baseline = t.px.select("row", "col", (F.col("value") / 1e5).alias("radiance"), F.when(F.col("cls") == 5, 2).otherwise(1).alias("land_water"))
    cells, zones = A.detect_outage(seen, baseline, t.nrows, 100)
    people = cells.where("zone_id IS NOT NULL").join(t.px.select("row", "col", F.col("cls").alias("people")), ["row", "col"])
    return zones.join(people.groupBy("zone_id").agg(F.sum("people").alias("people")), "zone_id", "left")


#: Bands of the two granules of ``out4_detect_outage``: the gate, the first clear observation, the smoothed drop, and clumps of two cells or more.
OUTAGES = f"""g AS (SELECT row, col, o AS granule, value/1e5*CASE WHEN col % 40 < 12 THEN 5e-2 ELSE 1e0 END AS radiance, (value + o) % 5 = 0 AS cloud, cls = 5 AS out FROM px, (SELECT unnest([1, 2]) AS o) u),
u AS (SELECT granule, round(avg(CASE WHEN cloud THEN 1e0 ELSE 0e0 END)*100) < 95 AS used, round(avg(CASE WHEN out THEN 1e0 ELSE 0e0 END)*100) AS plain, round(avg(CASE WHEN out OR cloud THEN 1e0 ELSE 0e0 END)*100) AS clouded FROM g GROUP BY 1),
y AS (SELECT row, col, arg_min(ln(1+radiance), g.granule) AS daily FROM g JOIN u ON u.granule = g.granule WHERE CASE WHEN used THEN clouded ELSE plain END < 97 AND NOT (cloud AND used) GROUP BY 1, 2),
b AS MATERIALIZED (SELECT px.row, px.col, ln(1+value/1e5) AS base, coalesce(daily, ln(1+value/1e5)) AS daily, daily IS NOT NULL AND cls <> 5 AS valid FROM px LEFT JOIN y ON y.row = px.row AND y.col = px.col),
{smoothed(2)}, d AS ({window('s', BOX3, 'base')}), n AS (SELECT row, col, stddev_pop(v) AS sd FROM d GROUP BY 1, 2),
z AS MATERIALIZED (SELECT b.row, b.col, coalesce(valid AND s.daily-s.base < ln(5e-1) AND (s.daily-s.base)/greatest(sd/exp(s.base), 15e-2) < -2, false) AS dark FROM b JOIN s ON s.row = b.row AND s.col = b.col JOIN n ON n.row = b.row AND n.col = b.col),
dark AS MATERIALIZED (SELECT row, col, CAST(row AS BIGINT)*100+col AS id FROM z WHERE dark),
step AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM dark a JOIN dark b ON (b.row = a.row AND abs(b.col-a.col) = 1) OR (b.col = a.col AND abs(b.row-a.row) = 1)),
reached(a, b) AS (SELECT id, id FROM dark UNION SELECT reached.a, step.b FROM reached JOIN step ON step.a = reached.b),
zone AS (SELECT a AS id, min(b) AS zone_id FROM reached GROUP BY 1 HAVING count(*) >= 2)"""


def _outages(t: Tables):
    seen = t.px.withColumn("granule", F.explode(F.array(F.lit(1), F.lit(2))))
    radiance = F.col("value") / 1e5 * F.when(F.col("col") % 40 < 12, 0.05).otherwise(1.0)
    seen = seen.select("row", "col", "granule", F.col("granule").alias("order"), radiance.alias("radiance"), F.when((F.col("value") + F.col("granule")) % 5 == 0, 192).otherwise(0).alias("quality"))
    baseline = t.px.select("row", "col", (F.col("value") / 1e5).alias("radiance"), F.when(F.col("cls") == 5, 2).otherwise(1).alias("land_water"))
    return A.detect_outage(seen, baseline, t.nrows, 100)


def _outage_people_sql() -> str:
    own = {n: f"sum(CAST(value % {97 + k} AS DOUBLE))" for n, k in POP}
    own |= {f"{s}_total": "(" + "+".join(own[f"{s}_{g}"] for g in GROUPS) + ")" for s in SEXES}
    own |= {f"{g}_total": "(" + "+".join(own[f"{s}_{g}"] for s in SEXES) + ")" for g in GROUPS}
    own |= {"total": f"({own['male_total']}+{own['female_total']})", "dependency": f"({own['child_total']}+{own['elderly_total']})/nullif({own['active_total']}, 0)*100"}
    own |= {f"{g}_dependency": f"{own[f'{g}_total']}/nullif({own['active_total']}, 0)*100" for g in ("child", "elderly")}
    extent = "CAST(min(px.col) AS DOUBLE) AS xmin, CAST(max(px.col)+1 AS DOUBLE) AS xmax, CAST(min(px.row) AS DOUBLE) AS ymin, CAST(max(px.row)+1 AS DOUBLE) AS ymax"
    return f"WITH {OUTAGES} SELECT zone_id, count(*) AS cells, CAST(count(*) AS DOUBLE) AS area, {extent}, {', '.join(f'round({e}, 4) AS {n}' for n, e in own.items())} FROM zone JOIN px ON CAST(px.row AS BIGINT)*100+px.col = zone.id GROUP BY 1"


@query("out4_outage_cells", f"WITH {OUTAGES} SELECT z.row, z.col, dark AS outage, zone_id FROM z LEFT JOIN zone ON zone.id = CAST(z.row AS BIGINT)*100+z.col")
def out4_cells(t: Tables):
    return _outages(t)[0].select("row", "col", "outage", "zone_id")


@query("out4_outage_population", _outage_people_sql())
def out4_people(t: Tables):
    cells, zones = _outages(t)
    people = t.px.select("row", "col", *[(F.col("value") % (97 + k)).cast("double").alias(n) for n, k in POP])
    out = A.outage_population(zones, cells, people)
    named = [c for c in out.columns if c not in zones.columns]
    return out.withColumns({c: F.round(c, 4) for c in named})


@query("jn17_mosaic_by_country", "SELECT row, col, value FROM px WHERE cls <> 3")
def by_country(t: Tables):
    parts = t.px.where("cls <> 3").select("row", "col", "value", F.col("cls").alias("k"))
    return raster.mosaic_last(parts, ["k"], nodata=None)


