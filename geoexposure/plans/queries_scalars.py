"""Queries of the scalar operators: projections, pixel functions, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoexposure.functions import pixels as P
from geoexposure.functions import projections as J
from geoexposure.operators import scenes as S
from geoexposure.operators.stats import derive
from geoexposure.plans.fixtures import Tables
from geoexposure.plans.registry import query

r6 = lambda c, name: F.round(c, 6).alias(name)


@query("prj1_to_equal_area", """
SELECT fid, round(6378137e0*radians(lon), 4) AS x,
  round(6378137e0/2*(1-6.69437999014131e-3)*(s/(1-6.69437999014131e-3*s*s) - ln((1-8.1819190842621e-2*s)/(1+8.1819190842621e-2*s))/(2*8.1819190842621e-2)), 3) AS y
FROM (SELECT *, sin(radians(lat)) AS s FROM geo) q""")
def prj1(t: Tables):
    x, y = J.to_equal_area(F.col("lon"), F.col("lat"))
    return t.geo.select("fid", F.round(x, 4).alias("x"), F.round(y, 3).alias("y"))


@query("prj2_to_web_mercator", """
SELECT fid, round(6378137e0*radians(lon), 4) AS x, round(6378137e0*ln(tan(pi()/4+radians(lat)/2)), 4) AS y, round(lon, 6) AS lon2, round(lat, 6) AS lat2 FROM geo""")
def prj2(t: Tables):
    x, y = J.to_web_mercator(F.col("lon"), F.col("lat"))
    lon, lat = J.from_web_mercator(x, y)
    return t.geo.select("fid", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), r6(lon, "lon2"), r6(lat, "lat2"))


@query("prj3_to_mgrs_100k", """
WITH a AS (SELECT fid, lon, lat, CAST(greatest(1, ceil((lon+180)/6)) AS INTEGER) AS z, radians(lat) AS k FROM geo),
b AS (SELECT *, radians(lon-(z*6-183)) AS t, cos(k) AS n, tan(k) AS q, 6.739496742276434e-3*cos(k)*cos(k) AS o, 6378137e0/sqrt(1-6.69437999014131e-3*sin(k)*sin(k)) AS nu FROM a),
c AS (SELECT *, nu*(n*t + n*n*n*(1-q*q+o)*t*t*t/6 + power(n*t,5)*(5-18*q*q+power(q,4)+14*o-58*q*q*o)/120 + power(n*t,7)*(61-479*q*q+179*power(q,4)-power(q,6))/5040)*9.996e-1+5e5 AS e,
  (6367449.14570093e0*(k-2.51882794504e-3*sin(2*k)+2.64354112e-6*sin(4*k)-3.45262e-9*sin(6*k)) + nu*q*(n*n*t*t/2+power(n*t,4)*(5-q*q+9*o+4*o*o)/24+power(n*t,6)*(61-58*q*q+power(q,4)+270*o-330*q*q*o)/720))*9.996e-1 + CASE WHEN lat<0 THEN 1e7 ELSE 0e0 END AS nn FROM b)
SELECT fid, z AS zone, CASE WHEN lat < -80 THEN 'Too far South' WHEN lat > 84 THEN 'Too far North' ELSE
  lpad(CAST(z AS VARCHAR),2,'0') || substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor(lat/8+10) AS INTEGER)+1, 1) ||
  substr(CASE (z-1)%3 WHEN 0 THEN 'ABCDEFGH' WHEN 1 THEN 'JKLMNPQR' ELSE 'STUVWXYZ' END, CAST(floor(e/1e5) AS INTEGER), 1) ||
  substr(CASE (z-1)%2 WHEN 0 THEN 'ABCDEFGHJKLMNPQRSTUV' ELSE 'FGHJKLMNPQRSTUVABCDE' END, CAST(floor(nn/1e5) AS INTEGER)%20+1, 1) END AS square FROM c""")
def prj3(t: Tables):
    return t.geo.select("fid", J.utm_zone(F.col("lon")).alias("zone"), J.to_mgrs_100k(F.col("lon"), F.col("lat")).alias("square"))


@query("prj3_from_mgrs_100k", "SELECT fid, round(lon, 4) AS lon, round(lat, 4) AS lat FROM geo WHERE lat BETWEEN -80 AND 84")
def prj3_inverse(t: Tables):
    # From a point to its square and the metres within it, and back again.
    east, north = J.to_utm(F.col("lon"), F.col("lat"), J.utm_zone(F.col("lon")))
    there = t.geo.where("lat BETWEEN -80 AND 84").select("fid", J.to_mgrs_100k(F.col("lon"), F.col("lat")).alias("square"), F.pmod(east, F.lit(1e5)).alias("e"), F.pmod(north, F.lit(1e5)).alias("n"))
    found = there.select("fid", J.from_mgrs_100k(F.col("square"), F.col("e"), F.col("n")).alias("p"))
    return found.select("fid", F.round("p.lon", 4).alias("lon"), F.round("p.lat", 4).alias("lat"))


def _boxes(t: Tables):
    return t.sql("SELECT fid, lon AS xmin, lat AS ymin, lon + (fid % 7)*3e0 AS xmax, lat + (fid % 5)*3e0 AS ymax FROM {geo}")


@query("prj4_tiles_for_bbox", """
SELECT fid, printf('h%02dv%02d', h, v) AS tile FROM (SELECT fid, lon AS xmin, lat AS ymin, lon + (fid % 7)*3e0 AS xmax, lat + (fid % 5)*3e0 AS ymax FROM geo) b,
  (SELECT range AS h FROM range(36)) hh, (SELECT range AS v FROM range(18)) vv
WHERE h BETWEEN floor((xmin+180)/10) AND floor((xmax+180)/10) AND v BETWEEN floor((90-ymax)/10) AND floor((90-ymin)/10)""")
def prj4(t: Tables):
    return J.tiles_for_bbox(_boxes(t)).select("fid", "tile")


@query("prj5_mgrs_tiles_for_bbox")
def prj5(t: Tables):
    boxes = t.sql("SELECT fid, lon AS xmin, lat AS ymin, lon + (fid % 4)*5e-1 AS xmax, lat + (fid % 5)*5e-1 AS ymax FROM {geo}")
    return J.mgrs_tiles_for_bbox(boxes).select("fid", "square")


@query("prj9_class_to_area", "SELECT row, col, CASE WHEN cls = 2 THEN 1e2 END AS area FROM px")
def prj9(t: Tables):
    return t.px.select("row", "col", P.class_to_area(F.col("cls"), 2, 100.0).alias("area"))


@query("prj10_harmonize", "SELECT row, col, CASE WHEN acquired >= TIMESTAMP '2022-01-25' AND value <> 0 THEN value - 1000 ELSE value END AS value FROM px")
def prj10(t: Tables):
    return t.px.select("row", "col", P.harmonize(F.col("value"), F.col("acquired")).alias("value"))


@query("prj11_normalize_bands", """
SELECT row, col, round(e1/(e1+1), 6) AS b1, round(e2/(e2+1), 6) AS b2 FROM (
  SELECT row, col, exp(5*((ln(value/1e4*5e-3+1)-1e0)/(4e0-1e0))-1) AS e1, exp(5*((ln(cls*1e3*5e-3+1)-15e-1)/(35e-1-15e-1))-1) AS e2 FROM px) q""")
def prj11(t: Tables):
    bands = P.normalize_bands(F.array(F.col("value") / 1e4, F.col("cls") * 1e3), [1.0, 1.5], [4.0, 3.5])
    return t.px.select("row", "col", bands.alias("b")).select("row", "col", r6(F.col("b")[0], "b1"), r6(F.col("b")[1], "b2"))


@query("prj12_argmax_class", """
SELECT row, col, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS best FROM (SELECT row, col, value % 101 AS a, value % 97 AS b, value % 89 AS c FROM px) q""")
def prj12(t: Tables):
    scores = F.array(*[F.col("value") % k for k in (101, 97, 89)])
    return t.px.select("row", "col", P.argmax_class(scores).alias("best"))


@query("prj13_log_radiance", "SELECT row, col, round(CASE WHEN v >= 0 THEN ln(1+v) ELSE 0e0 END, 6) AS v FROM (SELECT row, col, (value-1e7)/1e5 AS v FROM px) q")
def prj13(t: Tables):
    return t.px.select("row", "col", r6(P.log_radiance((F.col("value") - 1e7) / 1e5), "v"))


@query("prj14_cloud_from_quality", "SELECT row, col, (CAST(floor((value % 65536)/64) AS BIGINT) % 4) = 3 AS cloud FROM px")
def prj14(t: Tables):
    return t.px.select("row", "col", P.cloud_from_quality(F.col("value") % 65536).alias("cloud"))


@query("prj15_analysis_mask", "SELECT row, col, cls IN (2,3) OR value < 5000000 AS leave_out, cls IN (0,1,5) AS land FROM px")
def prj15(t: Tables):
    return t.px.select("row", "col", P.analysis_mask(F.col("cls"), F.col("value") - 5000000).alias("leave_out"), P.is_land(F.col("cls")).alias("land"))


@query("prj16_shift_lon_360", "SELECT fid, round(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END, 6) AS lon, max(lon) OVER () - min(lon) OVER () > 300 AS crosses FROM geo")
def prj16(t: Tables):
    span = t.geo.agg(F.min("lon").alias("a"), F.max("lon").alias("b")).select(J.crosses_date_line(F.col("a"), F.col("b")).alias("crosses"))
    return t.geo.crossJoin(F.broadcast(span)).select("fid", r6(J.shift_lon_360(F.col("lon")), "lon"), "crosses")


@query("prj17_radiance_scale", "SELECT row, col, round(CASE WHEN v >= -900 THEN v*1e5 END, 4) AS v FROM (SELECT row, col, CASE WHEN cls = 1 THEN -999e0 ELSE value/1e9 END AS v FROM px) q")
def prj17(t: Tables):
    raw = F.when(F.col("cls") == 1, -999.0).otherwise(F.col("value") / 1e9)
    return t.px.select("row", "col", F.round(P.radiance_scale(raw), 4).alias("v"))


@query("prj18_local_overpass_utc", "SELECT fid, CAST(epoch_us(TIMESTAMP '2024-03-01') + round((5400 - lon/15*3600)*1000000) AS BIGINT) AS at_us FROM geo")
def prj18(t: Tables):
    return t.geo.select("fid", F.unix_micros(J.local_overpass_utc(F.to_date(F.lit("2024-03-01")), F.col("lon"))).alias("at_us"))


@query("prj19_night_hours", """
SELECT fid, CAST(round_even(24 - 2*degrees(acos(greatest(-1e0, least(1e0, -tan(radians(lat))*tan(asin(sin(radians(23.44e0))*sin(radians(360/365.24e0*(d-81)))))))))/15, 0) AS INTEGER) AS hours,
  round(greatest(1e1, 24 - 2*degrees(acos(greatest(-1e0, least(1e0, -tan(radians(lat))*tan(4.09e-1*sin(2*pi()*(d-80)/365))))))/15), 6) AS simple
FROM (SELECT fid, lat, CAST(fid % 365 + 1 AS DOUBLE) AS d FROM geo) q""")
def prj19(t: Tables):
    day = (F.col("fid") % 365 + 1).cast("double")
    return t.geo.select("fid", J.night_hours(F.col("lat"), day).alias("hours"), r6(J.night_hours_simple(F.col("lat"), day), "simple"))


@query("prj20_baseline_period", """
SELECT DISTINCT CAST(d AS DATE) AS d, CAST(CASE WHEN date_trunc('month', d) = DATE '1996-06-01' THEN date_trunc('month', d) - INTERVAL 1 MONTH ELSE date_trunc('month', d) END + INTERVAL 14 DAY AS DATE) AS month_mid,
  CAST(CASE WHEN date_trunc('month', d) = DATE '1996-06-01' THEN date_trunc('month', d) - INTERVAL 1 MONTH ELSE date_trunc('month', d) END AS DATE) AS month_first,
  make_date(CAST(year(d) - CASE WHEN year(d) = 1996 THEN 1 ELSE 0 END AS INTEGER), 7, 1) AS year_mid, CAST(abs(date_diff('day', d, DATE '1996-06-20')) <= 7 AS BOOLEAN) AS nrt
FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) q""")
def prj20(t: Tables):
    today = F.to_date(F.lit("1996-06-20"))
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    d = F.col("d")
    return days.select("d", J.baseline_month(d, today, True).alias("month_mid"), J.baseline_month(d, today, False).alias("month_first"), J.baseline_year(d, today, True).alias("year_mid"), (F.abs(F.datediff(today, d)) <= 7).alias("nrt"))


DAY96 = "DATE '1996-06-20'"


def _month(d: str) -> str:
    return f"(CASE WHEN date_trunc('month', {d}) = DATE '1996-06-01' THEN date_trunc('month', {d}) - INTERVAL 1 MONTH ELSE date_trunc('month', {d}) END + CASE WHEN o_custkey % 2 = 0 THEN INTERVAL 14 DAY ELSE INTERVAL 0 DAY END)"


@query("prj20_baseline_by_level", f"""
WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - 42 AS before FROM orders),
p AS (SELECT *, CASE WHEN o_custkey % 3 = 0 AND abs(date_diff('day', d, {DAY96})) > 7 THEN NULL WHEN o_orderkey % 5 IN (1, 2) THEN epoch(d) + 5400 - (o_orderkey % 360 - 180)*240
  WHEN o_orderkey % 5 = 3 THEN epoch({_month('d')}) WHEN o_orderkey % 5 = 4 AND d <= {DAY96} THEN epoch(make_date(CAST(year(d) - CASE WHEN year(d) = 1996 THEN 1 ELSE 0 END AS INTEGER), CASE WHEN o_custkey % 2 = 0 THEN 7 ELSE 1 END, 1)) END AS period FROM o)
SELECT o_orderkey, CAST(period AS BIGINT) AS period, CAST(epoch({_month('before')}) AS BIGINT) AS outage_baseline FROM p""")
def prj20_level(t: Tables):
    today, d = F.to_date(F.lit("1996-06-20")), F.col("o_orderdate").cast("date")
    level, stac = F.format_string("vnp46a%d", F.col("o_orderkey") % 5), F.col("o_custkey") % 2 == 0
    period = J.baseline_period(d, today, level, stac, F.col("o_orderkey") % 360 - 180, F.col("o_custkey") % 3 == 0)
    outage = J.baseline_period(J.outage_baseline_day(d), today, F.lit("A3"), stac, F.lit(0))
    return t.orders.select("o_orderkey", F.unix_seconds(period).alias("period"), F.unix_seconds(outage).alias("outage_baseline"))


@query("prj22_admin_level_map", "SELECT fid, CASE WHEN l = 2 THEN 0 WHEN l IN (3,4) THEN 1 WHEN l BETWEEN 5 AND 8 THEN 2 END AS level FROM (SELECT fid, fid % 11 AS l FROM feats) q")
def prj22(t: Tables):
    return t.feats.select("fid", P.admin_level(F.col("fid") % 11).alias("level"))


@query("prj23_derive", """
SELECT iso, (c+e)/nullif(a, 0)*100 AS dependency, (ca+ea)/nullif(aa, 0)*100 AS dependency_affected FROM (
  SELECT iso, CAST(sum(CASE WHEN age < 15 THEN 1 ELSE 0 END) AS DOUBLE) AS c, CAST(sum(CASE WHEN age BETWEEN 15 AND 64 THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN age > 64 THEN 1 ELSE 0 END) AS DOUBLE) AS e,
    CAST(sum(CASE WHEN age < 15 THEN sex ELSE 0 END) AS DOUBLE) AS ca, CAST(sum(CASE WHEN age BETWEEN 15 AND 64 THEN sex ELSE 0 END) AS DOUBLE) AS aa, CAST(sum(CASE WHEN age > 64 THEN sex ELSE 0 END) AS DOUBLE) AS ea FROM feats GROUP BY iso) q""")
def prj23(t: Tables):
    groups = {"child_total": F.col("age") < 15, "active_total": F.col("age").between(15, 64), "elderly_total": F.col("age") > 64}
    sums = [F.sum(F.when(on, v).otherwise(0)).cast("double").alias(n + s) for s, v in (("", F.lit(1)), ("_affected", F.col("sex"))) for n, on in groups.items()]
    df, formula = t.feats.groupBy("iso").agg(*sums), "((child_total+elderly_total)/active_total)*100"
    return derive(derive(df, "dependency", formula), "dependency", formula, "_affected").select("iso", "dependency", "dependency_affected")


@query("prj25_facility_filter", "SELECT fid FROM feats WHERE fid % 6 IN (0, 1) OR fid % 5 = 0")
def prj25(t: Tables):
    amenity = F.element_at(F.array(*map(F.lit, ("hospital", "pharmacy", "school", "bar", "fuel", "bank"))), (F.col("fid") % 6 + 1).cast("int"))
    tags = F.map_from_arrays(F.array(F.lit("amenity"), F.lit("healthcare")), F.array(amenity, F.when(F.col("fid") % 5 == 0, "yes")))
    return t.feats.where(P.facility_filter(tags)).select("fid")


@query("prj26_cell_of", f"SELECT fid, CAST(floor(y) AS INTEGER) AS row, CAST(floor(x) AS INTEGER) AS col, x < 100 AND y < (SELECT count(*)/100 FROM orders) AS inside FROM feats")
def prj26(t: Tables):
    row, col = P.cell_of(F.col("x"), F.col("y"), 0.0, 0.0, 1.0, 1.0)
    return t.feats.select("fid", row.alias("row"), col.alias("col"), ((F.col("x") < 100) & (F.col("y") < t.nrows)).alias("inside"))


@query("prj29_area_label", """
SELECT fid, CASE WHEN span > 15 THEN c WHEN span > 1 THEN CASE WHEN c = r THEN c ELSE c || '_' || r END ELSE
  CASE WHEN c = r AND r = l THEN c WHEN c = r THEN c || '_' || l WHEN r = l OR c = l THEN c || '_' || r ELSE c || '_' || r || '_' || l END END AS label
FROM (SELECT fid, (fid % 20) * 1e0 AS span, 'land-' || (fid % 3) AS c, 'land-' || (fid % 4) AS r, 'land-' || (fid % 5) AS l FROM feats) q""")
def prj29(t: Tables):
    from geoexposure.sources.readers import area_label

    name = lambda k: F.concat(F.lit("Land "), (F.col("fid") % k).cast("string"))
    return t.feats.select("fid", area_label(name(3), name(4), name(5), (F.col("fid") % 20).cast("double")).alias("label"))


@query("scn1_quality_score", "SELECT scene_id, round(100/3e0*(exp(-d/3e0)+(1-cloud/1e2)+coverage/1e2), 3) AS score FROM (SELECT *, abs(date_diff('second', TIMESTAMP '2024-01-15', ts))/864e2 AS d FROM scenes) q")
def scn1(t: Tables):
    days = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-15 00:00:00"))) / 86400.0
    return t.scenes.select("scene_id", S.quality_score(days, F.col("cloud"), F.col("coverage")).alias("score"))


@query("scn9_pass_offset_km", "SELECT fid, CAST(trunc(abs(lon-(fid % 50))*111.32e0*cos(radians(lat))) AS INTEGER) AS km FROM geo WHERE fid % 90 >= 20")
def scn9(t: Tables):
    passes = t.geo.withColumn("elevation", F.col("fid") % 90).where("elevation >= 20")
    return passes.select("fid", S.pass_offset_km(F.col("lon"), F.col("lat"), F.col("fid") % 50).alias("km"))


@query("scn10_snap_to_pulse", "SELECT event_id, round(floor((t-12.5e0)/85.41667e0)*85.41667e0+12.5e0, 2) AS start FROM (SELECT event_id, epoch(ts) % 86400 AS t FROM events) q")
def scn10(t: Tables):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 % 86400
    return t.events.select("event_id", F.round(S.snap_to_pulse(seconds, 12.5), 2).alias("start"))
