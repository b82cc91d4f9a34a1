"""Queries of moving windows and outage maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoexposure.operators import focal as O
from geoexposure.operators import kernels as K
from geoexposure.operators import outage
from geoexposure.plans.fixtures import Tables
from geoexposure.plans.registry import query

NR = "(SELECT CAST(count(*)/100 AS INTEGER) FROM orders)"


def fold(i: str, n: str) -> str:
    return f"CASE WHEN {i} < 0 THEN -({i})-1 WHEN {i} >= {n} THEN 2*{n}-1-({i}) ELSE {i} END"


def window(source: str, offsets: str, value: str = "value") -> str:
    """Rows (row, col, k, v) of a source table for each cell and offset, mirrored at the grid's edge."""
    at = f"SELECT c.row, c.col, o.i, o.j, o.k, {fold('c.row+o.i', NR)} AS at_row, {fold('c.col+o.j', '100')} AS at_col FROM {source} c, ({offsets}) o"
    return f"SELECT c.row, c.col, c.i, c.j, c.k, s.{value} AS v FROM ({at}) c JOIN {source} s ON s.row = at_row AND s.col = at_col"


def disk(r: int) -> str:
    rng = f"range(-{r}, {r + 1})"
    return f"SELECT a.range AS i, b.range AS j, 1e0 AS k FROM {rng} a, {rng} b WHERE a.range*a.range + b.range*b.range <= {r * r}"


BOX3 = "SELECT a.range AS i, b.range AS j, 1e0 AS k FROM range(-1, 2) a, range(-1, 2) b"
VAL = "v AS (SELECT row, col, CAST(value AS DOUBLE)/1e5 AS value FROM px)"


def _values(t: Tables):
    return t.px.select("row", "col", (F.col("value") / 1e5).alias("value"))


def _rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("foc1_focal_mean", f"WITH {VAL}, w AS ({window('v', disk(2))}) SELECT row, col, round(avg(v), 6) AS value FROM w GROUP BY 1, 2")
def foc1(t: Tables):
    return _rounded(O.focal_mean(_values(t), 2, t.nrows, 100), "value")


@query("foc2_focal_std", f"WITH {VAL}, w AS ({window('v', BOX3)}) SELECT row, col, round(stddev_pop(v), 6) AS value FROM w GROUP BY 1, 2")
def foc2(t: Tables):
    return _rounded(O.focal_std(_values(t), t.nrows, 100), "value")


@query("foc3_focal_gradient", f"WITH {VAL}, w AS ({window('v', BOX3)}) SELECT row, col, round(hypot(sum(v*j*(2-abs(i))), sum(v*i*(2-abs(j)))), 6) AS value FROM w GROUP BY 1, 2")
def foc3(t: Tables):
    return _rounded(O.focal_gradient(_values(t), t.nrows, 100), "value")


@query("foc4_haze_mask", f"WITH v AS (SELECT row, col, (CAST(value AS DOUBLE)/1e6 % 7 - 3)/1e1 - CASE WHEN floor(row/20) % 3 = 0 THEN 55e-2 ELSE 0e0 END AS value FROM px), w AS ({window('v', disk(7))}) SELECT row, col, CASE WHEN avg(v) < -5e-1 AND sqrt(greatest(avg(v*v)-avg(v)*avg(v), 0)) < 35e-2 THEN 1 ELSE 0 END AS haze FROM w GROUP BY 1, 2")
def foc4(t: Tables):
    banks = F.when(F.floor(F.col("row") / 20) % 3 == 0, 0.55).otherwise(0.0)
    return O.haze_mask(t.px.select("row", "col", ((F.col("value") / 1e6 % 7 - 3) / 10 - banks).alias("value")), t.nrows, 100)


BOX7 = "SELECT a.range AS i, b.range AS j, 1e0 AS k FROM range(-3, 4) a, range(-3, 4) b"


@query("foc5_ssim", f"""
WITH v AS (SELECT row, col, value/1e7 AS a, value/1e7*(1-cls/1e1) AS b FROM px), w AS (SELECT c.row, c.col, s.a, s.b FROM v c, ({BOX7}) o JOIN v s ON s.row = {fold('c.row+o.i', NR)} AND s.col = {fold('c.col+o.j', '100')}),
m AS (SELECT row, col, avg(a) AS x, avg(b) AS y, avg(a*a)-avg(a)*avg(a) AS vx, avg(b*b)-avg(b)*avg(b) AS vy, avg(a*b)-avg(a)*avg(b) AS c FROM w GROUP BY 1, 2)
SELECT row, col, round((2*x*y+144e-4)*(2*c+1296e-4)/((x*x+y*y+144e-4)*(vx+vy+1296e-4)), 6) AS value FROM m""")
def foc5(t: Tables):
    bands = t.px.select("row", "col", (F.col("value") / 1e7).alias("a"), (F.col("value") / 1e7 * (1 - F.col("cls") / 10.0)).alias("b"))
    return _rounded(O.ssim(bands, t.nrows, 100, "a", "b"), "value")


MASK = "m AS (SELECT row, col FROM px WHERE mask = 1 AND cls < 4)"
MOVED = f"SELECT m.row + o.i AS row, m.col + o.j AS col FROM m, ({disk(1)}) o"


def _mask(t: Tables):
    return t.px.where("mask = 1 AND cls < 4").select("row", "col")


@query("foc6_close_mask", f"""
WITH {MASK}, d AS (SELECT DISTINCT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM ({MOVED}) q), e AS (SELECT d.row + o.i AS row, d.col + o.j AS col FROM d, ({disk(1)}) o)
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM e GROUP BY 1, 2 HAVING count(*) = 5""")
def foc6(t: Tables):
    return O.close_mask(_mask(t), 1)


@query("foc6_open_mask", f"""
WITH {MASK}, e AS (SELECT row, col FROM ({MOVED}) q GROUP BY 1, 2 HAVING count(*) = 5) SELECT DISTINCT CAST(e.row + o.i AS INTEGER) AS row, CAST(e.col + o.j AS INTEGER) AS col FROM e, ({disk(1)}) o""")
def foc6b(t: Tables):
    return O.open_mask(_mask(t), 1)


@query("geo7_buffer_zone_cells", f"SELECT DISTINCT zone_id, CAST(row + o.i AS INTEGER) AS row, CAST(col + o.j AS INTEGER) AS col FROM zones JOIN px ON col+5e-1 >= xmin AND col+5e-1 < xmax AND row+5e-1 >= ymin AND row+5e-1 < ymax, ({disk(2)}) o")
def geo7(t: Tables):
    from geoexposure.operators.zonal import rasterize
    from geoexposure.plans.queries_sources import zone_polygons

    return O.buffer_zone_cells(rasterize(zone_polygons(t), t.nrows, 100), 2)


@query("foc7_tiled_apply", "SELECT row, col, CAST(value AS DOUBLE) AS value FROM px")
def foc7(t: Tables):
    return O.tiled_apply(t.px, ["value"], lambda im: {"value": im["value"][3:-3, 3:-3]}, ["value"], t.nrows, 100, tile=32, halo=3)


BANDS = "b AS (SELECT row, col, ln(1+value/1e5) AS base, ln(1+value/1e5*(1-cls/6e0)) AS daily, (mask = 1 OR cls > 1) AS valid, (value % 97)/1e1 AS std, cls*4 AS num, mask = 0 AS cloudy FROM px)"


def _bands(t: Tables):
    v = F.col("value") / 1e5
    return t.px.select("row", "col", F.log(v + 1).alias("base"), F.log(v * (1 - F.col("cls") / 6.0) + 1).alias("daily"), ((F.col("mask") == 1) | (F.col("cls") > 1)).alias("valid"), (F.col("value") % 97 / 10.0).alias("std"), (F.col("cls") * 4).alias("num"), (F.col("mask") == 0).alias("cloudy"))


def smoothed(r: int) -> str:
    return f"""f AS (SELECT row, col, CASE WHEN valid THEN base ELSE m END AS base, CASE WHEN valid THEN daily ELSE m END AS daily FROM b, (SELECT avg(base) AS m FROM b WHERE valid) q),
s AS (SELECT c.row, c.col, avg(s.base) AS base, avg(s.daily) AS daily FROM f c, ({disk(r)}) o JOIN f s ON s.row = {fold('c.row+o.i', NR)} AND s.col = {fold('c.col+o.j', '100')} GROUP BY 1, 2)"""


@query("out1_outage_logdiff", f"""
WITH {BANDS}, {smoothed(2)}, d AS ({window('s', BOX3, 'base')}), n AS (SELECT row, col, stddev_pop(v) AS sd FROM d GROUP BY 1, 2),
z AS (SELECT row, col, CASE WHEN valid THEN s.daily-s.base END AS ld, CASE WHEN valid THEN (s.daily-s.base)/greatest(sd/exp(s.base), 15e-2) END AS z FROM b JOIN s USING (row, col) JOIN n USING (row, col))
SELECT row, col, round(ld, 6) AS log_diff, round(z, 5) AS z_score, coalesce(ld < ln(5e-1) AND z < -2, false) AS outage FROM z""")
def out1(t: Tables):
    return _rounded(_rounded(outage.outage_logdiff(_bands(t), t.nrows, 100), "log_diff"), "z_score", digits=5)


@query("out2_outage_zscore", f"""
WITH {BANDS}, r AS (SELECT *, daily-base-m AS rest FROM b, (SELECT quantile_cont(daily-base, 0.5) AS m FROM b WHERE valid) q), z AS (SELECT *, rest/greatest(std/exp(base), 15e-2) AS z FROM r)
SELECT row, col, round(CASE WHEN valid THEN z END, 6) AS z_score, CASE WHEN NOT valid THEN 0 WHEN rest < -7e-1 OR z < -3 THEN 2 WHEN rest < -3e-1 OR z < -2 THEN 1 ELSE 0 END AS health FROM z""")
def out2(t: Tables):
    return _rounded(outage.outage_zscore(_bands(t)), "z_score")


@query("out2_confirmed_outages", f"""
WITH {BANDS}, r AS (SELECT *, daily-base-m AS rest FROM b, (SELECT quantile_cont(daily-base, 0.5) AS m FROM b WHERE valid) q),
h AS (SELECT row, col FROM r WHERE valid AND (rest < -7e-1 OR rest/greatest(std/exp(base), 15e-2) < -3))
SELECT DISTINCT a.row, a.col FROM h a JOIN h b ON (abs(a.row-b.row) = 1 AND a.col = b.col) OR (a.row = b.row AND abs(a.col-b.col) = 1)""")
def out2_confirmed(t: Tables):
    return outage.confirmed_outages(outage.outage_zscore(_bands(t)), 100)


@query("out3_outage_confidence", f"""
WITH {BANDS}, {smoothed(1)}, z AS (SELECT b.*, CASE WHEN valid THEN s.daily-s.base END AS ld FROM b JOIN s USING (row, col)),
h AS (SELECT *, CASE WHEN ld < ln(1-8e1/100) THEN 2 WHEN ld < ln(1-5e1/100) THEN 1 ELSE 0 END AS health FROM z)
SELECT row, col, round(ld, 6) AS log_diff, health, round(CASE WHEN health = 2 THEN least(1, abs(ld)/greatest(std, 5e-2)/3)*least(1, num/15e0)*CASE WHEN cloudy THEN 0e0 ELSE 1e0 END ELSE 0e0 END, 6) AS confidence FROM h""")
def out3(t: Tables):
    return _rounded(outage.outage_confidence(_bands(t), t.nrows, 100), "log_diff", "confidence")


@query("foc5_ssim_gauss", f"""
WITH v AS (SELECT row, col, value/1e7 AS a, value/1e7*(1-cls/1e1) AS b FROM px), k AS (SELECT CAST(range-5 AS INTEGER) AS i, exp(-5e-1*power((range-5)/15e-1, 2)) AS w FROM range(11)),
o AS MATERIALIZED (SELECT x.i, y.i AS j, x.w*y.w/power((SELECT sum(w) FROM k), 2) AS w FROM k x, k y), n AS MATERIALIZED (SELECT {NR} AS n),
c AS MATERIALIZED (SELECT row, col, {fold('row+i', 'n')} AS r2, {fold('col+j', '100')} AS c2, w FROM v, o, n),
s AS (SELECT c.row, c.col, sum(w*a) AS ma, sum(w*b) AS mb, sum(w*a*a) AS aa, sum(w*b*b) AS bb, sum(w*a*b) AS ab FROM c JOIN v ON v.row = r2 AND v.col = c2 GROUP BY 1, 2)
SELECT row, col, round((2*ma*mb+144e-4)*(2*(ab-ma*mb)+1296e-4)/((ma*ma+mb*mb+144e-4)*(greatest(aa-ma*ma, 0)+greatest(bb-mb*mb, 0)+1296e-4)), 6) AS value FROM s""")
def foc5b(t: Tables):
    bands = t.px.select("row", "col", (F.col("value") / 1e7).alias("a"), (F.col("value") / 1e7 * (1 - F.col("cls") / 10.0)).alias("b"))
    assert abs(sum(K.gaussian(1.5, 3.5).values()) - 1) < 1e-9
    return _rounded(O.ssim(bands, t.nrows, 100, "a", "b", gauss=True), "value")
