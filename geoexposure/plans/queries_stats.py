"""Queries of series, groups, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoexposure.operators import graph, layers, stats
from geoexposure.plans.fixtures import Tables
from geoexposure.plans.registry import query


@query("agg10_population_groups", """
WITH p AS (SELECT iso, sex, CASE WHEN age < 15 THEN 'child' WHEN age < 65 THEN 'active' ELSE 'elderly' END AS grp, fid % 7 AS v FROM feats)
SELECT iso, sex, grp, CAST(sum(v) AS BIGINT) AS value FROM p GROUP BY 1, 2, 3 UNION ALL SELECT iso, sex, NULL, CAST(sum(v) AS BIGINT) FROM p GROUP BY 1, 2
UNION ALL SELECT iso, NULL, grp, CAST(sum(v) AS BIGINT) FROM p GROUP BY 1, 3 UNION ALL SELECT iso, NULL, NULL, CAST(sum(v) AS BIGINT) FROM p GROUP BY 1""")
def agg10(t: Tables):
    return stats.population_groups(t.feats, ["iso"], F.col("fid") % 7)


@query("agg13_growth_rate", "SELECT iso3, round(regr_slope(ln(pop), yr), 9) AS rate FROM series GROUP BY 1 HAVING count(*) >= 2")
def agg13(t: Tables):
    return stats.growth_rate(t.series).where("rate IS NOT NULL").withColumn("rate", F.round("rate", 9))


@query("agg14_project_population", """
SELECT iso3, CAST(trunc(p*power(1+r, 2030-y)) AS BIGINT) AS pop, round(CAST(trunc(p*power(1+r, 2030-y)) AS DOUBLE)/e, 9) AS coefficient FROM (SELECT iso3, arg_max(pop, yr) AS p, max(yr) AS y, regr_slope(ln(pop), yr) AS r, max(CASE WHEN yr = 1995 THEN pop END) AS e FROM series GROUP BY 1) q""")
def agg14(t: Tables):
    series = t.series
    return stats.project_population(series, 2030).join(stats.growth_coefficient(series, 1995, 2030), "iso3").withColumn("coefficient", F.round("coefficient", 9))


@query("agg15_linear_population", "SELECT iso3, round(regr_slope(pop, yr)*2030 + regr_intercept(pop, yr), 4) AS pop FROM series GROUP BY 1")
def agg15(t: Tables):
    return stats.linear_population(t.series, 2030).withColumn("pop", F.round("pop", 4))


@query("agg17_detect_code_column", """
SELECT "column", share FROM (SELECT 'n_name' AS "column", avg(CASE WHEN v IN ('FRANCE','KENYA','A','B') THEN 1e0 ELSE 0e0 END) AS share FROM (SELECT DISTINCT upper(n_name) AS v FROM nation) a
UNION ALL SELECT 'code', avg(CASE WHEN v IN ('FRANCE','KENYA','A','B') THEN 1e0 ELSE 0e0 END) FROM (SELECT DISTINCT upper(CASE WHEN n_nationkey % 3 = 0 THEN 'a' WHEN n_nationkey % 3 = 1 THEN 'b' ELSE 'c' END) AS v FROM nation) b) q ORDER BY 2 DESC, 1 LIMIT 1""")
def agg17(t: Tables):
    code = F.element_at(F.array(*map(F.lit, "abc")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return stats.detect_code_column(t.nation.select("n_nationkey", "n_name", code.alias("code")), ["FRANCE", "KENYA", "A", "B"])


@query("agg22_extent_by_code", """
SELECT CAST(iso AS VARCHAR) AS iso3, min(x-side/2) AS xmin, min(y-side/2) AS ymin, max(x+side/2) AS xmax, max(y+side/2) AS ymax FROM feats GROUP BY 1
UNION ALL SELECT 'all', min(x-side/2), min(y-side/2), max(x+side/2), max(y+side/2) FROM feats""")
def agg22(t: Tables):
    boxes = t.feats.selectExpr("CAST(iso AS STRING) AS iso3", "x-side/2 AS xmin", "y-side/2 AS ymin", "x+side/2 AS xmax", "y+side/2 AS ymax")
    return stats.extent_by_code(boxes).unionByName(stats.extent_by_code(boxes, None).withColumn("iso3", F.lit("all")))


@query("set1_append_layer", "SELECT fid, iso, CASE WHEN sex = 0 THEN side END AS side, CASE WHEN sex = 1 THEN age END AS age FROM feats")
def set1(t: Tables):
    return layers.append_layer(t.feats.where("sex = 0").select("fid", "iso", "side"), t.feats.where("sex = 1").select("fid", "iso", "age"))


@query("set2_dedupe_ids", "SELECT DISTINCT tile AS id FROM scenes WHERE cloud < 50 OR coverage > 40")
def set2(t: Tables):
    a, b = t.scenes.where("cloud < 50").select(F.col("tile").alias("id")), t.scenes.where("coverage > 40").select(F.col("tile").alias("id"))
    return layers.dedupe_ids(a, b)


EXPECTED = "SELECT DISTINCT user_id AS tile FROM {events}"


@query("set3_missing_expected", "SELECT DISTINCT tile FROM scenes WHERE tile NOT IN (SELECT tile FROM scenes WHERE cloud < 1 AND coverage > 60)")
def set3(t: Tables):
    return layers.missing_expected(t.sql(EXPECTED), t.scenes.where("cloud < 1 AND coverage > 60"))


@query("set4_common_tiles", "SELECT DISTINCT tile FROM scenes WHERE cloud < 1 INTERSECT SELECT DISTINCT tile FROM scenes WHERE coverage > 95")
def set4(t: Tables):
    return layers.common_tiles(t.scenes.where("cloud < 1"), t.scenes.where("coverage > 95"))


@query("jn15_compare_barriers", "SELECT sex + 1 AS contour, n, b AS n_barrier, n - b AS n_difference FROM (SELECT sex, count(*) AS n, CASE WHEN sex = 1 THEN count(CASE WHEN age > 40 THEN 1 END) END AS b FROM feats GROUP BY 1) q")
def jn15(t: Tables):
    base = t.feats.groupBy((F.col("sex") + 1).alias("contour")).agg(F.count("*").alias("n"))
    other = t.feats.where("age > 40 AND sex = 1").groupBy((F.col("sex") + 1).alias("contour")).agg(F.count("*").alias("n"))
    return graph.compare_barriers(base, other, ["n"])


@query("win4_disjoint_rings", "SELECT grp, contour, area, area - coalesce(lag(area) OVER (PARTITION BY grp ORDER BY contour), 0) AS ring FROM (SELECT iso AS grp, age // 10 AS contour, sum(fid) OVER (PARTITION BY iso ORDER BY age // 10)*1e0 AS area, row_number() OVER (PARTITION BY iso, age // 10 ORDER BY fid) AS n FROM feats) q WHERE n = 1")
def win4(t: Tables):
    from pyspark.sql import Window

    sums = t.feats.groupBy(F.col("iso").alias("grp"), F.floor(F.col("age") / 10).cast("long").alias("contour")).agg(F.sum("fid").alias("s"))
    areas = sums.select("grp", "contour", F.sum("s").over(Window.partitionBy("grp").orderBy("contour")).cast("double").alias("area"))
    return graph.disjoint_rings(areas)
