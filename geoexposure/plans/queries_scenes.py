"""Queries of scene selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoexposure.operators import scenes as S
from geoexposure.plans.fixtures import Tables
from geoexposure.plans.registry import query

DAYS = "abs(date_diff('second', TIMESTAMP '2024-01-15', ts))/864e2"


def _days():
    return F.abs(F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-15 00:00:00"))) / 86400.0


@query("scn2_best_scenes", f"""
SELECT scene_id, tile, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY score DESC, scene_id) AS rank FROM (
  SELECT scene_id, tile, round(100/3e0*(exp(-{DAYS}/3e0)+(1-cloud/1e2)+coverage/1e2), 3) AS score FROM scenes) s) q WHERE rank <= 6""")
def scn2(t: Tables):
    scored = t.scenes.withColumn("score", S.quality_score(_days(), F.col("cloud"), F.col("coverage")))
    return S.best_scenes(scored, 6).select("scene_id", "tile", "rank")


@query("scn3_expand_until_found", """
WITH s AS (SELECT tile, greatest(0, coverage - 30) AS d FROM scenes WHERE cloud < 20 OR coverage > 90),
c AS (SELECT tile, CAST(ceil(d/7e0) AS INTEGER) AS k, count(*) AS n FROM s GROUP BY 1, 2), r AS (SELECT tile, k, sum(n) OVER (PARTITION BY tile ORDER BY k) AS have FROM c)
SELECT tile, min(CASE WHEN have >= 6 THEN k END) AS steps FROM r GROUP BY 1""")
def scn3(t: Tables):
    some = t.scenes.where("cloud < 20 OR coverage > 90").select("tile", F.greatest(F.lit(0), F.col("coverage") - 30).alias("days_outside"))
    return S.expand_until_found(some, 6)


COVER_CELLS = "SELECT tile, scene_id, (coverage + i) % 101 AS cell, d FROM (SELECT *, CAST(floor(abs(date_diff('second', TIMESTAMP '2024-01-15', ts))/864e2) AS BIGINT)*20 + cloud % 7 AS d FROM scenes WHERE cloud % 3 = 0) s, (SELECT range AS i FROM range(40)) r"


@query("scn3_expand_until_covered", f"""
WITH c AS ({COVER_CELLS}), s AS (SELECT tile, scene_id, CAST(ceil(greatest(0, min(d) - 30)/7e0) AS INTEGER) AS k FROM c GROUP BY 1, 2), n AS (SELECT * FROM s WHERE k <= 52),
f AS (SELECT c.tile, cell, min(k) AS k FROM c JOIN n ON c.tile = n.tile AND c.scene_id = n.scene_id WHERE cell < 80 GROUP BY 1, 2), k AS (SELECT DISTINCT tile, k FROM n),
r AS (SELECT k.tile, k.k, (SELECT count(*) FROM n WHERE n.tile = k.tile AND n.k <= k.k) AS have, (SELECT count(*) FROM f WHERE f.tile = k.tile AND f.k <= k.k)*100e0/80 AS pct FROM k),
o AS (SELECT tile, min(CASE WHEN pct >= 99.99e0 OR have = 6 THEN k END) AS steps, max(k) AS far FROM r GROUP BY 1)
SELECT t.tile, steps, coalesce(have, 0) AS candidates, round(coalesce(pct, 0e0), 6) AS covered FROM (SELECT DISTINCT tile FROM c) t LEFT JOIN o ON t.tile = o.tile LEFT JOIN r ON r.tile = t.tile AND r.k = coalesce(steps, far)""")
def scn3_cover(t: Tables):
    days = F.floor(_days()).cast("long") * 20 + F.col("cloud") % 7
    some = t.scenes.where("cloud % 3 = 0").select("tile", "scene_id", "coverage", F.greatest(F.lit(0), days - 30).alias("days_outside"))
    cells = some.select("tile", "scene_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: (F.col("coverage") + i) % 101)).alias("cell"))
    area = some.select("tile").distinct().select("tile", F.explode(F.sequence(F.lit(0), F.lit(79))).alias("cell"))
    return S.expand_until_covered(some, cells, area).withColumn("covered", F.round("covered", 6))


@query("scn4_latest_available_month", """
SELECT id, month, max(m) AS found FROM (SELECT DISTINCT user_id AS id, CAST(date_trunc('month', DATE '1995-03-01' + CAST(user_id*13 AS INTEGER)) AS DATE) AS month FROM events) w
LEFT JOIN (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders) h ON m <= month AND m >= month - INTERVAL 3 MONTH GROUP BY 1, 2""")
def scn4(t: Tables):
    wanted = t.events.select(F.col("user_id").alias("id")).distinct().select("id", F.trunc(F.date_add(F.lit("1995-03-01").cast("date"), (F.col("id") * 13).cast("int")), "month").alias("month"))
    months = t.orders.select(F.trunc("o_orderdate", "month").alias("month"))
    return S.latest_available_month(wanted, months)


CELLS = "SELECT tile, rank, (cell0 + i) % 101 AS cell FROM (SELECT tile, row_number() OVER (PARTITION BY tile ORDER BY cloud, scene_id) AS rank, coverage AS cell0 FROM scenes) s, (SELECT range AS i FROM range(30)) r"


def _cells(t: Tables):
    ranked = t.sql("SELECT tile, row_number() OVER (PARTITION BY tile ORDER BY cloud, scene_id) AS rank, coverage AS cell0 FROM {scenes}")
    return ranked.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(29)))).select("tile", "rank", ((F.col("cell0") + F.col("i")) % 101).alias("cell"))


@query("scn5_greedy_cover", f"""
SELECT tile, rank, added FROM (SELECT tile, rank, count(*) AS added, row_number() OVER (PARTITION BY tile ORDER BY rank) AS n FROM (SELECT tile, cell, min(rank) AS rank FROM ({CELLS}) c WHERE cell < 60 GROUP BY 1, 2) o GROUP BY 1, 2) q WHERE n <= 10""")
def scn5(t: Tables):
    # The area of interest is a tile's first 60 cells; in scn5_greedy_cover_all it is the whole tile.
    area = t.scenes.select("tile").distinct().select("tile", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("cell"))
    return S.greedy_cover(_cells(t), target=area).select("tile", F.col("rank").cast("long").alias("rank"), "added")


@query("scn5_greedy_cover_all", f"""
SELECT tile, rank, added FROM (SELECT tile, rank, count(*) AS added, row_number() OVER (PARTITION BY tile ORDER BY rank) AS n FROM (SELECT tile, cell, min(rank) AS rank FROM ({CELLS}) c GROUP BY 1, 2) o GROUP BY 1, 2) q WHERE n <= 10""")
def scn5_all(t: Tables):
    return S.greedy_cover(_cells(t)).select("tile", F.col("rank").cast("long").alias("rank"), "added")


@query("scn6_prune_similar", f"""
WITH m AS (SELECT tile, rank, bit_or(CAST(1 AS HUGEINT) << CAST(cell AS INTEGER)) AS own FROM ({CELLS}) c GROUP BY 1, 2),
w AS (SELECT tile, rank, own AS cover, true AS kept FROM m WHERE rank = 1
  UNION ALL SELECT tile, rank, CASE WHEN k THEN cover | own ELSE cover END, k FROM (SELECT m.tile, m.rank, own, cover, bit_count(own & cover)*1e0/bit_count(own | cover) <= 5e-1 AS k FROM w JOIN m ON m.tile = w.tile AND m.rank = w.rank + 1) q)
SELECT tile, CAST(rank AS INTEGER) AS rank FROM w WHERE kept""")
def scn6(t: Tables):
    return S.prune_similar(_cells(t))


@query("scn7_minimum_cover")
def scn7(t: Tables):
    cells = t.scenes.select((F.col("scene_id") % 12).alias("granule"), (F.col("scene_id") * 7 % 499).alias("cell")).distinct()
    return S.minimum_cover(cells, t.scenes.select((F.col("scene_id") % 499).alias("cell")).distinct(), most=None)


@query("scn7_minimum_covers", """
WITH w AS (SELECT DISTINCT tile, cell FROM (SELECT tile, (coverage*3) % 31 AS cell FROM scenes) q), g AS (SELECT DISTINCT tile, scene_id % 7 AS g, (scene_id*7 + coverage) % 31 AS cell FROM scenes),
s AS (SELECT tile, cell, CAST(sum(CAST(power(2, 6-g) AS INTEGER)) AS INTEGER) AS bits FROM g JOIN w USING (tile, cell) GROUP BY 1, 2), m AS (SELECT CAST(range AS INTEGER) AS m FROM range(1, 128)),
c AS (SELECT tile, m, count(*) AS covered FROM s, m WHERE (bits & m) <> 0 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY covered DESC, bit_count(m), m DESC) AS n FROM c)
SELECT b.tile, array_to_string([g FOR g IN range(0, 7) IF (m >> CAST(6-g AS INTEGER)) & 1 = 1], ',') AS ids, CAST(covered AS INTEGER) AS covered, round(covered*1e2/total, 6) AS pct
FROM b JOIN (SELECT tile, count(*) AS total FROM w GROUP BY 1) t ON t.tile = b.tile WHERE n = 1""")
def scn7_boxes(t: Tables):
    cells = t.scenes.select("tile", (F.col("scene_id") % 7).alias("granule"), ((F.col("scene_id") * 7 + F.col("coverage")) % 31).alias("cell"))
    found = S.minimum_covers(cells, t.scenes.select("tile", (F.col("coverage") * 3 % 31).alias("cell")), "tile")
    return found.select("tile", F.array_join(F.transform("ids", lambda g: g.cast("string")), ",").alias("ids"), "covered", F.round("pct", 6).alias("pct"))


@query("scn8_scene_filter", "SELECT scene_id FROM scenes WHERE coverage > 10 AND cloud < 20 AND scene_id % 3 <> 0")
def scn8(t: Tables):
    assets = F.when(F.col("scene_id") % 3 != 0, F.array(*map(F.lit, ("B02", "B03", "B04")))).otherwise(F.array(F.lit("B02")))
    rows = t.scenes.select("scene_id", "cloud", F.col("coverage").alias("overlap"), assets.alias("assets"))
    return S.scene_filter(rows, 10, 20, ["B02", "B04"]).select("scene_id")


@query("scn10_match_minute", "SELECT p.event_id AS pass_id, f.event_id AS file_id FROM events p JOIN events f ON p.event_id % 2 = 0 AND f.event_id % 2 = 1 AND abs(epoch(p.ts)-epoch(f.ts)) <= 60")
def scn10b(t: Tables):
    rows = t.events.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    passes, files = rows.where("event_id % 2 = 0").toDF("pass_id", "t"), rows.where("event_id % 2 = 1").toDF("file_id", "ft")
    return S.match_minute(passes, files).select("pass_id", "file_id")


@query("ord2_rank_granules", """
SELECT scene_id AS granule, CAST(CASE WHEN cloud = 0 THEN trunc(e/9e1*100) ELSE trunc(4e-1*trunc(e/9e1*100) + 6e-1*(100-cloud)) END AS INTEGER) AS rank_score FROM (SELECT *, coverage % 91 AS e FROM scenes) s""")
def ord2(t: Tables):
    rows = t.scenes.select(F.col("scene_id").alias("granule"), (F.col("coverage") % 91).alias("elevation"), F.when(F.col("cloud") != 0, F.col("cloud")).alias("cloud"))
    return S.rank_granules(rows).select("granule", "rank_score")


@query("ord3_top_scene_per_tile", "SELECT tile, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY coverage >= 100 DESC, cloud, ts DESC, scene_id) AS n FROM scenes) q WHERE n = 1")
def ord3(t: Tables):
    return S.top_scene_per_tile(t.scenes).select("tile", "scene_id")


@query("agg18_complete_tile_set", """
SELECT day, min(product) AS product FROM (SELECT CAST(ts AS DATE) AS day, event_type AS product, count(DISTINCT user_id % 12) AS n, count(DISTINCT hour(ts) // 24) AS s FROM events GROUP BY 1, 2) q WHERE n = 12 AND s = 1 GROUP BY 1""")
def agg18(t: Tables):
    files = t.events.select(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("product"), (F.col("user_id") % 12).alias("tile"), F.floor(F.hour("ts") / 24).alias("ts"))
    return S.complete_tile_set(files, 12)


@query("agg18_complete_tile_set_by_route", """
WITH f AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN event_id % 2 = 0 THEN 'A1' ELSE 'A2' END AS level, CASE WHEN event_id % 5 < 2 THEN 'bulk' ELSE 'api' END AS route, event_type AS product, user_id % 12 AS tile,
  CASE WHEN event_id % 5 < 2 AND CAST(day(ts) AS INTEGER) % 3 = 0 THEN hour(ts) ELSE 0 END AS ts FROM events),
s AS (SELECT day, level, route, product, count(DISTINCT tile) AS n, count(DISTINCT ts) AS k, min(ts) AS ts FROM f GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY day, level, route ORDER BY product) AS i FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY day, level ORDER BY CASE route WHEN 'bulk' THEN 1 ELSE 2 END) AS j FROM p WHERE i = 1 AND n = 12 AND k = 1)
SELECT day, level, route, product, CAST(ts AS INTEGER) AS ts, level = max(level) OVER (PARTITION BY day) AS first FROM r WHERE j = 1""")
def agg18_by_route(t: Tables):
    bulk = F.col("event_id") % 5 < 2
    files = t.events.select(
        F.col("ts").cast("date").alias("day"), F.when(F.col("event_id") % 2 == 0, "A1").otherwise("A2").alias("level"), F.when(bulk, "bulk").otherwise("api").alias("route"), F.col("event_type").alias("product"),
        (F.col("user_id") % 12).alias("tile"), F.when(bulk & (F.dayofmonth("ts") % 3 == 0), F.hour("ts")).otherwise(0).alias("ts"),
    )
    return S.complete_tile_set_by_route(files, 12, ["A2", "A1"], ["bulk", "api"])
