"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time; its integral gives the source's share. The
cumulative token demand of a source is inverted to place each of its documents at a training
position, and documents are range-sorted by position. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoexposure.llm.shared import bounded, keep

WEIGHTS = (1, 2, 3)
#: Slope of the weight schedule of each source, repeating as the weights do: weight 1 falls over training time, weight 3 rises.
SLOPES = (-0.5, 0.0, 0.5)
#: No source is repeated more often than this.
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(totals: DataFrame) -> DataFrame:
    """Targets of the sources by weight, none above ``MOST`` times its size.

    ``totals``: _null, _source, source_size. The shares that stop at their cap come first in the order
    of cap per weight, so one pass over running sums finds the level at which the rest stops.
    The table has a row for each source.
    """
    by_name = Window.orderBy("_null", "_source")
    by_cap = Window.orderBy("_cap_each", "_null", "_source")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), ((F.col("_rank") - 1) % len(values) + 1).cast("int"))
    everything = Window.partitionBy()
    ranked = totals.withColumn("_rank", F.row_number().over(by_name))
    ranked = ranked.select("*", pick(WEIGHTS).cast("long").alias("_weight"), pick(SLOPES).cast("double").alias("_slope"), (F.col("source_size") * MOST).alias("_cap"))
    ranked = ranked.withColumn("_cap_each", F.col("_cap") / F.col("_weight"))
    ranked = ranked.select(
        "*",
        F.row_number().over(by_cap).alias("_at"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_left"),
        F.sum("_weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)).alias("_weights"),
    )
    stops = F.when(F.col("_left") / F.col("_weights") <= F.col("_cap_each"), F.struct("_at", "_left", "_weights"))
    ranked = ranked.withColumn("_level", F.min(stops).over(everything))
    level = (F.col("_weight") * F.col("_level._left")) / F.col("_level._weights")
    target = F.when(F.col("_at") < F.col("_level._at"), F.col("_cap").cast("double")).otherwise(level.cast("double"))
    return ranked.select("_null", "_source", "source_size", "_slope", target.alias("target"))


def mix(docs: DataFrame, size: str = "_size", source: str = "source", doc_id: str = "doc_id", tie: Column | None = None) -> DataFrame:
    """Add source_size, target, taken, copies and position to the rows of ``docs``, which has a column of sizes.

    Within a source, documents follow each other by the md5 of their id, then by size, then by ``tie`` (of rows that tie in all of these
    any may come first; without it those are rows of one id and size, whose sums are the same either way); whole passes over
    the source are taken first, then as many words of a further pass as the target asks for. Sums within a
    source run in two levels (4096 ranges of the md5, then rows within a range), so a source that holds
    a third of all rows is spread over many tasks. Rows without id or source are a document and a source
    like any other (null source last); a repeated row is taken like another document; sizes of zero take
    nothing; very long texts count whole; an empty table gives an empty table. Names that start with an underscore are taken by this function.
    """
    order = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    rows = docs.select("*", F.col(source).isNull().alias("_null"), F.coalesce(F.col(source), F.lit("")).alias("_source"), order.alias("_order"), F.substring(order, 1, 3).alias("_range"))
    ranges = keep(rows.groupBy("_null", "_source", "_range").agg(F.sum(size).alias("_range_size")), "mix-ranges")
    totals = ranges.groupBy("_null", "_source").agg(F.sum("_range_size").alias("source_size"))
    goals = keep(targets(totals), "mix-targets")
    before = Window.partitionBy("_null", "_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_null", "_source", "_range", F.coalesce(F.sum("_range_size").over(before), F.lit(0)).alias("_range_before"))
    inside = Window.partitionBy("_null", "_source", "_range").orderBy("_order", size, F.lit(0) if tie is None else tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_row_before", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    rows = rows.join(ranges, ["_null", "_source", "_range"]).join(bounded(goals), ["_null", "_source"])
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    rows = rows.withColumn("_passes", F.least(passes, F.lit(MOST)).cast("long")).withColumn("_before", F.col("_range_before") + F.col("_row_before"))
    rest = F.round(F.col("target") - F.col("_passes") * F.col("source_size")).cast("long")
    rows = rows.withColumn("_extra", F.greatest(F.lit(0), F.least(F.col(size), rest - F.col("_before"))))
    more = (F.col("_extra") > 0) & (F.col("_extra") * 2 >= F.col(size))
    rows = rows.select("*", (F.col("_passes") * F.col(size) + F.col("_extra")).alias("taken"), (F.col("_passes") + more.cast("long")).alias("copies"))
    return rows.withColumn("position", position(F.lit(0), F.col(size)))


def position(turn: Column, size: Column) -> Column:
    """Training time from 0 to 1 at which the middle of a document is due in its ``turn``-th repetition.

    With the schedule 1 - a + 2at the demand up to time t is ((1 - a)t + at²) of the target; this inverts it.
    """
    due = F.least(F.lit(1.0), F.coalesce(F.try_divide(turn * F.col("source_size") + F.col("_before") + size / 2.0, F.col("target")), F.lit(1.0)))
    a = F.col("_slope")
    return due * 2.0 / ((1.0 - a) + F.sqrt((1.0 - a) * (1.0 - a) + a * 4.0 * due))


def mixed_report(docs: DataFrame) -> DataFrame:
    """Of each document its size, its source's size and target, and the words that the mix takes."""
    light = docs.select("doc_id", "source", word_count(F.col("text")).alias("_size"))
    light = keep(light, "mix-sizes")
    return mix(light).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", "copies", "position")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The documents as training reads them: each as often as the mix takes it, range-sorted by training position."""
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("_size"), F.xxhash64("text").alias("_tie"))
    rows = mix(packed, tie=F.col("_tie")).where("copies > 0")
    rows = rows.withColumn("_turn", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    rows = rows.withColumn("_position", position(F.col("_turn"), F.col("_size")))
    return rows.orderBy("_position", "_order", "_tie", "_turn").select("row.*")


REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, (rk - 1) % 3 + 1 AS weight, ((rk - 1) % 3 - 1) * 5e-1 AS slope, 3 * source_size AS cap,
             CAST(3 * source_size AS DOUBLE) / ((rk - 1) % 3 + 1) AS cap_each FROM s),
r AS (SELECT *, row_number() OVER o AS pos, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w WINDOW o AS (ORDER BY cap_each, source NULLS LAST)),
l AS (SELECT pos AS lpos, CAST(rest AS DOUBLE) AS lrest, CAST(weights AS DOUBLE) AS lweights FROM r
      WHERE CAST(rest AS DOUBLE) / CAST(weights AS DOUBLE) <= cap_each ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, slope, CASE WHEN pos < lpos THEN CAST(cap AS DOUBLE) ELSE weight * lrest / lweights END AS target FROM r, l),
b AS (SELECT d.doc_id, d.size, t.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CASE WHEN t.source_size = 0 THEN 0 ELSE least(floor(t.target / t.source_size), 3) END AS passes
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, greatest(0, least(size, CAST(round(target - passes * source_size) AS BIGINT) - before)) AS extra FROM b),
f AS (SELECT *, CASE WHEN target = 0 THEN 1e0 ELSE least(1e0, (before + size / 2e0) / target) END AS due FROM e)
SELECT doc_id, size, source_size, target, CAST(passes * size + extra AS BIGINT) AS taken,
       CAST(passes + CASE WHEN extra > 0 AND extra * 2 >= size THEN 1 ELSE 0 END AS BIGINT) AS copies,
       due * 2e0 / ((1e0 - slope) + sqrt((1e0 - slope) * (1e0 - slope) + slope * 4e0 * due)) AS position FROM f
"""
