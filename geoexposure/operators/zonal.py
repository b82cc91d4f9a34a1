"""Zones and cells: exact cover weights, zonal statistics, masks, shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoexposure.functions import geometry as G

#: Rows of a zone that go to one task together.
BLOCK = 16


def polygon_sides(zones: DataFrame) -> DataFrame:
    """(zone_id, x1, y1, x2, y2): one row for each side of each ring of polygons."""
    rings = zones.select("zone_id", F.explode("geom").alias("_ring"))
    return rings.select("zone_id", F.explode(G.ring_sides(F.col("_ring"))).alias("_side")).select("zone_id", "_side.*")


def zone_runs(zones: DataFrame, nrows: int, ncols: int, block: int = BLOCK) -> DataFrame:
    """(zone_id, row, first, last, w): the area fraction of the unit grid's cells that a zone's polygon covers, as runs of cells of a row that have the same.

    Rings may be wound either way. Sides are cut at the grid lines. A piece covers its own cell to its right and all cells further right, by its signed
    height, so a running sum along a row gives the weights. No geometry is copied: what is shuffled are the cells that sides cross, by
    zone and ``block`` rows, and what lies inside between two of them is one run.
    """
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    met = (y1 != y2) & (F.greatest(y1, y2) > 0) & (F.least(y1, y2) < nrows) & (F.least(x1, x2) < ncols)
    cut = lambda t, x, y: F.struct(t.alias("t"), x.alias("x"), y.alias("y"))
    lines = lambda a, b, n: G.between(F.greatest(F.lit(0.0), F.least(a, b)), F.least(F.lit(float(n)), F.greatest(a, b)))
    across = F.when(x1 != x2, lines(x1, x2, ncols)).otherwise(F.array().cast("array<long>"))
    upright = F.transform(across, lambda v: cut((v - x1) / (x2 - x1), v.cast("double"), y1 + (y2 - y1) * ((v - x1) / (x2 - x1))))
    level = F.transform(lines(y1, y2, nrows), lambda v: cut((v - y1) / (y2 - y1), x1 + (x2 - x1) * ((v - y1) / (y2 - y1)), v.cast("double")))
    cuts = F.array_sort(F.concat(F.array(cut(F.lit(0.0), x1, y1), cut(F.lit(1.0), x2, y2)), upright, level))
    sides = polygon_sides(zones.select("zone_id", G.oriented(F.col("geom")).alias("geom"))).where(met).select("zone_id", cuts.alias("_cuts"))
    middle = lambda p, q: F.struct(((p["x"] + q["x"]) / 2).alias("x"), ((p["y"] + q["y"]) / 2).alias("y"), (q["y"] - p["y"]).alias("h"))
    pieces = sides.select("zone_id", F.explode(G.steps(F.col("_cuts"), middle)).alias("_p")).select("zone_id", "_p.*")
    pieces = pieces.where((F.col("h") != 0) & (F.col("y") >= 0) & (F.col("y") < nrows) & (F.col("x") < ncols))
    own = F.when(F.col("x") >= 0, F.col("h") * (1 - (F.col("x") - F.floor("x")))).otherwise(0.0)
    pieces = pieces.select("zone_id", F.floor("y").cast("int").alias("row"), F.greatest(F.lit(-1), F.floor("x")).cast("int").alias("col"), own.alias("own"), "h")
    keys = ["zone_id", "_block", "row"]
    crossed = pieces.withColumn("_block", F.floor(F.col("row") / block)).repartition("zone_id", "_block").groupBy(*keys, "col").agg(F.sum("own").alias("own"), F.sum("h").alias("h"))
    order = Window.partitionBy(*keys).orderBy("col")
    before = F.coalesce(F.sum("h").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    crossed = crossed.select(*keys, "col", "own", "h", before.alias("_before"), F.coalesce(F.lead("col").over(order), F.lit(ncols)).alias("_next"))
    run = lambda first, last, w: F.struct(first.alias("first"), last.alias("last"), F.least(F.lit(1.0), F.abs(w)).alias("w"))
    runs = F.array(run(F.col("col"), F.col("col"), F.col("own") + F.col("_before")), run(F.col("col") + 1, F.col("_next") - 1, F.col("_before") + F.col("h")))
    # A sum that rounds to nothing is no cover.
    runs = F.filter(runs, lambda r: (r["first"] <= r["last"]) & (r["last"] >= 0) & (r["w"] >= 1e-12))
    found = crossed.select("zone_id", "row", F.explode(runs).alias("_run"))
    return found.select("zone_id", "row", F.greatest(F.lit(0), "_run.first").alias("first"), F.col("_run.last").alias("last"), "_run.w")


def zone_cell_weights(zones: DataFrame, nrows: int, ncols: int, block: int = BLOCK) -> DataFrame:
    """(zone_id, row, col, w): the runs of ``zone_runs`` cell by cell."""
    runs = zone_runs(zones, nrows, ncols, block)
    return runs.select("zone_id", "row", F.explode(F.sequence("first", "last")).alias("col"), "w")


#: Raster operators by name: the parts of a block of cells that they need (sum, number, least, most of the values), and the result from the parts and weights of blocks.
RASTER_OPS = {
    "sum": (("s",), lambda s, w: F.coalesce(F.sum(s * w), F.lit(0.0))),
    "mean": (("s", "n"), lambda s, n, w: F.try_divide(F.sum(s * w), F.sum(F.when(n > 0, n * w)))),
    "count": (("n",), lambda n, w: F.coalesce(F.sum(n * w), F.lit(0.0))),
    "min": (("least",), lambda least, w: F.min(least)),
    "max": (("most",), lambda most, w: F.max(most)),
}
_PARTS = {"s": "sum", "n": "sum", "least": "min", "most": "max"}
#: A block of cells has FAN blocks of the level below, and there are so many levels above cells.
FAN, LEVELS = 16, 4


def raster_op(name: str):
    """The raster operator of a name; unknown names raise."""
    if name not in RASTER_OPS:
        raise ValueError(f"unknown raster operator {name!r}; known: {', '.join(RASTER_OPS)}")
    return RASTER_OPS[name]


def block_pyramid(cells: DataFrame, parts: dict[str, tuple[str, Column]], by: tuple[str, ...] = ()) -> DataFrame:
    """(level, row, block, ``by``, parts): what ``parts`` (name -> kind, value) are of each cell (level 0), and what they sum up to in each block of FAN ** level cells of a row.

    Cells are summed up to the first level on the map side; the levels above come from it.
    """
    single = cells.select(F.lit(0).alias("level"), "row", F.col("col").cast("long").alias("block"), *by, *[_one(k, v).alias(n) for n, (k, v) in parts.items()])
    again = [F.expr(f"{_PARTS[k]}({n}) AS {n}") for n, (k, _) in parts.items()]
    first = single.groupBy("row", F.expr(f"floor(block / {FAN}) AS block"), *by).agg(*again)
    above = ", ".join(f"struct({k} AS level, floor(block / {FAN ** (k - 1)}) AS block)" for k in range(1, LEVELS + 1))
    blocks = first.selectExpr("row", *by, *parts, f"inline(array({above})) AS (level, _block)").withColumnRenamed("_block", "block")
    return single.unionByName(blocks.groupBy("level", "row", "block", *by).agg(*again))


def run_blocks(runs: DataFrame) -> DataFrame:
    """(zone_id, row, level, block, w): runs (first, last) as the fewest blocks that make them up: a run of n cells is some 30 blocks for each factor of FAN in n, not n rows."""
    # What is left at each level, [l, h) in its blocks: the ends that don't fill a block of the next level are taken, the rest goes up.
    span = lambda a, b, k: f"IF({a} < {b}, transform(sequence({a}, {b} - 1), v -> struct({k} AS level, v AS block)), CAST(array() AS array<struct<level:int,block:bigint>>))"
    out, pairs = runs.selectExpr("zone_id", "row", "w", "CAST(first AS BIGINT) AS l0", "CAST(last AS BIGINT) + 1 AS h0"), []
    for k in range(LEVELS):
        up, down = f"least(h{k}, CAST(ceil(l{k} / {FAN}) AS BIGINT) * {FAN})", f"CAST(floor(h{k} / {FAN}) AS BIGINT) * {FAN}"
        pairs += [span(f"l{k}", up, k), span(f"greatest({up}, {down})", f"h{k}", k)]
        out = out.selectExpr("*", f"CAST(ceil(l{k} / {FAN}) AS BIGINT) AS l{k + 1}", f"CAST(floor(h{k} / {FAN}) AS BIGINT) AS h{k + 1}")
    pairs.append(span(f"l{LEVELS}", f"h{LEVELS}", LEVELS))
    return out.selectExpr("zone_id", "row", f"inline(concat({', '.join(pairs)})) AS (level, block)", "w")


def _over_blocks(cells: DataFrame, weights: DataFrame, parts: dict[str, tuple[str, Column]], by: tuple[str, ...] = ()) -> DataFrame:
    """Weights joined with the parts of their cells, or with those of the blocks that make up their runs.

    Both sides are shuffled: Spark takes weights for as small as the zones that they are unfolded from, and would send them to the driver and broadcast them, however many there are.
    """
    if "first" in weights.columns:
        return run_blocks(weights).hint("merge").join(block_pyramid(cells, parts, by), ["row", "level", "block"])
    return weights.hint("merge").join(cells, ["row", "col"]).select("zone_id", "w", *by, *[_one(k, v).alias(n) for n, (k, v) in parts.items()])


def _one(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), 1).otherwise(0) if kind == "n" else value


def zonal_stats(cells: DataFrame, weights: DataFrame, values: dict[str, tuple[str, str, Column | None]]) -> DataFrame:
    """Weighted statistics of cells by zone, all in one pass.

    ``values``: name of the result -> (operator, value column, condition on the cell or None). ``weights`` are runs (``zone_runs``) or single cells
    (``zone_cell_weights``). Runs meet blocks of cells that are summed up beforehand, so what is shuffled of a zone goes with its edge and the logarithm of
    its width, not with its area. Aggregation combines on the map side before it shuffles by zone.
    """
    picked = {n: (raster_op(op), F.col(v) if on is None else F.when(on, F.col(v))) for n, (op, v, on) in values.items()}
    parts, names, shared = {}, {}, {}
    for n, ((kinds, _), v) in picked.items():
        for kind in kinds:
            names[n, kind] = shared.setdefault((kind, str(v)), f"_p{len(shared)}")  # results that need the same part share it
            parts.setdefault(names[n, kind], (kind, v))
    met = _over_blocks(cells, weights, parts)
    return met.groupBy("zone_id").agg(*[of(*[F.col(names[n, k]) for k in kinds], F.col("w")).alias(n) for n, ((kinds, of), _) in picked.items()])


def attach_stats(zones: DataFrame, stats: DataFrame) -> DataFrame:
    """Zones with their statistics; no zone is lost."""
    return zones.join(stats, "zone_id", "left")


def affected_pct(affected: Column, total: Column) -> Column:
    """Share in percent; null where the total is zero."""
    return F.try_divide(affected * 100.0, total)


def class_area(cells: DataFrame, weights: DataFrame, pixel_area: float = 1.0) -> DataFrame:
    """(zone_id, cls, area)."""
    met = _over_blocks(cells, weights, {"_n": ("n", F.lit(1))}, ("cls",))
    return met.groupBy("zone_id", "cls").agg((F.sum(F.col("_n") * F.col("w")) * pixel_area).alias("area"))


def rasterize(zones: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """(zone_id, row, col) of the cells whose centre lies in a zone."""
    box = G.bbox(F.flatten("geom"))
    rows = zones.select("zone_id", "geom", box.alias("_b"))
    span = lambda low, high, n: F.sequence(F.greatest(F.lit(0), F.floor(low).cast("int")), F.least(F.lit(n - 1), F.floor(high).cast("int")))
    rows = rows.where((F.col("_b.xmax") > 0) & (F.col("_b.xmin") < ncols) & (F.col("_b.ymax") > 0) & (F.col("_b.ymin") < nrows))
    rows = rows.withColumn("row", F.explode(span(F.col("_b.ymin"), F.col("_b.ymax"), nrows))).repartition("zone_id", "row")
    rows = rows.withColumn("col", F.explode(span(F.col("_b.xmin"), F.col("_b.xmax"), ncols)))
    return rows.where(G.contains(F.col("geom"), F.col("col") + 0.5, F.col("row") + 0.5)).select("zone_id", "row", "col")
