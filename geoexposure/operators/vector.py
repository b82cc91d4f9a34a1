"""Spatial joins of points, lines and polygons.

Each meets on the numbers of grid cells, an equality that Spark can shuffle or broadcast by, and is then tested exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoexposure.functions import geometry as G
from geoexposure.operators import kernels as K
from geoexposure.operators import zonal
from geoexposure.operators.quantiles import exact_quantile
from geoexposure.sources.workspace import keep


def on_grid(df: DataFrame, points: Column, step: float, grow: float = 0.0) -> DataFrame:
    """Explode rows to the grid cells (_cx, _cy) of width ``step`` that the extent of their points meets, grown by ``grow``."""
    rows = df.withColumn("_box", G.bbox(points))
    rows = rows.withColumn("_cx", F.explode(G.cover(F.col("_box.xmin") - grow, F.col("_box.xmax") + grow, step)))
    return rows.withColumn("_cy", F.explode(G.cover(F.col("_box.ymin") - grow, F.col("_box.ymax") + grow, step))).drop("_box")


def point_cells(df: DataFrame, step: float) -> DataFrame:
    return df.select("*", F.floor(F.col("x") / step).alias("_cx"), F.floor(F.col("y") / step).alias("_cy"))


def point_in_polygon(points: DataFrame, zones: DataFrame, step: float = 16.0) -> DataFrame:
    """Points (x, y) with the zones (geom) that contain them."""
    met = point_cells(points, step).join(on_grid(zones, F.flatten("geom"), step), ["_cx", "_cy"])
    return met.where(G.contains(F.col("geom"), F.col("x"), F.col("y"))).drop("_cx", "_cy")


def read_features(features: DataFrame, zones: DataFrame, step: float = 16.0) -> DataFrame:
    """Features (fid, x, y) that lie in any zone, each once, tagged with the smallest such zone_id."""
    met = point_in_polygon(features, zones.select("zone_id", "geom"), step).drop("geom")
    first = Window.partitionBy("fid").orderBy("zone_id")
    return met.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


#: Share of a cell by which the grid of lines and sides is moved, so that no line of it lies on round coordinates.
SHIFT = 0.3819660112501051
#: Sides of one zone that a cell should hold at most (the grid gets finer where one holds more), and cells of a row whose inner runs are looked up together.
CROWD, RUN = 48, 64
#: What a side is grown by, as a share of a cell, when its cells are listed.
MARGIN = 1e-9


def _number(v: str, step: float) -> str:
    """The number of the interval of the moved grid that ``v`` lies in, as SQL."""
    return f"CAST(floor(({v}) / {step!r}D - {SHIFT!r}D) AS BIGINT)"


def _at(k: str, step: float) -> str:
    """Where interval ``k`` of the moved grid begins, as SQL."""
    return f"(({k}) + {SHIFT!r}D) * {step!r}D"


def _passes(s: str, x: str, y: str) -> tuple[str, str]:
    """Whether the line of side ``s`` passes below a point, and to the right of it, as SQL; the two agree however close it passes."""
    dx, dy = f"({s}x2 - {s}x1)", f"({s}y2 - {s}y1)"
    turn = f"coalesce(nullif({dx} * ({y} - {s}y1) - {dy} * ({x} - {s}x1), 0D), {dx})"
    return f"({turn} * {dx} > 0)", f"({turn} * {dy} > 0)"


def grid_step(zones: DataFrame, step: float) -> float:
    """``step``, halved (ten times at most) until no cell should hold more than CROWD sides of one zone."""
    if (zones.agg(F.max(F.size(F.flatten("geom")))).first()[0] or 0) <= CROWD:
        return step
    sides = zonal.polygon_sides(zones).selectExpr("zone_id", f"{_number('(x1 + x2) / 2', step)} AS cx", f"{_number('(y1 + y2) / 2', step)} AS cy")
    most = sides.groupBy("zone_id", "cx", "cy").count().agg(F.max("count")).first()[0] or 0
    return step / 2 ** min(10, max(0, math.ceil(math.log2(max(1, most) / CROWD))))


def side_index(zones: DataFrame, cells: DataFrame, step: float) -> DataFrame:
    """(cx, cy, zone_id, _odd, _sides): the cells that zones (geom) reach, as far as ``cells`` (cx, cy) names them.

    _sides are the zone's sides in the cell; _odd (0 or 1) tells whether the cell's lower left corner lies inside. It is carried along each row of cells: a
    running sum counts the sides that cross the row's lower line further left, so a cell needs no sides but its own. Cells inside without sides
    are runs until they meet those in ``cells``, by RUN of them.
    """
    grown, low, high = f"{MARGIN * step!r}D", _at("cy", step), _at("cy + 1", step)
    sides = zonal.polygon_sides(zones).where("x1 <> x2 OR y1 <> y2")
    rows = sides.selectExpr("*", f"explode(sequence({_number(f'least(y1, y2) - {grown}', step)}, {_number(f'greatest(y1, y2) + {grown}', step)})) AS cy")
    # Where the side enters and leaves the row, and the cell in whose lower line it crosses.
    end = lambda x, y: f"IF(y1 <> y2, x1 + (x2 - x1) * ((least(greatest({y}, {low}), {high}) - y1) / (y2 - y1)), {x})"
    crosses = f"(y1 > {low}) <> (y2 > {low})"
    rows = rows.selectExpr("zone_id", "cy", "x1", "y1", "x2", "y2", f"{end('x1', 'y1')} AS _a", f"{end('x2', 'y2')} AS _b", f"IF({crosses}, {_number(f'x1 + (x2 - x1) * (({low} - y1) / (y2 - y1))', step)}, NULL) AS _near")
    right_of = lambda k: _passes("", _at(k, step), low)[1]
    hit = f"CASE WHEN NOT {right_of('_near')} THEN _near - 1 WHEN {right_of('_near + 1')} THEN _near + 1 ELSE _near END"  # rounding may miss it by one
    rows = rows.selectExpr("zone_id", "cy", "struct(x1, y1, x2, y2) AS _side", f"{_number(f'least(_a, _b) - {grown}', step)} AS _first", f"{_number(f'greatest(_a, _b) + {grown}', step)} AS _last", f"IF(_near IS NULL, NULL, {hit}) AS _hit")
    listed = rows.selectExpr("zone_id", "cy", "_side", "_hit", "explode(sequence(least(_first, _hit), greatest(_last, _hit))) AS cx").repartition("zone_id", "cy")
    held = listed.groupBy("zone_id", "cy", "cx").agg(F.expr("collect_list(_side) AS _sides"), F.expr("count_if(cx = _hit) AS _hits"))
    order = "OVER (PARTITION BY zone_id, cy ORDER BY cx"
    held = held.selectExpr("*", f"coalesce(sum(_hits) {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before", f"lead(cx) {order}) AS _next")
    index = held.selectExpr("cx", "cy", "zone_id", "_before % 2 AS _odd", "_sides")
    runs = held.where("_next > cx + 1 AND (_before + _hits) % 2 = 1")
    runs = runs.selectExpr("zone_id", "cy", "cx + 1 AS _low", "_next - 1 AS _high", f"explode(sequence(floor((cx + 1) / {RUN}), floor((_next - 1) / {RUN}))) AS _tile")
    inner = cells.selectExpr("cx", "cy", f"floor(cx / {RUN}) AS _tile").join(runs, ["cy", "_tile"]).where("cx BETWEEN _low AND _high")
    return index.unionByName(inner.selectExpr("cx", "cy", "zone_id", "1L AS _odd", "CAST(array() AS array<struct<x1:double,y1:double,x2:double,y2:double>>) AS _sides"))


def line_parts(lines: DataFrame, step: float) -> DataFrame:
    """The segments of lines (fid, geom) cut at the moved grid: fid, _line (the other columns), _segment, x1, y1, x2, y2, _a and _b in shares of the segment, cx, cy."""
    others = [F.col(c) for c in lines.columns if c not in ("fid", "geom")]
    ends = F.expr("posexplode(transform(slice(geom, 1, greatest(size(geom) - 1, 0)), (p, i) -> struct(p.x AS x1, p.y AS y1, get(geom, i + 1).x AS x2, get(geom, i + 1).y AS y2)))")
    segments = lines.select("fid", F.struct(F.lit(0).alias("_"), *others).alias("_line"), ends.alias("_segment", "_ends")).select("fid", "_line", "_segment", "_ends.*")
    segments = segments.where(" AND ".join(f"abs({v}) < double('infinity')" for v in ("x1", "y1", "x2", "y2")))

    def crossings(a: str, b: str) -> str:
        first, last = f"{_number(f'least({a}, {b})', step)} + 1", _number(f"greatest({a}, {b})", step)
        return f"IF({first} <= {last}, transform(sequence({first}, {last}), k -> ({_at('k', step)} - {a}) / ({b} - {a})), CAST(array() AS array<double>))"

    ends = f"array_sort(concat(array(0D), filter(concat({crossings('x1', 'x2')}, {crossings('y1', 'y2')}), t -> t > 0 AND t < 1)))"
    pieces = _named(ends, "e", "transform(e, (t, i) -> struct(t AS a, coalesce(get(e, i + 1), 1D) AS b))")
    parts = segments.selectExpr("*", f"explode(filter({pieces}, p -> p.b > p.a)) AS _t")
    cell = lambda a, b: _number(f"{a} + ({b} - {a}) * ((_t.a + _t.b) / 2)", step)
    return parts.selectExpr("fid", "_line", "_segment", "x1", "y1", "x2", "y2", "_t.a AS _a", "_t.b AS _b", f"{cell('x1', 'x2')} AS cx", f"{cell('y1', 'y2')} AS cy")


def _named(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, as SQL."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _inside(odd: str, sides: str, step: float) -> str:
    """What of a part (see ``line_parts``) lies within a zone, from the sides in its cell: an array of structs a, b in shares of the segment, as SQL.

    The part is cut where its line passes between the ends of sides, and is in and out of the zone by turns. Whether its longest piece is inside is told by the
    way from the cell's corner to the middle of the piece, up the left edge and then to the right: it crosses an odd number of sides, or an even one if the corner itself is inside. What
    runs along a side counts as right of it or above it, whichever way the line goes.
    """
    left, low = _at("cx", step), _at("cy", step)
    above = lambda v: f"(IF(x2 > x1 OR (x2 = x1 AND y2 < y1), 1, -1) * ((x2 - x1) * (s.y{v} - y1) - (y2 - y1) * (s.x{v} - x1)) > 0)"
    along = "try_divide((s.x1 - x1) * (s.y2 - s.y1) - (s.y1 - y1) * (s.x2 - s.x1), (x2 - x1) * (s.y2 - s.y1) - (y2 - y1) * (s.x2 - s.x1))"
    cuts = f"array_sort(concat(array(_a), filter(transform({sides}, s -> IF({above(1)} <> {above(2)}, {along}, NULL)), t -> t > _a AND t < _b)))"
    below_bend, right_of_bend = _passes("s.", left, "m.y")
    up = f"((s.x1 > {left}) <> (s.x2 > {left}) AND NOT {_passes('s.', left, low)[0]} AND {below_bend})"
    level = f"((s.y1 > m.y) <> (s.y2 > m.y) AND {right_of_bend} AND m.x >= (s.x2 - s.x1) * (m.y - s.y1) / (s.y2 - s.y1) + s.x1)"
    way = f"aggregate({sides}, {odd}, (n, s) -> n + IF({up}, 1, 0) + IF({level}, 1, 0))"
    found = "transform(filter(q, p -> pmod(z + p.i - m.i, 2) = 1 AND p.b - p.a > 1e-12), p -> struct(p.a AS a, p.b AS b))"
    middle = "struct(w.i AS i, x1 + (x2 - x1) * w.t AS x, y1 + (y2 - y1) * w.t AS y)"
    longest = "array_max(transform(q, p -> struct(p.b - p.a AS n, p.i AS i, (p.a + p.b) / 2 AS t)))"
    pieces = "transform(e, (t, i) -> struct(t AS a, coalesce(get(e, i + 1), _b) AS b, i AS i))"
    spans = _named(cuts, "e", _named(pieces, "q", _named(longest, "w", _named(middle, "m", _named(way, "z", found)))))
    whole = f"IF({odd} = 1, array(struct(_a AS a, _b AS b)), CAST(array() AS array<struct<a:double,b:double>>))"
    return f"IF(size({sides}) = 0, {whole}, {spans})"


def _met(lines: DataFrame, zones: DataFrame, step: float, mask: DataFrame | None = None) -> DataFrame:
    """(fid, _line, _segment, _length, zone_id, _a, _b): what of lines lies within zones, in shares of their segments; with a mask _hazard too, the sorted array of what lies under any of its polygons.

    Lines are cut at a grid and meet, by cell, the sides that zones and the mask have in it. What is shuffled are lines and sides once each, by cell; all else is columns of
    one row. Lines and rings without finite coordinates take no part.
    """
    step = min(grid_step(z, step) for z in (zones, mask) if z is not None)
    parts = line_parts(lines, step)
    cells = parts.select("cx", "cy").distinct()
    met = parts.join(side_index(zones.select("zone_id", "geom"), cells, step), ["cx", "cy"])
    if mask is not None:
        polygons = side_index(mask.select("zone_id", "geom"), cells, step).groupBy("cx", "cy").agg(F.expr("collect_list(struct(_odd, _sides)) AS _mask"))
        met = met.join(polygons, ["cx", "cy"], "left")
    kept = ["fid", "_line", "_segment", "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS _length", "zone_id"]
    under = [] if mask is None else [f"IF(_mask IS NULL, NULL, array_sort(flatten(transform(_mask, c -> {_inside('c._odd', 'c._sides', step)})))) AS _hazard"]
    # Unfolding the spans keeps them from being worked out once for each use.
    return met.selectExpr(*kept, *under, f"inline({_inside('_odd', '_sides', step)}) AS (_a, _b)")


def line_spans(lines: DataFrame, zones: DataFrame, step: float = 8.0) -> DataFrame:
    """The parts of the segments of lines (fid, geom) within zones: fid, zone_id, _segment, _from and _to in shares of the segment, _length of the segment,
    and the other columns of the lines as the struct _line. ``fid`` names a line.
    """
    return _met(lines, zones, step).selectExpr("fid", "zone_id", "_segment", "_a AS _from", "_b AS _to", "_length", "_line")


#: The share of the segment that lies in [_a, _b] and under any of _hazard; what several hazards cover counts once.
_COVERED = """coalesce(aggregate(_hazard, struct(_a AS reach, 0D AS total), (s, h) -> struct(greatest(s.reach, h.b) AS reach,
  s.total + greatest(0D, least(_b, h.b) - greatest(s.reach, h.a)) AS total), s -> s.total), 0D)"""


def overlay_with_mask(lines: DataFrame, zones: DataFrame, mask: DataFrame | None = None, step: float = 8.0) -> DataFrame:
    """Lines with the zones that they run through: all columns of the lines, zone_id, the length inside (positive), and with a mask ``affected``, the part of that length
    under the union of the mask's polygons. Lines are cut and meet the sides of zones once for both. ``fid`` names a line.
    """
    met = _met(lines, zones, step, mask)
    sums = ["sum((_b - _a) * _length) AS length"] + ([] if mask is None else [f"sum({_COVERED} * _length) AS affected"])
    found = met.groupBy("fid", "zone_id").agg(F.expr("any_value(_line) AS _line"), *map(F.expr, sums)).where("length > 0")
    return found.select(*["fid" if c == "fid" else f"_line.{c}" for c in lines.columns if c != "geom"], "zone_id", "length", *([] if mask is None else ["affected"]))


def overlay_lines(lines: DataFrame, zones: DataFrame, step: float = 8.0) -> DataFrame:
    """Lines with the zones that they run through and the length inside (positive); all columns of the lines."""
    return overlay_with_mask(lines, zones, None, step)


def overlay_masked(lines: DataFrame, zones: DataFrame, mask: DataFrame, step: float = 8.0) -> DataFrame:
    """Lines with the zones that they run through and the length within both the zone and the union of the mask's polygons (positive); all columns of the lines."""
    found = overlay_with_mask(lines, zones, mask, step).where("affected > 1e-12")
    return found.drop("length").withColumnRenamed("affected", "length")


def lines_intersect_zones(lines: DataFrame, zones: DataFrame, step: float = 8.0) -> DataFrame:
    """(fid, zone_id, length) of lines that run through a zone, with their whole length."""
    whole = lines.select("fid", G.length(F.col("geom")).alias("_whole"), *[c for c in lines.columns if c != "fid"])
    return overlay_lines(whole, zones, step).drop("length").withColumnRenamed("_whole", "length")


def features_on_mask(features: DataFrame, mask: DataFrame) -> DataFrame:
    """Footprints whose centre's pixel is masked; ``mask``: row, col."""
    keyed = features.select("*", F.floor("y").cast("int").alias("row"), F.floor("x").cast("int").alias("col"))
    return keyed.join(mask.select("row", "col"), ["row", "col"], "left_semi")


def bbox_overlaps(a: DataFrame, b: DataFrame, step: float = 16.0) -> DataFrame:
    """Pairs of rows whose boxes overlap. Columns: axmin, aymin, axmax, aymax of ``a`` and bxmin, ... of ``b``."""
    corners = lambda s: F.array(G.point(F.col(f"{s}xmin"), F.col(f"{s}ymin")), G.point(F.col(f"{s}xmax"), F.col(f"{s}ymax")))
    met = on_grid(a, corners("a"), step).join(on_grid(b, corners("b"), step), ["_cx", "_cy"])
    first = lambda c: F.floor(F.greatest(f"a{c}", f"b{c}") / step)
    met = met.where((F.col("_cx") == first("xmin")) & (F.col("_cy") == first("ymin"))).drop("_cx", "_cy")
    return met.where("axmin < bxmax AND bxmin < axmax AND aymin < bymax AND bymin < aymax")


def exclude_disputed(zones: DataFrame, lines: DataFrame, step: float = 8.0) -> DataFrame:
    """Zones that no line runs through."""
    return zones.join(overlay_lines(lines, zones, step).select("zone_id").distinct(), "zone_id", "left_anti")


#: Buckets of places: a bucket has FOUR x FOUR of the level below, one of the lowest level should hold so many places at most, and so many buckets are the top level.
FOUR, PLACES, TOPMOST = 4, 64, 4
_BOX = ("xlow", "xhigh", "ylow", "yhigh")


def place_pyramid(places: DataFrame, step: float) -> tuple[DataFrame, list[DataFrame], float]:
    """(places by bucket, levels of occupied buckets, width of the lowest). Of places at one spot the one with the smallest id counts.

    A level is a table (cx, cy, the box of what is in it); each has one row for the occupied buckets of the level below that lie in it.
    """
    spots = keep(places.groupBy("px", "py").agg(F.min("place_id").alias("place_id")), "nearest-places")
    for _ in range(12):
        most = spots.groupBy(F.floor(F.col("px") / step), F.floor(F.col("py") / step)).count().agg(F.max("count")).first()[0]
        if most <= PLACES:
            break
        step /= 2 ** max(1, math.ceil(math.log2(most / PLACES) / 2))
    spots = spots.select("*", F.floor(F.col("px") / step).alias("cx"), F.floor(F.col("py") / step).alias("cy"))
    ends = [f(F.col(c)).alias(n) for n, f, c in zip(_BOX, (F.min, F.max, F.min, F.max), ("px", "px", "py", "py"), strict=True)]
    levels = [keep(spots.groupBy("cx", "cy").agg(*ends), "nearest-level")]
    while levels[-1].count() > TOPMOST:
        up = levels[-1].select(F.floor(F.col("cx") / FOUR).alias("cx"), F.floor(F.col("cy") / FOUR).alias("cy"), *_BOX)
        levels.append(keep(up.groupBy("cx", "cy").agg(*[f(n).alias(n) for n, f in zip(_BOX, (F.min, F.max, F.min, F.max), strict=True)]), "nearest-level"))
    return spots, levels, step


def _around(cells: DataFrame, *kept: str) -> DataFrame:
    """The 3 x 3 buckets around each (cx, cy)."""
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(cx + i AS cx, cy + j AS cy))))")).alias("_c")
    return cells.select(*kept, near).select(*kept, "_c.cx", "_c.cy")


def nearest_place(points: DataFrame, places: DataFrame, step: float = 1.0) -> DataFrame:
    """Each point (fid, x, y) with its nearest place (place_id, px, py) and the distance, however far; ties to the smaller id. ``fid`` names a point.

    Places make up a pyramid of occupied buckets. A point goes up to the first level that has one next to it: the nearest place lies within the 3 x 3 buckets of the level above. From
    there it goes down: of the buckets that it meets those stay whose nearest side is no farther than another one's farthest, until few places are left. So a
    point meets a few buckets a level, far or near, and never all places. Points and places without finite coordinates take no part; without places there are no rows.
    """
    finite = lambda *c: reduce(Column.__and__, [F.abs(v) < float("inf") for v in c])
    places, left = places.where(finite("px", "py")), points.where(finite("x", "y")).select("fid", "x", "y")
    if places.isEmpty():
        return left.select("fid", F.lit(None).cast(places.schema["place_id"].dataType).alias("place_id"), F.lit(0.0).alias("distance")).where("false")
    spots, levels, step = place_pyramid(places, step)
    cell = lambda k: [F.floor(F.col(c) / (step * FOUR**k)).alias(n) for c, n in (("x", "cx"), ("y", "cy"))]
    point = ("fid", "x", "y")
    starts = {}
    for k in range(len(levels) - 1):
        here = left.select(*point, *cell(k))
        seen = _around(levels[k].select("cx", "cy")).distinct()
        starts[k + 1] = keep(here.join(seen, ["cx", "cy"], "left_semi").select(*point), "nearest-start")
        left = keep(here.join(seen, ["cx", "cy"], "left_anti").select(*point), "nearest-left")
        if left.isEmpty():
            break
    top = max(starts, default=0)
    met = None
    if len(starts) == len(levels) - 1:  # what has nothing near it at any level meets all of the few buckets at the top
        top = len(levels) - 1
        few = [F.struct(*[F.lit(b[c]).alias(c) for c in ("cx", "cy", *_BOX)]) for b in levels[top].collect()]
        met = left.select(*point, F.explode(F.array(*few)).alias("_b")).select(*point, "_b.*")
    for k in range(top, -1, -1):
        if k in starts:
            own = _around(starts[k].select(*point, *cell(k)), *point).join(levels[k], ["cx", "cy"]).select(*point, "cx", "cy", *_BOX)
            met = own if met is None else met.unionByName(own)
        gap = lambda c, low, high: F.greatest(F.lit(0.0), F.col(low) - F.col(c), F.col(c) - F.col(high))
        reach = lambda c, low, high: F.greatest(F.abs(F.col(c) - F.col(low)), F.abs(F.col(c) - F.col(high)))
        met = met.select(*point, "cx", "cy", F.hypot(gap("x", "xlow", "xhigh"), gap("y", "ylow", "yhigh")).alias("_least"), F.hypot(reach("x", "xlow", "xhigh"), reach("y", "ylow", "yhigh")).alias("_most"))
        # A bit more than the bound, as distances are rounded.
        met = met.withColumn("_bound", F.min("_most").over(Window.partitionBy("fid"))).where(F.col("_least") <= F.col("_bound") * (1 + 1e-12)).select(*point, "cx", "cy")
        met = keep(met, "nearest-met")
        if k:
            below = levels[k - 1].select(F.floor(F.col("cx") / FOUR).alias("_ux"), F.floor(F.col("cy") / FOUR).alias("_uy"), "cx", "cy", *_BOX)
            met = met.withColumnsRenamed({"cx": "_ux", "cy": "_uy"}).join(below, ["_ux", "_uy"]).select(*point, "cx", "cy", *_BOX)
    gap = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    best = met.join(spots, ["cx", "cy"]).groupBy("fid").agg(F.min(F.struct(gap.alias("distance"), "place_id")).alias("_best"))
    return best.select("fid", "_best.place_id", "_best.distance")


def admin_hierarchy(points: DataFrame, areas: DataFrame, levels: tuple[int, ...] = (0, 1, 2), step: float = 16.0) -> DataFrame:
    """(fid, admin0_name, admin1_name, ...): the names of the areas (level, osm_level, name, geom) that contain a point.

    Of several areas of one level the one with the lowest osm_level counts, then the first by name.
    """
    met = point_in_polygon(points.select("fid", "x", "y"), areas, step)
    chosen = lambda n: F.min_by(F.when(F.col("level") == n, F.col("name")), F.when(F.col("level") == n, F.struct("osm_level", "name"))).alias(f"admin{n}_name")
    return met.groupBy("fid").agg(*[chosen(n) for n in levels])


def resample_swath(samples: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """Each target (row, col, x, y) with the value of the nearest sample (sx, sy, value) within ``radius``; ties to the smaller value."""
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = samples.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    spread = spread.select("sx", "sy", "value", (F.floor(F.col("sx") / radius) + F.col("_dx")).alias("_cx"), (F.floor(F.col("sy") / radius) + F.col("_dy")).alias("_cy"))
    gap = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    met = point_cells(targets, radius).join(spread, ["_cx", "_cy"]).withColumn("_gap", gap).where(F.col("_gap") <= radius)
    return met.groupBy("row", "col").agg(F.min_by("value", F.struct("_gap", "value")).alias("value"))


def within_distance(points: DataFrame, segments: DataFrame, d: float) -> DataFrame:
    """Points (fid, x, y) closer than ``d`` to any segment (x1, y1, x2, y2)."""
    step = max(4.0 * d, 1.0)
    ends = G.segment(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    met = point_cells(points, step).join(on_grid(segments.select("x1", "y1", "x2", "y2"), ends, step, d), ["_cx", "_cy"])
    near = G.point_segment_distance(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2"))) <= d
    return points.join(met.where(near).select("fid").distinct(), "fid", "left_semi")


def barrier_edges(edges: DataFrame, lines: DataFrame | None = None, polygons: DataFrame | None = None, d: float = 5.0) -> DataFrame:
    """(u, v), each once, of the edges (u, v, x1, y1, x2, y2) that barriers block: those within ``d`` of a line (geom) or that touch a polygon (geom).

    Edges meet the segments of lines and the sides of polygons on grid cells; an edge within a polygon has no side near it and is found by its start.
    """
    step = max(4.0 * d, 1.0)
    ends = G.segment(*map(F.col, ("x1", "y1", "x2", "y2")))
    roads = edges.select("u", "v", "x1", "y1", "x2", "y2")
    found = []
    cells = on_grid(roads, ends, step)
    for barriers, paths, reach in ((lines, F.array("geom"), d), (polygons, F.col("geom"), 0.0)):
        if barriers is None:
            continue
        sides = barriers.select(F.explode(paths).alias("_path")).select(F.explode(G.steps(F.col("_path"), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("_s"))
        sides = sides.selectExpr("_s.p.x AS px", "_s.p.y AS py", "_s.q.x AS qx", "_s.q.y AS qy")
        met = cells.join(on_grid(sides, G.segment(*map(F.col, ("px", "py", "qx", "qy"))), step, reach), ["_cx", "_cy"])
        found.append(met.where(G.segment_distance(*map(F.col, ("x1", "y1", "x2", "y2", "px", "py", "qx", "qy"))) <= reach).select("u", "v"))
    if polygons is not None:
        starts = roads.select("u", "v", F.col("x1").alias("x"), F.col("y1").alias("y"))
        found.append(point_in_polygon(starts, polygons.select("geom"), max(step, 16.0)).select("u", "v"))
    return reduce(DataFrame.unionByName, found).distinct() if found else roads.select("u", "v").where("false")


def polygons_to_grid_pieces(zones: DataFrame, step: float) -> DataFrame:
    """(zone_id, cx, cy, area) of the pieces into which a grid of width ``step`` cuts polygons."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [K.ring_area(K.clip_rect(K.rings_of(g), x * step, y * step, (x + 1) * step, (y + 1) * step)) for g, x, y in zip(batch["geom"], batch["_cx"], batch["_cy"], strict=True)]
            out = batch[["zone_id", "_cx", "_cy"]].assign(area=np.array(parts, float)).rename(columns={"_cx": "cx", "_cy": "cy"})
            yield out[out["area"] > 0]

    pieces = on_grid(zones.select("zone_id", G.oriented(F.col("geom")).alias("geom")), F.flatten("geom"), step).select("zone_id", "geom", "_cx", "_cy")
    return pieces.repartition("zone_id", "_cx", "_cy").mapInPandas(cut, "zone_id long, cx long, cy long, area double")


#: Line operators by name, each over the lengths of a zone's lines; zones without lines have 0. The median is selected, see ``quantiles``.
LINE_OPS = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg, "count": F.count}


def line_stats(pieces: DataFrame, zones: DataFrame, ops: tuple[str, ...], classes: dict[str, Column] | None = None) -> DataFrame:
    """Statistics of line lengths by zone (clipped pieces, or whole lines); with ``classes`` one set of columns for each condition, in one pass."""
    if unknown := set(ops) - {*LINE_OPS, "median"}:
        raise ValueError(f"unknown line operators {sorted(unknown)}; known: median, {', '.join(LINE_OPS)}")
    sets = {"": F.lit(True)} if classes is None else {f"{n}_": on for n, on in classes.items()}
    wanted = [LINE_OPS[op](F.when(on, F.col("length"))).alias(f"{n}{op}") for n, on in sets.items() for op in ops if op != "median"]
    if "median" in ops:
        named = F.array_compact(F.array(*[F.when(on, F.lit(n)) for n, on in sets.items()]))
        pieces = keep(pieces.select("zone_id", "length", named.alias("_sets"), *[on.alias(f"_on_{n}") for n, on in sets.items()]), "line-lengths")
        wanted = [LINE_OPS[op](F.when(F.col(f"_on_{n}"), F.col("length"))).alias(f"{n}{op}") for n in sets for op in ops if op != "median"]
        middle = exact_quantile(pieces.select("zone_id", F.explode("_sets").alias("_set"), "length"), ["zone_id", "_set"], F.col("length"))
        medians = middle.groupBy("zone_id").agg(*[F.max(F.when(F.col("_set") == n, F.col("quantile"))).alias(f"{n}median") for n in sets])
    found = zones.select("zone_id")
    if wanted:
        found = found.join(pieces.groupBy("zone_id").agg(*wanted), "zone_id", "left")
    if "median" in ops:
        found = found.join(medians, "zone_id", "left")
    return found.select("zone_id", *[f"{n}{op}" for n in sets for op in ops]).fillna(0)


def line_density(pieces: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_id, density): length of the clipped pieces over the zone's area; null without lines."""
    total = pieces.groupBy("zone_id").agg(F.sum("length").alias("_length"))
    return zones.join(total, "zone_id", "left").select("zone_id", F.try_divide(F.col("_length"), G.area(F.col("geom"))).alias("density"))
