"""Geometry kernels and columns on small hand-made shapes, and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from geoexposure.functions import geometry as G
from geoexposure.operators import kernels as K
from geoexposure.operators import vector, zonal


def star(seed, n=9, cx=8.0, cy=7.0):
    rnd = random.Random(seed)
    points = [(cx + rnd.uniform(1, 6) * math.cos(2 * math.pi * i / n), cy + rnd.uniform(1, 6) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return np.array([*points, points[0]])


def rows(rings):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


@pytest.mark.parametrize("seed", range(20))
def test_clipped_cells_add_up(seed):
    ring = star(seed)
    w = plain.block_weights([ring], 0, 0, 16)
    assert w.sum() == pytest.approx(K.ring_area([ring]), rel=1e-9)
    assert (w >= 0).all() and (w <= 1 + 1e-12).all()


def test_weights_holes_and_tiles(spark):
    shell, hole = star(3), star(3)[::-1] * 0.25 + np.array([6.0, 5.25])
    zones = spark.createDataFrame([(1, rows([shell, hole])), (2, rows([star(5)])), (3, [])], f"zone_id long, geom {G.POLYGON}")
    area = {r.zone_id: r.a for r in zones.select("zone_id", G.area(F.col("geom")).alias("a")).collect()}
    for block in (2, 4, 16):
        found = {r.zone_id: r.w for r in zonal.zone_cell_weights(zones, 20, 20, block).groupBy("zone_id").agg(F.sum("w").alias("w")).collect()}
        assert found == {k: pytest.approx(area[k], rel=1e-9) for k in (1, 2)}
    assert area[1] == pytest.approx(K.ring_area([shell]) - K.ring_area([hole]))
    assert area[3] == 0


def test_line_parts_cover_the_line(spark):
    zones = [[np.array([(0, 0), (5, 0), (5, 9), (0, 9), (0, 0)], float)], [np.array([(5, 0), (12, 0), (12, 9), (5, 9), (5, 0)], float)]]
    rnd = random.Random(1)
    for _ in range(50):
        line = np.array([(rnd.uniform(0, 12), rnd.uniform(0, 9)) for _ in range(4)])
        whole = np.hypot(*np.diff(line, axis=0).T).sum()
        assert sum(plain.length_inside(line, z) for z in zones) == pytest.approx(whole)


def test_line_through_a_concave_polygon():
    u = np.array([(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9), (0, 0)], float)
    assert plain.length_inside(np.array([(-1.0, 6.0), (10.0, 6.0)]), [u]) == pytest.approx(6.0)


def test_points_on_borders_belong_once(spark):
    left, right = (G.rectangle(F.lit(a), F.lit(0.0), F.lit(a + 2.0), F.lit(2.0)) for a in (0.0, 2.0))
    p = spark.createDataFrame([(2.0, 1.0), (0.0, 0.0), (4.0, 1.0), (1.0, 2.0)], "x double, y double")
    got = [tuple(r) for r in p.select("x", "y", G.contains(left, F.col("x"), F.col("y")), G.contains(right, F.col("x"), F.col("y"))).collect()]
    assert got == [(2.0, 1.0, False, True), (0.0, 0.0, True, False), (4.0, 1.0, False, False), (1.0, 2.0, False, False)]


def test_disjoint_zones_partition_cells(spark):
    cells = spark.range(400).selectExpr("cast(id div 20 as int) AS row", "cast(id % 20 as int) AS col", "cast(id as double) AS value")
    boxes = [(i, rows([np.array([(x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10), (x, y)], float)])) for i, (x, y) in enumerate([(0, 0), (10, 0), (0, 10), (10, 10)])]
    zones = spark.createDataFrame(boxes, f"zone_id long, geom {G.POLYGON}")
    stats = zonal.zonal_stats(cells, zonal.zone_cell_weights(zones, 20, 20), {"s": ("sum", "value", None), "n": ("count", "value", None)}).collect()
    assert sum(r.s for r in stats) == sum(range(400)) and all(r.n == 100 for r in stats)


def test_unknown_operators_raise(spark):
    with pytest.raises(ValueError):
        zonal.raster_op("nope")
    with pytest.raises(ValueError):
        vector.line_stats(spark.range(1), spark.range(1), ("nope",))


def test_overlapping_masks_count_once(spark):
    zones = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 20.0)], "zone_id long, a double, b double, c double, d double").select("zone_id", G.rectangle(*map(F.col, "abcd")).alias("geom"))
    boxes = [(7, 2.0, 0.0, 8.0, 20.0), (8, 5.0, 0.0, 12.0, 20.0), (9, 6.0, 0.0, 7.0, 20.0)]
    mask = spark.createDataFrame(boxes, "zone_id long, a double, b double, c double, d double").select("zone_id", G.rectangle(*map(F.col, "abcd")).alias("geom"))
    lines = spark.createDataFrame([(1, "A", -5.0, 3.0, 25.0, 3.0)], "fid long, cls string, a double, b double, c double, d double").select("fid", "cls", G.segment(*map(F.col, "abcd")).alias("geom"))
    (row,) = vector.overlay_masked(lines, zones, mask).collect()
    assert (row.fid, row.cls, row.zone_id) == (1, "A", 1) and row.length == pytest.approx(10.0)


def test_nearest_place_has_no_limit(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9e6, 0.0), (3, None, 1.0)], "fid long, x double, y double")
    places = spark.createDataFrame([(5, 1.0, 0.0), (4, -1.0, 0.0)], "place_id long, px double, py double")
    assert sorted(map(tuple, vector.nearest_place(points, places).collect())) == [(1, 4, 1.0), (2, 5, 9e6 - 1)]
    assert vector.nearest_place(points, places.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["even", "clustered", "one spot", "far"])
def test_nearest_place_of_many(spark, kind):
    """Against all distances; no join has anything like points times places."""
    draws = np.random.default_rng(11)
    n = 1500
    p, q = draws.uniform(-50, 50, (n, 2)), draws.uniform(-50, 50, (n, 2))
    if kind == "clustered":
        q = np.concatenate([draws.normal(7, 0.01, (n // 2, 2)), draws.normal(-40, 3, (n // 2, 2))])
        p[: n // 2] = draws.normal(7, 0.02, (n // 2, 2))
    if kind == "one spot":
        q[: n // 2] = (3.0, 4.0)
    if kind == "far":
        p += (40_000.0, -9_000.0)
    gaps = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
    want = {i: (int(np.flatnonzero(g == g.min())[0]), g.min()) for i, g in enumerate(gaps)}
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "fid int, x double, y double")
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(q)], "place_id int, px double, py double")
    got = {r.fid: (r.place_id, pytest.approx(r.distance)) for r in vector.nearest_place(points, places).collect()}
    assert {i: d for i, (_, d) in got.items()} == {i: d for i, (_, d) in want.items()} and sum(got[i][0] != want[i][0] for i in want) == 0


def test_geojson_centroids():
    from geoexposure.sources.readers import centroid_of

    def centre(kind, at):
        return centroid_of(f'{{"type": "{kind}", "coordinates": {at}}}')[1:]

    triangle = "[[[0,0],[4,0],[4,1],[0,0]]]"
    assert centre("Polygon", triangle) == pytest.approx((8 / 3, 1 / 3))
    assert centre("MultiPolygon", f"[{triangle}, [[[10,0],[12,0],[12,2],[10,2],[10,0]]]]") == pytest.approx((2 * (8 / 3) / 6 + 4 * 11 / 6, (2 / 3 + 4) / 6))
    assert centre("Polygon", "[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[2,0],[4,0],[4,4],[2,4],[2,0]]]") == pytest.approx((1.0, 2.0))
    assert centre("LineString", "[[0,0],[3,0],[3,1]]") == pytest.approx((1.875, 0.125))
    assert centre("LineString", "[[2,2],[2,2]]") == (2.0, 2.0) and centre("Point", "[1, 2, 3]") == (1.0, 2.0) and centre("MultiPoint", "[[0,0],[1,2]]") == (0.5, 1.0)
    both = f'{{"type": "GeometryCollection", "geometries": [{{"type": "Point", "coordinates": [50, 50]}}, {{"type": "Polygon", "coordinates": {triangle}}}]}}'
    assert centroid_of(both) == ("GeometryCollection", pytest.approx(8 / 3), pytest.approx(1 / 3)) and centroid_of(None) == (None, None, None)


def test_spans_of_lines_equal_the_kernel(spark):
    rings = {1: [star(3), star(3)[::-1] * 0.25 + np.array([6.0, 5.25])], 2: [star(5)], 3: [np.array([(0, 0), (16, 0), (16, 8), (0, 8), (0, 0)], float)]}
    rnd = random.Random(4)
    lines = {k: np.array([(rnd.uniform(-2, 18), rnd.uniform(-2, 16)) for _ in range(4)]) for k in range(60)} | {90: np.array([(-3.0, 8.0), (20.0, 8.0)]), 91: np.array([(1.0, 1.0), (1.0, 1.0), (9.0, 1.0)])}
    want = {(f, z): n for f, line in lines.items() for z, r in rings.items() if (n := plain.length_inside(line, r)) > 1e-9}
    zones = spark.createDataFrame([*((z, rows(r)) for z, r in rings.items()), (4, []), (5, None)], f"zone_id long, geom {G.POLYGON}")
    df = spark.createDataFrame([*((f, "a", rows([line])[0]) for f, line in lines.items()), (95, "b", []), (96, None, None)], f"fid long, cls string, geom {G.LINE}")
    for step in (2.0, 8.0):
        got = {(r.fid, r.zone_id): r.length for r in vector.overlay_lines(df, zones, step).collect()}
        assert got == {k: pytest.approx(n) for k, n in want.items()}


def test_polygon_of_many_sides(spark):
    n = 100_000
    ring = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: G.point(F.cos(i * (2 * math.pi / n)) * 40 + 50, F.sin(i * (2 * math.pi / n)) * 40 + 50))
    zones = spark.range(1).select(F.lit(1).alias("zone_id"), F.array(ring).alias("geom"))
    lines = spark.createDataFrame([(1, 0.0, 50.0, 100.0, 50.0), (2, 50.0, 50.0, 50.0, 200.0)], "fid long, a double, b double, c double, d double").select("fid", G.segment(*map(F.col, "abcd")).alias("geom"))
    assert {r.fid: r.length for r in vector.overlay_lines(lines, zones).collect()} == {1: pytest.approx(80.0, rel=1e-6), 2: pytest.approx(40.0, rel=1e-6)}
    weights = zonal.zone_cell_weights(zones, 100, 100).agg(F.sum("w").alias("w"), F.max("w").alias("most")).first()
    assert weights.w == pytest.approx(math.pi * 1600, rel=1e-6) and weights.most <= 1.0


def wound(ring, way):
    return ring if way else ring[::-1]


@pytest.mark.parametrize("ways", [(a, b, c) for a in (True, False) for b in (True, False) for c in (True, False)])
def test_rings_of_any_orientation(spark, ways):
    """A shell with a hole, an island in the hole and a part beside it: areas, centres, weights and pieces agree with points on a fine grid."""
    square = lambda x, y, n: np.array([(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)], float)
    rings = [wound(square(0, 0, 10), ways[0]), wound(square(2.5, 3, 6), ways[1]), wound(square(4, 5, 1.5), ways[2]), wound(square(12, 1, 4), ways[1]), wound(square(4, 3, 1.5), ways[0])]
    zones = spark.createDataFrame([(1, rows(rings)), (2, rows([wound(star(5), ways[2])]))], f"zone_id long, geom {G.POLYGON}")
    fine = 0.05
    grid = spark.range(400 * 240).select(((F.col("id") % 400 + 0.5) * fine).alias("x"), ((F.floor(F.col("id") / 400) + 0.5) * fine).alias("y")).join(F.broadcast(zones.where("zone_id = 1")), F.lit(True)).where(G.contains(F.col("geom"), F.col("x"), F.col("y")))
    want = grid.agg(F.count("*") * fine**2, F.avg("x"), F.avg("y")).first()
    got = zones.where("zone_id = 1").select(G.area(F.col("geom")).alias("a"), G.centroid(F.col("geom")).alias("c")).first()
    assert (got.a, got.c.x, got.c.y) == (pytest.approx(want[0], rel=1e-9), pytest.approx(want[1]), pytest.approx(want[2]))
    cells = {(r.row, r.col): r.w for r in zonal.zone_cell_weights(zones.where("zone_id = 1"), 20, 20).collect()}
    points = {(int(r.r), int(r.c)): r.n * fine**2 for r in grid.groupBy(F.floor("y").alias("r"), F.floor("x").alias("c")).agg(F.count("*").alias("n")).collect()}
    assert cells == {k: pytest.approx(v) for k, v in points.items()}
    for step in (1.0, 7.0):
        pieces = vector.polygons_to_grid_pieces(zones, step).groupBy("zone_id").agg(F.sum("area").alias("a")).collect()
        areas = {r.zone_id: r.a for r in zones.select("zone_id", G.area(F.col("geom")).alias("a")).collect()}
        assert {r.zone_id: r.a for r in pieces} == {k: pytest.approx(v) for k, v in areas.items()}


def test_a_large_zone_meets_few_rows(spark):
    """A zone of 10 ** 8 inner cells: what is joined goes with its edge and the logarithm of its width; statistics equal those cell by cell."""
    ring = lambda n: rows([np.array([(0.5, 0.5), (n + 0.25, 0.5), (n + 0.25, n + 0.75), (0.5, n + 0.75), (0.5, 0.5)])])
    large = spark.createDataFrame([(1, ring(10_000))], f"zone_id long, geom {G.POLYGON}")
    runs = zonal.zone_runs(large, 20_000, 20_000)
    assert runs.agg(F.sum((F.col("last") - F.col("first") + 1) * F.col("w"))).first()[0] == pytest.approx(9999.75 * 10_000.25)
    assert runs.count() < 4 * 10_001 and zonal.run_blocks(runs).count() < 110 * 10_001
    small = spark.createDataFrame([(1, ring(300)), (2, rows([star(4) * 20]))], f"zone_id long, geom {G.POLYGON}")
    cells = spark.range(400 * 400).selectExpr("cast(id div 400 as int) AS row", "cast(id % 400 as int) AS col", "IF(id % 7 = 0, NULL, cast(id * 37 % 1009 as double)) AS value", "cast(id % 3 as int) AS cls").where("row % 11 <> 5 OR col % 5 <> 1")
    wanted = {op: (op, "value", None) for op in zonal.RASTER_OPS} | {f"{op}_on": (op, "value", F.col("cls") == 1) for op in zonal.RASTER_OPS}
    by_run = zonal.zonal_stats(cells, zonal.zone_runs(small, 400, 400), wanted).orderBy("zone_id").collect()
    by_cell = zonal.zonal_stats(cells, zonal.zone_cell_weights(small, 400, 400), wanted).orderBy("zone_id").collect()
    assert [list(r) for r in by_run] == [[pytest.approx(v) for v in r] for r in by_cell] and len(by_run) == 2
    areas = [{(r.zone_id, r.cls): pytest.approx(r.area) for r in zonal.class_area(cells, w, 2.0).collect()} for w in (zonal.zone_runs(small, 400, 400), zonal.zone_cell_weights(small, 400, 400))]
    assert areas[0] == areas[1] and len(areas[0]) == 6


def test_lines_over_a_crowded_zone(spark):
    """A comb of 4,000 sides in one strip of cells, and lines through, along and beside its teeth."""
    n = 4000
    comb = np.array([(i * 0.02, 1.0 if i % 2 else 7.0) for i in range(n + 1)] + [(n * 0.02, 0.5), (0.0, 0.5), (0.0, 7.0)])
    rnd = random.Random(12)
    lines = {k: np.array([(rnd.uniform(-1, 81), rnd.uniform(0, 8)) for _ in range(2)]) for k in range(40)}
    lines |= {100: np.array([(0.0, 0.5), (80.0, 0.5)]), 101: np.array([(80.0, 0.5), (0.0, 0.5)]), 102: np.array([(80.0, 7.0), (0.0, 7.0)]), 103: np.array([(0.0, 0.0), (0.0, 9.0)]), 104: np.array([(0.0, 9.0), (0.0, 0.0)]), 105: np.array([(0.04, 9.0), (0.04, 0.0)])}
    zones = spark.createDataFrame([(1, rows([comb]))], f"zone_id long, geom {G.POLYGON}")
    df = spark.createDataFrame([(f, rows([line])[0]) for f, line in lines.items()], f"fid long, geom {G.LINE}")
    assert vector.grid_step(zones, 8.0) < 8.0
    got = {r.fid: r.length for r in vector.overlay_lines(df, zones).collect()}
    assert got == {f: pytest.approx(v, rel=1e-9) for f, line in lines.items() if (v := plain.length_inside(line, [comb])) > 1e-9}
    spans = vector.line_spans(df, zones).groupBy("fid").agg(F.sum((F.col("_to") - F.col("_from")) * F.col("_length")).alias("n")).collect()
    assert {r.fid: pytest.approx(r.n) for r in spans} == got
