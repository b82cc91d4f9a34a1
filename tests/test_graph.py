"""Iterative jobs against plain Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from geoexposure.functions import geometry as G
from geoexposure.operators import focal, graph
from geoexposure.operators import vector as V
from geoexposure.operators.components import connected_components


def components_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_connected_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    pairs = [(a, b) for a, b in pairs if a != b]
    df = spark.createDataFrame([*pairs, (7, 7), (None, 3)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(df).collect()} == components_of(pairs)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_clumps(spark):
    rnd = random.Random(3)
    cells = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(1900)}
    df = spark.createDataFrame(list(cells), "row int, col int")
    pairs = [(r * 60 + c, a * 60 + b) for r, c in cells for a, b in ((r + 1, c), (r, c + 1)) if (a, b) in cells]
    want = components_of(pairs + [(r * 60 + c, r * 60 + c) for r, c in cells])
    for tile in (8, 64):
        got = {r.row * 60 + r.col: r.label for r in graph.clumps(df, 60, tile=tile).collect()}
        assert got == want
    sizes = {k: list(want.values()).count(k) for k in set(want.values())}
    zones, _ = graph.mask_to_zones(df, 60, least=3)
    assert {r.zone_id: r.cells for r in zones.collect()} == {k: n for k, n in sizes.items() if n >= 3}


def test_travel_times(spark):
    rnd = random.Random(4)
    edges = {(rnd.randrange(80), rnd.randrange(80)): rnd.randrange(1, 50) for _ in range(260)}
    blocked = {e for k, e in enumerate(edges) if k % 9 == 0}
    for block in (set(), blocked):
        best, queue = {}, [(0, 0), (0, 40)]
        while queue:
            d, n = heapq.heappop(queue)
            if n in best or d > 120:
                continue
            best[n] = d
            for (u, v), c in edges.items():
                if v == n and (u, v) not in block:
                    heapq.heappush(queue, (d + c, u))
        df = spark.createDataFrame([(u, v, c) for (u, v), c in edges.items()], "u long, v long, cost long")
        sites = spark.createDataFrame([(0,), (40,), (0,)], "node long")
        barriers = spark.createDataFrame(list(block), "u long, v long") if block else None
        times = graph.travel_times(df, sites, 120, barriers)
        assert {r.node: r.seconds for r in times.collect()} == best
        areas = {r.node: r.contour for r in graph.service_area(times, (1, 2)).collect()}
        assert areas == {n: 1 if d <= 60 else 2 for n, d in best.items()}


def test_means_of_travel(spark):
    edges = spark.createDataFrame([(1, 2, 510, "motorway"), (2, 3, 510, "service"), (3, 4, 510, None)], "u long, v long, length_m long, cls string")
    of = lambda **how: {tuple(r) for r in graph.travel_seconds(edges, **how).collect()}
    assert of(mode="walk") == {(2, 3, 360), (3, 2, 360), (3, 4, 360), (4, 3, 360)}
    assert of(mode="bike") == {(2, 3, 102), (3, 4, 102)}
    assert of(speeds={"motorway": 51}) == {(1, 2, 36), (2, 3, 74), (3, 4, 46)}
    with pytest.raises(ValueError):
        graph.travel_seconds(edges, mode="fly")


def test_barriers_of_lines_and_polygons(spark):
    edges = spark.createDataFrame(
        [(1, 1, 0.0, 0.0, 100.0, 0.0), (2, 2, 0.0, 20.0, 100.0, 20.0), (3, 3, 203.0, 203.0, 204.0, 204.0), (4, 4, 0.0, 300.0, 50.0, 300.0), (5, 5, 190.0, 250.0, 260.0, 250.0)],
        "u long, v long, x1 double, y1 double, x2 double, y2 double",
    )
    lines = spark.createDataFrame([(50.0, 4.0, 50.0, 15.1), (50.0, 310.0, 50.0, 400.0)], "a double, b double, c double, d double").select(G.segment(*map(F.col, "abcd")).alias("geom"))
    squares = spark.createDataFrame([(200.0, 200.0, 300.0, 300.0)], "a double, b double, c double, d double").select(G.rectangle(*map(F.col, "abcd")).alias("geom"))
    blocked = lambda *on: {r.u for r in V.barrier_edges(edges, *on).collect()}
    assert blocked(lines) == {1, 2} and blocked(None, squares) == {3, 5} and blocked(lines, squares) == {1, 2, 3, 5} and blocked() == set()


def test_dilate_then_erode_holds_the_mask(spark):
    rnd = random.Random(5)
    cells = {(rnd.randrange(30), rnd.randrange(30)) for _ in range(200)}
    df = spark.createDataFrame(list(cells), "row int, col int")
    closed = {tuple(r) for r in focal.close_mask(df, 2).collect()}
    opened = {tuple(r) for r in focal.open_mask(df, 1).collect()}
    assert cells <= closed and opened <= cells


def test_tile_size_changes_nothing(spark):
    cells = spark.range(37 * 41).select((F.col("id") / 41).cast("int").alias("row"), (F.col("id") % 41).cast("int").alias("col"), F.sin(F.col("id") * 7.0).alias("value"))
    from geoexposure.operators import kernels as K

    def run(tile):
        out = focal.tiled_apply(cells, ["value"], lambda im: {"value": K.convolve(im["value"], K.disk(4))}, ["value"], 37, 41, tile=tile, halo=4)
        return {(r.row, r.col): round(r.value, 9) for r in out.collect()}

    whole = run(64)
    assert len(whole) == 37 * 41
    for tile in (3, 5, 16):
        assert run(tile) == whole
