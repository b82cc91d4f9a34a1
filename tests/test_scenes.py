"""Walks over scenes and tile systems against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from geoexposure.functions import projections as J
from geoexposure.operators import scenes
from geoexposure.plans import assess


def test_prune_similar(spark):
    rnd = random.Random(1)
    sets = {(t, k): set(rnd.sample(range(40), rnd.randrange(5, 25))) for t in range(4) for k in range(1, 9)}
    want = set()
    for t in range(4):
        cover = set()
        for k in range(1, 9):
            own = sets[t, k]
            if not cover or len(own & cover) / len(own | cover) <= 0.5:
                cover |= own
                want.add((t, k))
    df = spark.createDataFrame([(t, k, c) for (t, k), own in sets.items() for c in own], "tile int, rank int, cell int")
    assert {tuple(r) for r in scenes.prune_similar(df).collect()} == want


def test_walks_take_all_scenes_of_a_tile(spark):
    from geoexposure.plans import queries_scenes

    # The first 25 scenes share one footprint, later ones add cells.
    rows = [(k, 1, 0, 5) for k in range(25)] + [(25, 1, 1, 60)]
    view = spark.createDataFrame(rows, "scene_id long, tile long, cloud int, coverage int")

    class Own:
        def sql(self, text):
            return spark.sql(text, scenes=view)

    for plan, want in ((queries_scenes.scn5_all, [1, 26]), (queries_scenes.scn6, [1, 26])):
        assert sorted(r["rank"] for r in plan(Own()).collect()) == want


def test_greedy_cover_stops_when_little_is_left(spark):
    rnd = random.Random(6)
    area = {t: set(range(3000 if t else 500)) for t in range(3)}
    walk = {t: [set(rnd.sample(range(3500), rnd.randrange(400, 2500))) for _ in range(14)] for t in range(3)}
    walk[1][:3] = [set(range(2000)), set(range(1500, 2998)), set(range(2990, 3000))]  # two of 3000 cells are left before the third
    want = set()
    for t, sets in walk.items():
        rest, n = set(area[t]), 0
        for rank, own in enumerate(sets, 1):
            if not rest & own:
                continue
            want.add((t, rank, len(rest & own)))
            rest, n = rest - own, n + 1
            if len(rest) < len(area[t]) * 0.001 or n == 10:
                break
    cells = spark.createDataFrame([(t, k, c) for t, sets in walk.items() for k, own in enumerate(sets, 1) for c in own], "tile int, rank int, cell int")
    target = spark.createDataFrame([(t, c) for t, own in area.items() for c in own] * 2, "tile int, cell int")
    assert {tuple(r) for r in scenes.greedy_cover(cells, target=target).select("tile", "rank", "added").collect()} == want
    assert {r for r in want if r[0] == 1} == {(1, 1, 2000), (1, 2, 998)}


def test_minimum_cover(spark):
    rnd = random.Random(2)
    for size in (6, 14):
        sets = {g: set(rnd.sample(range(30), size)) for g in range(7)}
        target = set(range(25))
        cells = spark.createDataFrame([(g, c) for g, own in sets.items() for c in own], "granule int, cell int")
        for most in (3, None):
            found = (c for n in range(1, (most or 7) + 1) for c in itertools.combinations(sorted(sets), n))
            best = max(found, key=lambda c: (len(set().union(*(sets[g] for g in c)) & target), -len(c), [-g for g in c]))
            row = scenes.minimum_cover(cells, spark.createDataFrame([(c,) for c in target], "cell int"), most).first()
            assert tuple(row.ids) == best and row.covered == len(set().union(*(sets[g] for g in best)) & target)


def widened(own, cells, area, most_days=365, enough=6):
    """(steps, candidates, covered) of one tile by widening the window step by step."""
    for k in range(most_days // 7 + 1):
        inside = {s for s, d in own if d <= 7 * k}
        held = 100.0 * len(set().union(set(), *(cells.get(s, set()) for s in inside)) & area) / len(area)
        if inside and (held >= 99.99 or len(inside) == enough):
            return k, len(inside), held
    return None, len(inside), held


def test_search_widens_until_the_tile_is_covered(spark):
    rnd = random.Random(8)
    own, cells, want = {}, {}, {}
    for tile in range(40):
        own[tile] = [(tile * 100 + i, rnd.choice([0, 0, 3, 7, 8, 30, 100, 363, 364, 365, 900])) for i in range(rnd.choice([1, 3, 8, 20]))]
        cells[tile] = {s: set(rnd.sample(range(30), rnd.choice([2, 10, 25]))) for s, _ in own[tile]}
        want[tile] = widened(own[tile], cells[tile], set(range(20)))
    scene = spark.createDataFrame([(t, s, d) for t, rows in own.items() for s, d in rows] + [(0, own[0][0][0], 900)], "tile int, scene_id int, days_outside int")
    cell = spark.createDataFrame([(t, s, c) for t, rows in cells.items() for s, held in rows.items() for c in held], "tile int, scene_id int, cell int")
    target = spark.createDataFrame([(t, c) for t in own for c in range(20)], "tile int, cell int")
    got = {r.tile: (r.steps, r.candidates, pytest.approx(r.covered)) for r in scenes.expand_until_covered(scene, cell, target).collect()}
    assert got == want and {None} < {k for k, _, _ in want.values()}


def test_files_fall_back_by_level_and_route(spark):
    whole = lambda day, level, route, product, ts="t", n=2: [(day, level, route, product, tile, ts) for tile in range(n)]
    rows = whole(1, "A2", "bulk", "p") + whole(1, "A2", "api", "p") + whole(1, "A1", "api", "q")  # the first route of the first level, and the next level too
    rows += whole(2, "A2", "bulk", "a", n=1) + whole(2, "A2", "bulk", "b") + whole(2, "A2", "api", "c")  # the first product isn't whole: the next route
    rows += whole(3, "A2", "bulk", "a", n=1) + whole(3, "A1", "bulk", "a") + [(3, "A1", "bulk", "a", 0, "t")]  # the next level
    rows += whole(4, "A2", "bulk", "a", "t", 1) + [(4, "A2", "bulk", "a", 1, "u")] + whole(5, "A3", "bulk", "a")  # two timestamps; an unknown level
    files = spark.createDataFrame(rows, "day int, level string, route string, product string, tile int, ts string")
    got = {tuple(r) for r in scenes.complete_tile_set_by_route(files, 2, ["A2", "A1"], ["bulk", "api"]).collect()}
    assert got == {(1, "A2", "bulk", "p", "t", True), (1, "A1", "api", "q", "t", False), (2, "A2", "api", "c", "t", True), (3, "A1", "bulk", "a", "t", True)}


def test_squares_and_back(spark):
    """A point's square and the metres within it give the point again, within a metre, in all zones and bands."""
    rnd = random.Random(9)
    points = [(i, rnd.uniform(-180, 180), rnd.uniform(-80, 84)) for i in range(3000)] + [(3000 + k, 6.0 * k - 180 + 3, 8.0 * (k % 20) - 80 + 1e-6) for k in range(60)]
    df = spark.createDataFrame(points, "i int, lon double, lat double")
    east, north = J.to_utm(F.col("lon"), F.col("lat"), J.utm_zone(F.col("lon")))
    there = df.select("*", J.to_mgrs_100k(F.col("lon"), F.col("lat")).alias("s"), F.pmod(east, F.lit(1e5)).alias("e"), F.pmod(north, F.lit(1e5)).alias("n"))
    there = there.withColumn("p", J.from_mgrs_100k(F.col("s"), F.col("e"), F.col("n")))
    lon, lat = F.col("p.lon"), F.col("p.lat")
    off = F.hypot((lon - F.col("lon")) * 111320 * F.cos(F.radians("lat")), (lat - F.col("lat")) * 111320)
    assert there.agg(F.max(off), F.count(off)).first() == (pytest.approx(0, abs=0.05), len(points))
    odd = spark.createDataFrame([("31U DQ",), ("31UIQ",), ("61UDQ",), (None,), ("",)], "s string").select(J.from_mgrs_100k(F.col("s")).alias("p"))
    assert [r.p is None for r in odd.collect()] == [False, True, True, True, True]


def test_minimum_cover_of_any_size(spark):
    # Five strips cover the target; the sixth granule repeats half of two of them.
    sets = {g: set(range(5 * g, 5 * g + 5)) for g in range(5)} | {5: {3, 4, 5, 6}}
    cells = spark.createDataFrame([(g, c) for g, own in sets.items() for c in own], "granule int, cell int")
    row = scenes.minimum_cover(cells, spark.createDataFrame([(c,) for c in range(25)], "cell int"), most=None).first()
    assert (row.ids, row.covered, row.pct) == ([0, 1, 2, 3, 4], 25, 100.0)
    # Where no set covers all, the smallest that covers the most is taken.
    row = scenes.minimum_cover(cells, spark.createDataFrame([(c,) for c in range(50)], "cell int"), most=None).first()
    assert (row.ids, row.covered, row.pct) == ([0, 1, 2, 3, 4], 25, 50.0)


def test_squares_of_boxes_hold_their_points(spark):
    boxes = spark.createDataFrame([(0, 5.0, 50.0, 9.0, 53.0), (1, -3.0, -2.0, 1.0, 2.0), (2, 179.0, 60.0, 179.9, 61.0), (3, 179.0, -17.5, -178.5, -15.5), (4, 11.0, 79.0, 25.0, 84.5)], "id int, xmin double, ymin double, xmax double, ymax double")
    found = {(r.id, r.square) for r in J.mgrs_tiles_for_bbox(boxes).collect()}
    rnd = random.Random(3)
    points = []
    for b in boxes.collect():
        width = (b.xmax - b.xmin) % 360
        for _ in range(3000):
            on = rnd.choice((0.0, 1.0, rnd.random()))  # edges and corners often
            lon = (b.xmin + width * rnd.choice((on, rnd.random())) + 180) % 360 - 180
            points.append((b.id, lon, min(84.0, b.ymin + (b.ymax - b.ymin) * rnd.choice((on, rnd.random())))))
    df = spark.createDataFrame(points, "id int, lon double, lat double").select("id", J.to_mgrs_100k(F.col("lon"), F.col("lat")).alias("square"))
    seen = [(r.id, r.square) for r in df.collect()]
    assert set(seen) <= found
    # What no point was drawn in are slivers.
    assert len(found - set(seen)) <= 0.1 * len(found)
    assert {s[:2] for b, s in found if b == 3} == {"60", "01"}


def test_known_squares(spark):
    # Public reference points: Greenwich, Sydney, New York.
    df = spark.createDataFrame([(-0.0015, 51.4779), (151.2153, -33.8568), (-73.9857, 40.7484), (0.0, -85.0), (0.0, 85.0)], "lon double, lat double")
    got = [r[0] for r in df.select(J.to_mgrs_100k(F.col("lon"), F.col("lat"))).collect()]
    assert got == ["30UYC", "56HLH", "18TWL", "Too far South", "Too far North"]


def test_detect_outage_finds_a_dark_block(spark):
    rows = [(r, c, 80.0 + (r * 7 + c * 3) % 11) for r in range(30) for c in range(30)]
    base = spark.createDataFrame([(r, c, v, 1) for r, c, v in rows], "row int, col int, radiance double, land_water int")
    dark = lambda r, c: 10 <= r < 20 and 5 <= c < 16
    seen = [(r, c, g, g, v * (0.02 if dark(r, c) else 1.0), 192 if g == 1 and (r + c) % 5 == 0 else 0) for r, c, v in rows for g in (1, 2)]
    cells, zones = assess.detect_outage(spark.createDataFrame(seen, "row int, col int, granule int, order int, radiance double, quality int"), base, 30, 30)
    zone = zones.collect()
    # The block has 110 cells; smoothing darkens the cells around it too, 156 with them.
    assert len(zone) == 1 and 110 <= zone[0].cells <= 156
    hit = [(r.row, r.col) for r in cells.where("zone_id IS NOT NULL").collect()]
    assert all(8 <= r < 22 and 3 <= c < 18 for r, c in hit)


def test_minimum_covers_of_many_boxes(spark):
    """Boxes that need other sizes of sets, one whose cells no granule holds, and targets that repeat; ties go to the lowest names."""
    rnd = random.Random(12)
    sets, target, want = {}, {}, {}
    for box in range(12):
        sets[box] = {f"g{k}": set(rnd.sample(range(16), rnd.choice([2, 5, 9]))) for k in range(rnd.choice([1, 2, 4, 6]))}
        target[box] = set(rnd.sample(range(20), 8))
        found = [c for n in range(1, len(sets[box]) + 1) for c in itertools.combinations(sorted(sets[box]), n)]
        held = lambda c, b=box: len(set().union(*(sets[b][g] for g in c)) & target[b])
        best = min(found, key=lambda c: (-held(c), len(c), c))
        want[box] = (list(best), held(best), pytest.approx(held(best) * 12.5))
    target[99] = {1, 2}
    cells = spark.createDataFrame([(b, g, c) for b, own in sets.items() for g, held in own.items() for c in held] * 2, "box int, granule string, cell int")
    wanted = spark.createDataFrame([(b, c) for b, own in target.items() for c in own] * 2, "box int, cell int")
    got = {r.box: (r.ids, r.covered, r.pct) for r in scenes.minimum_covers(cells, wanted).collect()}
    assert got == {b: w for b, w in want.items() if w[1]} and len({len(w[0]) for w in want.values()}) > 2
    assert scenes.minimum_covers(cells.limit(0), wanted).count() == 0
