"""Geometry as arrays: a line is array<struct<x, y>>, a polygon an array of closed rings, of any orientation: a ring within an odd number of others is a hole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "array<struct<x:double,y:double>>"
POLYGON = f"array<{LINE}>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segment(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(point(x1, y1), point(x2, y2))


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A polygon of one ring, counter-clockwise."""
    corners = ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin))
    return F.array(F.array(*[point(x, y) for x, y in corners]))


def _sides(ring: Column, of) -> Column:
    """Array of ``of(from, to)`` for each side of a line or ring."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), of)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(ring: Column) -> Column:
    return _total(_sides(ring, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]) / 2))


def ring_sides(ring: Column) -> Column:
    """The sides of a ring (x1, y1, x2, y2), one from its last point to its first included."""
    to = lambda i: F.get(ring, (i + 1) % F.size(ring))
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), to(i)["x"].alias("x2"), to(i)["y"].alias("y2")))


def between(low: Column, high: Column) -> Column:
    """Array of the whole numbers in [low, high]."""
    first, last = F.ceil(low).cast("long"), F.floor(high).cast("long")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))


def steps(values: Column, of) -> Column:
    """Array of ``of(value, next value)`` of an array."""
    return _sides(values, of)


def oriented(polygon: Column) -> Column:
    """The polygon with its rings wound by how deep they lie: shells counter-clockwise, holes clockwise, islands in holes counter-clockwise again.

    A ring lies in another one if most of the middles of three of its sides do, so rings may touch. A polygon of one ring is not looked at further.
    """

    def middle(ring: Column, k: int) -> Column:
        at = ((F.size(ring) - 1) * k / 3).cast("int")
        p, q = F.get(ring, at), F.get(ring, at + 1)
        return point((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2)

    def known(ring: Column) -> Column:
        return F.struct(ring.alias("ring"), bbox(ring).alias("box"), F.array(*[middle(ring, k) for k in range(3)]).alias("probes"), signed_area(ring).alias("area"))

    def lies_in(a: Column, b: Column) -> Column:
        near = (a["box"]["xmin"] <= b["box"]["xmax"]) & (b["box"]["xmin"] <= a["box"]["xmax"]) & (a["box"]["ymin"] <= b["box"]["ymax"]) & (b["box"]["ymin"] <= a["box"]["ymax"])
        votes = F.aggregate(a["probes"], F.lit(0), lambda n, p: n + _crossings(b["ring"], p["x"], p["y"]) % 2)
        return near & (F.abs(b["area"]) > F.abs(a["area"])) & F.when(near, votes >= 2).otherwise(F.lit(False))

    def wound(rings: Column) -> Column:
        depth = lambda a: F.size(F.filter(rings, lambda b: lies_in(a, b)))
        return F.transform(rings, lambda a: F.when((a["area"] < 0) == (depth(a) % 2 == 1), a["ring"]).otherwise(F.reverse(a["ring"])))

    # The outer array binds what is known of the rings to a name, so it is worked out once.
    return F.when(F.size(polygon) <= 1, polygon).otherwise(F.get(F.transform(F.array(F.transform(polygon, known)), wound), F.lit(0)))


def area(polygon: Column) -> Column:
    """Planar area; holes subtract, whichever way rings are wound."""
    return F.abs(_total(F.transform(oriented(polygon), signed_area)))


def length(line: Column) -> Column:
    return _total(_sides(line, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def centroid(polygon: Column) -> Column:
    """Centre of area as a struct; null for a polygon without area."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    moment = lambda g, axis: _total(F.transform(g, lambda r: _total(_sides(r, lambda p, q: (p[axis] + q[axis]) * cross(p, q) / 6))))
    whole = lambda g: _total(F.transform(g, signed_area))
    of = lambda g: F.when(whole(g) != 0, F.struct((moment(g, "x") / whole(g)).alias("x"), (moment(g, "y") / whole(g)).alias("y")))
    return F.get(F.transform(F.array(oriented(polygon)), of), F.lit(0))


def bbox(points: Column) -> Column:
    """Extent of an array of points."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def _crossings(ring: Column, x: Column, y: Column) -> Column:
    """How many sides of a ring a ray to the right crosses."""

    def crossing(p: Column, q: Column) -> Column:
        across = (p["y"] > y) != (q["y"] > y)
        return (across & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(across, q["y"] - p["y"]).otherwise(1.0) + p["x"])).cast("int")

    return F.aggregate(_sides(ring, crossing), F.lit(0), lambda a, v: a + v)


def contains(polygon: Column, x: Column, y: Column) -> Column:
    """Parity of crossings of a ray to the right; half-open in y, so a point on a shared side lies in one polygon."""
    return F.aggregate(polygon, F.lit(0), lambda n, ring: n + _crossings(ring, x, y)) % 2 == 1


def point_segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.hypot(x - x1 - dx * along, y - y1 - dy * along)


def segment_distance(x1: Column, y1: Column, x2: Column, y2: Column, px: Column, py: Column, qx: Column, qy: Column) -> Column:
    """Distance of the segments (x1, y1)-(x2, y2) and (px, py)-(qx, qy); 0 where they cross."""
    turn = lambda ax, ay, bx, by, cx, cy: F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    crossing = (turn(x1, y1, x2, y2, px, py) * turn(x1, y1, x2, y2, qx, qy) < 0) & (turn(px, py, qx, qy, x1, y1) * turn(px, py, qx, qy, x2, y2) < 0)
    gaps = [point_segment_distance(x, y, px, py, qx, qy) for x, y in ((x1, y1), (x2, y2))] + [point_segment_distance(x, y, x1, y1, x2, y2) for x, y in ((px, py), (qx, qy))]
    return F.when(crossing, 0.0).otherwise(F.least(*gaps))


def cover(low: Column, high: Column, step: float) -> Column:
    """Numbers of the grid intervals of width ``step`` that [low, high] meets."""
    return F.sequence(F.floor(low / step).cast("long"), F.floor(high / step).cast("long"))
