"""Iterative jobs: clumps of cells, zones from masks, travel times."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoexposure.operators.components import connected_components
from geoexposure.sources.workspace import BROADCAST_ROWS, forget, keep

TILE = 256
#: Edges of mean cost that a bucket of travel times spans at least; narrower ones would have more rounds than they save work.
HOPS = 8
# km/h by road class.
SPEEDS = {"motorway": 105, "trunk": 90, "primary": 75, "secondary": 60, "tertiary": 50, "unclassified": 40, "residential": 35, "service": 25}

#: Top speeds (km/h) on foot and by bicycle, which go at one pace on every class of road but those closed to them. Walkers use edges both ways.
PACES, CLOSED = {"walk": 5.1, "bike": 18.0}, ("motorway", "trunk")


def _tile_labels(image: np.ndarray) -> np.ndarray:
    """Smallest index of the 4-connected clump of each set cell of a small image; other cells have the number of cells."""
    n = image.size
    labels = np.where(image, np.arange(n).reshape(image.shape), n)
    while True:
        padded = np.pad(labels, 1, constant_values=n)
        low = np.minimum.reduce([labels, padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])
        low = np.where(image, low, n)
        jump = np.append(low.ravel(), n)
        low = np.where(image, np.minimum(low, jump[jump[np.minimum(low, n)]]), n)
        if (low == labels).all():
            return labels
        labels = low


def clumps(cells: DataFrame, ncols: int, least: int = 1, tile: int = TILE) -> DataFrame:
    """(row, col, label) of the 4-connected clumps of cells that have ``least`` cells or more; the label is the smallest row * ncols + col.

    Cells are labelled within tiles; only clumps that meet across a tile's border go through the
    distributed components, so their rows are those of borders.
    """

    def label(key: tuple[int, int], rows: pd.DataFrame) -> pd.DataFrame:
        ty, tx = key
        image = np.zeros((tile, tile), bool)
        y, x = rows["row"].to_numpy() - ty * tile, rows["col"].to_numpy() - tx * tile
        image[y, x] = True
        i, j = np.divmod(_tile_labels(image)[y, x], tile)
        local = (i + ty * tile).astype("int64") * ncols + j + tx * tile
        return pd.DataFrame({"row": rows["row"], "col": rows["col"], "local": local})

    tiled = cells.select("row", "col").distinct().withColumn("_ty", F.floor(F.col("row") / tile).cast("int")).withColumn("_tx", F.floor(F.col("col") / tile).cast("int"))
    local = keep(tiled.groupBy("_ty", "_tx").applyInPandas(label, "row int, col int, local long"), "clumps-local")
    at_border = local.where((F.col("row") % tile == 0) | (F.col("col") % tile == 0) | ((F.col("row") + 1) % tile == 0) | ((F.col("col") + 1) % tile == 0))
    steps = F.explode(F.array(F.struct(F.lit(1).alias("i"), F.lit(0).alias("j")), F.struct(F.lit(0).alias("i"), F.lit(1).alias("j")))).alias("_d")
    ahead = at_border.select("row", "col", F.col("local").alias("src"), steps)
    ahead = ahead.select((F.col("row") + F.col("_d.i")).alias("row"), (F.col("col") + F.col("_d.j")).alias("col"), "src")
    edges = ahead.join(at_border.withColumnRenamed("local", "dst"), ["row", "col"]).where("src <> dst").select("src", "dst")
    joined = connected_components(edges)
    labelled = local.join(joined.withColumnRenamed("node", "local"), "local", "left").select("row", "col", F.coalesce("component", "local").alias("label"))
    if least <= 1:
        return labelled
    large = labelled.groupBy("label").count().where(F.col("count") >= least)
    return labelled.join(large, "label", "left_semi").select("row", "col", "label")


def mask_to_zones(cells: DataFrame, ncols: int, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Zones (zone_id, cells, area, extent) from the clumps of a mask, and their cells with weight 1 for zonal statistics."""
    labelled = keep(clumps(cells, ncols, least).withColumnRenamed("label", "zone_id"), "clump-zones")
    zones = labelled.groupBy("zone_id").agg(
        F.count("*").alias("cells"), F.count("*").cast("double").alias("area"), F.min("col").cast("double").alias("xmin"), (F.max("col") + 1).cast("double").alias("xmax"),
        F.min("row").cast("double").alias("ymin"), (F.max("row") + 1).cast("double").alias("ymax"),
    )
    return zones, labelled.withColumn("w", F.lit(1.0))


def travel_seconds(edges: DataFrame, speeds: dict[str, float] | None = None, default: float = 40.0, mode: str = "drive") -> DataFrame:
    """Edges (u, v, cost) of edges (u, v, length_m, cls): whole seconds (rounded up) by the means of travel ``mode``.

    Drivers go by the speed of the road's class (``speeds`` replaces those of the table), walkers and cyclists at one pace, not on motorways and trunk roads.
    """
    if mode not in ("drive", *PACES):
        raise ValueError(f"unknown mode {mode!r}; known: drive, {', '.join(PACES)}")
    if mode in PACES:
        open_to = edges.where(F.col("cls").isNull() | ~F.col("cls").isin(*CLOSED))
        cost = F.ceil(F.col("length_m") * 3.6 / PACES[mode]).cast("long").alias("cost")
        ways = open_to.select("u", "v", cost)
        return ways.unionByName(ways.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost")) if mode == "walk" else ways
    table = SPEEDS | (speeds or {})
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]
    speed = F.coalesce(F.element_at(F.create_map(*pairs), F.col("cls")), F.lit(float(default)))
    return edges.select("u", "v", F.ceil(F.col("length_m") * 3.6 / speed).cast("long").alias("cost"))


def travel_times(edges: DataFrame, sites: DataFrame, most: int, barriers: DataFrame | None = None, rounds: int = 500, width: int | None = None) -> DataFrame:
    """(node, seconds): least cost from each node to the nearest site, up to ``most``.

    ``edges``: u, v, cost; times run backwards along them. ``barriers`` (u, v) are left out. Nodes are settled in buckets of ``width`` seconds (if not given, a quarter of ``most``, or
    HOPS edges of mean cost if that is more): those in the current one go on, and go on again when their time falls, until none does; then the bucket is written and never touched again. A round writes
    what fell only; what lies beyond the bucket waits, and is merged when the next one begins. Tables of finished rounds are deleted.
    """
    if barriers is not None:
        edges = edges.join(barriers, ["u", "v"], "left_anti")
    edges = keep(edges.select("u", "v", "cost").where("u <> v"), "travel-edges")
    if width is None:
        width = max(most // 4, int(HOPS * (edges.agg(F.avg("cost")).first()[0] or 0)))
    width = max(1, width)
    settled, limit = [], width
    front = keep(sites.select("node", F.lit(0).cast("long").alias("seconds")).where(F.col("node").isNotNull()).distinct(), "travel")
    open_, going = [front], front.count()
    for _ in range(rounds):
        ahead = F.broadcast(front) if going <= BROADCAST_ROWS else front
        near = edges.join(ahead, edges["v"] == front["node"]).select(F.col("u").alias("node"), (F.col("seconds") + F.col("cost")).alias("seconds"))
        near = near.where(F.col("seconds") <= most).groupBy("node").agg(F.min("seconds").alias("seconds"))
        if settled:
            near = near.join(reduce(DataFrame.unionByName, settled).select("node"), "node", "left_anti")
        known = reduce(DataFrame.unionByName, open_).groupBy("node").agg(F.min("seconds").alias("_old"))
        fell = keep(near.join(known, "node", "left").where("_old IS NULL OR seconds < _old").select("node", "seconds"), "travel")
        open_.append(fell)
        front = fell.where(F.col("seconds") < limit)
        going = front.count()
        if not going:  # the bucket is settled: all that is open is merged, once, and the rest goes on to the next bucket that has anything
            least = keep(reduce(DataFrame.unionByName, open_).groupBy("node").agg(F.min("seconds").alias("seconds")), "travel-settled")
            forget(*(t for t in open_ if hasattr(t, "kept_path")))
            first, waiting = least.where(F.col("seconds") >= limit).agg(F.min("seconds"), F.count("*")).first()
            settled.append(least.where(F.col("seconds") < limit))
            if first is None:
                forget(edges)
                return reduce(DataFrame.unionByName, settled)
            rest, limit = least.where(F.col("seconds") >= limit), (first // width + 1) * width
            open_, front, going = [rest], rest.where(F.col("seconds") < limit), waiting
    raise RuntimeError(f"travel times did not settle in {rounds} rounds")


def service_area(times: DataFrame, minutes: tuple[int, ...] = (5, 15, 30, 60)) -> DataFrame:
    """(node, contour): the smallest contour (minutes) that a node lies in."""
    first = F.array_min(F.filter(F.array(*map(F.lit, minutes)), lambda m: F.col("seconds") <= m * 60))
    return times.select("node", first.alias("contour")).where("contour IS NOT NULL")


def disjoint_rings(areas: DataFrame, by: str = "grp") -> DataFrame:
    """Areas of contours less those of the next smaller one of the group. ``areas``: group, contour, area."""
    order = Window.partitionBy(by).orderBy("contour")
    return areas.select("*", (F.col("area") - F.coalesce(F.lag("area").over(order), F.lit(0.0))).alias("ring"))


def compare_barriers(base: DataFrame, barrier: DataFrame, columns: list[str]) -> DataFrame:
    """Contours with and without barriers: columns of the second with suffix _barrier, and the differences."""
    other = barrier.select("contour", *[F.col(c).alias(f"{c}_barrier") for c in columns])
    return base.join(other, "contour", "left").select("*", *[(F.col(c) - F.col(f"{c}_barrier")).alias(f"{c}_difference") for c in columns])
