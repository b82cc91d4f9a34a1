"""Connected components of a graph held as a table of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoexposure.sources.workspace import forget, keep


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them. Edges go from larger (u) to smaller (v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node links its larger neighbours to the smallest neighbour, or to itself if it is smaller; and the kept table that this reads."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written first, so that both sides of the join are plain scans and Spark can split the edges of a node that has very many.
    least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 40) -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its smallest node.

    A round costs shuffles of as many rows as there are edges and never gathers a component; rounds grow with the logarithm
    of the longest path. Each round is written to the shared folder, so the lineage stays short, and the round before it is deleted. Null ends and loops
    are ignored.
    """
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(f"u <> v AND {src} IS NOT NULL AND {dst} IS NOT NULL").distinct()
    now = keep(now, "edges")
    state = None
    for _ in range(rounds):
        moved, least = _large_star(now)
        before, now = now, keep(_small_star(moved), "edges")
        forget(before, least)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
