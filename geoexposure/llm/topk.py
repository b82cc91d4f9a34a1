"""Exact top-k search by inner product with pivot tables.

Distances of every vector to many pivots, which lie far apart, are computed once. For a query and a vector the
largest difference of their distances to a pivot is a lower bound of their own distance, hence an upper bound of
their inner product. Vectors are cut into blocks by their nearest pivot; for a block the ranges of its distances bound
all its members at once. A query first meets its own block, which tells what score others must reach; then
blocks whose bound falls short of it are left out, and within a block candidates are evaluated in the order of their
bounds until none that is left can reach the query's k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoexposure.llm.shared import bounded, keep

SCALE, PIVOTS = 256, 64
#: Pivots are chosen from so many vectors for each of them.
POOL = 32
ROW_BLOCK, QUERY_BLOCK = 8192, 1024
#: Rows whose bounds are held in memory at once, and the share of candidates evaluated in a step, by their bounds.
PART, STEPS = 2048, (0.03, 0.25, 1.0)
#: Bounds that are worked out at once.
TILE = 1 << 16
#: Bounds are widened by this part of the squared lengths, more than rounding of 32-bit distances can make of them.
SLACK = 1e-5


def whole_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x). Rows with a null id, no vector, or a null or non-finite component take no part."""
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector)).where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & sound)
    return rows.select("vec_id", F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def stacked(vectors: pd.Series, width: int) -> np.ndarray:
    """The vectors as rows; missing components at the end count as zero."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows; in floating point where every sum is below 2 ** 53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors.astype(float) ** 2).sum(1)[:, None] - 2.0 * (vectors.astype(float) @ pivots.T) + (pivots**2).sum(1)
    return np.sqrt(np.maximum(squares, 0))


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the vectors (all, if fewer), each the one farthest from those before it."""
    if len(vectors) <= n:
        return vectors
    chosen, gap = [0], distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < n:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


def upper_bounds(q: np.ndarray, dq: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products, queries by candidates, from squared lengths (``q``, ``x``: largest of a block) and distances to pivots.

    A candidate's distance to a pivot lies from ``low`` to ``high``: for one vector both are its distance, for a block they are its range.
    """
    middle, half = np.ascontiguousarray(((low + high) / 2).T), np.ascontiguousarray(((high - low) / 2).T)
    gap = np.zeros((len(q), len(x)), np.float32)
    few = max(1, TILE // max(1, len(x)))
    for at in range(0, len(q), few):  # a tile stays in the processor's cache while all pivots are gone through
        own, d = gap[at : at + few], dq[at : at + few]
        step = np.empty_like(own)
        for p in range(dq.shape[1]):
            np.abs(np.subtract(d[:, p, None], middle[p], out=step), out=step)
            if low is not high:
                step -= half[p]
            np.maximum(own, step, out=own)
    lengths = q[:, None] + x
    return (lengths - gap.astype(float) ** 2) / 2 + SLACK * (lengths + 1)


class Best:
    """The k best (score, id) of each query; larger scores first, then smaller ids."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.scores, self.ids = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, real: np.ndarray) -> None:
        """Candidates by query; ``real`` marks those that count."""
        lowest = np.iinfo(np.int64).min
        scores = np.concatenate([self.scores, np.where(real, scores, lowest)], 1)
        ids = np.concatenate([self.ids, np.broadcast_to(ids, real.shape)], 1)
        order = np.lexsort((ids, -np.maximum(scores, lowest + 1)), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        if self.scores.shape[1] == self.k:
            self.least = np.maximum(self.least, self.scores[:, -1])

    def rows(self, queries: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(self.scores > np.iinfo(np.int64).min)
        return pd.DataFrame({"query_id": queries[i], "score": self.scores[i, j], "vec_id": self.ids[i, j]})


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> tuple[pd.DataFrame, int]:
    """The k best rows of one block for each query, and how many candidates were evaluated.

    Columns: vec_id, v, d (distances to pivots), and of ``queries`` least: the score that a candidate must reach.
    """
    nothing = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "score", "vec_id")})
    if not len(queries) or not len(rows):
        return nothing, 0
    width = max(map(len, [*queries["v"], *rows["v"]]))
    q, own = stacked(queries["v"], width), queries["vec_id"].to_numpy()
    dq, nq = np.stack(queries["d"]).astype(np.float32), (q.astype(float) ** 2).sum(1)
    best, evaluated = Best(len(q), k, queries["least"].to_numpy()), 0
    for at in range(0, len(rows), PART):
        part = rows.iloc[at : at + PART]
        x, ids, dx = stacked(part["v"], width), part["vec_id"].to_numpy(), np.stack(part["d"]).astype(np.float32)
        nx = (x.astype(float) ** 2).sum(1)
        reach = upper_bounds(nq, dq, nx.max(keepdims=True), dx.min(0, keepdims=True), dx.max(0, keepdims=True))[:, 0] >= best.least
        some = np.flatnonzero(reach)
        if not len(some):
            continue
        bound = upper_bounds(nq[some], dq[some], nx, dx, dx)
        bound[own[some, None] == ids] = -np.inf
        # The order of the bounds in a few steps: the best share first, then what can still reach the k-th score.
        done = np.zeros(bound.shape, bool)
        for share in STEPS:
            n = max(k, int(share * len(x)))
            line = np.partition(bound, len(x) - n, axis=1)[:, len(x) - n, None] if n < len(x) else -np.inf
            now = (bound >= np.maximum(line, best.least[some, None])) & (bound > -np.inf) & ~done
            columns = np.flatnonzero(now.any(0))
            if len(columns):
                evaluated += int(now.sum())
                done |= now
                scores = products(q[some], x[columns])
                real = now[:, columns] & (scores >= best.least[some, None])
                # Only the columns that matter to a query are sorted: as many as the query with the most has.
                most = int(real.sum(1).max())
                if most:
                    taken = np.argsort(~real, axis=1, kind="stable")[:, :most] if most < len(columns) else np.broadcast_to(np.arange(len(columns)), real.shape)
                    new = Best(len(some), k, best.least[some])
                    if best.scores.shape[1]:
                        new.scores, new.ids = best.scores[some], best.ids[some]
                    new.add(np.take_along_axis(scores, taken, 1), ids[columns][taken], np.take_along_axis(real, taken, 1))
                    best = merged(best, new, some)
    return best.rows(own), evaluated


def merged(best: Best, new: Best, some: np.ndarray) -> Best:
    """``best`` with the rows ``some`` of ``new``."""
    short = new.scores.shape[1] - best.scores.shape[1]
    if short > 0:
        best.scores = np.pad(best.scores, ((0, 0), (0, short)), constant_values=np.iinfo(np.int64).min)
        best.ids = np.pad(best.ids, ((0, 0), (0, short)))
    best.scores[some], best.ids[some], best.least[some] = new.scores, new.ids, new.least
    return best


def blocks_of(table: DataFrame, pivots: int, row_block: int) -> tuple[DataFrame, int]:
    """(vec_id, v, d, n, block), and how many blocks: distances to the pivots, the squared length, and the block, of about ``row_block`` vectors that have the same nearest pivot or neighbouring ones.

    Pivots come from a sample of POOL vectors for each of them, in the order of hashes; every vector is in the table. Blocks are
    ranges of (nearest pivot, distance to it, vec_id), so a vector that is repeated under many ids does not swell one.
    """
    chosen = table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots * POOL).toPandas()
    width = max(map(len, chosen["v"]), default=0)
    points = far_apart(stacked(chosen["v"], width).astype(float), pivots)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                wide = max(width, *map(len, rows["v"])) if len(rows) > 1 else max(width, len(rows["v"].iloc[0]))
                d = distances(stacked(rows["v"], wide), np.pad(points, ((0, 0), (0, wide - width)))).astype(np.float32)
                near = d.argmin(1)
                n = [float(v @ v) for v in map(np.asarray, rows["v"])]
                yield rows.assign(d=list(d), n=n, near=near, gap=d[np.arange(len(d)), near])

    n = max(1, -(-table.count() // row_block))
    far = table.mapInPandas(measured, "vec_id long, v array<long>, d array<float>, n double, near long, gap float")
    placed = far.repartitionByRange(n, "near", "gap", "vec_id").withColumn("block", F.spark_partition_id())
    return keep(placed.select("vec_id", "v", "d", "n", "block"), "topk-pivot-table"), n


def reached(ranges: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """(block, qb) of the blocks that any of the queries can find a candidate in."""
    found = np.zeros(0, np.int64)
    if len(ranges) and len(queries):
        bound = upper_bounds(queries["n"].to_numpy(), np.stack(queries["d"]), ranges["n"].to_numpy(), np.stack(ranges["low"]), np.stack(ranges["high"]))
        found = ranges["block"].to_numpy()[(bound >= queries["least"].to_numpy()[:, None]).any(0)]
    return pd.DataFrame({"block": found, "qb": np.full(len(found), queries["qb"].iloc[0] if len(queries) else 0)})


def block_ranges(table: DataFrame) -> DataFrame:
    """(block, low, high, n): the ranges of distances and the largest squared length of each block; batches come down to a row for each block before they meet."""

    def summed(rows: pd.DataFrame, low: str, high: str) -> pd.DataFrame:
        found = [(b, np.stack(g[low]).min(0), np.stack(g[high]).max(0), g["n"].max()) for b, g in rows.groupby("block")]
        return pd.DataFrame(found, columns=["block", "low", "high", "n"])

    schema = "block int, low array<float>, high array<float>, n double"
    parts = table.select("block", "d", "n").mapInPandas(lambda batches: (summed(x, "d", "d") for x in batches if len(x)), schema)
    return parts.groupBy("block").applyInPandas(lambda x: summed(x, "low", "high"), schema)


def active_blocks(table: DataFrame, queries: DataFrame, blocks: int, query_blocks: int) -> DataFrame:
    """(block, qb): the blocks of rows, each with the blocks of queries of which one can reach its best bound."""
    share = F.lit(max(1, blocks // 512))  # a block of queries looks at so many groups of blocks
    ranges = block_ranges(table).select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), F.pmod("block", share).alias("s"))
    asked = queries.select("qb", "d", "least", "n", F.explode(F.sequence(F.lit(0), share - 1)).alias("s"))
    return ranges.groupBy("qb", "s").cogroup(asked.groupBy("qb", "s")).applyInPandas(reached, "block int, qb int")


def top_k(vectors: DataFrame, is_query: str | Column, k: int = 5, pivots: int = PIVOTS, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query with the other vectors, ties to the smaller id.

    ``vectors``: vec_id, v (see ``whole_vectors``); ``is_query``: a condition on vec_id. A repeated id counts once, with its smallest
    vector; vectors of fewer components than others count as filled up with zeros, so very long ones only cost their length. An empty table
    gives an empty table; other columns, of whatever names, are ignored. Memory of a task is bounded by the block sizes; the work is that of every
    query against every row, less what the bounds rule out.
    """
    once = keep(vectors.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-vectors")
    table, blocks = blocks_of(once, pivots, row_block)

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return search_block(queries, rows, k)[0]

    asked = keep(table.where(is_query).withColumn("least", F.lit(-(1 << 62)).cast("long")), "topk-queries")
    found = "query_id long, score long, vec_id long"
    first = keep(asked.groupBy("block").cogroup(table.join(bounded(asked.select("block").distinct()), "block", "left_semi").groupBy("block")).applyInPandas(search, found), "topk-first")
    known = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("known"))
    query_blocks = max(1, -(-asked.count() // query_block))
    asked = asked.join(known, asked["vec_id"] == known["query_id"], "left").select("vec_id", "v", "d", "n", "block", F.coalesce("known", "least").alias("least"))
    asked = keep(asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")), "topk-asked")
    active = keep(active_blocks(table, asked, blocks, query_blocks), "topk-active")
    rows = table.join(bounded(active), "block")
    mine = asked.withColumnRenamed("block", "own").join(bounded(active), "qb").where("own <> block")
    rest = mine.groupBy("block", "qb").cogroup(rows.groupBy("block", "qb")).applyInPandas(search, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = first.unionByName(rest).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP5_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.e, c.e)]) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
