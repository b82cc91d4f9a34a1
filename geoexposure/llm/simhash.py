"""SimHash near-dedup over a Gray-order hierarchical index of fingerprints.

A fingerprint has a bit set where over half the hashes of a text's features have it. The index is a forest: its
roots are shared masked patterns, the bits of a fingerprint under one of several masks. Two fingerprints that are close have
the same pattern under one mask at least, so they meet under a root. Below a root, fingerprints are sorted by their Gray rank,
which puts those with few differing bits side by side, and runs of them form nodes: the bits that all members share are factored into
the node (a mask and a pattern). A search goes down with the differences that it has met so far and leaves out a whole
node as soon as they are too many. Spark shuffles by root and sorts by Gray rank; tasks build the lower levels.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoexposure.llm.shared import bounded, filled, id_and_text, keep, slices
from geoexposure.operators.components import connected_components

SEED = 42
#: Members of a lowest node, and nodes in a node above.
LEAF, FAN = 16, 8
#: Fingerprints under one root that a task handles; larger roots are split into pairs of blocks.
BLOCK = 4096
#: Pairs of 64-bit words in memory at once.
PAIRS = 1 << 19


def features(text: str | None, words: int) -> list[bytes]:
    """The text's runs of ``words`` words in lower case (A-Z only), repeats included; of a shorter text the whole sequence, of none nothing."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints, as rows of bytes, of groups of hashes (rows of bytes) that end at ``ends``."""
    starts = np.concatenate([[0], ends[:-1]])
    counts = ends - starts
    out = np.zeros((len(ends), hashes.shape[1]), np.uint8)
    full = counts > 0
    if full.any():
        ones = np.add.reduceat(np.unpackbits(hashes, axis=1), starts[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > counts[full, None], axis=1)
    return out


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) per row: the 64-bit fingerprint of the hashes XXH64 (seed 42) of the text's shingles, as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=2 << 20):
            digests, ends = [], []
            for text in filled(part.column("text")).to_pylist():
                digests += map(xxhash.xxh64_digest, features(text, words), itertools.repeat(SEED))
                ends.append(len(digests))
            rows = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
            fp = majority(rows, np.array(ends)).view(">i8").ravel().astype(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fp": pa.array(fp)})

    return id_and_text(docs).mapInArrow(hashed, "doc_id long, fp long")


def root_masks(bits: int) -> list[int]:
    """Masks of which one at least covers no differing bit of two fingerprints with ``bits`` differing bits or fewer.

    The 64 bits are cut into ``bits`` + 2 blocks; a mask covers two of them. Differing bits spoil ``bits`` blocks at most.
    """
    edges = [64 * i // (bits + 2) for i in range(bits + 3)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    masks = [x | y for x, y in itertools.combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def gray_rank(fp: Column) -> Column:
    """Rank of a fingerprint in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; the last axis holds the 64-bit words of a fingerprint."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


class GrayIndex:
    """The nodes over fingerprints (rows of 64-bit words) that are sorted by Gray rank; level 0 are the lowest nodes."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.levels, self.pairs = fps, [], PAIRS // fps.shape[1]
        common = (~np.zeros_like(fps), fps)
        for size in itertools.chain([LEAF], itertools.repeat(FAN)):
            masks, patterns = common
            starts = np.arange(0, len(masks), size)
            every = np.bitwise_and.reduceat(patterns & masks, starts, axis=0)
            none = np.bitwise_and.reduceat(~patterns & masks, starts, axis=0)
            common = (every | none, every)
            self.levels.append((size, *common))
            if len(starts) <= FAN:
                break

    def close(self, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) numbers of all pairs with ``most`` differing bits or fewer, in parts."""
        top = len(self.levels[-1][1])
        step = max(1, self.pairs // (top * 64))
        for at in range(0, len(queries), step):
            q = np.repeat(np.arange(at, min(at + step, len(queries))), top)
            yield from self._down(queries, q, np.tile(np.arange(top), len(q) // top), np.zeros(len(q), np.int32), len(self.levels) - 1, most)

    def _down(self, queries, q, node, met, level, most) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Goes from nodes to their members; ``met``: differing bits under the masks of the nodes above."""
        size, masks, patterns = self.levels[level]
        new = masks[node]
        if level + 1 < len(self.levels):
            new = new & ~self.levels[level + 1][1][node // self.levels[level + 1][0]]
        met = met + np.bitwise_count((queries[q] ^ patterns[node]) & new).sum(-1, dtype=np.int32)
        stay = met <= most
        q, node, met = q[stay], node[stay], met[stay]
        below = len(self.levels[level - 1][1]) if level else len(self.fps)
        step = max(1, self.pairs // size)
        for at in range(0, len(q), step):
            child = (node[at : at + step, None] * size + np.arange(size)).ravel()
            qs, mets = np.repeat(q[at : at + step], size), np.repeat(met[at : at + step], size)
            real = child < below
            qs, child, mets = qs[real], child[real], mets[real]
            if level:
                yield from self._down(queries, qs, child, mets, level - 1, most)
            else:
                near = differences(queries[qs], self.fps[child]) <= most
                yield qs[near], child[near]


class Clusters:
    """Joins members of a group; works on arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of equal rows of ``keys`` that have two rows or more."""
    change = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
    bounds = np.concatenate([[0], change, [len(keys)]])
    for k in np.flatnonzero(np.diff(bounds) > 1):
        yield int(bounds[k]), int(bounds[k + 1])


def by_root(rows: DataFrame, columns: list[str], handle: Callable[[np.ndarray, np.ndarray], list], schema: str, roots: tuple[str, ...] = ("_mask", "_pattern", "_i", "_j"), order: str = "_rank") -> DataFrame:
    """Apply ``handle`` (keys, values) to the rows under each root, in the order of ``order``; roots do not cross tasks.

    Rows come in batches; only the root that a batch ends in waits for the next one. ``handle`` gets whole roots,
    several at once, and returns arrays for the columns of ``schema``.
    """
    roots = list(roots)

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in itertools.chain(batches, [None]):
            both = pd.concat([x for x in (waiting, batch) if x is not None and len(x)]) if waiting is not None or batch is not None and len(batch) else None
            if both is None:
                continue
            keys = both[roots].to_numpy()
            if batch is None:
                cut = len(keys)
            else:
                same = (keys == keys[-1]).all(1)
                cut = int(np.argmax(same)) if same.any() else len(keys)
            if cut:
                yield pd.DataFrame(dict(zip(names, handle(keys[:cut], both[columns].iloc[:cut].to_numpy()), strict=True)))
            waiting = both.iloc[cut:] if batch is not None else None

    placed = rows.repartition(*roots).sortWithinPartitions(*roots, order)
    return placed.select(*roots, *columns).mapInPandas(per_task, schema)


def split_roots(rows: DataFrame, member: Column, block: int = BLOCK) -> DataFrame:
    """Add _i and _j to rows with _mask and _pattern: roots of more than ``block`` members become pairs of blocks, so that every two members meet and no task gets more than two blocks."""
    counts = rows.groupBy("_mask", "_pattern").count().where(F.col("count") > block)
    large = keep(counts.select("_mask", "_pattern", F.ceil(F.col("count") / block).cast("int").alias("_blocks")), "simhash-large")
    zero = F.lit(0)
    if large.isEmpty():
        return rows.select("*", zero.alias("_i"), zero.alias("_j"))
    rows = rows.join(bounded(large), ["_mask", "_pattern"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(zero, F.col("_blocks") - 1)))
    return rows.select("*", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j")).drop("_b", "_o", "_blocks")


def close_fingerprints(fps: DataFrame, bits: int) -> DataFrame:
    """Edges (src, dst) that connect every two of the distinct ``fps`` (column fp) with ``bits`` differing bits or fewer, directly or by others.

    Under each root only a spanning tree of what is close is returned, so a group of any size gives fewer edges than it
    has members times the number of masks.
    """
    masks = root_masks(bits)
    patterns = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
    rows = fps.select("fp", patterns.alias("_mask", "_pattern"))
    rows = split_roots(rows, F.col("fp")).withColumn("_rank", gray_rank(F.col("fp")))

    def handle(keys: np.ndarray, values: np.ndarray) -> list:
        fp = values[:, 0].astype(np.int64)
        words = fp.view(np.uint64)[:, None]
        src, dst = [], []
        for start, end in runs(keys):
            own = words[start:end]
            clusters = Clusters(end - start)
            if end - start <= LEAF:
                a, b = np.nonzero(differences(own[:, None], own[None]) <= bits)
                clusters.join(a, b)
            else:
                for a, b in GrayIndex(own).close(own, bits):
                    clusters.join(a, b)
            linked = np.flatnonzero(clusters.root != np.arange(end - start))
            src.append(fp[start:end][linked])
            dst.append(fp[start:end][clusters.root[linked]])
        empty = np.zeros(0, np.int64)
        return [np.concatenate([*src, empty]), np.concatenate([*dst, empty])]

    return by_root(rows, ["fp"], handle, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints are those of shingles of ``words`` words. They link at ``bits`` differing bits or fewer, and component_id is the smallest
    doc_id that links reach, the row's own included. Texts without words (null, empty, white space) have fingerprint zero, which links like any
    other. Rows with equal fingerprints are one node, so copies cost nothing further. A null id is reached but never names a component unless all ids in it are null.
    Repeated rows repeat; an empty table gives an empty table; other columns are ignored.
    """
    rows = keep(fingerprints(docs, words), "simhash-rows")
    nodes = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    labels = connected_components(close_fingerprints(nodes.select("fp"), bits))
    labels = keep(nodes.join(labels.withColumnRenamed("node", "fp"), "fp"), "simhash-labels")
    smallest = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = labels.join(smallest, "component").select("fp", "component_id")
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(keep(named, "simhash-named"), "fp").select("doc_id", fingerprint, "component_id")
