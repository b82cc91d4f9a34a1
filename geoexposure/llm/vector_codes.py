"""Product codes of vectors, with codebooks fitted over all rows.

Vectors are cut into equal parts, and each part is coded by the nearest entry of its position's codebook. Within a task the distinct parts of a
position make up a lexicographic trie: a node is a prefix of components, and carries the squared distances of that prefix to all entries. Going down
adds one component's distances to those of the parent, so parts that begin alike share that work; a leaf takes the smallest distance, and its
part counts as often as it occurs in the sums that move the entries. Tries are made of what a task holds, so no part is shuffled: what tasks send are sums
by entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoexposure.llm.shared import bounded, give_back, keep

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows whose parts make up one trie, and nodes of it that are gone through side by side.
ROWS, NODES = 1 << 15, 4096
#: Squared distances below this are exact in floating point.
_EXACT = 2**53


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): each component x as floor(scale * x), without rows whose vector is null or holds a null or non-finite component."""
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return table.where(F.col(vector).isNotNull() & sound).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))


def rows_of(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of ``width`` components; missing ones at the end count as zero."""
    sizes, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, which of them each row is, how often each occurs)."""
    low = parts.min(0)
    bits = [int(x).bit_length() for x in (parts.max(0) - low)]
    if sum(bits) < 63:  # one number for each part sorts faster
        keys = np.zeros(len(parts), np.int64)
        for k, b in enumerate(bits):
            keys = (keys << b) | (parts[:, k] - low[k])
        _, first, which, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        return parts[first], which, times
    leaves, which, times = np.unique(parts, axis=0, return_inverse=True, return_counts=True)
    return leaves, which.ravel(), times


class Trie:
    """The lexicographic trie over distinct parts, gone through depth first: at a leaf ``code`` is the nearest entry, ``gap`` its squared distance.

    A node of more than NODES leaves goes on child by child; below, the nodes of a level are handled side by side. So what is held are the distances
    along one path and those of one small subtree.
    """

    def __init__(self, leaves: np.ndarray, book: np.ndarray):
        self.leaves, self.depth = leaves, leaves.shape[1]
        most = float(np.abs(leaves).max(initial=0)) + float(np.abs(book).max(initial=0))
        self.kind = np.float64 if most * most * max(1, self.depth) < _EXACT else np.int64
        self.book = book.astype(self.kind)
        self.code, self.gap = np.zeros(len(leaves), np.int64), np.zeros(len(leaves), np.int64)
        self.evaluated = 0
        self._descend(0, len(leaves), 0, np.zeros((1, len(book)), self.kind))

    def _further(self, values: np.ndarray, level: int, above: np.ndarray) -> np.ndarray:
        """Distances of the children with these components, from those of their parents."""
        self.evaluated += len(values)
        step = values.astype(self.kind)[:, None] - self.book[None, :, level]
        step *= step
        step += above
        return step

    def _descend(self, start: int, stop: int, level: int, above: np.ndarray) -> None:
        if stop - start <= NODES or level == self.depth:
            return self._side_by_side(start, stop, level, above)
        column = self.leaves[start:stop, level]
        cuts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [len(column)]])
        if level + 1 == self.depth:  # the children are leaves
            for at in range(start, stop, NODES):
                self._side_by_side(at, min(stop, at + NODES), level, above)
            return None
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self._descend(start + a, start + b, level + 1, self._further(column[a : a + 1], level, above))
        return None

    def _side_by_side(self, start: int, stop: int, level: int, above: np.ndarray) -> None:
        below = self.leaves[start:stop]
        node, fresh = np.zeros(len(below), np.int64), np.zeros(len(below), bool)
        fresh[:1] = True
        for d in range(level, self.depth):
            fresh[1:] |= below[1:, d] != below[:-1, d]
            heads = np.flatnonzero(fresh)
            above = self._further(below[heads, d], d, above[node[heads]])
            node = np.cumsum(fresh) - 1
        code = above.argmin(1)
        self.code[start:stop], self.gap[start:stop] = code[node], above[np.arange(len(above)), code][node].astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, put together to about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    give_back()


def entry_sums(vectors: DataFrame, books: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of ``books`` (position, entry, component) the sum of the parts nearest to it, and their number."""
    positions, entries, size = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((positions, entries), np.int64)
        for block in _blocks(batches, rows):
            parts = rows_of(block.column("v"), positions * size).reshape(-1, positions, size)
            for p in range(positions):
                leaves, _, times = distinct_parts(parts[:, p])
                code = Trie(leaves, books[p]).code
                np.add.at(total[p], code, leaves * times[:, None])
                np.add.at(count[p], code, times)
        used = np.flatnonzero(count)
        cells = np.repeat(used, size)
        columns = [cells, np.tile(np.arange(size), len(used)), total.reshape(-1, size)[used].ravel(), count.ravel()[cells]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cell", "at", "total", "n"])

    found = vectors.select("v").mapInArrow(summed, "cell long, at long, total long, n long").groupBy("cell", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()
    total, count = np.zeros((positions * entries, size), np.int64), np.zeros(positions * entries, np.int64)
    cell = found["cell"].to_numpy(np.int64)
    total[cell, found["at"].to_numpy(np.int64)], count[cell] = found["total"], found["n"]
    return total.reshape(books.shape), count.reshape(positions, entries)


def fitted(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (position, entry, component): they start as the parts of the rows with the smallest vec_ids, and each round moves every entry to the floor of the mean of its parts.

    Of rows with one vec_id the one with the smaller vector comes first; rows without id come last. An entry that nothing is nearest to stays.
    """
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    size = -(-(vectors.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    start = np.array([list(r.v) + [0] * (parts * size - len(r.v)) for r in first], np.int64).reshape(len(first), parts, size)
    books = start.transpose(1, 0, 2).copy()
    for _ in range(rounds if size else 0):
        total, count = entry_sums(vectors, books)
        used = count > 0
        books[used] = total[used] // count[used][:, None]
    return books


def coded(vectors: DataFrame, books: np.ndarray, rows: int = ROWS) -> DataFrame:
    """(vec_id, label, code, error) of each vector; a code has two hex digits for each part."""
    positions, entries, size = books.shape
    digits = np.array([f"{i:02x}" for i in range(max(1, entries))], "S2")
    kind = vectors.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, rows):
            whole = rows_of(block.column("v"), positions * size).reshape(-1, positions, size)
            codes, error = np.zeros((len(whole), positions), np.int64), np.zeros(len(whole), np.int64)
            for p in range(positions if size else 0):
                leaves, which, _ = distinct_parts(whole[:, p])
                trie = Trie(leaves, books[p])
                codes[:, p] = trie.code[which]
                error += trie.gap[which]
            text = np.ascontiguousarray(digits[codes]).view(f"S{2 * positions}").ravel().astype(str)
            yield pa.RecordBatch.from_arrays([block.column("vec_id"), block.column("label"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(code, f"vec_id long, label {kind}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components of the codebooks by position, entry and component."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row whose vector is whole.

    Columns vec_id, embedding and label of ``table`` count, others of whatever names are ignored. Rows whose vector is null or holds a null or
    non-finite component are left out. Repeated rows and ids stay, each with its code; rows without id too, and rows without label make up one group.
    Where vectors differ in length (or don't divide evenly) missing components at the end count as zero. Of equally near entries the one of lower index
    is taken. With fewer rows than ``entries`` the codebooks have as many entries as rows; an empty table gives an empty table.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    vectors = keep(integer_vectors(table), "codes-vectors")
    books = fitted(vectors, parts, entries, rounds)
    found = keep(coded(vectors, books), "codes-found")
    totals = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    met = found.join(bounded(totals), F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def compressed_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
     WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"p AS MATERIALIZED (SELECT r, vec_id, k, e[k * (len(e) // {parts}) + 1 : (k + 1) * (len(e) // {parts})] AS x FROM v, range({parts}) t(k))",
        f"b0 AS MATERIALIZED (SELECT k, i, x FROM (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY vec_id, x) - 1 AS i FROM p) WHERE i < {entries})",
    ]
    for n in range(rounds + 1):
        gap = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.x, b.x)])"
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, p.k, min((CAST({gap} AS BIGINT), i)) AS best, any_value(p.x) AS x FROM p JOIN b{n} b ON p.k = b.k GROUP BY r, p.k)")
        if n < rounds:
            steps.append(f"s{n} AS (SELECT k, i, j, floor(sum(y) / count(*)) AS y FROM (SELECT k, best[2] AS i, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{n}) GROUP BY ALL)")
            moved = f"(SELECT k, i, list(CAST(y AS BIGINT) ORDER BY j) AS x FROM s{n} GROUP BY ALL)"
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT k, i, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN {moved} m USING (k, i))")
    steps.append(f"c AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY k) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, i)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h"


COMPRESSED_SQL = compressed_sql()
