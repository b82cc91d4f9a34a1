"""Ranked lexical search with bag deduplication.

Documents are cut down to the vocabulary of the items: what is left of one is its bag, the pairs (term, times), and its length share m. Documents
of equal bag and m can't differ in score for any item, so they make up one class: bags are hashed, grouped by hash, and told apart by comparing
them whole. Each class is scored once for each item, and the best classes are expanded to their documents by ascending doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoexposure.llm.shared import Words, bounded, filled, id_and_text, keep, slices

TOP = 10
#: Pairs of item and term that one pass over the documents takes; more items are handled in several passes.
PAIRS = 200_000
#: Bytes of bags that are scored at once.
BAG_BYTES = 4 << 20
#: Bytes of a text with A-Z in lower case and a space for each other ASCII character that is no letter or digit.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Sums of floating point numbers below this are exact.
_EXACT = 2**53
_BAGS = "doc_id long, n long, bag binary"


def terms_of(texts: pa.Array) -> Words:
    """The terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of an array of strings, A-Z in lower case."""
    _, offsets, body = texts.buffers()
    if body is None:
        return Words(texts)
    return Words(pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(body.to_pybytes().translate(_PLAIN)), None, 0, texts.offset))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item; items of one id make up one, those without id too."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = terms_of(filled(part.column("text")))
            owner = np.repeat(np.arange(part.num_rows), words.counts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), words.values.take(pa.array(words.codes))], ["item_id", "term"])

    rows = id_and_text(items.select(F.col("item_id").alias("doc_id"), "text"))
    return rows.mapInArrow(cut, "item_id long, term string").distinct()


def bags_of(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, bag): the number of terms of each document, and its bag, the pairs (index in ``terms``, times) as 32-bit integers in the order of indexes."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batches):
            words = terms_of(filled(part.column("text")))
            index = pc.fill_null(pc.index_in(words.values, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[words.codes]
            owner, held = np.repeat(np.arange(part.num_rows), words.counts), index >= 0
            keys, times = np.unique(owner[held] * len(known) + index[held], return_counts=True)
            pairs = np.stack([keys % max(1, len(known)), times], 1).astype("<i4")
            ends = np.searchsorted(keys, np.arange(part.num_rows + 1) * len(known)).astype(np.int32) * 8
            bags = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(pairs.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts), bags], ["doc_id", "n", "bag"])

    return id_and_text(docs).mapInArrow(cut, _BAGS)


def pairs_of(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of all pairs of an array of bags."""
    ends = np.frombuffer(bags.buffers()[1], np.int32)[bags.offset : bags.offset + len(bags) + 1]
    flat = np.frombuffer(bags.buffers()[2], "<i4")[ends[0] // 4 : ends[-1] // 4].reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(bags)), np.diff(ends) // 8), flat[:, 0], flat[:, 1]


def classes_of(bags: DataFrame, documents: int, terms: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of the bags that aren't empty.

    Members: doc_id, m, key and digest (hash and SHA-256 of the bag), bag. Classes: a row for each distinct bag and m, with class_no, the least doc_id and
    the number of members; rows are grouped by hash and by the whole bag, so a clash of hashes merges nothing, and copies are counted before they are shuffled.
    """
    m = (F.lit(10) + F.expr(f"(90 * CAST(n AS DECIMAL(38, 0)) * {documents}) div {terms}")).cast("long")
    members = bags.where(F.length("bag") > 0).select("doc_id", m.alias("m"), F.xxhash64("bag").alias("key"), F.sha2("bag", 256).alias("digest"), "bag")
    grouped = members.groupBy("key", "m", "digest", "bag").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"))
    return members, keep(grouped.withColumn("class_no", F.monotonically_increasing_id()), "ranked-classes")


def document_counts(classes: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term stands; tasks sum by term before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for part in slices(batches, "bag", BAG_BYTES):
            row, term, _ = pairs_of(part.column("bag"))
            np.add.at(total, term, part.column("members").to_numpy()[row])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "n"])

    found = classes.select("bag", "members").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(terms, np.int64)
    counts[found["term"].to_numpy(np.int64)] = found["n"]
    return counts


class Best:
    """The ``k`` best classes of one item so far: by score, then by least doc_id. Any document among the k best is in one of them."""

    def __init__(self, k: int):
        self.k, self.line = k, 1
        self.rows = np.zeros((0, 3), np.int64)

    def add(self, scores: np.ndarray, least: np.ndarray, numbers: np.ndarray) -> None:
        some = np.flatnonzero(scores >= self.line)
        if len(some):
            rows = np.concatenate([self.rows, np.stack([scores[some], least[some], numbers[some]], 1)])
            self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]
            if len(self.rows) == self.k:
                self.line = int(self.rows[-1, 0])


def best_classes(classes: DataFrame, items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, k: int) -> DataFrame:
    """(item_id, class_no, least, score): the ``k`` best classes of each item within each task. ``items``: ids and indexes of terms."""
    shared = classes.sparkSession.sparkContext.broadcast((items, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = shared.value
        best = [Best(k) for _ in asked]
        exact = max((len(t) for _, t in asked), default=0) * float(w.max(initial=0)) * 1e6 < _EXACT
        for part in slices(batches, "bag", BAG_BYTES):
            row, term, times = pairs_of(part.column("bag"))
            m, numbers = part.column("m").to_numpy(), part.column("class_no").to_numpy()
            least = pc.fill_null(part.column("least"), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            gain = w[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[row]))
            order = np.argsort(term, kind="stable")
            row, gain, starts = row[order], gain[order], np.searchsorted(term[order], np.arange(len(w) + 1))
            for (_, wanted), found in zip(asked, best, strict=True):
                spans = [slice(a, b) for a, b in zip(starts[wanted].tolist(), starts[wanted + 1].tolist(), strict=True) if a < b]
                if not spans:
                    continue
                at, gains = np.concatenate([row[s] for s in spans]), np.concatenate([gain[s] for s in spans])
                if exact:
                    scores = np.bincount(at, weights=gains, minlength=part.num_rows).astype(np.int64)
                else:
                    scores = np.zeros(part.num_rows, np.int64)
                    np.add.at(scores, at, gains)
                found.add(scores, least, numbers)
        rows = np.concatenate([np.zeros((0, 3), np.int64), *[b.rows for b in best]])
        ids = [i for (i, _), b in zip(asked, best, strict=True) for _ in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows[:, 2]), pa.array(rows[:, 1]), pa.array(rows[:, 0])], ["item_id", "class_no", "least", "score"])

    return classes.select("bag", "m", "class_no", "least").mapInArrow(score, "item_id long, class_no long, least long, score long")


def _first(by: list[str], order: list[Column], k: int) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= k


def _ranked(docs: DataFrame, asked: pd.DataFrame, k: int) -> DataFrame:
    """The ranking of the items in ``asked`` (item_id, term)."""
    terms = sorted(set(asked["term"]))
    place = {t: i for i, t in enumerate(terms)}
    bags = keep(bags_of(docs, terms), "ranked-bags")
    size = bags.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    members, classes = classes_of(bags, size.documents, max(1, size.terms))
    weights = np.floor(1000 * np.log((2 * size.documents + 2) / (2 * document_counts(classes, len(terms)) + 1))).astype(np.int64)
    items = [(None if pd.isna(i) else int(i), np.array([place[t] for t in g["term"]])) for i, g in asked.groupby("item_id", dropna=False)]
    best = best_classes(classes, items, weights, k)
    best = keep(best.withColumn("_in", _first(["item_id"], [F.desc("score"), F.asc("least"), F.asc("class_no")], k)).where("_in").drop("_in"), "ranked-best")
    # The members of the best classes: the first k of each are enough, and a window that asks for so many takes them before it shuffles.
    named = classes.join(bounded(best.select("class_no").distinct()), "class_no", "left_semi").select("class_no", "key", "m", "digest")
    found = members.select("doc_id", "key", "m", "digest").join(bounded(named), ["key", "m", "digest"]).select("class_no", "doc_id")
    found = found.withColumn("_in", _first(["class_no"], [F.asc_nulls_last("doc_id")], k)).where("_in").drop("_in")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.select("item_id", "class_no", "score").join(found, "class_no").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 for each item, ties to the smaller doc_id.

    A null text has no terms, of a document or of an item; an item that no document shares a term with gives no rows. A document is a row:
    repeats of an id are ranked each, and rows without id come after others of their score. Items that share an id are one item with the terms of
    all. Very long texts are read whole, one slice at a time. Empty tables give an empty table; other columns, of whatever
    names, are ignored. Items go in blocks of about ``pairs`` terms, each a pass over the documents, so what is sent to the tasks is bounded.
    """
    wanted = keep(item_terms(items), "ranked-items")
    blocks = -(-wanted.count() // pairs)
    parts = []
    for b in range(blocks):
        asked = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select(F.col("item_id").cast("string"), "term").orderBy("item_id", "term").toPandas()
        if len(asked):
            parts.append(_ranked(docs, asked, k))
    if not parts:
        return wanted.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


_SPLIT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
RANKED_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d),
i AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS term FROM benchmark),
f AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s GROUP BY term),
g AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(t) * docs) // terms))) AS gain FROM f JOIN d USING (r) JOIN w USING (term), s),
q AS (SELECT item_id, r, CAST(sum(gain) AS BIGINT) AS score FROM i JOIN g USING (term) GROUP BY ALL),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
      FROM q JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
