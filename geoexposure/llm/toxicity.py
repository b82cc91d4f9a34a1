"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The labels are binary, the grades are ordered: 0 for a row labelled clean; a row labelled toxic has grade 2 if
it holds more than the median number of distinct telling words, else 1. A word is telling if TELLING_ROWS
rows of the sample or more hold it and TELLING_SHARE of them or more are toxic. One weight for each feature is shared by all
thresholds: P(grade > k) = logistic(w x - t[k]). Expected severity is the sum of these chances.
Features are words and beginnings of words, so that forms of one stem share a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoexposure.llm.features import SAMPLE, plain_word, sample
from geoexposure.llm.shared import REMEMBERED_WORDS, Words, filled, give_back, id_and_text, keep, let_go, slices, sums
from geoexposure.llm.token_words import spread

TELLING_ROWS, TELLING_SHARE = 20, 0.9
#: Features are hashed to 2 ** TOXIC_BITS bins. Beginnings of words have these lengths. Counts are taken per AMONG words in longer texts.
TOXIC_BITS, STARTS, AMONG = 20, (4, 5, 6, 7), 200
#: Penalty on the sum of absolute weights (per row of the sample), steps and step size of the fit, and sample rows that a learned bin is in at least.
PENALTY, STEPS, RATE, LEARNED_ROWS = 1e-3, 120, 0.5, 16
#: Bytes of text of the sample whose features are worked out at once, and features of the sample that a step of the fit holds in doubles at once: two workers share an executor with the JVM.
PART_BYTES, FEATURES = 1 << 20, 1 << 18
#: A document is toxic if the chance of a grade above 0 is this or more; chosen on held-out labels, where no clean one reaches it.
TOXIC = 0.25
_NONE = np.zeros(0, np.int64)


def starts_of(word: str) -> list[str]:
    """The features of a word: itself and its beginnings (words of one stem share them)."""
    return [f"={word}", *(word[:n] for n in STARTS if len(word) >= n)]


class Stems:
    """Words of texts as (document, word, count) triples, and the bins of each distinct word."""

    def __init__(self, wanted: np.ndarray | None = None):
        self.wanted = wanted
        self.known: dict[str, tuple[int, ...]] = {}

    def bins_of(self, word: str) -> tuple[int, ...]:
        if (found := self.known.get(word)) is None:
            if len(self.known) > REMEMBERED_WORDS:
                self.known.clear()
            plain = plain_word(word)
            found = tuple(xxhash.xxh64_intdigest(f) >> (64 - TOXIC_BITS) for f in starts_of(plain)) if plain else ()
            if self.wanted is not None:
                found = tuple(b for b in found if self.wanted[b])
            self.known[word] = found
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bins, values, offsets): each bin once in a text. The value grows with the bin's share of the text's words."""
        words = Words(texts)
        lists = [self.bins_of(w) for w in words.values.to_pylist()]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((b for one in lists for b in one), np.int64, int(sizes.sum()))
        rows = np.repeat(np.arange(len(texts)), words.counts)
        telling = sizes[words.codes] > 0
        pairs, counts = np.unique(rows[telling] * max(1, len(lists)) + words.codes[telling], return_counts=True)
        rows, codes = np.divmod(pairs, max(1, len(lists)))
        expanded = flat[spread((np.cumsum(sizes) - sizes)[codes], sizes[codes])]
        both, inverse = np.unique((np.repeat(rows, sizes[codes]) << TOXIC_BITS) | expanded, return_inverse=True)
        totals = np.bincount(inverse, weights=np.repeat(counts, sizes[codes]), minlength=len(both))
        rows = both >> TOXIC_BITS
        values = np.log1p(totals * AMONG / np.maximum(words.counts[rows], AMONG))
        return both & ((1 << TOXIC_BITS) - 1), values, np.searchsorted(rows, np.arange(len(texts) + 1))


def grades(at: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, bins: int = 1 << TOXIC_BITS) -> np.ndarray:
    """The grades of the sample's rows, as the module says."""
    held, held_toxic = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
    for a, b in _blocks(offsets):
        some = at[offsets[a] : offsets[b]]
        held += np.bincount(some, minlength=bins)
        held_toxic += np.bincount(some[np.repeat(toxic[a:b] == 1, np.diff(offsets[a : b + 1]))], minlength=bins)
    telling = (held >= TELLING_ROWS) & (held_toxic >= TELLING_SHARE * held)
    hits = np.concatenate([_NONE, *(sums(telling[at[offsets[a] : offsets[b]]].astype(np.int64), offsets[a : b + 1] - offsets[a]) for a, b in _blocks(offsets))])
    middle = np.median(hits[toxic == 1]) if (toxic == 1).any() else 0
    return np.where(toxic == 1, np.where(hits > middle, 2, 1), 0)


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with FEATURES features at most (one row at least)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + FEATURES, side="right")) - 1)
        yield start, stop
        start = stop


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learn(at: np.ndarray, values: np.ndarray, offsets: np.ndarray, y: np.ndarray, bins: int = 1 << TOXIC_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by proximal gradient steps with per-feature rates; most weights stay zero.

    A step goes through all rows, block by block, so that besides the sample it holds one block's doubles.
    """
    n, k = len(y), 2
    weights = np.zeros(bins)
    tail = np.clip(np.array([(y > j).mean() for j in range(k)]), 1e-4, 1 - 1e-4)
    cuts = -np.log(tail / (1 - tail))
    seen, seen_cuts = np.full(bins, 1e-8), np.full(k, 1e-8)
    for _ in range(STEPS):
        x = np.zeros(n)
        for a, b in _blocks(offsets):
            own = slice(offsets[a], offsets[b])
            x[a:b] = sums(weights[at[own]] * values[own], offsets[a : b + 1] - offsets[a])
        above = np.stack([np.ones(n), *(_logistic(x - c) for c in cuts), np.zeros(n)])
        chance = np.maximum(above[y, np.arange(n)] - above[y + 1, np.arange(n)], 1e-12)
        slope = above * (1 - above)
        high, low = slope[y, np.arange(n)] / chance, slope[y + 1, np.arange(n)] / chance
        g_row = -(high - low) / n
        g = np.zeros(bins)
        for a, b in _blocks(offsets):
            own = slice(offsets[a], offsets[b])
            g += np.bincount(at[own], weights=np.repeat(g_row[a:b], np.diff(offsets[a : b + 1])) * values[own], minlength=bins)
        g_cuts = np.array([(high * (y == j + 1) - low * (y == j)).sum() / n for j in range(k)])
        seen += g * g
        seen_cuts += g_cuts * g_cuts
        rate = RATE / np.sqrt(seen)
        weights -= rate * g
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * PENALTY, 0)
        cuts = np.maximum.accumulate(cuts - RATE / np.sqrt(seen_cuts) * g_cuts)
    return weights, cuts


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    stems = Stems()
    for part in slices(batches, limit=PART_BYTES):
        at, values, offsets = stems(filled(part.column("text")))
        ends = pa.array(offsets, pa.int32())
        lists = {"bins": pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), "counts": pa.ListArray.from_arrays(ends, pa.array(values, pa.float32()))}
        yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "label": part.column("label")} | lists)


def _ordered(parts: list[np.ndarray], starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The features of rows, which begin at ``starts`` of ``parts`` one after the other, in the order of rows."""
    every = np.concatenate(parts)
    out = np.empty_like(every)
    for a, b in _blocks(offsets):
        out[offsets[a] : offsets[b]] = every[spread(starts[a:b], np.diff(offsets[a : b + 1]))]
    return out


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    held = np.zeros(1 << TOXIC_BITS, np.int64)
    for part in parts:
        flat = part.column("bins").flatten()
        for start in range(0, len(flat), FEATURES):
            held += np.bincount(flat[start : start + FEATURES].to_numpy(), minlength=1 << TOXIC_BITS)
    # Bins of few rows could only be learned by heart. The others are numbered anew.
    names = np.flatnonzero(held >= LEARNED_ROWS)
    number = np.full(1 << TOXIC_BITS, -1, np.int32)
    number[names] = np.arange(len(names))
    ids = np.concatenate([p.column("doc_id").to_numpy() for p in parts])
    toxic = np.concatenate([p.column("label").to_numpy() for p in parts])
    chosen, lengths = [], []
    while parts:
        part = parts.pop(0)
        offsets = part.column("bins").offsets.to_numpy().astype(np.int64)
        offsets, at, values = offsets - offsets[0], part.column("bins").flatten().to_numpy(), part.column("counts").flatten().to_numpy()
        for a, b in _blocks(offsets):
            own = slice(offsets[a], offsets[b])
            some = number[at[own]]
            lengths.append(sums((some >= 0).astype(np.int64), offsets[a : b + 1] - offsets[a]))
            chosen.append((some[some >= 0], values[own][some >= 0]))
    part = at = values = None  # what has come is no longer needed
    give_back()
    # Rows in the order of ids, whatever the order in which they came.
    lengths, order = np.concatenate(lengths), np.argsort(ids, kind="stable")
    starts, lengths, toxic = (np.cumsum(lengths) - lengths)[order], lengths[order], toxic[order]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at, values = (_ordered([c[k] for c in chosen], starts, offsets) for k in range(2))
    chosen = None
    give_back()
    weights, cuts = learn(at, values, offsets, grades(at, offsets, toxic, len(names)), len(names))
    full = np.flatnonzero(weights)
    at = values = None
    give_back()
    yield pa.RecordBatch.from_pydict({"bin": pa.array(np.append(names[full], [-1, -2]), pa.int64()), "weight": np.append(weights[full], cuts)})


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds), learned by one task from a sample of ``rows`` labelled documents at most."""
    chosen = keep(sample(labels, "toxic", rows), "toxicity-sample")
    examples = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(_examples, "doc_id long, label int, bins array<int>, counts array<float>")
    found = examples.repartition(1).mapInArrow(_fit, "bin long, weight double").toPandas()
    weights, cuts = np.zeros(1 << TOXIC_BITS), np.full(2, 30.0)
    if len(found):
        cuts = found.set_index("bin").loc[[-1, -2], "weight"].to_numpy()
        found = found[found["bin"] >= 0]
        weights[found["bin"]] = found["weight"]
    return weights, cuts


def score(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("doc_id",), rows: int = SAMPLE, within: str = "") -> DataFrame:
    """Per row: ``columns``, severity (expected grade, 0 to 2), grade (the likeliest), p_toxic and toxic.

    A null or empty text has the grade that the thresholds alone give; without labels nothing is toxic. Repeated rows
    are scored alike; null ids are scored and never learned from. A very long text is scored whole, an empty table gives an empty table. The model has 2 ** TOXIC_BITS weights whatever the input's
    size, and scoring shuffles nothing. Added columns have the names _severity, _grade, _p_toxic and _toxic, so a column of the input must not have these.
    ``within``: the one of ``columns`` whose structs hold the text as a string; it is read there, so that a text goes to a worker once.
    """
    weights, cuts = fit(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("_text", pc.struct_field(batch.column(within), "text")) if within else batch

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        own = shared.value.astype(np.float64)
        stems = Stems(own != 0)
        for part in slices(with_text(batches), "_text"):
            at, values, offsets = stems(filled(part.column("_text")))
            x = sums(own[at] * values, offsets)
            above = np.stack([_logistic(x - c) for c in cuts])
            chances = np.stack([1 - above[0], above[0] - above[1], above[1]])
            added = [pa.array(above.sum(0)), pa.array(chances.argmax(0).astype(np.int32)), pa.array(above[0]), pa.array(above[0] >= TOXIC)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *added], names=[*columns, "_severity", "_grade", "_p_toxic", "_toxic"])

    needed = docs.select(*columns, *([] if within else [F.col("text").cast("string").alias("_text")]))
    added = T.StructType.fromDDL("_severity double, _grade int, _p_toxic double, _toxic boolean")
    return needed.mapInArrow(scored, T.StructType([docs.schema[c] for c in columns] + added.fields))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "doc_id", "text")
    within = "row" if docs.schema["text"].dataType == T.StringType() else ""
    return score(packed, labels, ("row",), within=within).where("NOT _toxic").select("row.*")
