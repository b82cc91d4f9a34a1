"""Quality: hashed word n-gram logistic regression with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoexposure.llm.features import BITS, SAMPLE, HashedWords, bins, held_out, pairs_of, sample
from geoexposure.llm.shared import filled, id_and_text, keep, slices, sums

#: Learning rate, smoothing and penalties of the updates, and passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.2, 1.0, 0.02, 0.1, 3
#: A text's n-grams of one family weigh this much together.
MASS = 8.0
THRESHOLD = 0.3


def grams(hashed: HashedWords, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Bins of the four families (words, word pairs, shapes, shape pairs), each with one bin for each word; offsets of the texts.

    The pair families mark a word that repeats the one before it. Pairs lie within a text, so a score does not depend on the texts beside it.
    """
    words, shapes, offsets = hashed(texts)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[offsets[:-1][np.diff(offsets) > 0]] = False
    pairs, shape_pairs = pairs_of(words, offsets), pairs_of(shapes, offsets)
    pairs[again] = np.uint64(1)
    shape_pairs[again] = np.uint64(2)
    return [bins(words, 3), bins(pairs, 4), bins(shapes, 5), bins(shape_pairs, 6)], offsets


def linear(weights: np.ndarray, hashed: HashedWords, texts: pa.Array) -> np.ndarray:
    """Sparse dot product of each text: the mean weight of its n-grams times MASS, summed over the families."""
    families, offsets = grams(hashed, texts)
    total = sum(weights[b] for b in families) if len(families[0]) else np.zeros(0)
    return MASS * sums(total, offsets) / np.maximum(np.diff(offsets), 1)


def learn(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias from sparse examples (bins, values), taken one after the other."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(at: np.ndarray) -> np.ndarray:
        own, free = z[at], at == bias
        shrunk = np.sign(own) * np.maximum(np.abs(own) - np.where(free, 0.0, L1), 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + np.where(free, 0.0, L2))

    for _ in range(EPOCHS):
        for (at, values), y in zip(examples, labels, strict=True):
            at, values = np.append(at, bias), np.append(values, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(values @ w, -30, 30)))
            g = (p - y) * values
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    all_weights = weights(np.arange((1 << BITS) + 1))
    return all_weights[:-1], float(all_weights[-1])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed = HashedWords()
    for part in slices(batches):
        families, offsets = grams(hashed, filled(part.column("text")))
        found = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            at, counts = np.unique(np.concatenate([f[a:b] for f in families]), return_counts=True)
            found.append((at.astype(np.int32), (counts * (MASS / max(1, b - a))).astype(np.float32)))
        yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "label": part.column("label"), "bins": pa.array([f[0] for f in found], pa.list_(pa.int32())), "counts": pa.array([f[1] for f in found], pa.list_(pa.float32()))})


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.assign(turn=pd.util.hash_array(rows["doc_id"].to_numpy().astype("int64"))).sort_values(["turn", "doc_id"], kind="stable")
    weights, bias = learn(list(zip(rows["bins"], rows["counts"], strict=True)), rows["label"].to_numpy(float))
    at = np.flatnonzero(weights)
    return pd.DataFrame({"bin": np.append(at, -1), "weight": np.append(weights[at], bias)})


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights (as many as bins) and bias, learned by one task from a sample of ``rows`` labelled documents at most."""
    chosen = keep(sample(labels, "quality", rows), "quality-sample")
    examples = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(_examples, "doc_id long, label int, bins array<int>, counts array<float>")
    found = examples.groupBy().applyInPandas(_fit, "bin long, weight double").toPandas()
    weights, bias = np.zeros(1 << BITS), 0.0
    if len(found):
        bias = float(found.loc[found["bin"] < 0, "weight"].iloc[0])
        found = found[found["bin"] >= 0]
        weights[found["bin"]] = found["weight"]
    return weights, bias


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: better), predicted.

    A null or empty text has the score of the bias alone; without labels every score is 0.5. A row of a repeated document is
    scored like the first; null ids are scored and never learned from; other columns, of whatever names, are ignored. A very long text
    is scored whole, an empty table gives an empty table. The model has
    2 ** BITS weights whatever the input's size, and scoring shuffles nothing.
    """
    weights, bias = fit(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, own = HashedWords(), shared.value.astype(np.float64)
        for part in slices(batches):
            s = 1 / (1 + np.exp(-np.clip(linear(own, hashed, filled(part.column("text"))) + bias, -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(s), "predicted": pa.array((s >= THRESHOLD).astype(np.int32))})

    rows_in = id_and_text(docs).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows_in.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
