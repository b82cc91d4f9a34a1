"""The toxicity stage within an executor's memory: the fit, texts sent to workers, what workers remember."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from geoexposure.llm import sentencepiece_codec, toxicity
from geoexposure.llm.queries import tokenizer_path


def examples(rows, each, bins, seed=3):
    """A sample as the fit gets it; toxic rows hold two bins that the others lack."""
    rng = np.random.default_rng(seed)
    label = (np.arange(rows) % 3 == 0).astype(np.int32)
    at = rng.integers(100, bins, (rows, each)).astype(np.int32)
    at[:, :2] = np.where(label[:, None] == 1, [7, 8], [17, 18])
    ends = pa.array(np.arange(rows + 1) * each, pa.int32())
    lists = {"bins": pa.ListArray.from_arrays(ends, at.ravel()), "counts": pa.ListArray.from_arrays(ends, rng.random(rows * each, np.float32))}
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(np.arange(rows)), "label": pa.array(label)} | lists), label


def fitted(batches):
    (out,) = toxicity._fit(iter(batches))
    return dict(zip(out.column("bin").to_pylist(), out.column("weight").to_pylist(), strict=True))


def test_fit_holds_little_besides_the_sample(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 3)
    batch, label = examples(6_000, 1_000, 50_000)
    at, values = batch.column("bins").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
    offsets = batch.column("bins").offsets.to_numpy().astype(np.int64)
    tracemalloc.start()
    y = toxicity.grades(at, offsets, label)
    toxicity.learn(at, values, offsets, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A few arrays of all bins in doubles; before, several of all features came on top.
    assert peak < 8 * 8 * (1 << toxicity.TOXIC_BITS) + 8 * 8 * toxicity.FEATURES


def test_fit_is_the_same_in_any_order_and_batches(monkeypatch):
    batch, _ = examples(900, 40, 3_000)
    whole = fitted([batch])
    assert whole[7] > 0 and whole[8] > 0 and {-1, -2} < set(whole)
    mixed = batch.take(pa.array(np.random.default_rng(1).permutation(900)))
    assert fitted([mixed.slice(0, 1), mixed.slice(1, 0), mixed.slice(1, 500), mixed.slice(501)]) == whole
    monkeypatch.setattr(toxicity, "FEATURES", 30)  # below a single row's
    assert fitted([mixed]) == pytest.approx(whole, rel=1e-4, abs=1e-5)
    assert list(toxicity._fit(iter([batch.slice(0, 0)]))) == []


def test_clean_sends_a_text_once(spark, edge_docs, labels):
    plan = toxicity.clean(edge_docs.select("doc_id", "text"), labels)._jdf.queryExecution().analyzed().toString()
    sent = plan.split("MapInArrow")[1].split("\n")[1]
    assert "row#" in sent and "_text" not in sent and "text#" not in sent
    cleaned = toxicity.clean(edge_docs, labels)
    scored = toxicity.score(edge_docs, labels, ("doc_id", "text")).where("NOT _toxic").select("doc_id", "text")
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(key, cleaned.select("doc_id", "text").collect())) == sorted(map(key, scored.collect()))
    binary = edge_docs.withColumn("text", edge_docs["text"].cast("binary"))
    assert toxicity.clean(binary, labels).count() == scored.count()


def test_examples_let_go_of_tokenizers():
    sentencepiece_codec.codec_of(tokenizer_path("piece_bpe_32k.model"))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two"], "label": pa.array([0], pa.int32())})
    assert len(list(toxicity._examples(iter([batch])))) == 1
    assert sentencepiece_codec.codec_of.cache_info().currsize == 0
