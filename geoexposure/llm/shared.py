"""Helpers that several text operators use: kept tables, and words as Arrow arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoexposure.sources.workspace import bounded, fresh_path, keep, shared_dir

__all__ = ["REMEMBERED_WORDS", "Words", "bounded", "filled", "fresh_path", "give_back", "id_and_text", "keep", "let_go", "loaded", "shared_dir", "slices", "sums"]

#: Distinct words whose features a worker remembers.
REMEMBERED_WORDS = 100_000
#: Texts handled at once in a Python worker, in bytes.
SLICE_BYTES = 4 << 20
#: What empties the stores of loaded files that this process has.
loaded: list[Callable[[], None]] = []


def give_back() -> None:
    """Return freed memory to the system, as a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def let_go() -> None:
    """Forget what earlier tasks loaded into this worker, such as tokenizers, when it goes on to work that has no use for it."""
    for forget in loaded:
        forget()
    give_back()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, cut so that a slice has about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            # Copied, as some of Arrow's functions on strings misread arrays that start within their buffers.
            yield batch.take(pa.array(np.arange(start, stop)))
            start = stop
    give_back()


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as a long and text as a string, without other columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def filled(texts: pa.Array) -> pa.Array:
    """Null texts count as empty."""
    return pc.fill_null(texts, "")


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of an array of texts.

    ``codes`` index ``values`` (distinct words), text ``i`` has ``codes[offsets[i]:offsets[i + 1]]``.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if not full.all():
            flat = flat.filter(pa.array(full))
            offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.values = coded.dictionary
        self.offsets = offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each range of ``offsets``."""
    running = np.concatenate([[0], np.cumsum(values)])
    return running[offsets[1:]] - running[offsets[:-1]]
