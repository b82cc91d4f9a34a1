"""Token ids as Arrow files of equal-length sequences, for random access without copying.

A data file holds record batches of BATCH rows of two fixed-size-list columns, ``ids`` and ``mask``, of
SEQUENCE entries; only the last batch may be shorter, and its last sequence is filled up under mask 0. So token
``t`` of a file is entry ``t % SEQUENCE`` of row ``t // SEQUENCE``, and a memory map gives it without a copy.
Beside it lies an index file: doc_id, first token and number of tokens of each document.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoexposure.llm.shared import filled, fresh_path, id_and_text, keep, slices
from geoexposure.llm.token_words import text_encoder

SEQUENCE, BATCH = 2048, 64
#: Bytes of text that are encoded at once: the larger, the more often a rare word is encoded once only.
PART_BYTES = 8 << 20
#: Code points of a text that take part in the ranges of documents.
HEAD = 32
#: The id that ends each document.
END = 0

def data_schema(wide: bool) -> pa.Schema:
    """Ids of 16 bits where the vocabulary allows it, else of 32; masks of one bit."""
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of the shared folder, a path or an URI of any store that pyarrow knows."""
    return fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{os.path.abspath(folder)}")


def _put(store: fs.FileSystem, made: str, name: str) -> None:
    """Give a whole file its name. If an earlier run of the task has left one (some stores do not replace it), its content is the same."""
    if store.get_file_info(name).type != fs.FileType.NotFound:
        store.delete_file(name)
    store.move(made, name)


class SequenceWriter:
    """Writes ids to one data file, in whole batches as they fill up."""

    def __init__(self, sink: pa.NativeFile, wide: bool):
        self.schema = data_schema(wide)
        self.kind = np.uint32 if wide else np.uint16
        self.writer = ipc.new_file(sink, self.schema)
        self.waiting, self.held, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.kind))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= SEQUENCE * BATCH:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // (SEQUENCE * BATCH) * (SEQUENCE * BATCH)
            for at in range(0, whole, SEQUENCE * BATCH):
                self._write(ids[at : at + SEQUENCE * BATCH], SEQUENCE * BATCH)
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), SEQUENCE) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.waiting)
            self._write(np.pad(ids, (0, -len(ids) % SEQUENCE)), len(ids))
        self.writer.close()


class SequenceReader:
    """Random access to the ids of one data file; batches are read, or mapped, when asked for."""

    def __init__(self, source: pa.NativeFile):
        self.reader, self.at, self.ids = ipc.open_file(source), -1, None

    def tokens(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """Views of the ids from ``start`` to ``stop``, one for each batch that they lie in."""
        while start < stop:
            k, offset = divmod(start, SEQUENCE * BATCH)
            if k != self.at:
                self.at, self.ids = k, self.reader.get_batch(k).column("ids").flatten().to_numpy()
            part = self.ids[offset : offset + stop - start]
            yield part
            start += len(part)


def write(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Write the ids of ``docs`` to ``folder`` in ascending doc_id order; return the table of the files.

    The table has a row for each file: part, file, n_docs, n_tokens. Documents are range-partitioned by id and the beginning of their text; a task writes
    the files of its range under a name of its own and renames them when they are whole, so a task that runs
    again, after a lost executor or beside a slow one, leaves the same files. Null ids come first, rows with the same
    id follow each other by text, a null text counts as empty (its only id is END).
    """

    def write_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = _opened(folder)
        store.create_dir(root)
        encoder, name, own = text_encoder(tokenizer), f"part-{part:06d}", uuid.uuid4().hex
        n_docs = 0
        with store.open_output_stream(f"{root}/.{name}.{own}.arrow") as data, store.open_output_stream(f"{root}/.{name}.{own}.index") as index:
            sequences, entries = SequenceWriter(data, encoder.tokenizer.get_vocab_size() > 1 << 16), ipc.new_file(index, INDEX)
            for piece in slices(batches, limit=PART_BYTES):
                ids, counts = encoder.ids(filled(piece.column("text")))
                ids = np.insert(ids, np.cumsum(counts), END)
                counts = counts + 1
                starts = sequences.total + np.cumsum(counts) - counts
                entries.write_batch(pa.record_batch([piece.column("doc_id"), pa.array(starts), pa.array(counts)], schema=INDEX))
                sequences.add(ids)
                n_docs += len(counts)
            total = sequences.total
            sequences.close()
            entries.close()
        for kind in ("arrow", "index"):
            _put(store, f"{root}/.{name}.{own}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    # Beginnings of texts order as texts do, so rows without id, or of one repeated id, are spread too.
    ordered = id_and_text(docs).repartitionByRange("doc_id", F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text")
    return keep(ordered.mapInArrow(write_range, "part long, file string, n_docs long, n_tokens long"), "token-files")


def read(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32.

    ``files`` is the table that ``write`` returned; it has a row for each file, so the sums over it are small.
    """

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        local = isinstance(store, fs.LocalFileSystem)
        opened = pa.memory_map if local else store.open_input_file
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with opened(f"{root}/{name}.arrow") as data, opened(f"{root}/{name}.index") as index:
                    sequences, entries = SequenceReader(data), ipc.open_file(index)
                    for k in range(entries.num_record_batches):
                        docs = entries.get_batch(k)
                        starts, counts = (docs.column(c).to_numpy() for c in ("start", "n_tokens"))
                        sums = np.zeros(len(starts), np.int64)
                        for i, (start, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
                            crc = 0
                            for part in sequences.tokens(start, start + n):
                                crc = zlib.crc32(part.astype("<u4"), crc)
                            sums[i] = crc
                        yield pa.RecordBatch.from_pydict({"doc_id": docs.column("doc_id"), "start": pa.array(starts + base), "n_tokens": docs.column("n_tokens"), "ids_crc32": pa.array(sums)})

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    based = based.repartition(max(1, files.count()), "part").select("file", "base")
    return based.mapInArrow(read_files, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to fresh files in the shared folder and read their documents back."""
    folder = fresh_path(spark, "tokens")
    return read(write(docs, tokenizer, folder), folder)
