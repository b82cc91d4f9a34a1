"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here: pieces with scores and types, and the normaliser's settings. From them the
normaliser, the metaspace marker, the model (unigram scores, or merges for a BPE model) and byte
fallback are rebuilt in the tokenizers library, which encodes in batches on several threads. Each distinct
string that a worker encodes is held against the sentencepiece library and against its own decoding. A string whose ids
differ is marked and gets the ids of the model, so a difference never goes unseen or on.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoexposure.llm.shared import filled, loaded, slices, sums
from geoexposure.llm.token_words import AT_ONCE, IdPool, chunked, flattened, spread

MARK = "▁"
#: Threads that encode a batch: as many as an executor commonly has cores.
THREADS = 2
#: Bytes of text encoded at once, and bytes of distinct strings that a worker remembers: two workers share an executor with the JVM.
PART_BYTES, REMEMBERED_BYTES = 1 << 20, 4 << 20
#: Marks of strings: the libraries' ids differ; the ids do not decode to the string.
DIFFERENT, BENT = 1, 2
# Piece types and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of a protobuf message: integers for varints, bytes for the other kinds."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """What the model file says."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unknown = UNIGRAM, False, 0
        self.charsmap, self.dummy_prefix, self.trim, self.escape = b"", True, True, True
        with open(path, "rb") as f:
            for number, value in fields(f.read()):
                if number == 1:
                    piece = dict(fields(value))
                    self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
                elif number == 2:
                    spec = dict(fields(value))
                    self.kind, self.byte_fallback, self.unknown = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
                elif number == 3:
                    spec = dict(fields(value))
                    self.charsmap = spec.get(2, b"")
                    self.dummy_prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), self.unknown)

    @property
    def by_words(self) -> bool:
        """Whether a text may be cut before each single space: nothing is normalised away and no piece goes on past a space."""
        inner = any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))
        return not self.charsmap and not self.trim and self.escape and self.dummy_prefix and not inner

    def merges(self) -> list[tuple[str, str]]:
        """Merges of a BPE model: every way to make a piece of two others, best piece first."""
        usable = {p: (score, i) for i, (p, score, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        made = [(-usable[p][0], usable[p][1], k, (p[:k], p[k:])) for p in usable for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        return [m[3] for m in sorted(made)]


def tokenizer_of(model: Model):
    """The tokenizers library's counterpart of the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == BPE:
        # Types other than normal ones are in the vocabulary, for their ids, but no merge makes them.
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, model.merges(), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    made = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))  # not before an empty text
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    made.normalizer = normalizers.Sequence(steps)
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return made


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """The codec of this Python process: a worker that runs several tasks loads and remembers once."""
    return Codec(path)


loaded.append(codec_of.cache_clear)


class Codec:
    """Encodes and decodes texts; remembers distinct strings up to a bound in bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece

        self.model = Model(path)
        self.tokenizer = tokenizer_of(self.model)
        self.known = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pool = IdPool(self._both, REMEMBERED_BYTES)
        #: The bytes that each id stands for.
        self.bytes = pa.array([bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces], pa.binary())

    def _both(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of strings, each standing as at the start of a text, their numbers, and marks."""
        found, marks = [], np.zeros(len(strings), np.uint8)
        for at in range(0, len(strings), AT_ONCE):
            part = strings[at : at + AT_ONCE]
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            theirs = self.known.encode(part, num_threads=1)
            if ours != theirs:
                marks[at : at + len(part)] = [DIFFERENT * (a != b) for a, b in zip(ours, theirs, strict=True)]
            found += theirs if ours != theirs else ours
        flat, lengths = flattened(found)
        kept = pa.array(strings, pa.string()).cast(pa.binary())
        if self.model.dummy_prefix:
            kept = pc.if_else(pc.equal(kept, b""), kept, pc.binary_join_element_wise(pa.scalar(b" "), kept, pa.scalar(b"")))
        marks |= BENT * pc.not_equal(self._joined(flat, lengths), kept).to_numpy(zero_copy_only=False).astype(np.uint8)
        return flat, lengths, marks

    def _joined(self, flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """The bytes of lists of ids."""
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.bytes.take(pa.array(flat))), b"")

    def encode(self, texts: pa.Array) -> dict[str, np.ndarray | pa.Array]:
        """ids (one after the other), n_tokens, same (both libraries agree) and decoded of each text."""
        if self.model.by_words:
            # The marker itself in a text stands for a space, so such texts stay whole.
            codes, words, offsets, whole = chunked(texts, (MARK,))
            # An empty chunk at the start or end is a space at the edge: it takes part like a word, but for an empty text.
            whole |= pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")).to_numpy(zero_copy_only=False)
        else:
            codes, words, offsets, whole = np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64), np.ones(len(texts), bool)
        counts = np.where(whole, 0, np.diff(offsets))
        codes = codes[spread(offsets[:-1], counts)] if whole.any() else codes
        # Numbers of the strings that make up the texts, in order.
        order = self.pool.places(pa.concat_arrays([words, texts.filter(pa.array(whole))]))
        ends = np.cumsum(counts)
        order = np.insert(order[codes], (ends - counts)[whole], order[len(words) :])
        counts = counts + whole
        offsets = np.concatenate([[0], np.cumsum(counts)])
        lengths = self.pool.lengths[order]
        ids = self.pool.pool[spread(self.pool.starts[order], lengths)]
        n_tokens, marks = sums(lengths, offsets), self.pool.marks[order]
        back = sums(marks & BENT, offsets) == 0
        starts = np.cumsum(n_tokens) - n_tokens
        decoded = texts
        if not back.all():
            bent = [self.decode(ids[starts[i] : starts[i] + n_tokens[i]].tolist()) for i in np.flatnonzero(~back)]
            decoded = pc.replace_with_mask(texts, pa.array(~back), pa.array(bent, texts.type))
        return {"ids": ids, "n_tokens": n_tokens, "same": sums(marks & DIFFERENT, offsets) == 0, "decoded": decoded}

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that stands for the dummy prefix goes."""
        text = self.tokenizer.decode(ids, skip_special_tokens=False)
        return text.removeprefix(" ") if self.model.dummy_prefix else text


def encoded(docs: DataFrame, model: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``columns``, ids, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text) and same_ids.

    A null text counts as empty (no ids). Rows are handled on their own, without a shuffle, so repeats, ties, null
    ids and other columns (clashing names too) change nothing; an empty table gives an empty table. What a worker remembers is bounded in bytes, so very
    long texts are encoded whole and then forgotten.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for part in slices(batches, "_text", PART_BYTES):
            texts = filled(part.column("_text"))
            found = codec.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(found["n_tokens"])])
            plain = found["ids"].astype("<u4")
            yield pa.RecordBatch.from_pydict(
                {c: part.column(c) for c in columns}
                | {
                    "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found["ids"].astype(np.int32))),
                    "n_tokens": pa.array(found["n_tokens"]),
                    "ids_crc32": pa.array([zlib.crc32(plain[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64()),
                    "round_trip": pc.equal(found["decoded"], texts),
                    "same_ids": pa.array(found["same"]),
                }
            )

    kept = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    added = T.StructType.fromDDL("ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean, same_ids boolean")
    return kept.mapInArrow(encode, T.StructType([docs.schema[c] for c in columns] + added.fields))
