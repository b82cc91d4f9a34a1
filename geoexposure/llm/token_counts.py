"""Exact token counts of every prefix by dynamic programming, for byte-level BPE.

Of a BPE encoding, every pair of neighbouring tokens encodes to itself, and a sequence all of whose neighbours
do is the encoding of its bytes. So of the tokens that a prefix could end with exactly one can follow the
last token of the prefix before it; its count is that prefix's count plus one. One pass over
a pre-token gives the count of each of its prefixes, and the counts of a text's prefixes follow by addition.
They are stored as steps from one prefix to the next: truncation to a token budget and "does it fit" are read
from the stored table, whatever the budget, without encoding again.
"""

from __future__ import annotations

import array
import functools
import itertools
import json
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoexposure.llm.shared import filled, fresh_path, id_and_text, slices
from geoexposure.llm.token_words import REMEMBERED, chunked

# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT = 1024
#: What a code point adds to the count of its prefix is held in two bytes: it is bounded by the length of a token. Code points whose steps lie together in a stored part.
STEP, PART = np.dtype(np.int16), 4096


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file.

    Bytes that print in Latin-1 stand for themselves, the others for the letters from U+0100 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """The counter of this Python process: a worker that runs several tasks loads and remembers once."""
    return PrefixCounter(path)


class PrefixCounter:
    """Token counts of texts and of their prefixes, for a tokenizer file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        self._refuse_others(stored)
        letters = byte_letters()
        self.letters = [letters[b] for b in range(256)]
        self.special = tuple(t["content"] for t in stored["added_tokens"])
        self.vocab: set[str] = set(stored["model"]["vocab"])
        pairs = (m if isinstance(m, list) else m.split(" ") for m in stored["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.endings = {t[i:] for t in self.vocab for i in range(len(t))}
        self.pattern = regex.compile(PATTERN)
        self.runs = regex.compile(r"\s{2,}(?=\S)")
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.follows: dict[tuple[str, str], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    @staticmethod
    def _refuse_others(stored: dict) -> None:
        """Another kind of file would give wrong counts without an error, so it ends the job."""
        before = stored.get("pre_tokenizer") or {}
        plain = {"ignore_merges": False, "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}
        faults = [
            *(["a normaliser"] if stored.get("normalizer") else []),
            *(["a pre-tokenizer that is not byte-level"] if before.get("type") != "ByteLevel" else []),
            *(["a prefix space"] if before.get("add_prefix_space") else []),
            *(["no splitting pattern"] if not before.get("use_regex", True) else []),
            *(["a model that is not BPE"] if stored["model"].get("type", "BPE") != "BPE" else []),
            *(name for name, value in plain.items() if (stored["model"].get(name) or None) != (value or None)),
            *(["added tokens with options"] if any(t[o] for t in stored["added_tokens"] for o in ("single_word", "lstrip", "rstrip", "normalized")) else []),
        ]
        if faults:
            raise ValueError(f"prefix counts are for plain byte-level BPE files; this one has {', '.join(faults)}")

    def _may_follow(self, a: str, b: str) -> bool:
        """Whether the two tokens next to each other encode to themselves."""
        if (known := self.follows.get((a, b))) is None:
            known = self._merged(a + b) == [a, b]
            if len(self.follows) < 2 * REMEMBERED:
                self.follows[a, b] = known
        return known

    def _merged(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def piece_table(self, piece: str) -> list[int]:
        """Token counts of the prefixes of one pre-token by bytes, the empty one included."""
        text = "".join([self.letters[b] for b in piece.encode("utf-8", "surrogatepass")])
        counts, last = [0], [""]
        for end in range(1, len(text) + 1):
            start = end - 1
            while True:
                token = text[start:end]
                if token in self.vocab and (not start or self._may_follow(last[start], token)):
                    break
                start -= 1
                if start < 0 or text[start:end] not in self.endings:
                    raise ValueError(f"no token ends the prefix {piece.encode()[:end]!r}")
            counts.append(counts[start] + 1)
            last.append(token)
        return counts

    def _piece(self, piece: str) -> bytes:
        """Steps of one pre-token. A prefix that ends within a contraction has its apostrophe and letter as pre-tokens of their own."""
        if (steps := self.pieces.get(piece)) is None:
            counts = self.piece_table(piece)
            if len(counts) != len(piece) + 1:
                ends = itertools.accumulate((len(c.encode("utf-8", "surrogatepass")) for c in piece), initial=0)
                counts = [counts[end] for end in ends]
            if piece[0] == "'" and len(piece) == 3:
                counts[2] = self.count(piece[:2])
            steps = array.array("h", map(operator.sub, counts[1:], counts)).tobytes()
            if len(self.pieces) < REMEMBERED:
                self.pieces[piece] = steps
        return steps

    def _size(self, piece: str) -> int:
        return int(np.frombuffer(self._piece(piece), STEP).sum())

    def steps(self, text: str) -> bytes:
        """By how much each code point of a text without special strings changes the token count of the prefix that it ends.

        Pre-tokens before a prefix's end stay as they are, but for a run of white space: up to its end it is one pre-token, and what follows it takes the last of it.
        """
        joined = b"".join(map(self._piece, self.pattern.findall(text)))
        runs = list(self.runs.finditer(text))
        if not runs:
            return joined
        steps = np.frombuffer(joined, STEP).copy()
        for m in runs:
            end, step = m.end(), self._size(m[0]) - self._size(m[0][:-1])
            steps[end] += steps[end - 1] - step
            steps[end - 1] = step
        return steps.tobytes()

    def whole_steps(self, text: str) -> bytes:
        """Steps of any text; a special string in it is one token, the beginnings of one are plain text after the text before it."""
        parts, out = (self.split.split(text) if self.split else [text]), []
        for i, part in enumerate(parts):
            if i % 2 == 0:
                out.append(self.steps(part))
                continue
            before = parts[i - 1]
            inside = np.frombuffer(self.steps(before + part[:-1]), STEP).astype(np.int64)
            plain = np.frombuffer(self.steps(before), STEP).astype(np.int64).sum()
            own = np.append(np.cumsum(inside)[len(before) :] if len(part) > 1 else [], 1 + plain)
            out.append(np.diff(own, prepend=plain).astype(STEP).tobytes())
        return b"".join(out)

    def count(self, text: str) -> int:
        """Tokens of the whole text; special strings in it are one token each, as the library takes them."""
        return int(np.frombuffer(self.whole_steps(text), STEP).astype(np.int64).sum())

    def table(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of a text, by code points, the empty one included."""
        return np.concatenate([[0], np.cumsum(np.frombuffer(self.whole_steps(text), STEP), dtype=np.int64)])

    def _chunk(self, chunk: str) -> bytes:
        if (steps := self.chunks.get(chunk)) is None:
            steps = self.steps(chunk)
            if len(self.chunks) < REMEMBERED:
                self.chunks[chunk] = steps
        return steps

    def all_steps(self, texts: pa.Array) -> pa.Array:
        """The steps of each text; a chunk's are found once."""
        import pyarrow.compute as pc

        codes, values, offsets, whole = chunked(texts, self.special)
        words = values.to_pylist()
        firsts = offsets[:-1][~whole]
        known = pa.array([*(self._chunk(" " + w) for w in words), *(self._chunk(words[c]) for c in codes[firsts])], pa.binary())
        codes[firsts] = len(words) + np.arange(len(firsts))
        taken = known.take(pa.array(codes))
        ends = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1][offsets] if len(taken) else np.zeros(len(texts) + 1, np.int32)
        steps = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(ends)), taken.buffers()[2]])
        if whole.any():
            steps = pc.replace_with_mask(steps, pa.array(whole), pa.array([self.whole_steps(texts[int(i)].as_py()) for i in np.flatnonzero(whole)], pa.binary()))
        return steps


    def counts(self, texts: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each text, code points of its longest prefix within ``limit`` tokens), without a stored table."""
        steps = self.all_steps(texts)
        return _parts(steps)[0], np.array([_longest(s, 0, limit) for s in steps], np.int64)


def _longest(steps: pa.Scalar, before: int, limit: int) -> int:
    """How many of the steps go to the last prefix within ``limit`` tokens, from ``before`` on."""
    counts = before + np.cumsum(np.frombuffer(steps.as_buffer(), STEP), dtype=np.int64)
    within = np.flatnonzero(counts <= limit)
    return int(within[-1]) + 1 if len(within) else 0


def _parts(steps: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(tokens, code points, parts) of texts by their steps. A part holds PART steps, the count before it and the least count of a prefix that ends in it."""
    ends = np.frombuffer(steps.buffers()[1], np.int32)[steps.offset : steps.offset + len(steps) + 1].astype(np.int64) // STEP.itemsize
    flat = np.frombuffer(steps.buffers()[2] or b"", STEP)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    running = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
    sizes = np.diff(ends)
    each = -(-sizes // PART)
    row = np.repeat(np.arange(len(sizes)), each)
    firsts = np.cumsum(each) - each
    starts = ends[row] + (np.arange(len(row)) - firsts[row]) * PART
    base = running[ends[row]]
    least = np.minimum.reduceat(running[1:], starts) if len(starts) else np.zeros(0, np.int64)
    cut = pa.py_buffer((np.append(starts, ends[-1]) * STEP.itemsize).astype(np.int32))
    held = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, cut, pa.py_buffer(np.ascontiguousarray(flat))])
    rows = pa.StructArray.from_arrays([pa.array(running[starts] - base), pa.array(least - base), held], ["before", "least", "steps"])
    return running[ends[1:]] - running[ends[:-1]], sizes, pa.ListArray.from_arrays(pa.array(np.append(firsts, len(row)), pa.int32()), rows)


def stored(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The prefix table of each row, written to the shared folder: doc_id, n_bytes, n_tokens, n_chars and parts.

    The steps of a text say the exact token count of every prefix. They lie in parts of PART code points with the count before them, so a question reads one part, not the text, and nothing is encoded again.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        counter = prefix_counter(tokenizer)
        for part in slices(batches):
            texts = filled(part.column("text"))
            totals, sizes, parts = _parts(counter.all_steps(texts))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": pa.array(totals), "n_chars": pa.array(sizes), "parts": parts})

    made = id_and_text(docs).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, n_chars long, parts array<struct<before:long,least:long,steps:binary>>")
    path = fresh_path(docs.sparkSession, "prefix-counts")
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def within(tables: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Of each row of ``stored`` doc_id, n_bytes, n_tokens, over_limit, and fit_chars, the code points of its longest prefix within ``limit`` tokens.

    Any number of budgets can be asked of one table. Of a text over the limit the last part with a prefix within it is looked at, of others none.
    """

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = batch.column("_start").to_numpy().copy()
            before, steps = batch.column("_before").to_numpy(zero_copy_only=False), batch.column("_steps")
            for i in np.flatnonzero(steps.is_valid().to_numpy(zero_copy_only=False)):
                fits[i] += _longest(steps[int(i)], before[i], limit)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "n_bytes", "n_tokens", "over_limit")} | {"fit_chars": pa.array(fits)})

    over = F.col("n_tokens") > limit
    last = F.when(over, F.expr(f"array_max(transform(parts, (p, i) -> IF(p.least <= {int(limit)}, i, -1)))"))
    rows = tables.select("doc_id", "n_bytes", "n_tokens", over.alias("over_limit"), "n_chars", last.alias("_at"), F.when(over, F.col("parts")).alias("parts"))
    part = F.when(F.col("_at") >= 0, F.expr("get(parts, _at)"))
    start = F.when(F.col("over_limit"), F.greatest(F.col("_at"), F.lit(0)) * PART).otherwise(F.col("n_chars")).cast("long")
    rows = rows.select("doc_id", "n_bytes", "n_tokens", "over_limit", start.alias("_start"), F.coalesce(part["before"], F.lit(0)).cast("long").alias("_before"), part["steps"].alias("_steps"))
    return rows.mapInArrow(fitted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def report(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """``within`` of the ``stored`` prefix tables of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens). Rows are handled on their own, without a shuffle, so
    repeats, ties, null ids and other columns change nothing; an empty table gives an empty table. What a worker
    remembers is bounded; very long texts without spaces cost time in proportion to their bytes, and a text's steps take two bytes for each code point.
    """
    return within(stored(docs, tokenizer), limit)
