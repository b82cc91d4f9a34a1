"""Token ids of whole texts by way of their distinct chunks, for byte-level BPE with the usual pre-tokenizer.

The pre-tokenizer always cuts before a single space that stands between two characters that are no white
space, so a text is the sequence of its chunks at such spaces, and a chunk needs encoding once per worker.
Texts with other white space around spaces, or with special strings, go to the library whole.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the distinct chunks that a worker remembers, and, where their number counts, how many.
REMEMBERED_BYTES, REMEMBERED = 8 << 20, 500_000
#: Strings that the library encodes in one call: its encodings are large while they live.
AT_ONCE = 2_000
_SPACES = r"\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CROWDED = f"[{_SPACES}] | [{_SPACES}]"


def chunked(texts: pa.Array, special: tuple[str, ...] = ()) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(codes, distinct chunks, offsets, whole): chunks between single spaces; ``whole`` marks the texts that can't be cut.

    Texts that are marked have no chunks.
    """
    whole = pc.match_substring_regex(texts, _CROWDED)
    for s in special:
        whole = pc.or_(whole, pc.match_substring(texts, s))
    whole = whole.to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
    flat = lists.flatten().dictionary_encode()
    lengths = np.zeros(len(texts), np.int64)
    lengths[~whole] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return flat.indices.to_numpy().astype(np.int64), flat.dictionary, offsets, whole


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of ranges that start at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class IdPool:
    """Ids of remembered strings, one after the other in a growing array.

    Strings stay in the order in which they come (frequent ones come early) up to ``most`` bytes of text; later ones are forgotten at the next call.
    ``encode`` gives for a list of strings their ids one after the other, the number of ids of each, and a mark of each.
    """

    def __init__(self, encode, most: int = REMEMBERED_BYTES):
        self.encode, self.most = encode, most
        self.known = pa.array([], pa.string())
        self.pool, self.lengths, self.marks = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.uint8)
        self.starts = self.lengths

    def places(self, strings: pa.Array) -> np.ndarray:
        """The numbers under which the strings (repeats are allowed) are found until the next call."""
        n = len(self.known)
        used = int(self.lengths[:n].sum())
        self.pool, self.lengths, self.marks = self.pool[:used], self.lengths[:n], self.marks[:n]
        found = pc.index_in(strings, value_set=self.known)
        missing = found.is_null()
        places = found.fill_null(0).to_numpy().astype(np.int64)
        if found.null_count:
            unknown = strings.filter(missing)
            new = unknown.unique()
            flat, lengths, marks = self.encode(new.to_pylist())
            self.pool, self.lengths, self.marks = np.concatenate([self.pool, flat]), np.concatenate([self.lengths, lengths]), np.concatenate([self.marks, marks])
            places[missing.to_numpy(zero_copy_only=False)] = n + pc.index_in(unknown, value_set=new).to_numpy()
            ends = np.cumsum(pc.binary_length(new).to_numpy().astype(np.int64)) + self.known.nbytes
            self.known = pa.concat_arrays([self.known, new[: int(np.searchsorted(ends, self.most))]])
        self.starts = np.cumsum(self.lengths) - self.lengths
        return places


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids one after the other, number of ids of each list)."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


@functools.lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """The encoder of this Python process: a worker that runs several tasks loads and remembers once."""
    return TextEncoder(path)


class TextEncoder:
    """Ids of whole texts as the library for a tokenizer file gives them, without added special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.pool = IdPool(self._encode)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = []
        for at in range(0, len(texts), AT_ONCE):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]
        return *flattened(found), np.zeros(len(texts), np.uint8)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        codes, words, offsets, whole = chunked(texts, self.special)
        firsts = offsets[:-1][~whole]
        inner = pc.binary_join_element_wise(pa.scalar(" "), words, "")
        # One place for each chunk, in order; a whole text is a single chunk. First chunks have no space before them.
        places = self.pool.places(pa.concat_arrays([inner, words.take(pa.array(codes[firsts])), texts.filter(pa.array(whole))]))
        of_chunk = places[: len(words)][codes]
        of_chunk[firsts] = places[len(words) : len(words) + len(firsts)]
        counts = np.diff(offsets)
        order = np.insert(of_chunk, offsets[:-1][whole], places[len(words) + len(firsts) :]) if whole.any() else of_chunk
        counts = counts + whole
        lengths = self.pool.lengths[order]
        ids = self.pool.pool[spread(self.pool.starts[order], lengths)]
        running = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        return ids, running[ends] - running[ends - counts]
