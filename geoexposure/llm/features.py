"""Hashed sparse features of whole texts, and the labelled sample that the classifiers learn from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoexposure.llm.shared import REMEMBERED_WORDS, Words

BITS = 18
#: Labelled rows that a classifier learns from at most: those with the smallest hash of their doc_id.
SAMPLE = 8_000
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def plain_word(word: str) -> str:
    """The word in lower case, without what is no letter or digit at its ends."""
    low = word.lower()
    start, end = 0, len(low)
    while start < end and not low[start].isalnum():
        start += 1
    while end > start and not low[end - 1].isalnum():
        end -= 1
    return low[start:end]


def _shape(word: str) -> str:
    """How the word is written: case or digits, and the signs at its end (three at most)."""
    core = word.rstrip("\"'`!?.,;:#$%&*+-/<=>@\\^_|~()[]{}")
    kind = "" if not core else "0" if any(c.isdigit() for c in core) else "A" if len(core) > 1 and core.isupper() else "T" if core[0].isupper() else "a" if core.islower() else "x"
    return kind + " " + word[len(core) :][:3]


class HashedWords:
    """Turns texts into words with two hashes each, of what the word is and of how it is written."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of plain words, hashes of shapes, offsets) of the words of all texts."""
        words = Words(texts)
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        known, pairs = self.known, []
        for w in words.values.to_pylist():
            if (pair := known.get(w)) is None:
                pair = known[w] = (xxhash.xxh64_intdigest(plain_word(w)), xxhash.xxh64_intdigest(_shape(w), 1))
            pairs.append(pair)
        table = np.array(pairs, np.uint64).reshape(-1, 2)
        return table[words.codes, 0], table[words.codes, 1], words.offsets


def bins(hashes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(_MIX[salt % 3]) + np.uint64(salt)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def pairs_of(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one of its text; the last one of a text stands with nothing."""
    after = np.append(hashes[1:], np.uint64(0)) if len(hashes) else hashes.copy()
    after[offsets[1:][np.diff(offsets) > 0] - 1] = 0
    return (hashes * np.uint64(_MIX[1])) ^ ((after << np.uint64(17)) | (after >> np.uint64(47)))


def sample(labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of ``rows`` labelled documents at most, for learning.

    Documents whose crc32 of the id is divisible by 5 are held out. The smallest hashes of ids are taken, so the sample is
    the same at each run; its bound does not grow with the input, so it may be broadcast.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    one = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0
