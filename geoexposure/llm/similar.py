"""Near copies by exact similarity, found over a Gray-order index of wide SimHash fingerprints.

A 64-bit fingerprint of shingles differs in up to a quarter of its bits at a similarity of 0.8, too many for an index of such
fingerprints. So fingerprints have 256 bits here, of which a pair at the threshold differs in about 39 and hardly any pair in more than MOST. Roots
of the index are patterns of fingerprints under sampled masks, wide enough that a root has about ROOT members, and so
many that a pair at the threshold shares one with a chance of ``recall``. Below a root the differences met so far
leave out whole nodes, and members word by word.

What is close under a root is linked to a tree, so a root gives fewer links than it has members. Trees that touch make
up a neighbourhood; whatever is similar, and shares a root, is in one neighbourhood. Within each one the sets of shingles are
then held against each other exactly, so a document's class never rests on an estimate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoexposure.llm.shared import Words, bounded, filled, id_and_text, keep, slices
from geoexposure.llm.simhash import BLOCK, SEED, Clusters, GrayIndex, by_root, differences, gray_rank, runs, split_roots
from geoexposure.llm.token_words import spread
from geoexposure.operators.components import connected_components

#: 64-bit words of a fingerprint, and bits that close ones may differ in: three deviations above what a pair at 0.8 differs in.
WORDS, MOST = 4, 56
#: Members that a root has on average, and the share of pairs at the threshold that meet under a root.
ROOT, RECALL = 256, 0.98
#: Roots of up to so many members are one node; larger ones get a Gray-order index.
NODE = 1024
#: In roots of more than BLOCK members, those within so many bits of a leader are searched through it.
TIGHT, ROUNDS = 16, 2
#: Members and bytes of shingles of a neighbourhood that a task holds; larger ones are split.
MEMBERS, BYTES = 4096, 32 << 20
#: Bytes of text whose shingles are worked out at once.
PART_BYTES = 1 << 20
#: Bits of a shingle's hash; the rest of 64 bits numbers the texts of a slice.
HASH_BITS = 44
#: In the exact form: sets of so many shingles at most are ruled out by their bitmaps, a true bound; larger ones by fingerprints that differ in more than FAR bits, eight
#: deviations above the mean at 0.8. FEW: rows under one shingle that are compared together with those of others.
BOUND, FAR, FEW = 384, 84, 32
#: The order of shingles in the exact form: documents in its sample, of which so many make a shingle common, and common shingles at most. No order loses a pair.
SAMPLE, COMMON, MOST_COMMON = 5000, 3, 200_000
# Odd multipliers that spread hashes.
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_STEP = 0x9FB21C651E98DF25


def spread_bits(h: np.ndarray, by: int) -> np.ndarray:
    """Hashes of hashes."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(by)
    return h ^ (h >> np.uint64(32))


def shingle_codes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ends): the hashes (44 bits, ascending) of the distinct shingles of each text, one text after the other, and where each text's end.

    A text of fewer than ``words`` words has its whole sequence as its shingle, one without words none.
    """
    if len(texts) > 1 << (64 - HASH_BITS):
        half = len(texts) // 2
        (a, m), (b, n) = shingle_codes(texts[:half], words), shingle_codes(texts[half:], words)
        return np.concatenate([a, b]), np.concatenate([m, n + len(a)])
    found = Words(pc.ascii_lower(texts))
    own = np.fromiter((xxhash.xxh64_intdigest(v, SEED) for v in found.values.to_pylist()), np.uint64, len(found.values))
    flat = np.concatenate([own[found.codes], np.zeros(words, np.uint64)])
    counts = found.counts
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    at = spread(found.offsets[:-1], n)
    h = np.zeros(len(at), np.uint64)
    for k in range(words):
        h = h * np.uint64(_STEP) + flat[at + k]
    firsts = np.cumsum(n) - n
    for i in np.flatnonzero((counts > 0) & (counts < words)):
        x = np.zeros(1, np.uint64)
        for w in flat[found.offsets[i] : found.offsets[i + 1]]:
            x = x * np.uint64(_STEP) + w
        h[firsts[i]] = x[0]
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    both = np.unique((text << np.uint64(HASH_BITS)) | (spread_bits(h, _SPREAD[0]) >> np.uint64(64 - HASH_BITS)))
    ends = np.searchsorted(both, np.arange(1, len(texts) + 1, dtype=np.uint64) << np.uint64(HASH_BITS))
    return both & np.uint64((1 << HASH_BITS) - 1), ends


def wide_fingerprints(codes: np.ndarray, ends: np.ndarray, step: int = 4096) -> np.ndarray:
    """The fingerprints of sets of shingles, as rows of 64-bit words: a bit is set where over half the hashes have it."""
    out = np.zeros((len(ends), 8 * WORDS), np.uint8)
    start = 0
    for i, end in enumerate(ends.tolist()):
        ones = np.zeros(64 * WORDS, np.int64)
        for at in range(start, end, step):
            base = codes[at : min(at + step, end)]
            wide = np.stack([spread_bits(base, m) for m in _SPREAD], 1)
            ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.int32)
        out[i] = np.packbits(2 * ones > end - start)
        start = end
    return out.view(np.uint64)


_WIDE = [f"w{k}" for k in range(WORDS)]
_MAP = [f"m{k}" for k in range(WORDS)]


def bitmaps(codes: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """Of each set, which classes of hashes have odd numbers in it, as rows of 64-bit words. Two sets differ in as many hashes as their bitmaps in bits, or more."""
    out, step = np.empty((len(ends), words), np.uint64), max(1, (1 << 22) // (64 * words))
    sizes = np.diff(ends, prepend=0)
    for at in range(0, len(ends), step):
        some = sizes[at : at + step]
        own = (codes[ends[at] - sizes[at] : ends[at + len(some) - 1]] % np.uint64(64 * words)).astype(np.int64)
        odd = np.bincount(np.repeat(np.arange(len(some)), some) * (64 * words) + own, minlength=len(some) * 64 * words) & 1
        out[at : at + step] = np.packbits(odd.astype(np.uint8).reshape(len(some), -1), axis=1).view(np.uint64)
    return out


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, size, w0 to w3, m0 to m3) per document: number of distinct shingles, fingerprint, bitmap."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=PART_BYTES):
            codes, ends = shingle_codes(filled(part.column("text")), words)
            fps = wide_fingerprints(codes, ends).view(np.int64)
            columns = {"doc_id": part.column("doc_id"), "size": pa.array(np.diff(ends, prepend=0))}
            maps = bitmaps(codes, ends, WORDS).view(np.int64)
            yield pa.RecordBatch.from_pydict(columns | {w: pa.array(fps[:, k]) for k, w in enumerate(_WIDE)} | {m: pa.array(maps[:, k]) for k, m in enumerate(_MAP)})

    return id_and_text(docs).mapInArrow(hashed, "doc_id long, size long, " + ", ".join(f"{w} long" for w in _WIDE + _MAP))


def masks_for(n: int, similarity: float, recall: float) -> list[np.ndarray]:
    """Sampled masks, each the numbers of the bits that it covers, for ``n`` fingerprints.

    A mask covers so many bits that a root has ROOT members on average. Sets of equal size of a Jaccard similarity s have a cosine of 2s / (1 + s), and a
    bit differs with the chance of that angle over 180 degrees; as many masks are taken as ``recall`` needs at that chance.
    """
    bits = min(40, max(4, round(math.log2(max(2, n) / ROOT))))
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    many = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** bits))
    draws = np.random.default_rng(SEED)
    return [draws.choice(64 * WORDS, bits, replace=False) for _ in range(many)]


def with_roots(fps: DataFrame, masks: list[np.ndarray]) -> DataFrame:
    """``fps`` once under each of its roots: _mask, _pattern, doc_id, w0 to w3."""

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(w).to_numpy() for w in _WIDE], 1) if batch.num_rows else np.zeros((0, WORDS), np.int64)
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
            patterns = np.stack([bits[:, m].astype(np.int64) @ (1 << np.arange(len(m))) for m in masks], 1)
            ends = np.arange(batch.num_rows + 1) * len(masks)
            yield pa.RecordBatch.from_pydict({"patterns": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(patterns.ravel()))} | {c: batch.column(c) for c in ("doc_id", *_WIDE)})

    found = fps.select("doc_id", *_WIDE).mapInArrow(rooted, "patterns array<long>, doc_id long, " + ", ".join(f"{w} long" for w in _WIDE))
    return found.select(F.posexplode("patterns").alias("_mask", "_pattern"), "doc_id", *_WIDE)


def close_members(own: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (a, b) of the members of one root, in Gray order, that differ in ``most`` bits or fewer; each pair at least once."""
    if len(own) > NODE or most > MOST:
        yield from GrayIndex(own).close(own, most)
        return
    step = max(1, (1 << 20) // len(own))
    for at in range(0, len(own), step):
        some = own[at : at + step]
        met = np.bitwise_count(some[:, 0, None] ^ own[None, :, 0])
        for k in range(1, WORDS):  # no sum is above 256, and one of 256 is no pair
            met = np.add(met, np.bitwise_count(some[:, k, None] ^ own[None, :, k]), dtype=np.uint16, casting="unsafe")
        a, b = np.nonzero(met <= most)
        later = a + at < b
        yield a[later] + at, b[later]


def tree(ids: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (ids) that connect what is close among the members of one root; fewer than members."""
    clusters = Clusters(len(own))
    for a, b in close_members(own, most):
        clusters.join(a, b)
    linked = np.flatnonzero(clusters.root != np.arange(len(own)))
    return ids[linked], ids[clusters.root[linked]]


_NONE = np.zeros(0, np.int64)
_SPLIT = ("_mask", "_pattern", "_b")


def links_under(rows: DataFrame, most: int, roots: tuple[str, ...]) -> DataFrame:
    """(src, dst): the trees of all roots."""

    def handle(keys: np.ndarray, values: np.ndarray) -> list:
        values = values.astype(np.int64)
        ids, words = values[:, 0], np.ascontiguousarray(values[:, 1:]).view(np.uint64)
        src, dst = [_NONE], [_NONE]
        for start, end in runs(keys):
            a, b = tree(ids[start:end], words[start:end], most)
            src.append(a)
            dst.append(b)
        return [np.concatenate(src), np.concatenate(dst)]

    return by_root(rows.withColumn("_rank", gray_rank(F.col("w0"))), ["doc_id", *_WIDE], handle, "src long, dst long", roots)


def led(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of large roots: a row for each member with its root, fingerprint, ``near`` (the tree's link, or itself), and whether it leads.

    Members within TIGHT bits of a leader are represented by it: what is within ``most`` bits of them is within ``most`` + TIGHT of it.
    """

    def handle(keys: np.ndarray, values: np.ndarray) -> list:
        values = values.astype(np.int64)
        ids, words = values[:, 0], np.ascontiguousarray(values[:, 1:]).view(np.uint64)
        near, leads = ids.copy(), np.ones(len(ids), bool)
        for start, end in runs(keys):
            own, mine = words[start:end], ids[start:end]
            place = dict(zip(mine.tolist(), range(start, end), strict=True))
            for a, b in zip(*(x.tolist() for x in tree(mine, own, most)), strict=True):
                near[place[a]] = b
            for i in range(len(own)):
                if leads[start + i] and i + 1 < len(own):
                    leads[start + i + 1 : end] &= differences(own[i], own[i + 1 :]) > TIGHT
        return [keys[:, 0], keys[:, 1], ids, *words.view(np.int64).T, near, leads]

    schema = "_mask long, _pattern long, doc_id long, " + ", ".join(f"{w} long" for w in _WIDE) + ", near long, leads boolean"
    return by_root(rows.withColumn("_rank", gray_rank(F.col("w0"))), ["doc_id", *_WIDE], handle, schema, _SPLIT)


def close_links(fps: DataFrame, n: int, similarity: float, recall: float) -> DataFrame:
    """(src, dst) that connect those of the ``n`` documents whose fingerprints are close and share a root.

    Roots of more than BLOCK members are cut into blocks. Each block links what is close in it, and only its leaders go on to meet
    those of other blocks, at a distance wider by what they represent; so no close pair stays apart, and a large group shrinks before it meets
    itself. Leaders that are still too many after two rounds meet in pairs of blocks.
    """
    rows = with_roots(fps, masks_for(n, similarity, recall))
    counts = lambda rows: rows.groupBy("_mask", "_pattern").count().where(F.col("count") > BLOCK)
    large, most = keep(counts(rows), "similar-large"), MOST
    if large.isEmpty():
        return links_under(rows, most, ("_mask", "_pattern"))
    parts = [links_under(rows.join(bounded(large), ["_mask", "_pattern"], "left_anti"), most, ("_mask", "_pattern"))]
    left = rows.join(bounded(large), ["_mask", "_pattern"], "left_semi")
    for _ in range(ROUNDS):
        blocks = F.ceil(F.col("count") / BLOCK)
        cut = left.join(bounded(large), ["_mask", "_pattern"]).withColumn("_b", F.pmod(F.xxhash64("doc_id"), blocks).cast("long"))
        members = keep(led(cut, most), "similar-led")
        parts.append(members.where("near <> doc_id").select(F.col("doc_id").alias("src"), F.col("near").alias("dst")))
        left, most = members.where("leads").drop("near", "leads"), most + 2 * TIGHT
        large = keep(counts(left), "similar-large")
        if large.isEmpty():
            return _united([*parts, links_under(left, most, ("_mask", "_pattern"))])
    parts.append(links_under(left.join(bounded(large), ["_mask", "_pattern"], "left_anti"), most, ("_mask", "_pattern")))
    pairs = split_roots(left.join(bounded(large), ["_mask", "_pattern"], "left_semi"), F.col("doc_id"))
    return _united([*parts, links_under(pairs, most, ("_mask", "_pattern", "_i", "_j"))])


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def common_shingles(docs: DataFrame, n: int, words: int) -> np.ndarray:
    """Ascending hashes of the shingles that COMMON documents or more of a sample of about SAMPLE have, the most common MOST_COMMON at most."""
    every = max(1, n // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=PART_BYTES):
            yield pa.RecordBatch.from_pydict({"token": pa.array(shingle_codes(filled(part.column("text")), words)[0].astype(np.int64))})

    counts = id_and_text(some).mapInArrow(shingled, "token long").groupBy("token").count().where(F.col("count") >= COMMON)
    found = counts.orderBy(F.desc("count"), "token").limit(MOST_COMMON).toPandas()["token"].to_numpy(np.int64)
    return np.sort(found).astype(np.uint64)


def rare_links(docs: DataFrame, fps: DataFrame, n: int, words: int, similarity: float) -> DataFrame:
    """(src, dst) that connect all similar documents, whatever their roots: the exact form.

    Documents that reach ``similarity`` share at least that part of either's shingles. So, in any one order of all shingles, the first of each
    document that are one more than the rest hold a common one. Here the order is that of hashes, with common shingles last, so
    that documents of a common passage do not all meet under it. A tree links those under a shingle that neither their sizes nor their bitmaps rule out. For sets of more
    than BOUND shingles, whose bitmaps rule out nothing, FAR bits of their fingerprints do; a pair at the threshold of such sets differs in more with a chance of about 10 ** -14.
    """
    common = common_shingles(docs, n, words)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=PART_BYTES):
            codes, ends = shingle_codes(filled(part.column("text")), words)
            sizes = np.diff(ends, prepend=0)
            place = np.searchsorted(common, codes)
            late = common[np.minimum(place, len(common) - 1)] == codes if len(common) else np.zeros(len(codes), bool)
            codes = codes[np.argsort(2 * np.repeat(np.arange(len(ends)), sizes) + late, kind="stable")]
            taken = np.where(sizes > 0, sizes - np.ceil(sizes * similarity - 1e-9).astype(np.int64) + 1, 0)
            ids = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False), taken)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids), "_pattern": pa.array(codes[spread(ends - sizes, taken)].astype(np.int64))})

    rows = id_and_text(docs).mapInArrow(first, "doc_id long, _pattern long")
    rows = keep(rows, "similar-first")
    shared = rows.groupBy("_pattern").count().where("count > 1").select("_pattern")
    rows = rows.join(shared, "_pattern", "left_semi").join(fps.select("doc_id", "size", *_WIDE, *_MAP), "doc_id").withColumn("_mask", F.lit(0))
    met = split_roots(keep(rows, "similar-rare"), F.col("doc_id"))

    def handle(keys: np.ndarray, values: np.ndarray) -> list:
        values = values.astype(np.int64)
        ids, sizes = values[:, 0], values[:, 1]
        bits, maps = (np.ascontiguousarray(values[:, k : k + WORDS]).view(np.uint64) for k in (2, 2 + WORDS))

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            a, b = sizes[i], sizes[j]
            fits = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9
            most = (1 - similarity) / (1 + similarity) * (a + b) + 1e-9
            return fits & np.where(np.maximum(a, b) <= BOUND, differences(maps[i], maps[j]) <= most, differences(bits[i], bits[j]) <= FAR)

        bounds = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        lengths = np.diff(bounds)
        few, last = Clusters(len(ids)), np.repeat(bounds[1:], lengths)
        i = np.flatnonzero(np.repeat(lengths <= FEW, lengths))
        pairs = [(_NONE, _NONE)]
        for d in range(1, FEW):
            i = i[i + d < last[i]]
            x = i[near(i, i + d)]
            pairs.append((x, x + d))
        few.join(*(np.concatenate(p) for p in zip(*pairs, strict=True)))
        for k in np.flatnonzero(lengths > FEW):
            own, start = Clusters(int(lengths[k])), bounds[k]
            step = max(1, (1 << 17) // int(lengths[k]))
            for at in range(0, int(lengths[k]), step):
                x, y = np.nonzero(near(np.arange(start + at, min(start + at + step, bounds[k + 1]))[:, None], np.arange(start, bounds[k + 1])[None]))
                own.join(x + at, y)
            few.root[start : bounds[k + 1]] = own.root + start
        linked = np.flatnonzero(few.root != np.arange(len(ids)))
        return [ids[linked], ids[few.root[linked]]]

    return by_root(met.withColumn("_rank", F.col("size")), ["doc_id", "size", *_WIDE, *_MAP], handle, "src long, dst long")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles): the ascending 44-bit hashes of the distinct shingles, six bytes each."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=PART_BYTES):
            codes, ends = shingle_codes(filled(part.column("text")), words)
            raw = codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            offsets = pa.array(np.concatenate([[0], 6 * ends]), pa.int32())
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "shingles": pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets.buffers()[1], pa.py_buffer(raw)])})

    return id_and_text(docs).mapInArrow(shingled, "doc_id long, shingles binary")


def similar_clusters(sets: list[bytes], similarity: float, groups: np.ndarray | None = None) -> np.ndarray:
    """The cluster (smallest number in it) of each set; sets of a Jaccard similarity of ``similarity`` or more are linked. ``groups``: clusters known before.

    A set is first held against the first member of each cluster, then, for those that it does not join, against all of their members. Bitmaps as wide
    as the largest set rule out most pairs before their hashes are compared.
    """
    raw = [np.frombuffer(s, np.uint8).reshape(-1, 6) for s in sets]
    sizes = np.array([len(r) for r in raw], np.int64)
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, :6] = np.concatenate(raw) if raw else wide[:, :6]
    values, codes = np.unique(wide.view("<u8").ravel(), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    bits = bitmaps(values[codes], ends, max(1, 1 << (int(sizes.max(initial=1)) // 64).bit_length()))
    clusters, there = Clusters(len(sets)), np.zeros(len(values), bool)
    if groups is not None and len(groups):
        first = np.unique(groups, return_index=True, return_inverse=True)
        clusters.join(np.arange(len(groups)), first[1][first[2]])

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        fits = np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i]) - 1e-9
        others = others[fits & (sizes[others] > 0)]
        others = others[differences(bits[others], bits[i]) <= (1 - similarity) / (1 + similarity) * (sizes[others] + sizes[i]) + 1e-9]
        if not len(others):
            return others
        lengths = sizes[others]
        both = np.add.reduceat(there[codes[spread(starts[others], lengths)]], np.cumsum(lengths) - lengths, dtype=np.int64)
        return others[both >= similarity * (lengths + sizes[i] - both) - 1e-9]

    for i in range(1, len(sets)):
        there[codes[starts[i] : ends[i]]] = True
        before = clusters.root[:i]
        for others in (np.unique(before), None):
            if others is None:
                others = np.flatnonzero(clusters.root[:i] != clusters.root[i])
            if len(others) and len(near := linked(i, others)):
                clusters.join(near, np.full(len(near), i))
        there[codes[starts[i] : ends[i]]] = False
    return clusters.root


def clustered(rows: DataFrame, keys: tuple[str, ...], similarity: float) -> DataFrame:
    """(part, doc_id, lead): within each group of ``keys`` the smallest id of each cluster of similar sets. ``rows``: part, doc_id, shingles, lead (a cluster known before)."""

    def handle(marks: np.ndarray, values: np.ndarray) -> list:
        ids, known = values[:, 0].astype(np.int64), values[:, 1].astype(np.int64)
        lead = known.copy()
        for start, end in runs(marks):
            root = similar_clusters(values[start:end, 2].tolist(), similarity, known[start:end])
            least = np.full(end - start, np.iinfo(np.int64).max)
            np.minimum.at(least, root, known[start:end])
            lead[start:end] = least[root]
        return [marks[:, 0].astype(np.int64), ids, lead]

    return by_root(rows, ["doc_id", "lead", "shingles"], handle, "part long, doc_id long, lead long", keys, "doc_id")


def classes(neighbours: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, component): for each document of ``neighbours`` (doc_id, part) the smallest id that links of exact similarity reach.

    A neighbourhood that a task can hold is clustered in one. Of a larger one, blocks are clustered first, then the first members of their
    clusters; what is one cluster by then is done, and only the rest meets in pairs of blocks.
    """
    rows = keep(neighbours.join(sets, "doc_id").select("part", "doc_id", "shingles", F.col("doc_id").alias("lead")), "similar-sets")
    volume = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    need = F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("bytes") / BYTES)).cast("long")
    large = keep(volume.select("part", need.alias("blocks")).where("blocks > 1"), "similar-parts")
    if large.isEmpty():
        return clustered(rows, ("part",), similarity).select(F.col("doc_id").alias("node"), F.col("lead").alias("component"))
    small = clustered(rows.join(bounded(large), "part", "left_anti"), ("part",), similarity).select(F.col("doc_id").alias("node"), F.col("lead").alias("component"))
    many = rows.join(bounded(large), "part").withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    first = keep(clustered(many, ("part", "b"), similarity), "similar-blocks")
    leads = rows.join(first.select("part", "lead").distinct().withColumnRenamed("lead", "doc_id"), ["part", "doc_id"])
    leads = keep(leads, "similar-leads")
    room = leads.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum(F.length("shingles")) / BYTES)).cast("long").alias("room"))
    leads = leads.join(bounded(room), "part").withColumn("b", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("room")))
    second = clustered(leads, ("part", "b"), similarity)
    links = first.select("part", "doc_id", "lead").unionByName(second)
    now = keep(links.where("doc_id <> lead"), "similar-found")
    label = keep(connected_components(now, "doc_id", "lead").withColumnRenamed("node", "doc_id"), "similar-labels")
    named = many.join(label, "doc_id", "left").withColumn("lead", F.coalesce("component", "lead")).drop("component", "b")
    open_ = keep(named.groupBy("part").agg(F.countDistinct("lead").alias("c")).where("c > 1").select("part"), "similar-open")
    pairs = named.join(bounded(open_), "part", "left_semi").withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    pairs = pairs.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("part", "doc_id", "shingles", "lead", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    third = clustered(pairs, ("part", "i", "j"), similarity).select("part", "doc_id", "lead").where("doc_id <> lead")
    found = connected_components(now.unionByName(third), "doc_id", "lead")
    return small.unionByName(found)


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with a number _key of each distinct pair of doc_id and text: the doc_id, but where an id has several texts all of them but one get numbers above all ids."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pairs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.md5(text).alias("_md5"))
    clashing = keep(pairs.groupBy("_id").agg(F.min("_md5").alias("_first"), F.max("_md5").alias("_last")).where("_first <> _last"), "similar-clashes")
    if clashing.isEmpty():
        return docs.withColumn("_key", F.col("doc_id").cast("long"))
    most = pairs.agg(F.max("_id")).first()[0]
    more = pairs.join(bounded(clashing), "_id").where("_md5 <> _first").select("_id", "_md5").distinct()
    more = keep(more.withColumn("_more", F.monotonically_increasing_id() + F.lit(most + 1)), "similar-keys")
    rows = docs.withColumns({"_own": F.col("doc_id").cast("long"), "_body": F.md5(text)})
    rows = rows.join(bounded(more), (rows["_own"] == more["_id"]) & (rows["_body"] == more["_md5"]), "left")
    return rows.select(*[docs[c] for c in docs.columns], F.coalesce("_more", "_own").alias("_key"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = RECALL, exact: bool = True) -> DataFrame:
    """The rows of ``docs`` without near copies: of documents that links connect, the one with the smallest id stays.

    Documents link if their sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more, which is tested exactly. ``recall`` is the
    chance that the index brings together two documents at the threshold (closer ones meet more surely); with ``exact`` documents also meet under
    the first of their shingles, which similar pairs cannot miss, at the cost of shuffling a fifth of all shingles. Texts without words and rows
    without id stay as they are. A document is a pair of id and text: rows that repeat both are one, those that share an id alone are
    several, of which all but one count as larger than all ids. Very long texts are read whole; an empty table gives an empty table; other columns, of whatever names, are kept.
    """
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    keyed = with_keys(whole)
    usable = keyed.where(F.col("_key").isNotNull() & F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(F.col("_key").alias("doc_id"), "text")
    fps = keep(fingerprints(usable, words), "similar-rows")
    n = fps.count()
    links = close_links(fps, n, similarity, recall)
    if exact:
        links = links.unionByName(rare_links(usable, fps, n, words, similarity))
    near = keep(connected_components(links.where("src <> dst").distinct()).select(F.col("node").alias("doc_id"), F.col("component").alias("part")), "similar-near")
    sets = shingle_sets(usable.join(bounded(near.select("doc_id")), "doc_id", "left_semi"), words)
    labels = classes(near, sets.groupBy("doc_id").agg(F.min("shingles").alias("shingles")), similarity)
    gone = keep(labels.where("node <> component").select(F.col("node").alias("_gone")), "similar-gone")
    return keyed.join(bounded(gone), keyed["_key"] == gone["_gone"], "left_anti").select("row.*")
