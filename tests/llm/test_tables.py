"""Operators over whole tables (dedup, mixing, search, SimHash, classifiers, the pipeline) against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from geoexposure.llm import exact_dedup, mixing, quality, similar, simhash, topk, toxicity
from geoexposure.llm import queries as text_queries
from geoexposure.llm.queries import tokenizer_path


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(text_queries.oracle_sql()))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = text_queries.queries()[name](spark, sf_dir)
    found = con.execute(f"SELECT * FROM ({text_queries.oracle_sql()[name]}) q")
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda r: repr([round(v, 9) if isinstance(v, float) else v for v in r])
    assert sorted(map(plain, found.fetchall())) == sorted(map(plain, df.select(*names).collect()))


@pytest.mark.parametrize("capacity", [2, 4096])
def test_exact_dedup(edge_docs, no_docs, documents, capacity):
    for docs in (edge_docs, documents):
        groups = defaultdict(list)
        for i, t in texts_of(docs):
            groups[t].append(i)
        rows = exact_dedup.duplicates(docs, capacity, 6).collect()
        assert len(rows) == docs.count()
        sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        kept = Counter()
        for r in rows:
            ids = sha[r.text_sha256]
            assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
            assert not r.kept or r.doc_id == r.keep_id
            kept[r.text_sha256] += r.kept
        assert set(kept.values()) == {1}
        stay = exact_dedup.deduplicated(docs)
        assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_dedup.duplicates(no_docs).count() == 0 and exact_dedup.deduplicated(no_docs).count() == 0


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    """Keys that share their first 50 bits and more split as well."""
    keys = spark.range(500).selectExpr("cast(id as long) * 3 AS _key").unionByName(spark.range(200).selectExpr("xxhash64(id) AS _key")).distinct()
    known = exact_dedup.directory(keys.withColumn("n", F.lit(100)), capacity=20, bits=10)
    held, depths = Counter(), set()
    entries = {(level, r._prefix % 2**64): r for level, table in known for r in table.collect()}
    for r in keys.collect():
        key = r._key % 2**64
        (bucket,) = [e for level, _ in known if (e := entries.get((level, key >> (64 - level))))]
        held[bucket._bucket] += 1
        depths.add(bucket._depth)
        assert key >> (64 - bucket._depth) == (bucket._bucket % 2**64) >> (64 - bucket._depth) and 1 <= bucket._owners <= 25
    assert max(held.values()) <= 20 and len(depths) > 1 and max(depths) > 50


def test_exact_dedup_reads_its_directory(spark, documents):
    """The result comes through the directory: without one of its entries keys are lost, with an entry twice rows count twice."""
    known = exact_dedup.directory_of(documents, 16)
    want = sorted(map(tuple, exact_dedup.duplicates(documents, known=known).collect()))
    assert want == sorted(map(tuple, exact_dedup.duplicates(documents).collect())) and len(want) == documents.count()
    (level, table), *rest = known
    taken = table.orderBy("_prefix").first()._prefix
    with pytest.raises(Exception, match="outside the directory"):
        exact_dedup.duplicates(documents, known=[(level, table.where(f"_prefix <> {taken}")), *rest]).collect()
    assert exact_dedup.duplicates(documents, known=[(level, table.unionByName(table)), *rest]).count() > len(want)


def test_exact_dedup_of_many_equal_rows(spark):
    """Rows without id that all have one text, dealt over partitions: one stays, and owners share the bucket."""
    docs = spark.range(3000, numPartitions=7).selectExpr("CAST(NULL AS LONG) AS doc_id", "IF(id % 3 = 0, 'other ' || id, 'same text') AS text")
    known = exact_dedup.directory_of(docs, 64)
    assert max(r._owners for _, t in known for r in t.collect()) > 4
    rows = exact_dedup.duplicates(docs, known=known).collect()
    assert len(rows) == 3000 and sum(r.kept for r in rows) == 1001 and Counter(r.group_size for r in rows) == {1: 1000, 2000: 2000}
    assert exact_dedup.deduplicated(docs).count() == 1001


def test_mixing(edge_docs, no_docs, documents):
    for docs in (edge_docs, documents):
        rows = mixing.mixed_report(docs).collect()
        assert len(rows) == docs.count()
        source = {(r.doc_id, r.source) for r in docs.select("doc_id", "source").collect()}
        sizes = Counter()
        for r in docs.select("source", "text").collect():
            sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
        target, free = {}, set(names)
        while True:
            left, w = total - sum(target.values()), sum(weights[s] for s in free)
            over = {s for s in free if left * weights[s] / w > 3 * sizes[s]}
            if not over:
                target |= {s: left * weights[s] / w for s in free}
                break
            target |= {s: 3 * sizes[s] for s in over}
            free -= over
        taken = Counter()
        by_size = {(r.source_size, round(r.target, 6)) for r in rows}
        assert by_size == {(sizes[s], round(target[s], 6)) for s in names}
        for r in rows:
            assert 0 <= r.taken <= 3 * r.size and 0 <= r.position <= 1
            taken[(r.source_size, round(r.target, 6))] += r.taken
        for (size, t), n in taken.items():
            assert n == pytest.approx(t * sum(1 for s in names if (sizes[s], round(target[s], 6)) == (size, t)), abs=len(names))
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed_report(docs).collect()))
        mixed = mixing.mixed_rows(docs)
        assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows if r.copies > 0) and source
    assert mixing.mixed_report(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0


def test_topk(spark):
    draws = np.random.default_rng(1)
    vectors = draws.normal(size=(700, 8)).round(2)
    vectors[100:300] = vectors[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(700, None), (None, [1.0] * 8), (701, [1.0, None] * 4), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (5, rows[5][1]), (750, [1.5] * 8)]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS v")
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in [*rows, (750, [1.5] * 8)]}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    for blocks in ((4096, 1024), (64, 4)):
        got = topk.top_k(topk.whole_vectors(table), "vec_id % 50 = 0", 5, pivots=7, row_block=blocks[0], query_block=blocks[1]).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(topk.whole_vectors(table.where("false")), "vec_id % 50 = 0").count() == 0


def test_topk_leaves_out_blocks_of_clustered_vectors(spark):
    """On clustered vectors most pairs of blocks never meet, and of those that do few candidates are evaluated; the result stays exact."""
    draws = np.random.default_rng(2)
    centres = draws.normal(size=(16, 32)) * 4
    vectors = np.repeat(centres, 250, 0) + draws.normal(size=(4000, 32)) * 0.05
    vectors *= 4 / np.linalg.norm(vectors, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = topk.whole_vectors(table)
    cut, blocks = topk.blocks_of(whole, 32, 100)
    asked = cut.where("vec_id % 50 = 0").selectExpr("*", "CAST(vec_id DIV 1000 AS INT) AS qb", "CAST(round(n * 0.99) AS LONG) AS least")
    met = topk.active_blocks(cut, asked, blocks, 4).count()
    assert blocks == 40 and 4 <= met < 4 * 40 / 2
    one = cut.toPandas()
    found, evaluated = topk.search_block(one[one.vec_id % 50 == 0].assign(least=-(1 << 62)), one, 5)
    assert len(found) == 400 and evaluated < 0.2 * 80 * 4000
    v = np.floor(256 * vectors).astype(int)
    want = {(q, k, i, -s) for q in range(0, 4000, 50) for k, (s, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in range(4000) if i != q)[:5], 1)}
    assert set(map(tuple, topk.top_k(whole, "vec_id % 50 = 0", 5, pivots=32, row_block=250, query_block=20).collect())) == want


def brute_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] * bool(w)
    counts = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(runs))


def test_simhash(edge_docs, no_docs, documents):
    for docs in (edge_docs, documents):
        texts = [(i, t) for i, t in texts_of(docs)]
        fp = {t: brute_fingerprint(t) for _, t in texts}
        values = sorted(set(fp.values()))
        label = components([(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 3], values)
        smallest = {}
        for i, t in texts:
            if i is not None:
                k = label[fp[t]]
                smallest[k] = min(smallest.get(k, i), i)
        want = Counter((i, f"{fp[t]:016x}", smallest.get(label[fp[t]])) for i, t in texts)
        assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_close_fingerprints_in_blocks_and_nodes(spark, monkeypatch):
    draws = np.random.default_rng(2)
    base = draws.integers(0, 2**63, 40, dtype=np.int64).tolist()
    values = set(base)
    for b in base[:6]:
        for _ in range(60):
            values.add(b ^ sum(1 << int(k) for k in draws.choice(63, int(draws.integers(1, 6)), replace=False)))
    values = sorted(values)
    want = components([(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 3], values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for block in (8, 4096):
        monkeypatch.setattr(simhash.split_roots, "__defaults__", (block,))
        edges = [tuple(r) for r in simhash.close_fingerprints(df, 3).collect()]
        assert all((a, b) == (a, b) and want[a] == want[b] for a, b in edges)
        assert components(edges, values) == want


def test_gray_index_finds_all_pairs():
    draws = np.random.default_rng(3)
    fps = draws.integers(0, 2**64, 900, dtype=np.uint64)
    fps[300:600] = fps[0] ^ (np.uint64(1) << draws.integers(0, 64, 300).astype(np.uint64))
    fps = np.sort(fps)[:, None]
    got = set()
    for a, b in simhash.GrayIndex(fps).close(fps, 3):
        got |= set(zip(a.tolist(), b.tolist(), strict=True))
    far = np.bitwise_count(fps[:, None, 0] ^ fps[None, :, 0])
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(far <= 3)), strict=True))


def test_one_of_each(edge_docs, no_docs, spark):
    rnd = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, near = [], []
    for g in range(40):
        words = rnd.choice(vocabulary, 200).tolist()
        rows.append((10 * g, " ".join(words)))
        for k in range(1, 4):
            other = list(words)
            for at in rnd.choice(200, 2 if g % 2 else 60, replace=False):
                other[at] = "changed"
            rows.append((10 * g + k, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(simhash.features(t, 5)) for i, t in rows}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if a // 10 == b // 10 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {i for i, c in components(near, sets).items() if i == c}
    got = {r.doc_id for r in similar.one_of_each(docs).collect()}
    assert want <= got and len(got - want) <= 0.05 * len(sets)
    stay = similar.one_of_each(edge_docs)
    assert stay.columns == edge_docs.columns
    assert {r.doc_id for r in stay.select("doc_id").collect()} >= {0, 1, 2, 3, 4, 5, 6, 8, 10, None, 100}
    assert similar.one_of_each(no_docs).count() == 0


def test_one_of_each_finds_all_links(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    # Copies with a passage appended, whose new words make their wide fingerprints differ.
    for g in range(60):
        words = rnd.choice(vocabulary, 200).tolist()
        texts += [words, words + rnd.choice(vocabulary, 44).tolist()]
    # Texts of the same words in other orders, which are alike in words only, and near copies of each by another order of its end.
    base = rnd.choice(vocabulary, 120, replace=False).tolist()
    for g in range(70):
        words = rnd.permutation(base).tolist()
        texts += [words, words[:-14] + words[:-15:-1]]
    # Texts with a common passage that takes up a part of them just below and just above the limit.
    head = rnd.choice(vocabulary, 150).tolist()
    texts += [head + rnd.choice(vocabulary, 14 + g % 12).tolist() for g in range(80)]
    rows = [(int(i), " ".join(t)) for i, t in zip(rnd.permutation(len(texts)), texts, strict=True)]
    sets = {i: set(simhash.features(t, 5)) for i, t in rows}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {i for i, c in components(near, sets).items() if i == c}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in similar.one_of_each(docs).collect()} == want
    # Also where the first candidates find nothing and large shingles are split into blocks, and where large neighbourhoods are.
    monkeypatch.setattr(similar, "close_links", lambda *_: spark.createDataFrame([], "src long, dst long"))
    monkeypatch.setattr(simhash.split_roots, "__defaults__", (40,))
    assert {r.doc_id for r in similar.one_of_each(docs).collect()} == want
    monkeypatch.setattr(similar, "MEMBERS", 24)
    assert {r.doc_id for r in similar.one_of_each(docs).collect()} == want


def test_recall_of_the_index_and_of_the_exact_form(spark):
    """5,000 rows: copies with edits and with appended passages around the threshold, and a group of 1,300 near copies; against brute force."""
    rnd = np.random.default_rng(6)
    vocabulary = np.array([f"w{k}" for k in range(6000)])
    texts, group = [], []
    for g in range(925):
        words = rnd.choice(vocabulary, int(rnd.integers(40, 400)))
        texts.append(words)
        for k in range(3):
            other = words.copy()
            if k:
                at = rnd.choice(len(words), max(1, int(len(words) * rnd.uniform(0.0, 0.03))), replace=False)
                other[at] = "changed"
            else:
                other = np.concatenate([words, rnd.choice(vocabulary, int(len(words) * rnd.uniform(0.1, 0.3)))])
            texts.append(other)
        group += [g] * 4
    words = rnd.choice(vocabulary, 300)
    for k in range(1300):
        other = words.copy()
        other[rnd.choice(300, 3, replace=False)] = f"own{k}"
        texts.append(other)
    group += [-1] * 1300
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: set(simhash.features(t, 5)) for i, t in rows}
    near = []
    for g, own in itertools.groupby(range(len(rows)), key=lambda i: group[i]):
        for a, b in itertools.combinations(own, 2) if g >= 0 else ((3700, i) for i in range(3701, 5000)):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                near.append((a, b))
    want = components(near, sets)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    stay = {r.doc_id for r in similar.one_of_each(docs).select("doc_id").collect()}
    assert stay == {i for i, c in want.items() if i == c} and sum(i >= 3700 for i in stay) == 1
    fast = {r.doc_id for r in similar.one_of_each(docs, exact=False).select("doc_id").collect()}
    gone = {i for i, c in want.items() if i != c}
    small = {i for i in gone if i < 3700}
    print("recall", len(small - fast) / len(small), "of", len(small))
    assert len(small - fast) >= 0.95 * len(small) and stay <= fast and sum(i >= 3700 for i in fast) == 1


def test_quality(edge_docs, no_docs, labels, no_labels, spark, sf_dir):
    rows = quality.score(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert {r.score for r in quality.score(edge_docs, no_labels).collect()} == {0.5}
    assert quality.score(no_docs, labels).count() == 0
    big = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    scored = quality.score(spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet"))
    held = [r for r in scored.collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.9


def test_toxicity(edge_docs, no_docs, labels, no_labels, spark, sf_dir):
    rows = toxicity.score(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r._severity <= 2 and r._grade in (0, 1, 2) for r in rows)
    assert not any(r._toxic for r in toxicity.score(edge_docs, no_labels).collect())
    assert toxicity.score(no_docs, labels).count() == 0
    assert toxicity.clean(edge_docs, no_labels).columns == edge_docs.columns and toxicity.clean(edge_docs, no_labels).count() == edge_docs.count()
    big = sf_dir.replace("sf0.001", "sf0.1")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    scored = toxicity.score(spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")).collect()
    held = [(r._toxic, truth[r.doc_id], r._severity) for r in scored if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([t for t, y, _ in held if y]) >= 0.85 and np.mean([t for t, y, _ in held if not y]) <= 0.01
    assert np.mean([s for _, y, s in held if y]) > 1 > np.mean([s for _, y, s in held if not y])


def brute_toxic_features(text):
    """Bins and values of one text, word by word."""
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    counts = {}
    for w in words:
        low = w.lower()
        while low and not low[0].isalnum():
            low = low[1:]
        while low and not low[-1].isalnum():
            low = low[:-1]
        for f in ["=" + low, *(low[:n] for n in (4, 5, 6, 7) if len(low) >= n)] if low else []:
            b = xxhash.xxh64_intdigest(f) >> 44
            counts[b] = counts.get(b, 0) + 1
    return {b: math.log1p(n * 200 / max(200, len(words))) for b, n in counts.items()}


def test_toxicity_scores_equal_brute_force(spark, edge_docs, monkeypatch):
    draws = np.random.default_rng(7)
    weights, cuts = np.where(draws.random(1 << 20) < 0.5, draws.normal(0, 0.3, 1 << 20), 0.0).astype(np.float32), np.array([0.5, 1.5])
    monkeypatch.setattr(toxicity, "fit", lambda *_: (weights, cuts))
    rows = toxicity.score(edge_docs, None, ("doc_id", "text")).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        x = sum(float(weights[b]) * v for b, v in brute_toxic_features(r.text).items())
        above = [1 / (1 + math.exp(-(x - c))) for c in cuts]
        chances = [1 - above[0], above[0] - above[1], above[1]]
        assert r._severity == pytest.approx(sum(above)) and r._p_toxic == pytest.approx(above[0]) and chances[r._grade] == pytest.approx(max(chances))
        assert r._toxic == (r._p_toxic >= toxicity.TOXIC)


def test_quality_scores_equal_brute_force(spark, edge_docs, monkeypatch):
    from geoexposure.llm.features import _shape, plain_word

    draws = np.random.default_rng(8)
    weights, bias = draws.normal(0, 0.3, 1 << 18).astype(np.float32), -0.2
    monkeypatch.setattr(quality, "fit", lambda *_: (weights, bias))
    full, mixers = 2**64 - 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    turned = lambda h: ((h << 17) | (h >> 47)) & full
    weight = lambda h, salt: float(weights[((((h ^ (h >> 29)) * mixers[salt % 3]) + salt) & full) >> 46])
    texts = ["one two two three", "Three more, please!", "a a a", "", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in quality.score(docs, None).collect():
        words = texts[r.doc_id].split()
        total = 0.0
        for k, w in enumerate(words):
            for kind, salts in ((plain_word, (3, 4)), (_shape, (5, 6))):
                seed = 0 if kind is plain_word else 1
                own = [xxhash.xxh64_intdigest(kind(v), seed) for v in words[k : k + 2]]
                repeats = k > 0 and xxhash.xxh64_intdigest(plain_word(words[k - 1])) == xxhash.xxh64_intdigest(plain_word(w))
                total += weight(own[0], salts[0])
                total += weight(1 + seed if repeats else ((own[0] * mixers[1]) & full) ^ turned(own[1] if len(own) > 1 else 0), salts[1])
        assert r.score == pytest.approx(1 / (1 + math.exp(-(8.0 * total / max(1, len(words)) + bias))))


def test_thresholds_are_ordered():
    draws = np.random.default_rng(5)
    at = draws.integers(0, 50, 4000)
    offsets = np.arange(0, 4001, 10)
    y = (np.add.reduceat(at < 10, offsets[:-1]) // 2).clip(0, 2)
    w, cuts = toxicity.learn(at, np.ones(4000), offsets, y)
    assert cuts[0] < cuts[1] and w[:10].mean() > w[10:50].mean()


def test_pipeline(spark, sf_dir, edge_docs, no_docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "sentencepiece"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.where("NOT round_trip OR NOT same_ids").count() == 0
    for docs in (edge_docs, no_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            done = stage(spark, docs, sf_dir)
            assert k == 4 or done.columns == docs.columns
            assert done.count() <= 3 * docs.count()


def test_pipeline_equals_brute_force(spark, sf_dir):
    """Every stage but the mix's order in plain Python, over whole tables."""
    import corpus_pipeline
    import sentencepiece

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, labels).collect() if r._toxic}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id not in toxic}
    last = {rows[i].text or "": i for i in sorted(rows)}
    rows = {i: rows[i] for i in last.values()}
    sets = {i: set(simhash.features(r.text or "", 5)) for i, r in rows.items()}
    sets = {i: s for i, s in sets.items() if s}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    gone = {i for i, c in components(near, sets).items() if i != c}
    rows = {i: r for i, r in rows.items() if i not in gone}
    copies = {r.doc_id: r.copies for r in mixing.mixed_report(spark.createDataFrame(list(rows.values()), docs.schema)).collect() if r.copies}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == Counter(copies) and gone and toxic
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert all(list(r.ids) == model.encode(rows[r.doc_id].text or "") for r in out)


def test_arrow_slices_are_whole():
    from geoexposure.llm.shared import Words, slices

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a b", None, "ccc " * 50, "d", " x\ty "] * 30)})
    parts = list(slices(iter([batch]), limit=100))
    assert sum(p.num_rows for p in parts) == 150 and len(parts) > 10
    words = Words(pa.array(["a b", "", "  x\t y\v", " "]))
    assert words.counts.tolist() == [2, 0, 2, 0] and [words.values[c].as_py() for c in words.codes] == ["a", "b", "x", "y"]
