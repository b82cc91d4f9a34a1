"""Operators that handle rows on their own (spans, codecs, counts, files) against brute force and the libraries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoexposure.llm import pii, sentencepiece_codec, token_counts, token_files
from geoexposure.llm.queries import tokenizer_path
from geoexposure.llm.token_words import TextEncoder

BPE, SP = "byte_bpe_50k.json", "piece_bpe_32k.model"
TRICKY = st.text(alphabet=st.sampled_from(list("ab1 '\n\t.re%é日😀 s")), max_size=40)


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(tokenizer_path(BPE))


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(tokenizer_path(BPE))


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(tokenizer_path(SP))


def plain_ids(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


def brute_spans(s):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_pii_spans():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("a1234.@ +-()59%") for _ in range(rnd.randint(0, 60))) for _ in range(20000)]
    texts += ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111 2", "0001.2.3.4", "+1 (017) 555-7713", "9" * 50000, "1." * 30000, "a" * 50000 + "@"]
    for t in texts[:-3] + ["x" + t for t in texts[:50]]:
        assert [(s.start, s.kind, s.end) for s in pii.find(t) if s.kind < 4] == brute_spans(t)
    # The three longest, whose answer is plain; the expressions of the brute force backtrack on them.
    nines, dots, sign = ([(s.start, s.kind, s.end) for s in pii.find(t) if s.kind < 4] for t in texts[-3:])
    assert nines == [] and sign == [] and dots == [(8 * i, 1, 8 * i + 7) for i in range(7500)]


def test_pii_added_kinds():
    assert [str(s) for s in pii.find("IBAN DE89 3704 0044 0532 0130 00 THE END")] == ["iban:5:32"]
    assert not [s for s in pii.find("DE88 3704 0044 0532 0130 00") if s.kind > 3]
    assert [str(s) for s in pii.find("my ssn 123-45-6789")] == ["ssn:7:18"] and pii.find("part 123-45-6789") == []
    assert pii.masked("mail a.b@c.de or 10.0.0.1") == "mail <email> or <ip>"
    assert pii.find("server 10.0.0.1")[0].score > pii.find("value 10.0.0.1")[0].score


def test_pii_query(edge_docs, no_docs):
    rows = pii.report(edge_docs).collect()
    assert len(rows) == edge_docs.count() and pii.report(no_docs).count() == 0
    one = {r.doc_id: r for r in rows}
    assert one[0].base_sha256 == hashlib.sha256(b"").hexdigest() and one[0].spans == ""
    assert (one[15].n_email, one[15].n_ip, one[15].n_card, one[15].n_phone) == (1, 1, 0, 1)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TRICKY, max_size=6))
def test_encoder_matches_the_library(encoder, texts):
    ids, counts = encoder.ids(pa.array(texts, pa.string()))
    want = [plain_ids(encoder, t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=300, deadline=None)
@given(text=TRICKY)
def test_prefix_table_is_exact(encoder, counter, text):
    assert counter.table(text).tolist() == [len(plain_ids(encoder, text[:k])) for k in range(len(text) + 1)]


@settings(max_examples=200, deadline=None)
@given(text=TRICKY, limit=st.integers(0, 12))
def test_counts_and_longest_prefix(encoder, counter, text, limit):
    totals, fits = counter.counts(pa.array([text], pa.string()), limit)
    assert totals[0] == len(plain_ids(encoder, text))
    assert fits[0] == max(k for k in range(len(text) + 1) if len(plain_ids(encoder, text[:k])) <= limit)


def test_counts_query(edge_docs, no_docs, encoder):
    path = tokenizer_path(BPE)
    texts = {r.doc_id: r.text or "" for r in edge_docs.select("doc_id", "text").collect()}
    for r in token_counts.report(edge_docs, path).collect():
        want = len(plain_ids(encoder, texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), want, want > 1024)
        assert r.fit_chars == len(texts[r.doc_id]) or r.over_limit and len(plain_ids(encoder, texts[r.doc_id][: r.fit_chars])) <= 1024 < len(plain_ids(encoder, texts[r.doc_id][: r.fit_chars + 1]))
    assert token_counts.report(no_docs, path).count() == 0


@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.one_of(TRICKY, st.sampled_from(["<|endoftext|>", "<|endo", "  <|endoftext|> "])), max_size=5))
def test_prefixes_of_texts_with_special_strings(encoder, counter, parts):
    text = "".join(parts)
    assert counter.table(text).tolist() == [len(plain_ids(encoder, text[:k])) for k in range(len(text) + 1)]


def test_budgets_from_one_stored_table(spark, edge_docs, encoder, monkeypatch):
    """Several budgets are answered from one table; afterwards no encoder is needed, and a text of many parts is cut within the right one."""
    path = tokenizer_path(BPE)
    long = "it's  a 日 text\n\nof many parts " * 700
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, long), (901, "a" * 9000), (902, long + "<|endoftext|> end")], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    table = token_counts.stored(docs, path)
    assert table.where("doc_id = 900").selectExpr("size(parts) AS n").first().n == -(-len(long) // token_counts.PART)
    monkeypatch.setattr(token_counts, "prefix_counter", None)
    size = lambda t: len(plain_ids(encoder, t))
    for limit in (0, 3, 2500, 5200, 10**6):
        for r in token_counts.within(table, limit).collect():
            t = texts[r.doc_id]
            assert (r.n_tokens, r.over_limit) == (size(t), size(t) > limit)
            assert size(t[: r.fit_chars]) <= limit and (r.fit_chars == len(t) if not r.over_limit else all(size(t[: r.fit_chars + k]) > limit for k in range(1, 4)))


def test_token_files(spark, edge_docs, no_docs, documents, encoder):
    path = tokenizer_path(BPE)
    assert token_files.round_trip(spark, no_docs, path).count() == 0
    for docs in (documents, edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
        got, at = {r.doc_id: r for r in token_files.round_trip(spark, docs, path).collect()}, 0
        assert len(got) == len(texts)
        for i, t in texts:
            ids = [*plain_ids(encoder, t), 0]
            assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4")))
            at += len(ids)
    assert token_files.round_trip(spark, edge_docs, path).count() == edge_docs.count()


def test_sequences_are_read_without_copies(tmp_path):
    ids = np.arange(3 * token_files.SEQUENCE * token_files.BATCH + 777) % 50000
    with pa.OSFile(str(tmp_path / "f"), "wb") as sink:
        w = token_files.SequenceWriter(sink, False)
        for part in np.array_split(ids, 11):
            w.add(part)
        w.close()
    with pa.memory_map(str(tmp_path / "f")) as source:
        r = token_files.SequenceReader(source)
        assert pa.ipc.open_file(source).schema == token_files.data_schema(False)
        for a, b in ((0, 10), (token_files.SEQUENCE * token_files.BATCH - 5, token_files.SEQUENCE * token_files.BATCH + 5), (0, len(ids))):
            parts = list(r.tokens(a, b))
            assert np.concatenate(parts).tolist() == ids[a:b].tolist() and not any(p.flags.owndata for p in parts)
        last = pa.ipc.open_file(source).get_batch(3)
        assert last.num_rows == 1 and last.column("mask").flatten().to_numpy(zero_copy_only=False).sum() == 777


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("ab1 ▁\n.é日😀<0x>s")), max_size=40), max_size=5))
def test_codec_matches_sentencepiece(codec, texts):
    found = codec.encode(pa.array(texts, pa.string()))
    want = codec.known.encode(texts)
    assert found["n_tokens"].tolist() == [len(w) for w in want] and found["ids"].tolist() == [i for w in want for i in w]
    assert found["decoded"].to_pylist() == [codec.known.decode(w) for w in want]
    assert [codec.decode(w) for w in want] == [codec.known.decode(w) for w in want]


def test_codec_forgets_texts_with_the_marker(codec):
    """Texts that hold the marker decode to others; 180,000 distinct ones are no failure and leave nothing behind."""
    for k in range(3):
        texts = pa.array([f"a▁{i} b" for i in range(60_000 * k, 60_000 * (k + 1))])
        found = codec.encode(texts)
        assert found["same"].all() and found["decoded"].to_pylist()[:2] == [f"a {60_000 * k + i} b" for i in (0, 1)]
        assert codec.pool.known.nbytes <= 2 * codec.pool.most and len(codec.pool.pool) < 10_000_000


def test_codec_of_a_unigram_model(tmp_path):
    """A small unigram file written here field by field is rebuilt like the library reads it."""
    import struct

    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    def piece(text, score, kind):
        return message(1, message(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(kind))

    pieces = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3)]
    pieces += [piece(t, -i, 1) for i, t in enumerate(["▁", "a", "b", "ab", "▁ab", "ba", "▁b", "abab"], 1)]
    trainer = message(2, varint(3 << 3) + varint(1))
    normalizer = message(3, message(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(1) + varint(5 << 3) + varint(1))
    (tmp_path / "m.model").write_bytes(b"".join(pieces) + trainer + normalizer)
    own, lib = sentencepiece_codec.Codec(str(tmp_path / "m.model")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    assert own.model.kind == sentencepiece_codec.UNIGRAM and not own.model.by_words
    texts = ["ab", "abab ba", "  b   a ", "", "aabb"]
    found = own.encode(pa.array(texts))
    assert found["ids"].tolist() == [i for t in texts for i in lib.encode(t)] and found["same"].all()


def test_rows_without_id_are_spread_over_files(spark, tmp_path, encoder):
    """A third of all rows has no id: no file holds much more than its share, and their order is by text still."""
    rnd = random.Random(4)
    rows = [(None if i % 3 == 0 else i, f"{rnd.random()} text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would make one file
    try:
        files = token_files.write(docs, tokenizer_path(BPE), f"file:{tmp_path}/f")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n_docs for r in files.collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 2 * 3000 / len(sizes) and len(sizes) > 2
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read(files, f"file:{tmp_path}/f").collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    assert [(d, n) for _, d, n in got] == [(d, len(plain_ids(encoder, t)) + 1) for d, t in want]


def test_codec_query(edge_docs, no_docs, codec):
    path = tokenizer_path(SP)
    texts = {r.doc_id: r.text or "" for r in edge_docs.select("doc_id", "text").collect()}
    for r in sentencepiece_codec.encoded(edge_docs, path).collect():
        assert list(r.ids) == codec.known.encode(texts[r.doc_id]) and r.same_ids
        assert r.round_trip == (codec.known.decode(list(r.ids)) == texts[r.doc_id])
    assert sentencepiece_codec.encoded(no_docs, path).count() == 0


def test_counter_refuses_other_files():
    with pytest.raises(ValueError, match="normaliser"):
        token_counts.PrefixCounter(tokenizer_path("word_bpe_49k.json"))
