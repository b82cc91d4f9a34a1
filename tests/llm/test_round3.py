"""HTML extraction, vector codes and ranked search against plain Python, and what the near-copy stage does with clashing ids and short texts."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoexposure.llm import html_text, ranked, similar, vector_codes

SIDE = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">All the news</a></li></ul></nav><div class="ad">Buy now, only today.</div>'
FOOT = "<footer>&copy; 2020 example &middot; all rights</footer><aside>Read more</aside>"
WORDS = "a long paragraph of plain words that goes on for a while, so that it is dense enough to be found"
PAGES = {
    "article": (f"<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{SIDE}<article><h1>Head &amp; tail</h1><p><b>{WORDS}<br>more<p>{WORDS}  again\n</p></article>{FOOT}</body></html>", f"Head & tail\n{WORDS} more\n{WORDS} again"),
    "no end tags": (f"<html><body>{SIDE}<article><h1>One</h1><p>{WORDS}<p>short<p><i>{WORDS}</i>", f"One\n{WORDS}\nshort\n{WORDS}"),
    "sections": (f"<body>{SIDE}<div id=main><div class=part><h2>A</h2><p>{WORDS}</p><p>{WORDS}</p></div><div class=part><h2>B</h2><p>Few words.</p></div></div><div class='comments'><p>{WORDS}</p><p>{WORDS}</p><p>{WORDS}</p><p>{WORDS}</p><p>{WORDS}</p></div>{FOOT}</body>", f"A\n{WORDS}\n{WORDS}\nB\nFew words."),
    "forms and notices": (f"<body><div class='cookie-notice'><p>{WORDS}</p></div><main><p>{WORDS}</p><form><p>Sign up</p></form><ul><li>one<li>two <b>bold</b></ul><table><tr><td>x<td>y</table></main></body>", f"{WORDS}\none\ntwo bold\nx\ny"),
    "comment articles": (f"<article><p>{WORDS}</p><section class=comments><article class=comment><p>{WORDS}</p></article></section></article>", WORDS),
    "header": (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{WORDS}</p></article>", f"Title\n{WORDS}"),
    "plain": ("just text &lt;here&gt;", "just text <here>"),
    "nothing": ("<html><body><nav><a href=x>menu</a></nav><script>x()</script></body></html>", ""),
    "unknown marks": (f"<![foo bar]><p>{WORDS}</p><![CDATA[x]]><hidden-thing>q</hidden-thing>", f"{WORDS}\nq"),
    "named all wrong": (f"<div class=sidebar><p>{WORDS}</p></div>", WORDS),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, want = PAGES[name]
    assert html_text.main_text(html) == want


def test_composite_density_follows_its_formula():
    c, t, lc, lt, share = 300, 12, 40, 3, 0.2
    want = c / t * math.log((c / lc) * (t / lt), math.log(c / (c - lc) * lc + share * c + math.e))
    assert html_text.density(c, t, lc, lt, share) == pytest.approx(want)
    assert html_text.density(0, 3, 0, 0, 0.0) == 0 and html_text.density(90, 3, 0, 0, 0.0) == 30


def test_pages(spark, sf_dir):
    """Every given page: the blocks of its article, read by plain patterns."""
    import html as entities

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_text.extracted(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        blocks = re.split(r"</?(?:p|h\d)>", re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]).replace("<br>", " "))
        want = "\n".join(x for b in blocks if (x := " ".join(entities.unescape(b).split())))
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</p>" * 3000
    rows = [(1, "u", None), (2, None, ""), (None, "v", PAGES["article"][0]), (3, "u", deep), (3, "u", deep), (4, "w", "<" * 5000), (5, "x", "<p>" + "word " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    got = [tuple(r) for r in html_text.extracted(df).collect()]
    assert Counter((p, u, n) for p, u, _, n in got) == Counter([(1, "u", 0), (2, None, 0), (None, "v", len(PAGES["article"][1])), (3, "u", 4), (3, "u", 4), (4, "w", 5000), (5, "x", 999_999)])
    assert html_text.extracted(df.where("false")).count() == 0


def plain_codes(rows, parts, entries, rounds):
    """Codes and errors by comparing each part with all entries."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v in kept) // parts)
    whole = {k: [[math.floor(256 * x) for x in v] + [0] * (parts * width - len(v)) for _, v in kept][k] for k in range(len(kept))}
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k]))[:entries]
    books = [[cut(whole[k], p) for k in order] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((gap(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for v in whole.values():
                met.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [tuple(sum(c) // len(met[i]) for c in zip(*met[i], strict=True)) if i in met else e for i, e in enumerate(books[p])]
    found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for v in whole.values()]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return [(i, "".join(f"{c:02x}" for _, c in f), sum(g for g, _ in f)) for (i, _), f in zip(kept, found, strict=True)], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("parts", "width", "n"), [(4, 8, 300), (4, 6, 30), (2, 12, 200), (16, 16, 5)])
def test_vector_codes(spark, parts, width, n):
    draws = np.random.default_rng(width)
    rows = [(i, [float(x) for x in draws.normal(size=width).round(1)], i % 3 if i % 4 else None) for i in range(n)]
    rows += [(3, rows[3][1], 1), (3, rows[0][1], 7), (None, rows[1][1], None), (900, None, 1), (901, [1.0, None] * (width // 2), 1), (902, [float("nan")] * width, 1), (903, [float("inf")] * width, 2), (904, [2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"code": F.lit(1), "v": F.lit(2), "_label": F.lit(3)}).repartition(5)
    got = vector_codes.compressed(df, parts, 16, 2).collect()
    want, sha = plain_codes([(i, v) for i, v, _ in rows], parts, 16, 2)
    assert Counter((r.vec_id, r.code, r.error) for r in got) == Counter(want) and {r.codebooks_sha256 for r in got} == {sha}
    label, errors = {id(v): x for _, v, x in rows}, Counter()
    for i, v, x in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            errors[x] += next(e for (j, _, e), (k, u) in zip(want, [(a, b) for a, b, _ in rows if b is not None and all(c is not None and math.isfinite(c) for c in b)], strict=True) if u is v and j == i)
    assert label and {r.label_error for r in got} == set(errors.values())
    assert vector_codes.compressed(df.where("false"), parts).count() == 0


def test_trie_equals_all_comparisons_and_shares_prefixes():
    draws = np.random.default_rng(2)
    leaves = np.unique(draws.integers(-4, 4, (9000, 5)), axis=0)
    book = draws.integers(-4, 4, (64, 5))
    gaps = ((leaves[:, None] - book[None]) ** 2).sum(2)
    for nodes in (7, 100, vector_codes.NODES):
        old, vector_codes.NODES = vector_codes.NODES, nodes
        trie = vector_codes.Trie(leaves, book)
        vector_codes.NODES = old
        assert (trie.code == gaps.argmin(1)).all() and (trie.gap == gaps.min(1)).all()
    assert trie.evaluated < 0.4 * leaves.size


def plain_ranking(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(cut(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, b in bags:
            m = 10 + 90 * b.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("pairs", [ranked.PAIRS, 8])
def test_ranked(spark, edge_docs, no_docs, documents, sf_dir, pairs):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    odd = spark.createDataFrame([(1, "The SAME text, of several words"), (2, None), (3, "zzz unknown"), (1, "emoji ünïcödé 日本"), (None, "text word7"), (4, "")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    for docs, items in ((edge_docs, odd), (documents, benchmark) if pairs > 8 else (edge_docs, odd.limit(1))):
        got = [tuple(r) for r in ranked.ranked(docs, items, 10, pairs).collect()]
        want = plain_ranking([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.collect()], 10)
        assert Counter(got) == Counter(want) and want
    assert ranked.ranked(no_docs, odd, 10, pairs).count() == 0 and ranked.ranked(edge_docs, odd.where("false"), 10, pairs).count() == 0


def test_classes_hold_equal_bags_only(spark):
    """Copies and documents that differ in words outside the vocabulary make up one class; an equal bag in a longer text doesn't."""
    docs = spark.createDataFrame([(i, "alpha beta " + "x" * (i % 4 + 1)) for i in range(40)] + [(50, "alpha beta" + " y" * 30), (51, "alpha alpha beta z"), (52, "none")], "doc_id long, text string")
    bags = ranked.bags_of(docs, ["alpha", "beta"])
    members, classes = ranked.classes_of(bags, 43, bags.agg(F.sum("n")).first()[0])
    assert Counter((r.members, r.least) for r in classes.collect()) == Counter([(40, 0), (1, 50), (1, 51)]) and members.count() == 42
    items = spark.createDataFrame([(1, "Alpha")], "item_id long, text string")
    assert [(r.rank, r.doc_id) for r in ranked.ranked(docs, items, 5).orderBy("rank").collect()] == [(1, 51), (2, 0), (3, 1), (4, 2), (5, 3)]


def test_clashing_ids_lose_no_text(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    b = "quite another text that shares nothing at all with the first one and its copies, of about as many words in it"
    rows = [(1, a), (2, a.replace("twenty", "score")), (2, b), (3, "c d e f g h i j"), (3, "c d e f g h i j"), (2, b)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text) for r in similar.one_of_each(docs).collect())
    assert got == sorted([(1, a), (2, b), (2, b), (3, "c d e f g h i j"), (3, "c d e f g h i j")])


def test_links_do_not_depend_on_the_size_of_a_root():
    """Two fingerprints 26 bits apart in one word are linked in a root of 900 and in one of 1,100."""
    draws = np.random.default_rng(5)
    for n in (900, 1100):
        own = draws.integers(0, 2**63, (n, similar.WORDS), dtype=np.uint64)
        own[1] = own[0] ^ np.array([(1 << 26) - 1, 0, 0, 0], np.uint64)
        own = own[np.argsort(own[:, 0] ^ (own[:, 0] >> np.uint64(1)))]
        near = {(min(i, j), max(i, j)) for a, b in similar.close_members(own, similar.MOST) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i != j}
        want = {(i, j) for i in range(n) for j in np.flatnonzero(np.bitwise_count(own ^ own[i]).sum(1) <= similar.MOST).tolist() if i < j}
        assert near == want and len(want) == 1


def test_short_texts_at_the_threshold(spark):
    """Pairs of 8 and 9 words share four of five shingles: the exact form finds all; the index alone most."""
    words = [f"w{i}" for i in range(5000)]
    draws = np.random.default_rng(6)
    rows = []
    for k in range(200):
        t = [words[i] for i in draws.choice(5000, 9, replace=False)]
        rows += [(2 * k, " ".join(t[:8])), (2 * k + 1, " ".join(t))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in similar.one_of_each(docs).collect()} == set(range(0, 400, 2))
    assert 400 - similar.one_of_each(docs, exact=False).count() >= 160


def test_bitmaps_bound_what_differs():
    texts = pa.array(["a b c d e f g h i j", "a b c d e f g h i k", "", "x"])
    codes, ends = similar.shingle_codes(texts, 5)
    maps = similar.bitmaps(codes, ends, similar.WORDS)
    assert int(np.bitwise_count(maps[0] ^ maps[1]).sum()) <= 2 and not maps[2].any()
