"""Small cases of the training-data operators: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import base64
import hashlib
import itertools
import re
import struct
import zlib
from collections import Counter
from html import unescape

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from footscape.llm import bpe, dedup, hosts, html_extract, jaccard, knn, licenses, packing, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string"
LONG = " ".join(f"wörd{k % 997} x{k}," for k in range(6000)) + "y" * 3000
TEXTS = [None, "", " ", "Hello world", "hello WORLD", "HELLO world", "a  b\n\n c\t", LONG, LONG, "It's 3,14 — “naïve” 你好 😀", "x y \x1c z", "<|endoftext|> İstanbul ΣΑΣ"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, None, "s", 1, "extra", None) for k, t in enumerate(TEXTS)] + [(3, "Hello world", None, "s", 1, None, None), (None, "Hello world", None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_encoding_equals_library(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encode_documents(docs, path, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        t = TEXTS[r.doc_id] or "" if r.doc_id is not None else "Hello world"
        ids = enc.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_merges_in_an_order_that_is_not_that_of_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"ab": 301, b"abc": 256, b"aa": 302, b"aab": 257}
    enc = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    words = ["aabc", "abab", "aaab", "abcabc", "aaaa", "aabaab", "bcbcab", "aaabbbccc"]
    got = bpe.replay_merges([w.encode() for w in words], ranks, bpe.pair_ranks(ranks))
    assert got == [enc.encode_ordinary(w) for w in words]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vs = [(k, [float(x) for x in rng.normal(size=6)], "c") for k in range(400)]
    vs += [(400 + k, [0.5] * 6, "c") for k in range(200)]  # one vector many times: ties
    vs += [(1000, None, "c"), (1050, [None] * 6, "c"), (1100, [float("nan")] * 6, "c"), (1150, [float("inf")] * 6, "c"), (1200, [1.0, 2.0], "c"), (1201, [3.0, 1.0], "c")]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<float>, score string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.top_k(df, pivots=7, block_rows=60, query_rows=5).collect()}
    q = {k: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for k, v, _ in vs if v is not None and None not in v and np.isfinite(v).all()}
    want = {}
    for a in (k for k in q if k % 50 == 0):
        best = sorted((-int(q[a] @ q[b]), b) for b in q if b != a and len(q[b]) == len(q[a]))[:5]
        want |= {(a, n + 1): (b, -s) for n, (s, b) in enumerate(best)}
    assert got == want
    assert knn.top_k(df.limit(0)).count() == 0


def test_top_k_with_repeated_ids_equals_sql(spark):
    rng = np.random.default_rng(2)
    vs = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(1, 400) if k not in (50, 100)]
    vs += [(50, [2.0, 2.0, 2.0, 2.0])] * 130 + [(100, [float(x) for x in 3 + rng.normal(size=4)]) for _ in range(40)] + [(150, [0.0, 4.0, 0.0, -4.0])] * 6
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", vs)
    got = sorted(tuple(r) for r in knn.top_k(df, pivots=12, block_rows=60, query_rows=50).collect())
    assert got == sorted(con.sql(knn.ORACLE).fetchall())


PAGE = """<!doctype html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{}</style></head><body>
<div class="cookie notice">We use cookies</div><header><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a><li>News</ul></nav>
<article><h1>A &amp; B</h1><p>First  <b>bold</b>\n line.<br>Same block.<p>Second &lt;i&gt; block&hellip;<div class="share">Share this</div></article>
<aside class="sidebar"><p>Related things</p></aside><form><p>Sign up</p></form><section id="comments"><p>Nice post!</p></section><footer>&copy; Site</footer>"""


def test_page_extraction(spark):
    blocks = html_extract.blocks(PAGE)
    want = ["A & B", "First bold line. Same block.", "Second <i> block…"]
    assert [b.text for b, m in zip(blocks, html_extract.weak_labels(blocks)) if m] == want
    rows = [(k, "u", PAGE.replace("First", f"First {k}"), "x") for k in range(40)] + [(90, None, None, None), (91, "u", "", None), (92, "u", "<nav>Menu</nav><script>x", None), (92, "u", "<nav>Menu</nav><script>x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df, html_extract.fit(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "\n\n".join([want[0], want[1].replace("First", f"First {r.page_id}"), want[2]]) if r.page_id < 90 else ""
        assert (r.text, r.n_chars) == (text, len(text))
    assert html_extract.extract(df.limit(0), html_extract.fit(df.limit(0))).count() == 0


@pytest.mark.parametrize("inside,want", [
    ("<p>Let <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> hold.<p>End.", ["Let x=2 hold.", "End."]),
    ("<p>See <object data=a.pdf><p>the file</p></object><p>End.", ["See", "the file", "End."]),
    ("<p>Chart <svg viewBox='0 0'><path d=x /><g><text>of trees</text></g></svg> here.", ["Chart of trees here."]),
    ("<p>A <svg><path><p>B <math><mi>y<p>C <object>D<p>E", ["A", "B y", "C D", "E"]),
    ("<p>A <template>B<p>C <select>D<p>E <noscript>F", ["A", "B", "C", "D", "E", "F"]),
    ("<p>A <a title=don't href=/x>link</a> that's kept.<p>It isn't <b title='a>b' class=\"c>d\">lost</b>.", ["A link that's kept.", "It isn't lost."]),
    ("<p>A <a title=\"open>B<p>C", ["A B", "C"]),
    ("<p>A <svg><title>no</title><script>no</script></svg>B<script>no<p>no", ["A B"]),
])
def test_text_inside_the_article_stays(inside, want):
    assert [b.text for b in html_extract.blocks(f"<article>{inside}")] == want


def test_exact_texts_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = html_extract.extract(pages, html_extract.fit(pages)).collect()
    source = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == len(source)
    for r in rows:
        article = re.search("<article>(.*?)</article>", source[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split("</?(?:h1|p|ul|li|div)[^>]*>", article)]
        assert r.text == "\n\n".join(x for x in parts if x)


def test_page_sample_holds_one_row_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(html_extract, "train", lambda xs, ys, **_: seen.append(len(xs)))
    html_extract.fit(spark.createDataFrame([(1, f"<p>text {k}") for k in range(90)] + [(2, "<p>other")], "page_id long, html string"))
    assert seen == [4]  # two pages and a variant of each


def brute_components(rows, n, numer, denom):
    sets = {}
    for k, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets[k] = {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    of = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            o = len(sets[a] & sets[b])
            if a < b and o and denom * o >= numer * (len(sets[a]) + len(sets[b]) - o) and of[a] != of[b]:
                lo, hi = sorted((of[a], of[b]))
                of = {k: lo if v == hi else v for k, v in of.items()}
    return {k: (len(sets[k]), of[k]) for k in sets}


def test_jaccard_equals_brute_force(spark, empty):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(900)}"
    passage = [word() for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    for _ in range(12):
        base = [word() for _ in range(rng.integers(5, 120))]
        for _ in range(rng.integers(1, 9)):
            w = list(base)
            for _ in range(rng.integers(0, 5)):
                w[rng.integers(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, " ".join([*passage, *(word() for _ in range(rng.integers(0, 14)))])) for k in range(60)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, size string")
    for n, numer, denom, wide in ((4, 85, 100, 24), (4, 85, 100, 3), (5, 80, 100, 3)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df, n, numer, denom, wide).collect()}
        assert got == brute_components(rows, n, numer, denom)
    kept = {r.doc_id for r in jaccard.one_of_each(df).collect()}
    assert kept == {c for _, c in brute_components(rows, 4, 85, 100).values()}
    assert jaccard.components(empty).count() == 0


def test_jaccard_overlap_bounds():
    for a in range(1, 40):
        for b in range(1, 40):
            o = jaccard.least_overlap(a, b)
            assert 100 * o >= 85 * (a + b - o) and (o == 0 or 100 * (o - 1) < 85 * (a + b - o + 1))


def labelled(spark):
    rng = np.random.default_rng(5)
    plain, bad, rude = [f"word{k}" for k in range(60)], [f"@@{k}##" for k in range(9)], ["zorgish", "blurpy", "zorgs"]
    rows, labels = [], []
    for k in range(400):
        low, tox = k % 5 == 0, k % 3 == 0
        w = [plain[i] for i in rng.integers(60, size=40)]
        if low:
            w[::2] = [bad[i] for i in rng.integers(9, size=20)]
        if tox:
            w[int(rng.integers(40))] = rude[int(rng.integers(3))]
        rows.append((k, " ".join(w), "x"))
        labels.append((k, int(not low), int(tox)))
    rows += [(900, None, None), (901, "", None), (902, LONG, None), (902, LONG, None), (None, "word1", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(None, 1, 0), (900, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label,threshold", [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_classifiers_on_held_out_rows(spark, module, label, threshold):
    docs, labels = labelled(spark)
    rows = module.score_documents(docs, module.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 0
    blank = module.score_documents(docs.limit(0), module.fit(docs, labels.limit(0)))
    assert blank.count() == 0


def test_a_corpus_without_toxic_labels_is_kept_whole(spark):
    docs, labels = labelled(spark)
    for some in (labels.limit(0), labels.filter("toxic is null"), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        assert toxicity.keep_clean(docs, toxicity.fit(docs, some)).count() == docs.count()


def test_toxic_labels_in_one_part_of_the_folds_are_used(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    for fold in ("crc32(cast(doc_id as string)) % 5 <> 4", "crc32(cast(doc_id as string)) % 5 = 4"):
        rows = toxicity.score_documents(docs, toxicity.fit(docs, labels.filter(f"toxic = 0 or {fold}"))).filter("held_out").collect()
        held = [r for r in rows if r.doc_id in truth]
        assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held) > 0


def test_scale_sample_holds_both_classes_and_only_present_documents(spark):
    docs = spark.createDataFrame([(k, "t", "x") for k in range(300)] * 2, "doc_id long, text string, score string")
    present = spark.createDataFrame([(k, int(k in (7, 8, 9)), 4) for k in range(300)], "doc_id long, _label int, fold int")
    rows, size = toxicity.scale_sample(docs, present, (4,), 20)
    rows = rows.collect()
    assert len(rows) == 20 and {r["doc_id"] for r in rows if r["_label"]} == {7, 8, 9} and size == {0: 297, 1: 3}
    labels = spark.createDataFrame([(k, int(k % 2 == 0 or k >= 600)) for k in range(3000)], "doc_id long, toxic int")
    assert toxicity.keep_clean(docs.filter("doc_id % 2 = 1"), toxicity.fit(docs.filter("doc_id % 2 = 1"), labels)).count() == 300


def code_points(grams):
    return np.array(grams, "<U5").view("<u4").reshape(len(grams), 5)


def test_language_model_equals_one_of_exact_keys(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(rng.choice([97, 98, 99, 228, 0x4F60, 0x1F600])) for _ in range(rng.integers(1, 9)))
    counted = [(int(rng.integers(2)), w, int(rng.integers(1, 9))) for w in sorted({word() for _ in range(300)})]
    got = toxicity.gram_rows(spark.createDataFrame(counted, "toxic int, word string, n long")).collect()
    model = toxicity.tables(code_points([r.gram for r in got]), np.array([[r.ordinary, r.toxic] for r in got]))
    tail = lambda w, i, k: w[max(0, i + 1 - k):i + 1]
    n, ways = [Counter(), Counter()], [set() for _ in range(4)]
    for x, w, c in counted:
        w = f"^{w}$"
        for i in range(1, len(w)):
            n[x][tail(w, i, 5)] += c
            for k in range(4):
                ways[k].add((tail(w, i, k + 1), tail(w, i, k + 2)))
    assert {r.gram: (r.ordinary, r.toxic) for r in got} == {g: (n[0][g], n[1][g]) for g in {*n[0], *n[1]}}
    left = [Counter(g for g, _ in s) for s in ways]

    def ratio(w):
        w, out = f"^{w}$", 0.0
        for i in range(1, len(w)):
            p = toxicity.FLOOR
            for k in range(4):
                g = tail(w, i, k + 1)
                under = [v for h, v in left[k].items() if h[:-1] == g[:-1]]
                p = toxicity._smooth(left[k][g], sum(under), len(under), p, 0)
            g, logs = tail(w, i, 5), []
            for x in (0, 1):
                under = [v for h, v in n[x].items() if h[:-1] == g[:-1]]
                logs.append(np.log(toxicity._smooth(n[x][g], sum(under), len(under), p, toxicity.BACKOFF)))
            out += logs[1] - logs[0]
        return out

    words = [w for _, w, _ in counted[:60]] + [word() for _ in range(60)] + ["z", "ab" * 9]
    assert np.allclose(model.word_ratios(words), [ratio(w) for w in words])


def test_tables_of_the_language_model_grow_with_its_grams():
    letters = [chr(97 + k) for k in range(15)]
    grams = ["".join(g) for g in itertools.product(letters, repeat=5)]  # 759,375
    counts = np.column_stack([np.full(len(grams), 3), np.zeros(len(grams), int)])
    counts[::100_000] = 0, 50
    model = toxicity.tables(code_points(grams), counts)
    at = np.arange(0, len(grams), 50_000)
    digests = toxicity.gram_digests(np.array([[ord(c) for c in grams[k]] for k in at]))
    assert len(model.gram.keys) == len(grams) and (model.gram(digests) == counts[at]).all()


def test_samples_hold_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}", "x") for k in range(300)] + [(2, None, "x"), (3, "other", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0)], "doc_id long, quality int")
    rows = quality.labelled_sample(docs, labels, "quality", 10, (0, 1, 2, 3, 4)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["_label"]) for r in rows] == [(1, "text 0", 1), (2, "", 0), (3, "other", 1)]


def test_licenses_equal_brute_force(spark, empty):
    texts = [*TEXTS, "MIT License mit license", "The Apache License, Version 2.0; CC-BY-NC 4.0", "gnu\ngeneral.public:license v3 or later", "cc by cc by cc", "Licensed under the MIT License. " * 400, "smit license", "ämit license", "mit licenseé", "Permission is hereby granted, free of charge"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        at, found = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            at += here
            found |= {label} if here else set()
        r = got[k]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted(found)))
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert found <= set(r.labels.split(",")) | (set() if found else {""}) and 0 <= r.score <= 1
    assert got[len(TEXTS) + 1].labels == "apache,cc-by,cc-by-nc" and got[len(texts) - 1].labels == "permissive-text"
    assert licenses.scan(empty).count() == 0
    assert len(licenses.rules()) > 300


def test_urls(spark):
    urls = {1: "http://a.example.com/de/1", 2: "HTTP://A.Example.NET/en/x?q=/de/", 3: "https://b.net", 4: "https://b.net/", 5: "x.org/fr/", 6: None, 7: "http://x.org/fr/y#z", 8: "https://bad.example.org/1", 9: "https://notexample.com/de/", 10: "http://", 11: "https://good.example.org/2"}
    pages = spark.createDataFrame([(k, u, "x") for k, u in urls.items()], "page_id long, url string, rule string")
    outcomes = spark.createDataFrame([("bad.example.org", 1)] * 60 + [("good.example.org", 0)] * 60 + [(None, 1), ("good.example.org", None)], "host string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judged(pages, outcomes).collect()}
    assert got == {
        1: ("a.example.com", "/de/1", "example.com/de/", "block"), 2: ("a.example.net", "/en/x", "example.net/en/", "allow"), 3: ("b.net", "", None, "allow"), 4: ("b.net", "/", "net/", "block"), 5: ("", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("x.org", "/fr/y", "org/fr/", "allow"), 8: ("bad.example.org", "/1", None, "block"), 9: ("notexample.com", "/de/", None, "allow"), 10: ("", "", None, "allow"), 11: ("good.example.org", "/2", None, "allow")}
    rep = {r.host: r for r in hosts.reputations(outcomes).collect()}
    assert rep["bad.example.org"].lower > 0.8 and rep["good.example.org"].mean < 0.1
    assert hosts.judged(pages.limit(0), outcomes.limit(0)).count() == 0 and hosts.judged(pages, outcomes.limit(0)).count() == len(urls)


def test_hosts_without_outcomes_take_those_above_them(spark):
    outcomes = spark.createDataFrame([(f"{k}.spam.biz", 1) for k in range(20)] * 3 + [(f"{k}.fine.org", 0) for k in range(20)] * 3 + [("good.mixed.org", 0)] * 30 + [("bad.mixed.org", 1)] * 30, "host string, bad int")
    urls = {1: "http://new.spam.biz/1", 2: "http://spam.biz/1", 3: "http://other.biz/1", 4: "http://new.fine.org/1", 5: "http://new.mixed.org/", 6: "http://other.org/", 7: "http://x.unseen/", 8: None, 9: "http://3.spam.biz/"}
    pages = spark.createDataFrame(list(urls.items()) * 2, "page_id long, url string")
    rows = hosts.judged(pages, outcomes).collect()
    assert len(rows) == len(pages.collect())
    assert {r.page_id: r.verdict for r in rows} == {k: "block" if k in (1, 2, 3, 9) else "allow" for k in urls}
    assert all((r.lower is None) == (r.page_id == 8) for r in rows)


def test_exact_groups(spark, docs, empty):
    got = dedup.exact_groups(docs).collect()
    assert len(got) == len(TEXTS) + 2 and sum(r.kept for r in got) == len({(t or "").translate({c: c + 32 for c in range(65, 91)}) for t in TEXTS})
    hello = [r for r in got if r.group_size == 5]
    assert len(hello) == 5 and {r.keep_id for r in hello} == {5} and [r.doc_id for r in hello if r.kept] == [5]
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Same', concat('t', id div 2)) as text")
    rows = dedup.exact_groups(hot).toPandas()
    con = duckdb.connect()
    con.register("documents", hot.toPandas())
    want = con.sql(dedup.ORACLE).df()
    assert sorted(rows[want.columns].itertuples(index=False)) == sorted(want.itertuples(index=False))
    assert dedup.exact_groups(empty).count() == 0
    assert dedup.drop_copies(docs).columns == docs.columns


@pytest.mark.parametrize("share", [1 / 1000, 2])  # with and without heavy digests
def test_drop_copies_decides_by_row(spark, empty, share):
    rows = [(1, "twice"), (1, "TWICE"), (2, "a copy"), (2, "own text"), (3, "A copy"), (4, None), (None, ""), (None, "nameless"), (None, "Nameless"), (6, "alone")]
    rows += [(7, "hot")] * 40 + [(k % 7, "hot") for k in range(40)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, keep string")
    got = Counter((r.doc_id, (r.text or "").lower(), r.keep) for r in dedup.drop_copies(df, share=share).collect())
    want = [(1, "twice"), (2, "own text"), (3, "a copy"), (4, ""), (None, "nameless"), (6, "alone"), (7, "hot")]
    assert got == Counter((k, t, "x") for k, t in want)
    assert dedup.drop_copies(empty).count() == 0


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs.filter("doc_id is not null"), path, capacity=64, open_bins=4).collect()
    want = Counter()
    for k in [*range(len(TEXTS)), 3]:
        ids = tok.encode(TEXTS[k] or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 64)):
            part = ids[at:at + 64]
            want[k, p, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack_documents(empty, path).count() == 0


def test_best_fit_takes_the_fullest_and_closes_it_first():
    closed = []
    fit = packing.BestFit(10, 2, closed.append)
    for k, n in enumerate((6, 5, 4, 9, 8)):  # 4 fits best behind 6; for 8 the fullest open bin (9) is closed
        fit.add((k, n), n)
    assert closed == [[(0, 6), (2, 4)], [(3, 9)]] and sorted(map(tuple, fit.finish())) == [((1, 5),), ((4, 8),)]
