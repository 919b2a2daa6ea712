"""Runs, SimHash and manifest against brute force and SQL; rows that the pipeline's stages must not lose."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from test_llm_operators import brute_components

from footscape.llm import dedup, jaccard, manifest, packing, periodic, quality, simhash

ROW = "doc_id long, source string, lang string, n_chars long, text string, leaf string, runs string, fp string, _d string"
RUN = "the cat sat on " * 30


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda v: f"w{rng.randrange(v)}"
    texts = [None, "", "  \t", "one", "Two  words", RUN, RUN, "a " * 40, "a b " * 9 + "c", "x y z x y z x y z x y z x", "\x1c a \x1c a", "ÄÖ ß 你好 😀 " * 8]
    for _ in range(60):
        block = [word(rng.choice([2, 4, 30])) for _ in range(rng.randint(1, 60))]
        texts.append(" ".join([word(50) for _ in range(rng.randrange(40))] + block * rng.randint(1, 9) + [word(9) for _ in range(rng.randrange(9))]))
    out = [(k, rng.choice([None, "web", "Web", "wiki"]), "en", len(t or ""), t, "x", "x", "x", "x") for k, t in enumerate(texts)]
    out += [(900 + k, "hot", None, None, f"T {k % 7}", None, None, None, None) for k in range(300)] + [(5000, "alone", "el", 3, "ABC", None, None, None, None)]
    return out + [out[5], out[5], (None, "web", None, None, "no id", None, None, None, None), (None, None, None, None, None, None, None, None, None), (3, "web", "en", 1, "another text of id three", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, ROW)


def same(df, rows, sql):
    documents = pd.DataFrame(rows, columns=[c.split()[0] for c in ROW.split(", ")]).astype({"doc_id": "Int64", "n_chars": "Int64"})  # noqa: F841
    want = duckdb.sql(sql)
    cols = want.columns
    line = lambda r: tuple(str(x) for x in r)
    assert sorted(map(line, df.select(*cols).collect())) == sorted(map(line, want.fetchall()))


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def test_runs_equal_brute_force():
    rng = random.Random(8)
    texts = []
    for _ in range(250):
        v, n = rng.choice([1, 2, 3, 40]), rng.choice([0, 5, 6, 40, 200, 900])
        w = [rng.randrange(v) for _ in range(n)]
        for _ in range(rng.randrange(4) if n > 20 else 0):
            a, p = rng.randrange(n), rng.randint(1, n // 4)
            small = [rng.randrange(v) for _ in range(rng.randint(1, 4))]
            block = (small * p)[:p - 1] + [rng.randrange(60)] if rng.random() < .5 else [rng.randrange(v) for _ in range(p)]
            m = rng.randint(1, n - a)
            w[a:a + m] = [block[k % p] for k in range(m)]
        texts.append(w)
    texts.append([k % 2500 for k in range(11000)])  # a scale of thousands of words
    assert periodic.runs_of([np.array(w, np.int32) for w in texts[:-1]]) == [brute_runs(w) for w in texts[:-1]]
    assert periodic.runs_of([np.array(w, np.int32) for w in texts[-1:]]) == [[(0, 11000, 2500)]]
    assert periodic.runs_of([]) == []


def test_runs_equal_sql(docs, rows):
    same(periodic.run_digests(docs), rows, periodic.ORACLE)
    assert periodic.run_digests(docs.limit(0)).count() == 0
    got = {r.doc_id: r for r in periodic.find_runs(docs.filter("doc_id < 12")).collect()}
    assert got[5].runs == [(0, 120, 4)] and got[5].collapsed == "the cat sat on" and got[0].runs == [] and got[0].collapsed == ""


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def closed(nodes, edges):
    low = {x: x for x in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_near_duplicates_equal_brute_force(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(simhash, "PART_WORDS", 17)
    fp = [brute_fingerprint(r[4]) for r in rows]
    root = closed(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2])
    least = {}
    for k, r in enumerate(rows):
        ids = [x for x in (least.get(root[k]), r[0]) if x is not None]
        least[root[k]] = min(ids, default=None)
    want = sorted((str(r[0]), f"{fp[k]:016x}", str(least[root[k]])) for k, r in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [2, 64])
def test_crowded_buckets_lose_no_link(spark, crowded):
    rng, fps = random.Random(2), set()
    for base in (rng.getrandbits(64) for _ in range(3)):
        for _ in range(120):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(32)
            fps |= {x, base ^ 1 << rng.randrange(64) ^ 1 << 63}
    signed = sorted(x - 2 ** 64 if x >> 63 else x for x in fps)
    edges = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowded=crowded).collect()]
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2]
    assert closed(signed, edges) == closed(signed, near)


def test_manifest_equals_sql(docs, rows):
    same(manifest.manifest(docs), rows, manifest.ORACLE)
    assert manifest.manifest(docs.limit(0)).count() == 0
    got = manifest.manifest(docs.filter("doc_id = 5000")).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_near_dedup_decides_by_row(spark):
    long = " ".join(f"w{k}" for k in range(60))
    near = long + " end"
    rows = [(2, long, "a"), (5, near, "b"), (5, "something else entirely of five and more words", "c"), (1, "one text with quite a few words in it", "d"), (1, "one text with quite a few words in it", "e"),
            (None, long, "f"), (None, "unlinked words of a row without any id", "g"), (8, None, "h"), (9, "", "i")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _row string"), 5, 80, 100).collect()
    assert sorted(r["_row"] for r in got if r["_row"] not in "de") == ["a", "c", "g", "h", "i"] and sum(r["_row"] in "de" for r in got) == 1
    empty = spark.createDataFrame([], "doc_id long, text string, _row string")
    assert jaccard.one_of_each(empty).collect() == []


def test_near_dedup_equals_brute_force(docs, rows):
    some = {r[0]: r[4] for r in rows if r[0] is not None and r[0] < 60 and r[0] != 3}
    got = jaccard.one_of_each(docs.filter("doc_id < 60 and doc_id <> 3"), 5, 80, 100).collect()
    assert sorted(r.doc_id for r in got) == sorted({c for _, c in brute_components(list(some.items()), 5, 80, 100).values()})


def test_exact_stage_takes_any_column_names(spark):
    names = "doc_id long, text string, _d string, _id string, _heavy string, _keep string, _lost_id string, __d string"
    rows = [(k, t, *"abcdef") for k, t in ((1, "Same"), (2, "same"), (3, None), (4, ""), (5, "other"), (5, "same"))]
    got = dedup.drop_copies(spark.createDataFrame(rows, names))
    assert got.columns == [n.split()[0] for n in names.split(", ")] and sorted((r.doc_id, r.text) for r in got.collect()) == [(4, ""), (5, "other"), (5, "same")]
    assert dedup.drop_copies(spark.createDataFrame([], names)).count() == 0


def test_quality_keeps_all_where_labels_show_one_class(spark):
    docs = spark.createDataFrame([(k, f"some words number {k}", "x") for k in range(50)] + [(None, None, "x"), (7, "", "x")], "doc_id long, text string, score string")
    for labels in ([], [(k, 0) for k in range(50)], [(k, 1) for k in range(50)], [(k, None) for k in range(9)]):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert quality.keep_good(docs, model).count() == 52


def test_a_rare_quality_class_is_in_the_sample(spark):
    docs = spark.createDataFrame([(k, "text") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k in (11, 12, 13))) for k in range(3000)], "doc_id long, quality int")
    rows = quality.labelled_sample(docs, labels, "quality", 200, (0, 1, 2, 3, 4)).collect()
    assert {r.doc_id for r in rows if r._label} == {11, 12, 13} and 190 <= len(rows) <= 200


def test_words_keep_their_ids_when_generations_change(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(5)
    parts = ["the", "Été", "don't", "x.", "y!?", "42", "中文", ".\nThen", "\n\n", "\t", "", "é", "́", "Σας", "\x85"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", ""]) for _ in range(rng.randrange(12))) for _ in range(400)]
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    words = packing.Words(path)
    for k in range(0, len(texts), 7):
        for t, got in zip(texts[k:k + 7], words.ids(texts[k:k + 7], b"")):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    assert words.older


def test_a_worker_lets_packing_go_before_it_scores(spark):
    import public_tokenizers

    class Left:
        """Instead of scores, how many of packing's tables the worker still holds."""

        def scorer(self):
            return self

        def score(self, texts):
            import gc

            return [float(sum(type(x).__name__ == "Words" for x in gc.get_objects()))] * len(texts)

    docs = spark.createDataFrame([(k, f"words of number {k}") for k in range(64)], "doc_id long, text string").repartition(16)
    assert packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 64
    assert {r[0] for r in docs.select(quality.score_column(Left(), docs.text)).collect()} == {0.0}
