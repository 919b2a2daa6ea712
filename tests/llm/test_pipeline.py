"""The pipeline's stages on the smallest tables: each works on what its predecessor kept, and keeps clean documents."""

import corpus_pipeline as cp
import pytest
from test_llm_operators import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), [("start", spark.read.parquet(f"{SF}/documents.parquet"))]
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs))
    return dict(out)


def test_stages_keep_columns_and_only_lose_rows(kept):
    names = ["start", *[n for n, _ in cp.STAGES[:-1]]]
    for a, b in zip(names, names[1:]):
        assert kept[b].columns == kept["start"].columns
        assert kept[b].join(kept[a], "doc_id", "left_anti").count() == 0


def test_copies_go_and_one_of_each_stays(kept):
    before = {r.doc_id: (r.text or "").translate({c: c + 32 for c in range(65, 91)}) for r in kept["toxicity"].collect()}
    best = {}
    for k, t in before.items():
        best[t] = max(k, best.get(t, k))
    assert {r.doc_id for r in kept["exact_dedup"].collect()} == set(best.values())
    rows = [(r.doc_id, r.text) for r in kept["exact_dedup"].collect()]
    assert {r.doc_id for r in kept["near_dedup"].collect()} == {c for _, c in brute_components(rows, 5, 80, 100).values()}


def test_last_stage_packs_what_is_left(kept, spark):
    assert {r.doc_id for r in kept["packing"].collect()} == {r.doc_id for r in kept["near_dedup"].collect()}
    assert cp.ORACLE_SQL is None and cp.run(spark, SF).select("doc_id").distinct().count() == kept["near_dedup"].count()
