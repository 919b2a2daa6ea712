"""What assessments, reassessments and bridges write, send and read again."""

from datetime import datetime

from pyspark.sql import functions as F

from footscape.operators import bridges as B
from footscape.plans import assess as A
from footscape.plans import incremental as IN
from footscape.schemas import OBSERVATION
from footscape.sources import driver_tables as D


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, folder):
    rows = [(k, f"street {k}", f"Brand#{11 + k % 4}{1 + k % 5}", "STANDARD", 1 + k % 50) for k in range(1, 60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    said = lambda k: ("good", ("yes", "clear"), ("no", None), ("no",), ("paved", "good"), ("no", "none", ""), ("yes", []), ("clear",), [], "")
    obs = [(f"o{k}", [f"w{k}E", f"w{k}E", f"w{k + 1}N"], "r", "mapillary", f"i{k}", said(k), datetime(2001, 1, 1 + k % 28), datetime(2001, 2, 1), "active" if k % 7 else "failed") for k in range(1, 60)]
    reports = [(f"rep{k}", f"w{k}E" if k % 5 else None, "steps", "verified", datetime(2001, 3, 1), datetime(2001, 3, 2)) for k in range(1, 60)]
    return (D.segments(spark, folder),
            spark.createDataFrame(obs, f"observation_id string, segment_ids array<string>, region_id string, source_type string, source_id string, observation {OBSERVATION}, captured_at timestamp, analysed_at timestamp, status string"),
            spark.createDataFrame(reports, "report_id string, segment_id string, category string, status string, created_at timestamp, verified_at timestamp"))


def test_a_reader_of_assessments_reads_its_columns_only(spark, tmp_path):
    segments, obs, reports = tables(spark, str(tmp_path))
    out = A.assess(segments, obs, reports, D.now_observations())
    assert out.count() == segments.count()
    assert "ReadSchema: struct<status:string>" in plan(out.select("status"))


def test_reassessed_segments_are_as_in_a_whole_assessment(spark, tmp_path, monkeypatch):
    segments, obs, reports = tables(spark, str(tmp_path))
    cols = ["segment_id", "status", "accessibility_score", "evidence_confidence", "observation_count", "verified_report_count", "last_evidence_at"]
    touched = spark.createDataFrame([("w3E",), ("w4N",), ("w7E",), ("w7E",), ("gone",)], "segment_id string")
    want = sorted(map(tuple, A.assess(segments, obs, reports, D.now_observations()).select(cols).filter("segment_id IN ('w3E', 'w4N', 'w7E')").collect()))
    assert len(want) == 3 and {r[4] for r in want} == {0, 1}
    for few in (IN.FEW_TOUCHED, 0):
        monkeypatch.setattr(IN, "FEW_TOUCHED", few)
        assert sorted(map(tuple, IN.reassess(touched, segments, obs, reports, D.now_observations()).select(cols).collect())) == want


def test_observations_are_not_shuffled_to_find_the_touched(spark, tmp_path, monkeypatch):
    segments, obs, reports = tables(spark, str(tmp_path))
    monkeypatch.setattr(IN, "assess", lambda *given: given)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, near, said, *_ = IN.reassess(spark.createDataFrame([("w3E",)], "segment_id string"), segments, obs, reports, D.now_observations())
        assert [r.observation_id for r in near.collect()] == ["o3"]
        assert "Exchange hashpartitioning" not in plan(near) + plan(said)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bridges_store_their_edges_first_and_numbers_after(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "n1", "n2"), ("b", "n2", "n3"), ("c", "n3", "n1"), ("d", "n3", "n4"), ("d", "n3", "n4")], "edge_id string, src string, dst string").withColumn("wide", F.lit("x"))
    seen, plain = [], B.stored
    monkeypatch.setattr(B, "stored", lambda df: seen.append(df.columns) or plain(df))
    assert [r.edge_id for r in B.bridges(edges).collect()] == ["d"]
    assert seen[0] == ["edge_id", "src", "dst"] and seen[-1] == ["at", "next", "x1", "x2"]
