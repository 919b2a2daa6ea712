from datetime import datetime

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footscape.operators import imagery as I


def test_scored_frames_are_stored_by_column(spark, monkeypatch):
    """No checkpoint of plain rows: that of all pairs was the largest table of a discovery."""
    monkeypatch.setattr(DataFrame, "checkpoint", lambda *a, **k: pytest.fail("checkpoint"))
    rows = [("s", f"i{n}", 33.0 + n * 0.0001, 35.0, datetime(2024, 1, 1), 10.0, "q", 1.0 - n / 10, 2.0) for n in range(6)] + [("t", "j", 33.0, 35.0, None, None, None, 0.5, 1.0)]
    scored = spark.createDataFrame(rows, "segment_id string, image_id string, lng double, lat double, captured_at timestamp, compass_angle double, sequence_id string, score double, distance_m double")
    got = I.select_frames(scored, 3, 15.0).select("segment_id", "choice", "image_id").orderBy("segment_id", F.col("choice")).collect()
    assert [tuple(x) for x in got] == [("s", 1, "i0"), ("s", 2, "i2"), ("s", 3, "i4"), ("t", 1, "j")]
