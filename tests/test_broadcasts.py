from pyspark.sql import functions as F

from footscape.functions import geo as G
from footscape.operators import network as N
from footscape.operators import reports as RP
from footscape.operators import routing as R
from footscape.operators import spatial as SP
from footscape.sources import driver_tables as D


def grid(spark):
    x, y = F.col("id") % 10, F.floor(F.col("id") / 10)
    at = lambda i: G.point(33.0 + (x + i) * 0.0005, 35.0 + y * 0.0005)
    return spark.range(60).select(
        F.concat(F.lit("s"), "id").alias("segment_id"), F.lit("r").alias("region_id"), F.concat(F.lit("n"), "id").alias("from_node"), F.concat(F.lit("n"), F.col("id") + 1).alias("to_node"),
        F.array(at(0), at(1)).alias("geometry"), F.lit(45.0).alias("length_m"), F.lit("x").alias("street_name"), F.lit("partial").alias("status"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_a_large_network_are_merged(spark, monkeypatch):
    points = spark.range(200).select(F.col("id").alias("point_id"), (33.0 + F.col("id") * 0.00002).alias("lng"), F.lit(35.0001).alias("lat"))
    near = lambda: SP.points_near_lines(points, grid(spark), 30.0, 0.002, ["point_id"], ["segment_id"])
    few = near()
    want = sorted(few.select("point_id", "segment_id").collect())
    assert "BroadcastHashJoin" in plan(few) and want
    monkeypatch.setattr(SP, "BROADCAST_ROWS", 50)
    many = near()
    assert "Broadcast" not in plan(many) and sorted(many.select("point_id", "segment_id").collect()) == want


def test_tables_that_grow_with_the_network_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(SP, "BROADCAST_ROWS", 5)
    reports = spark.range(80).select(F.concat(F.lit("r"), "id").alias("report_id"), G.point(33.0 + F.col("id") * 0.00002, F.lit(35.00001)).alias("location"))
    matched = RP.match_reports(reports, grid(spark))
    assert "Broadcast" not in plan(matched) and matched.filter("segment_status = 'partial'").count() == 80
    asked = spark.range(40).select(F.concat(F.lit("q"), "id").alias("request_id"), G.point(33.0 + F.col("id") * 0.00002, F.lit(35.00001)).alias("origin"),
                                   G.point(33.001 + F.col("id") * 0.00002, F.lit(35.00001)).alias("destination"))
    snapped, extra, off = R.virtual_endpoints(asked, grid(spark))
    assert not [x for x in (snapped, extra, off) if "Broadcast" in plan(x)] and snapped.count() == 40


def test_way_ends_are_welded_by_merges(spark, monkeypatch):
    plans, kept = [], N.stored
    monkeypatch.setattr(N, "stored", lambda df: plans.append(plan(df)) or kept(df))
    rows = [("r", a, b, {"way_id": a, "pos": 0}, {"way_id": b, "pos": 0}) for a, b in [(1, 2), (2, 1), (2, 3), (3, 2), (4, 5), (5, 4)]]
    pairs = spark.createDataFrame(rows, "region_id string, a long, b long, ao struct<way_id:long,pos:int>, bo struct<way_id:long,pos:int>")
    got = sorted((x.node_id, x.welded_id) for x in N.clusters(pairs).collect())
    assert got == [(1, 1), (2, 1), (4, 4), (5, 4)] and len(plans) > 4 and not [x for x in plans if "Broadcast" in x]


def test_requests_keep_the_goals_of_the_map(spark, tmp_path):
    spark.range(100).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(90).selectExpr("id AS c_custkey", "id % 25 AS c_nationkey", "'BUILDING' AS c_mktsegment", "1.0D AS c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    found = D.route_requests(spark, str(tmp_path))
    assert "Broadcast" not in plan(found) and found.filter("substring(goal_node, 2, 9) >= 100").isEmpty() and not found.isEmpty()
