import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from footscape.functions import geo as G
from footscape.functions import text as X
from footscape.operators import network as N
from footscape.operators import observations as O
from footscape.operators import spatial as SP
from footscape.operators import tag_evidence as T
from footscape.plans.network import build_network
from footscape.sources import exchange as S

LAT, LNG = 35.0, 33.0
M = 1 / 111195.08


def extract():
    """An L-shaped footway crossing a path, steps, a road with its own sidewalks, and a motorway."""
    def node(i, east, north, **tags):
        return {"type": "node", "id": i, "lat": LAT + north * M, "lon": LNG + east * M / math.cos(math.radians(LAT)), "tags": tags}

    nodes = [node(1, 0, 0), node(2, 30, 0), node(3, 60, 0), node(4, 90, 0), node(5, 60, 40), node(6, 60, 42), node(7, 200, 42),
             node(8, 30, -30), node(20, 10, 10, amenity="hospital", name="H"), node(21, 5, 5, amenity="bar")]
    def way(i, ns, **tags):
        return {"type": "way", "id": i, "version": 1, "timestamp": "2024-01-01T00:00:00Z", "nodes": ns,
                "tags": {k.replace("__", ":"): v for k, v in tags.items()}}
    ways = [way(10, [1, 2, 3, 4], highway="footway", surface="asphalt", name="Long Walk", source="survey"),
            way(11, [3, 5], highway="steps"), way(12, [6, 7], highway="path", wheelchair="yes"),
            way(13, [1, 7], highway="residential", sidewalk="separate"), way(14, [1, 4], highway="motorway"),
            way(15, [2, 8], highway="footway", foot="no"), way(16, [4, 99], highway="footway")]
    return {"elements": nodes + ways + [{"type": "way", "id": 30, "center": {"lat": LAT, "lon": LNG}, "tags": {"amenity": "townhall"}}]}


def test_extract_to_network(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text(json.dumps(extract()))
    nodes, ways = S.read_osm(spark, str(p), "r")
    segments, graph_nodes = build_network(nodes, ways)
    rows = {r.segment_id: r for r in segments.collect()}
    # way 10 is cut at node 3 (a junction); 1-2-3 is 60 m, so it is cut again at node 2
    assert set(rows) == {"w10_1_2", "w10_2_3", "w10_3_4", "w11_3_5", "w12_6_7"}
    assert rows["w10_1_2"].length_m == 30.0
    # 5 and 6 are two metres apart: welded to the lower id
    assert rows["w11_3_5"].to_node == "n5" and rows["w12_6_7"].from_node == "n5"
    assert "source" not in rows["w10_1_2"].tags and rows["w10_1_2"].street_name == "Long Walk"
    again = {r.segment_id for r in build_network(nodes, ways)[0].collect()}
    assert again == set(rows)
    comp = N.connected_components(segments.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst")))
    assert N.connectivity_report(comp).first().components == 1
    assert graph_nodes.count() == 6
    pois = {r.poi_id: r["class"] for r in S.read_pois(spark, str(p), "r").collect()}
    assert pois == {"node20": "hospital", "way30": "townhall"}


def test_overlapping_regions_keep_their_ways(spark):
    """A way that lies in two regions gives the same segments in both, and uses are counted in each region alone."""
    nodes = spark.createDataFrame([(i, LNG + i * 20 * M, LAT) for i in range(1, 6)], "node_id long, lng double, lat double")
    tags = F.create_map(F.lit("highway"), F.lit("footway"))
    ways = spark.createDataFrame([("r1", 10, [1, 2, 3]), ("r2", 10, [1, 2, 3]), ("r2", 11, [2, 4])], "region_id string, way_id long, nodes array<long>").select(
        "*", F.lit(1).alias("version"), F.lit("2024-01-01").cast("timestamp").alias("ts"), tags.alias("tags"))
    got = {(r.region_id, r.segment_id) for r in build_network(nodes, ways)[0].collect()}
    assert got == {("r1", "w10_1_3"), ("r2", "w10_1_2"), ("r2", "w10_2_3"), ("r2", "w11_2_4")}


def test_a_long_line_is_cut_in_linear_time(spark):
    cum = [7.0 * i for i in range(2000)]
    assert N._cuts(np.diff(cum), 50.0) == py_cuts(cum, 50.0)
    line = [{"lng": LNG, "lat": LAT + 7.0 * i * M} for i in range(2000)]
    df = spark.createDataFrame([(line,), ([],), (line[:1],)], f"geometry {G.LINE}")
    got = [r.cuts for r in df.withColumn("cuts", N.length_cuts(F.col("geometry"), 50.0)).collect()]
    assert got[0][-1] == 1999 and max(b - a for a, b in zip([0] + got[0], got[0])) <= 7
    assert got[1] is None and got[2] == [0]


def py_cuts(cum, limit):
    cuts, at, last = [], 0, len(cum) - 1
    if last < 2 or cum[-1] <= limit:
        return [last]
    while cum[-1] - cum[at] > limit:
        rest = cum[-1] - cum[at]
        want = cum[at] + rest / math.ceil(rest / limit)
        fits = [i for i in range(at + 1, last) if cum[i] - cum[at] <= limit]
        nxt = min(fits, key=lambda i: (abs(cum[i] - want), i)) if fits else (at + 1 if at + 1 < last else None)
        if nxt is None:
            break
        cuts.append(nxt)
        at = nxt
    return cuts + [last]


def test_length_cuts_match_a_plain_loop(spark):
    rng = random.Random(5)
    rows, want = [], []
    for i in range(40):
        pos, line, cum = 0.0, [], []
        for _ in range(rng.randint(2, 14)):
            line.append({"lng": LNG, "lat": LAT + pos * M})
            cum.append(pos)
            pos += rng.choice([3, 8, 20, 33, 70])
        rows.append((i, line))
        want.append(py_cuts(cum, 50.0))
    df = spark.createDataFrame(rows, f"i int, geometry {G.LINE}").withColumn("cuts", N.length_cuts(F.col("geometry"), 50.0))
    assert [r.cuts for r in df.orderBy("i").collect()] == want


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(260)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in N.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_image_and_observation_readers(spark, tmp_path):
    img = tmp_path / "i.json"
    img.write_text("\n".join(json.dumps(x) for x in [
        {"id": 1, "geometry": {"coordinates": [1.0, 2.0]}, "computed_geometry": {"coordinates": [1.5, 2.5]}, "compass_angle": "x", "captured_at": 1000},
        {"id": None, "geometry": {"coordinates": [1.0, 2.0]}}, {"id": 3}]))
    rows = S.read_images(spark, str(img)).collect()
    assert len(rows) == 1 and rows[0].lng == 1.5 and rows[0].compass_angle is None and rows[0].captured_at.second == 1
    obs = tmp_path / "o.json"
    good = {"imageQuality": "good", "pedestrianPath": {"visible": "yes", "condition": "clear"}, "curbRamp": {"visible": "yes", "condition": "usable"},
            "stairs": {"visible": "no"}, "surface": {"type": "paved", "condition": "good"}, "obstacle": {"visible": "no", "severity": "none"},
            "crossing": {"visible": "yes", "accessibleFeatures": ["dropped_kerb", "dropped_kerb", "rocket"]},
            "clearPassage": {"classification": "clear"}, "uncertainFindings": ["  a   b ", ""], "notes": "n" * 500}
    bad = {"imageQuality": "superb", "surface": {"type": "lava", "condition": "good"}, "uncertainFindings": "text", "score": 95}
    obs.write_text("\n".join(json.dumps({"observationId": str(i), "segmentIds": ["s"], "observation": o}) for i, o in enumerate([good, bad, "prose"])))
    raw = S.read_observations(spark, str(obs))
    v = {r.observation_id: r for r in O.validate_observations(raw).collect()}
    assert v["0"].ok and not v["1"].ok and v["2"].errors == ["observation must be an object"]
    assert "curbRamp: missing" in v["1"].errors and "uncertainFindings: expected array" in v["1"].errors
    n = {r.observation_id: r for r in O.empty_observation(O.normalise_observations(raw)).collect()}
    a, b = n["0"].observation, n["1"].observation
    assert a.crossing.accessible_features == ["dropped_kerb"] and a.uncertain_findings == ["a b"] and len(a.notes) == 240
    assert b.image_quality == "poor" and b.surface.type == "unknown" and b.surface.condition == "good" and b.uncertain_findings == []
    assert n["2"].is_empty and not n["1"].is_empty


def test_labels_both_layouts(spark, tmp_path):
    one = {"segmentId": "a", "trueStatus": "partial", "trueBarriers": ["steps"]}
    (tmp_path / "bare.json").write_text(json.dumps([one, one]))
    (tmp_path / "wrapped.json").write_text(json.dumps({"regionId": "r", "samples": [one]}))
    assert S.read_labels(spark, str(tmp_path / "bare.json")).count() == 2
    w = S.read_labels(spark, str(tmp_path / "wrapped.json")).collect()
    assert len(w) == 1 and w[0].region_id == "r" and w[0].true_barriers == ["steps"]


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("r0", "a", 1), ("r0", "b", 1), ("r1", "c", 1)], "region_id string, id string, v int")
    S.write_upsert(a, path, ["id"])
    S.write_upsert(spark.createDataFrame([("r0", "a", 2), ("r0", "d", 2)], a.schema), path, ["id"])
    S.write_upsert(spark.createDataFrame([("r0", "a", 2), ("r0", "d", 2)], a.schema), path, ["id"])
    got = {(r.id, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 2), ("b", 1), ("c", 1), ("d", 2)}


def test_csv_export_layout(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you'), (2, None)], "n int, t string").coalesce(1)
    S.export_csv(df, [("N", F.col("n")), ("Text", F.col("t"))], str(tmp_path / "c"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "c").glob("part-*")))
    assert text == '﻿N,Text\r\n1,"say ""hi"", you"\r\n2,\r\n'.encode()


def test_geometry_round_trip_and_text(spark):
    df = spark.createDataFrame([([{"lng": 1.0, "lat": 2.0}, {"lng": 3.0, "lat": 4.0}],)], f"geometry {G.LINE}")
    flat = S.pack_geometry(S.pack_geometry(df))
    assert flat.first().geometry == [1.0, 2.0, 3.0, 4.0]
    assert S.unpack_geometry(S.unpack_geometry(flat)).first() == df.first()
    names = spark.createDataFrame([("Λεωφόρος Ποσειδώνος", "Leoforos Poseidonos"), ("Αγίου Αντωνίου", "Agiou Antoniou")], "el string, la string")
    for r in names.select(X.phonetic_key(F.col("el")).alias("a"), X.phonetic_key(F.col("la")).alias("b")).collect():
        assert r.a == r.b and r.a
    urls = spark.createDataFrame([("https://www.example.com/app/?pKey=12", "12"), ("https://example.com.evil.org/?pKey=12", None), ("https://notexample.com/?pKey=12", None)], "u string, want string")
    assert all(r.got == r.want for r in urls.select("want", X.image_id_from_url(F.col("u"), "example.com").alias("got")).collect())


def test_lengths_and_inclines(spark):
    df = spark.createDataFrame([("2.4", 2.4), ("150 cm", 1.5), ("900mm", 0.9), ("5 ft", 1.524), ('36"', 0.9144), ("wide", None)], "v string, want double")
    for r in df.withColumn("got", T.metres(F.col("v"))).collect():
        assert (r.got is None) == (r.want is None) and (r.got is None or abs(r.got - r.want) < 1e-9)
    inc = spark.createDataFrame([("-6%", 6.0), ("up", None), ("4", 4.0), ("45°", 100.0)], "v string, want double")
    for r in inc.withColumn("got", T.incline_percent(F.col("v"))).collect():
        assert (r.got is None) == (r.want is None) and (r.got is None or abs(r.got - r.want) < 1e-9)


def test_hot_cells_are_split_and_lose_nothing(spark):
    pts = spark.range(900).select(F.col("id").alias("image_id"), F.when(F.col("id") % 3 == 0, F.col("id") * 1e-3).otherwise(0.5).alias("k"))
    small = spark.createDataFrame([(0.5, "hot")] + [(i * 3e-3, f"c{i}") for i in range(300)], "k double, name string")
    a, b = SP.split_hot(pts, small, ["k"], rows_per_task=100)
    assert a.filter("k = 0.5").select("_salt").distinct().count() > 1
    joined = a.join(b, ["k", "_salt"])
    plain = pts.join(small, "k")
    assert joined.count() == plain.count() and joined.select("image_id", "name").exceptAll(plain.select("image_id", "name")).count() == 0


def test_distance_of_pairs_stays_out_of_the_join(spark):
    pts = spark.createDataFrame([(1, 32.4, 34.75), (2, 32.4, 34.7502)], "image_id long, lng double, lat double")
    line = F.array(G.point(F.lit(32.3999), F.lit(34.75)), G.point(F.lit(32.4002), F.lit(34.75)))
    lines = spark.range(1).select(F.lit("s").alias("segment_id"), line.alias("geometry"))
    near = SP.points_near_lines(pts, lines, 30.0, 0.0006, ["image_id"], ["segment_id"])
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if " Join " in x or x.startswith("Join ")]
    assert joins and not any("ASIN" in x for x in joins)  # a filter moved into the join repeats the formula
    want = pts.crossJoin(lines).select("image_id", G.point_to_line(F.col("lng"), F.col("lat"), F.col("geometry"))["dist"].alias("d"))
    assert {r.image_id: r.dist for r in near.collect()} == {r.image_id: r.d for r in want.collect() if r.d <= 30}


def test_points_snap_to_the_nearest_edge_near_and_far(spark):
    rng = random.Random(5)
    pts = [(f"p{i}", 32.4 + rng.random() * 0.004, 34.75 + rng.random() * 0.004) for i in range(60)] + [("far", 33.4, 34.75), (None, 32.4, 34.75), (None, 32.404, 34.75)]
    p = spark.createDataFrame(pts, "point_id string, lng double, lat double")
    edges = spark.createDataFrame([(f"s{i}", [(32.4 + i * 0.0011, 34.75), (32.4 + i * 0.0011, 34.7524)]) for i in range(4)],
                                  f"segment_id string, geometry {G.LINE}")
    got = SP.snap_points(p, edges, 250.0)
    assert got.select("point_id").distinct().count() == got.count()
    far = F.min(F.struct("d.dist", "segment_id")).alias("m")
    d = G.point_to_line(F.col("lng"), F.col("lat"), F.col("geometry"))
    want = p.crossJoin(edges).withColumn("d", d).filter("d.dist <= 250").groupBy("point_id").agg(far)
    assert {(r.point_id, r.dist, r.segment_id) for r in got.collect()} == {(r.point_id, r.m.dist, r.m.segment_id) for r in want.collect()}
    assert got.filter("dist < 31").count() and got.filter("dist > 32").count()


def test_network_joins_broadcast_nothing_that_grows(spark):
    nodes = spark.createDataFrame([("r", i, 32.4 + i * 0.0004, 34.75) for i in range(6)], "region_id string, node_id long, lng double, lat double")
    tags = F.create_map(F.lit("highway"), F.lit("footway"))
    ways = spark.createDataFrame([("r", i, [i, i + 1, i + 2]) for i in range(4)], "region_id string, way_id long, nodes array<long>").select(
        "*", F.lit(1).alias("version"), F.lit("2024-01-01").cast("timestamp").alias("ts"), tags.alias("tags"))
    segments, _ = build_network(nodes, ways)
    plan = segments._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert segments.count()


def test_pairs_of_frames_and_segments_are_met_once(spark):
    """Pairs of a segment of one piece aren't gathered; several pieces, or an id that comes twice, still give one row a pair."""
    frames = [(f"i{i}", 32.4 + i * 0.00003, 34.75 + i * 0.00002, None, 10.0 * i, 0.5, "q") for i in range(12)] + [(None, 32.4001, 34.75, None, None, None, None)]
    images = spark.createDataFrame(frames, "image_id string, lng double, lat double, captured_at timestamp, compass_angle double, quality_score double, sequence_id string")
    a, b, c = (32.4, 34.75), (32.4003, 34.75), (32.4003, 34.7503)
    rows = [("one", [a, b]), ("two", [a, b, c]), ("twice", [a, b]), ("twice", [b, c]), ("dot", [a]), (None, [a, b])]
    near = SP.images_near_segments(images, spark.createDataFrame(rows, f"segment_id string, geometry {G.LINE}"))
    got = near.collect()
    assert len({(r.image_id, r.segment_id) for r in got}) == len(got) and {r.segment_id for r in got} == {"one", "two", "twice", "dot", None}
    at = {(r[0]): r for r in frames}
    for r in got:
        best = min(spark_distance(at[r.image_id], p, q) for s, line in rows if s == r.segment_id for p, q in (zip(line, line[1:]) if len(line) > 1 else [(a, a)]))
        assert abs(r.near.dist - best) < 0.05
    single = SP.images_near_segments(images, spark.createDataFrame(rows[:1], f"segment_id string, geometry {G.LINE}"))
    assert "Aggregate" not in single._jdf.queryExecution().optimizedPlan().toString()
    east = single.first().near
    assert abs(east.bearing - 90) < 0.01


def spark_distance(frame, p, q):
    """Metres from a frame to a straight piece, on a plane."""
    kx, ky = 111320 * math.cos(math.radians(frame[2])), 110930.0
    x, y, dx, dy = (frame[1] - p[0]) * kx, (frame[2] - p[1]) * ky, (q[0] - p[0]) * kx, (q[1] - p[1]) * ky
    t = max(0.0, min(1.0, (x * dx + y * dy) / (dx * dx + dy * dy))) if p != q else 0.0
    return math.hypot(x - t * dx, y - t * dy)


def test_votes_are_counted_without_sorting_observations(spark):
    o = O.OBSERVATION
    rows = [("s", f"o{i}", t) for i, t in enumerate(["mapillary", "citizen", "mapillary", None])] + [("u", "o9", None), (None, "o8", "mapillary")]
    linked = spark.createDataFrame(rows, "segment_id string, observation_id string, source_type string").select(
        "*", F.lit(None).cast(o).alias("observation"), F.lit(None).cast("timestamp").alias("captured_at"), F.lit("2024-01-01").cast("timestamp").alias("analysed_at"))
    votes = O.vote_features(linked)
    got = {r.segment_id: (r.observation_count, r.n_mapillary, r.n_citizen, r.n_source_types, r.any_source_type, r.informative_count) for r in votes.collect()}
    assert got == {"s": (4, 2, 1, 2, "citizen", 0), "u": (1, 0, 0, 0, None, 0), None: (1, 1, 0, 1, "mapillary", 0)}
    plan = votes._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert any("HashAggregate(keys=[segment_id" in x and "source_type" in x.split("functions")[0] for x in plan)
    assert not any("SortAggregate" in x and "source_type" in x.split("functions")[0] for x in plan)
