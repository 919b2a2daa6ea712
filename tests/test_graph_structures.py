"""Components, bridges, welding, routes between points, keyed writes and redaction against brute force."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_routing_and_streams import P0, harbour

from footscape.functions import geo as G
from footscape.operators import components as C
from footscape.operators import municipal as M
from footscape.operators import network as N
from footscape.operators import routing as R
from footscape.operators.bridges import bridges
from footscape.plans import routes as PR
from footscape.sources import exchange as X


def closed(nodes, edges):
    low = {x: x for x in nodes}

    def find(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("tail,heavy", [(4000, 1000), (0, 20)])
def test_components_equal_brute_force(spark, monkeypatch, tail, heavy):
    monkeypatch.setattr(C, "TAIL_EDGES", tail)
    monkeypatch.setattr(C, "HEAVY_ROWS", heavy)
    rng = random.Random(3)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(500, k) for k in range(501, 600)] + [(k, k + 1) for k in range(700, 760)] + [(7, 7), (9999, 9999)]
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()}
    assert got == closed({x for e in edges for x in e}, edges)
    assert C.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_a_long_chain_and_a_large_star_settle(spark):
    n = 60_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    star = spark.range(n).select(F.lit(10 ** 6).cast("long").alias("src"), (F.col("id") + 10 ** 6 + 1).alias("dst"))
    got = C.connected_components(chain.unionByName(star)).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(0, n + 1), (10 ** 6, n + 1)}


def test_lookup_keeps_rows_of_heavy_keys_that_the_table_lacks(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, n int")
    table, heavy = spark.createDataFrame([("b", "B")], "k string, v string"), spark.createDataFrame([("a",), ("b",)], "k string")
    assert {tuple(r) for r in C.lookup(rows, "k", table, heavy, "left").collect()} == {("a", 1, None), ("a", 2, None), ("b", 3, "B"), ("c", 4, None)}
    assert [tuple(r) for r in C.lookup(rows, "k", table, heavy).collect()] == [("b", 3, "B")]


@pytest.mark.parametrize("tail", [4000, 0])
def test_bridges_equal_brute_force(spark, monkeypatch, tail):
    monkeypatch.setattr(C, "TAIL_EDGES", tail)
    rng, edges = random.Random(6), []
    add = lambda a, b: edges.append((f"e{len(edges)}", f"n{a}", f"n{b}"))
    for _ in range(60):
        add(rng.randrange(50), rng.randrange(50))
    for a, b in [(k, k + 1) for k in range(60, 75)] + [(90, 91), (91, 92), (92, 90), (92, 93), (93, 93), (93, 94), (93, 94), (94, 95)]:
        add(a, b)
    nodes = {x for e in edges for x in e[1:]}
    parts = lambda es: len(set(closed(nodes, [e[1:] for e in es]).values()))
    want = {e[0] for e in edges if parts([x for x in edges if x is not e]) > parts(edges)}
    assert {r.edge_id for r in bridges(spark.createDataFrame(edges, "edge_id string, src string, dst string")).collect()} == want


def test_clusters_equal_the_choice_in_order(spark):
    rng, pairs, want = random.Random(5), [], {}
    for region, n in (("r", 70), ("s", 40)):
        pts = [rng.random() * (12 if region == "r" else 4) for _ in range(n)] if region == "r" else [float(k) for k in range(n)]
        order = {k: ((k * 37) % 101 if region == "r" else k, 0) for k in range(n)}
        near = {k: [j for j in range(n) if j != k and abs(pts[j] - pts[k]) <= (0.2 if region == "r" else 1.0)] for k in range(n)}
        pairs += [(region, a, b, order[a], order[b]) for a in near for b in near[a]]
        done = {}
        for k in sorted(near, key=order.get):
            if k not in done:
                group = [k] + [j for j in near[k] if j not in done]
                done |= dict.fromkeys(group, min(group)) if len(group) > 1 else {}
        want |= {(region, k): v for k, v in done.items()}
    order = "struct<way_id:long,pos:int>"
    got = N.clusters(spark.createDataFrame(pairs, f"region_id string, a long, b long, ao {order}, bo {order}")).collect()
    assert {(r.region_id, r.node_id): r.welded_id for r in got} == want and len(got) == len(want)


def test_routes_between_points(spark):
    p = lambda lng, lat: {"lng": lng, "lat": lat}
    rows = [("on", "r", p(33.0005, 35.00001), p(33.002, 35.00001), "wheelchair", False), ("over", "r", p(33.0001, 35.0), p(33.0025, 35.001), "balanced", False),
            ("far", "r", p(34.0, 35.0), p(33.0, 35.0), "balanced", False), ("lost", "r", p(33.0, 35.0), p(33.0, 36.0), "balanced", False), ("other", "q", p(33.0005, 35.0), p(33.002, 35.0), "balanced", False)]
    req = spark.createDataFrame(rows, f"request_id string, region_id string, origin {G.POINT}, destination {G.POINT}, profile string, prefer_verified boolean")
    searches, paths, edges = PR.find_point_routes(harbour(spark), req)
    got = {r.search_id: r for r in paths.collect()}
    assert len(got) == 15 and got["on|shortest"].path == ["AB#direct@on"] and 136 < got["on|shortest"].length_m < 138
    assert got["over|shortest"].path[0].startswith("AB#") and got["over|shortest"].path[-1].startswith("CD#")
    assert {got[f"{k}|balanced"].reason for k in ("far", "other")} == {"origin_off_network"} and got["lost|balanced"].reason == "destination_off_network"
    plan = {r.search_id: r for r in PR.compare_routes(searches, paths, edges).collect()}
    assert plan["on|recommended"].distance_m == 137 and plan["far|recommended"].warning == "no_route" and not plan["far|shortest"].found
    line = R.stitch_geometry(R.route_edges(paths.filter("search_id = 'over|shortest'"), edges)).first().geometry
    assert (round(line[0].lng, 4), round(line[-1].lng, 4)) == (33.0001, 33.0025) and P0["C"] in [(q.lng, q.lat) for q in line]


def test_paths_by_doubling_have_every_edge(spark):
    n = 37
    labels = [("s", f"n{k}", (float(k), float(k), k, f"e{k}" if k else ""), f"n{k - 1}" if k else None) for k in range(n)] + [("t", "n0", (0.0, 0.0, 0, ""), None)]
    df = spark.createDataFrame(labels, "search_id string, node string, b struct<cost:double,len:double,edges:int,leg:string>, prev string")
    got = {r.search_id: r for r in R.reconstruct_paths(df.filter(f"node = 'n{n - 1}' or search_id = 't'"), df).collect()}
    assert got["s"].legs == [f"e{k}" for k in range(1, n)] and got["t"].legs == []


def test_a_key_that_moves_is_in_one_partition(spark, tmp_path):
    path, rows = str(tmp_path / "t"), lambda *r: spark.createDataFrame(r, "segment_id string, region_id string, v int")
    write = lambda *r: X.write_upsert(rows(*r), path, ["segment_id"], newest="v")
    read = lambda: sorted((r.segment_id, r.region_id, r.v) for r in spark.read.parquet(path).collect())
    write(("a", "r1", 1), ("b", "r1", 1), ("c", "r2", 1))
    write(("a", "r3", 2), ("a", "r3", 1))
    assert read() == [("a", "r3", 2), ("b", "r1", 1), ("c", "r2", 1)]
    for _ in range(2):  # the only row of r2 goes; a repeat changes nothing
        write(("c", "r1", 3), ("d", "r4", 0))
        assert read() == [("a", "r3", 2), ("b", "r1", 1), ("c", "r1", 3), ("d", "r4", 0)]


def test_redaction_reaches_every_level(spark):
    row = {"status": "x", "deep": {"authToken": "t", "list": [{"password": "p", "note": "n" * 500}] * 40, "a": {"b": {"c": {"d": 1}}}}}
    kind = T.StructType([T.StructField("status", T.StringType()), T.StructField("deep", T.StructType([
        T.StructField("authToken", T.StringType()), T.StructField("list", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("a", T.StructType([T.StructField("b", T.StructType([T.StructField("c", T.StructType([T.StructField("d", T.IntegerType())]))]))]))]))])
    got = spark.createDataFrame([(row,)], T.StructType([T.StructField("v", kind)])).select(M.redact(F.col("v"), kind).alias("v")).first().v
    assert "authToken" not in got.deep and len(got.deep.list) == 30 and set(got.deep.list[0]) == {"note"} and len(got.deep.list[0]["note"]) == 400
    assert got.deep.a.b.c.d == "[truncated]" and got.status == "x"


def test_prefix_index_keeps_six_rows_a_prefix(spark):
    index = spark.createDataFrame([(f"street{k:02d}", k, f"Street {k:02d}", None) for k in range(30)], "key string, segments long, street_name string, street_name_el string")
    pre = M.prefix_index(index)
    assert pre.groupBy("qk").count().agg(F.max("count")).first()[0] == 6
    got = M.suggest_streets(spark.createDataFrame([(1, "str"), (2, "s"), (3, "zz")], "query_id int, query string"), pre).collect()
    assert [(r.query_id, r.key) for r in sorted(got, key=lambda r: r["rank"])] == [(1, f"street{k}") for k in range(29, 23, -1)]


def published(spark):
    kept = "array<string>"
    more = {"way_id": F.lit(1), "positive_features": F.array().cast(kept), "sources": F.array(F.lit("osm")), "manually_verified": F.lit(False), "street_name_el": F.lit(None).cast("string"), "image_count": F.lit(2)}
    return harbour(spark).withColumns(more)


def test_feature_collections_are_whole_documents(spark, tmp_path):
    X.export_geojson(published(spark), str(tmp_path / "g"), collection=True)
    docs = [json.loads(p.read_text()) for p in Path(tmp_path / "g").rglob("part-*.txt")]
    assert all(d["type"] == "FeatureCollection" for d in docs) and sorted(f["id"] for d in docs for f in d["features"]) == ["AB", "AC", "BD", "CD"]


def test_a_repeated_publication_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "b")
    for _ in range(2):
        first = X.publish_bundle(published(spark), path)
    assert [r.version for r in first.collect()] == [1] and spark.read.parquet(f"{path}/features").count() == 4
    X.publish_bundle(published(spark), path, spark.read.parquet(f"{path}/versions"))
    got = spark.read.parquet(f"{path}/features")
    assert sorted(r.version for r in got.collect()) == [1] * 4 + [2] * 4 and got.first().images == 2
