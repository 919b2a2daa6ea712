import heapq
import random

import pytest
from pyspark.sql import functions as F

from footscape.operators import routing as R
from footscape.operators import tile_routes as TR

EDGE = "segment_id string, reversed boolean, region_id string, src string, dst string, length_m double, profile string, prefer_verified boolean, cost double"
SEARCH = "search_id string, profile string, prefer_verified boolean, region_id string, start string, goal string, without string"


def town(spark, columns=45, rows=12, seed=3):
    """A grid wider than the core of a tile with some streets missing, an island beside it and searches all over it: (nodes, edges, searches, plain edges)."""
    rnd = random.Random(seed)
    at = {f"n{x}_{y}": (33.0 + 0.0008 * x, 35.0 + 0.0004 * y) for x in range(columns) for y in range(rows)} | {"i1": (33.01, 35.0061), "i2": (33.0102, 35.0061)}
    lines = [(f"s{x}_{y}{d}", f"n{x}_{y}", f"n{x + (d == 'E')}_{y + (d == 'N')}") for x in range(columns) for y in range(rows) for d in "EN"]
    lines = [x for x in lines if x[2] in at and rnd.random() > 0.15] + [("island", "i1", "i2")]
    priced = {s: (float(rnd.choice([60, 75, 90])), rnd.choice([70.0, 75.0, 140.0])) for s, *_ in lines}
    both = [(s, back, "r", b if back else a, a if back else b, priced[s][0], "walk", False, priced[s][1]) for s, a, b in lines for back in (False, True)]
    names = sorted(at)
    asked = [(f"q{i}", "walk", False, "r", rnd.choice(names), rnd.choice(names), None) for i in range(150)]
    asked += [(f"d{i}", "walk", False, "r", a, b, s) for i, (s, a, b) in enumerate(rnd.sample(lines, 60))] + [
        ("isle", "walk", False, "r", "i1", "n3_3", None), ("same", "walk", False, "r", "i1", "i1", None), ("lost", "walk", False, "r", "nowhere", "i1", None), ("none", "walk", False, "r", None, "i1", None)]
    nodes = spark.createDataFrame([(k, *v) for k, v in at.items()], "node string, lng double, lat double")
    return nodes, spark.createDataFrame(both, EDGE), spark.createDataFrame(asked, SEARCH), both, asked


def by_hand(edges, start, goal, without):
    """(cost, legs) by Dijkstra over the whole network, ties by length, number of edges and last edge."""
    out = {}
    for s, back, _, a, b, length, _, _, cost in edges:
        if s != without:
            out.setdefault(a, []).append((b, cost, length, ("-" if back else "") + s))
    labels, heap = {start: (0.0, 0.0, 0, "", "")}, [(0.0, 0.0, 0, start)]
    while heap:
        c, m, k, node = heapq.heappop(heap)
        if (c, m, k) != labels[node][:3]:
            continue
        for b, cost, length, leg in out.get(node, ()):
            label = (c + cost, m + length, k + 1, leg, node)
            if b not in labels or label < labels[b]:
                labels[b] = label
                heapq.heappush(heap, (*label[:3], b))
    if goal not in labels:
        return None, None
    legs, node = [], goal
    while node != start:
        legs.append(labels[node][3])
        node = labels[node][4]
    return labels[goal][0], legs[::-1]


def check(got, edges, asked):
    assert len(got) == len(asked)
    for q, _, _, _, start, goal, without in asked:
        cost, legs = (None, None) if start is None else by_hand(edges, start, goal, without)
        r = got[q]
        assert (r.found, r.cost, r.legs) == (legs is not None, cost, legs), q


def test_searches_within_a_tile_need_no_rounds(spark, monkeypatch):
    nodes, edges, searches, plain, asked = town(spark, 20, 12)
    monkeypatch.setattr(R, "_relaxed", lambda *a: pytest.fail("rounds"))
    check({r.search_id: r for r in R.least_cost_paths(searches, edges, nodes).collect()}, plain, asked)


def test_what_a_tile_cannot_prove_is_relaxed(spark, monkeypatch):
    nodes, edges, searches, plain, asked = town(spark, 20, 5)
    left, relaxed = [], R._relaxed
    monkeypatch.setattr(R, "TILE_DEGREES", (0.004, 0.008))
    monkeypatch.setattr(R, "_relaxed", lambda s, *a: left.append(s.count()) or relaxed(s, *a))
    check({r.search_id: r for r in R.least_cost_paths(searches, edges, nodes).collect()}, plain, asked)
    assert 0 < left[0] < len(asked)


def test_large_tiles_are_not_loaded_and_many_searches_are_dealt_out(spark, monkeypatch):
    nodes, edges, searches, plain, asked = town(spark, 9, 6)
    monkeypatch.setattr(TR, "TILE_SEARCHES", 10)
    check({r.search_id: r for r in R.least_cost_paths(searches, edges, nodes).collect()}, plain, asked)
    monkeypatch.setattr(TR, "TILE_EDGES", 50)
    few = searches.filter("search_id IN ('d1', 'isle', 'same')")
    check({r.search_id: r for r in R.least_cost_paths(few, edges, nodes).collect()}, plain, [x for x in asked if x[0] in ("d1", "isle", "same")])


def test_overlays_and_unknown_places(spark):
    """A start off the network that two legs join, edges without a length and nodes without a place."""
    nodes, edges, _, plain, _ = town(spark, 8, 6)
    nodes = nodes.withColumn("lat", F.when(F.col("node") != "n4_4", F.col("lat")))
    edges = edges.withColumn("length_m", F.when(F.col("segment_id") != "s1_1E", F.col("length_m")))
    extra = spark.createDataFrame([("v", "s0_0E", False, "@v", "n1_0", 5.0, 6.0, 5.0), ("v", "s0_0E", True, "@v", "n0_0", 30.0, 31.0, 30.0)],
                                  "search_id string, segment_id string, reversed boolean, src string, dst string, length_m double, cost double, span_m double")
    asked = [("v", "walk", False, "r", "@v", "n6_4", None), ("w", "walk", False, "r", "n0_0", "n4_4", None)]
    searches = spark.createDataFrame(asked, SEARCH).withColumn("start_at", F.when(F.col("search_id") == "v", "n0_0"))
    got = {r.search_id: r for r in R.least_cost_paths(searches, edges, nodes, extra).collect()}
    own = [("s0_0E", False, "r", "@v", "n1_0", 5.0, "walk", False, 6.0), ("s0_0E", True, "r", "@v", "n0_0", 30.0, "walk", False, 31.0)]
    assert got["v"].found and got["v"].cost == by_hand(plain + own, "@v", "n6_4", None)[0]
    assert got["w"].cost == by_hand(plain, "n0_0", "n4_4", None)[0]
