"""Least-cost paths found within tiles of the network, each with a proof that no way out of its tile is better."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footscape.functions import geo as G
from footscape.session import stored

#: Widths of the tiles that are tried one after the other, in degrees. A tile also holds what lies within a quarter of its width around it.
TILE_DEGREES = (0.02, 0.08)
#: Tiles of more edges are not loaded, which bounds the memory of a task; so many searches go to one copy of a tile.
TILE_EDGES, TILE_SEARCHES = 200_000, 4_000
ANSWER = "n long, search_id string, settled boolean, cost double, length_m double, legs array<string>"


def _reach(c: Column, width: float) -> tuple[Column, Column]:
    """First and last tile, in one direction, that hold a coordinate."""
    return F.floor((c - F.lit(width / 4)) / F.lit(width)), F.floor((c + F.lit(width / 4)) / F.lit(width))


def answered(searches: DataFrame, edges: DataFrame, width: float) -> DataFrame:
    """(n, search_id, settled, cost, length_m, legs) of the searches that a tile of this width can be tried for; `cost` is null where there is no path.

    searches: (n, search_id, graph, start, goal, without, rate, mid_lng, mid_lat, apart, start_lng, start_lat, at_node, goal_lng, goal_lat, own),
    `apart` being the degrees between the ends, `at_node` whether the start is a node of the network and `own` the search's overlay.
    edges: (graph, node, dst, segment_id, length_m, cost, leg, node_lng, node_lat, dst_lng, dst_lat).

    A search goes to the tile of its middle. Edges go to all tiles that hold the node they leave, so a node of a tile has all of its edges there. All
    edges and then all searches of a tile come to one task; a tile of many searches is copied.
    """
    tx, ty = F.floor(F.col("mid_lng") / F.lit(width)), F.floor(F.col("mid_lat") / F.lit(width))
    s = searches.filter(F.col("apart") <= width / 4).withColumns({"tx": tx, "ty": ty})
    (x1, x2), (y1, y2) = _reach(F.col("node_lng"), width), _reach(F.col("node_lat"), width)
    dealt = edges.withColumn("tx", F.explode(F.sequence(x1, x2))).withColumn("ty", F.explode(F.sequence(y1, y2)))
    key = ["graph", "tx", "ty"]
    tiles = s.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TILE_SEARCHES).cast("int").alias("copies"))
    full = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > TILE_EDGES)
    tiles = stored(tiles.join(full, key, "left_anti").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("tile", F.monotonically_increasing_id()))
    rows = dealt.join(tiles, key).select(
        "tile", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("n"), "node", "dst", "segment_id", "leg", F.col("length_m").cast("double").alias("length_m"), F.col("cost").cast("double").alias("cost"), "node_lng", "node_lat",
        "dst_lng", "dst_lat", F.lit(True).alias("at_node"), "tx", "ty", F.lit(None).cast(s.schema["own"].dataType).alias("own"))
    asked = s.join(tiles.filter("copy = 0").select(*key, "copies"), key).withColumn("copy", F.pmod(F.xxhash64("search_id"), F.col("copies")).cast("int")).drop("copies")
    asked = asked.join(tiles.select(*key, "copy", "tile"), [*key, "copy"]).select(
        "tile", F.lit(1).alias("kind"), "n", F.col("start").alias("node"), F.col("goal").alias("dst"), F.col("without").alias("segment_id"), F.col("search_id").alias("leg"),
        F.lit(0.0).alias("length_m"), F.col("rate").alias("cost"), F.col("start_lng").alias("node_lng"), F.col("start_lat").alias("node_lat"),
        F.col("goal_lng").alias("dst_lng"), F.col("goal_lat").alias("dst_lat"), "at_node", "tx", "ty", "own")
    both = rows.unionByName(asked).repartition("tile").sortWithinPartitions("tile", "kind")
    return both.mapInArrow(_searched(width), ANSWER)


def _searched(width: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task: tile after tile, edges before searches.

    A search is best-first by cost and straight distance left at the cheapest cost per metre, with labels of cost, length, edges, last edge
    and node before; equal costs are settled in this order, and a label that gets better goes on again. A node that lies off the tile ends it unsettled
    as soon as its bound is among those that the search has to look at. So a settled path beats every way that leaves the tile.
    Ends that lie in different parts of the tile are known to be apart, where the start's part doesn't reach out of the tile, without a search.
    """
    radius, slack, none = G.EARTH_RADIUS_M, 1e-6, ()
    inf = math.inf
    schema = pa.schema([("n", pa.int64()), ("search_id", pa.string()), ("settled", pa.bool_()), ("cost", pa.float64()), ("length_m", pa.float64()), ("legs", pa.list_(pa.string()))])

    def vector(lng, lat):
        """A point on the unit sphere: straight lines between such points are never longer than the way along the surface."""
        if lng is None or lat is None or not math.isfinite(lng + lat):
            return None
        a, b = math.radians(lng), math.radians(lat)
        return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)

    def within(lng, lat, tx, ty):
        if lng is None or lat is None or not math.isfinite(lng + lat):
            return False
        q = width / 4
        return math.floor((lng - q) / width) <= tx <= math.floor((lng + q) / width) and math.floor((lat - q) / width) <= ty <= math.floor((lat + q) / width)

    def ordered(x, null=-inf):  # as Spark orders numbers: null before all, NaN after all
        return null if x is None else inf if x != x else x

    def shown(x):
        return None if x == -inf else math.nan if x == inf else x

    class Tile:
        def __init__(self):
            self.out: dict = {}  # node: its edges (dst, cost, length, leg, segment)
            self.at: dict = {}  # node: its place on the sphere
            self.off: set = set()  # nodes whose edges may lie off the tile
            self.part: dict = {}
            self.reaches: dict = {}

        def load(self, rows):
            for node, dst, segment, leg, length, cost, lng, lat, dlng, dlat, tx, ty in rows:
                self.out.setdefault(node, []).append((dst, ordered(cost), ordered(length), leg or "", segment))
                if node not in self.at:
                    self.at[node] = vector(lng, lat)
                if dst not in self.at:
                    self.at[dst] = vector(dlng, dlat)
                    if not within(dlng, dlat, tx, ty):
                        self.off.add(dst)

        def divide(self):
            """Parts whose nodes hang together, and whether they reach out of the tile."""
            beside: dict = {}
            for node, edges in self.out.items():
                for e in edges:
                    beside.setdefault(node, []).append(e[0])
                    beside.setdefault(e[0], []).append(node)
            for first in beside:
                if first in self.part:
                    continue
                self.part[first], stack, reaches = first, [first], False
                while stack:
                    node = stack.pop()
                    reaches = reaches or node in self.off
                    for other in beside[node]:
                        if other not in self.part:
                            self.part[other] = first
                            stack.append(other)
                self.reaches[first] = reaches

        def apart(self, start, goal, own, off):
            """None where a path may exist, else whether the ends are certainly apart (and not perhaps joined off the tile)."""
            part, ends = self.part, {start}
            met = {part.get(start, start)}
            while True:
                more = {d[0] for x, edges in own.items() if x in ends or part.get(x, x) in met for d in edges} - ends
                if not more:
                    break
                ends |= more
                met |= {part.get(x, x) for x in more}
            if goal in ends or part.get(goal, goal) in met:
                return None
            return not (any(x in off for x in ends) or any(self.reaches.get(p) for p in met))

        def search(self, start, goal, without, rate, at_goal, start_off, own, own_at, own_off):
            """(settled, cost, length, legs)"""
            if start is None or goal is None:
                return True, None, None, None
            if start == goal:
                return True, 0.0, 0.0, []
            off = self.off | own_off if own_off else self.off
            if start_off and start not in self.out:
                off = off | {start}
            answer = self.apart(start, goal, own, off)
            if answer is not None:
                return answer, None, None, None
            gx, gy, gz = at_goal or (0.0, 0.0, 0.0)
            scale = radius * rate if at_goal and rate == rate else 0.0
            out, at, sqrt, push, pop = self.out, self.at, math.sqrt, heapq.heappush, heapq.heappop

            def left(node):
                p = at.get(node) or own_at.get(node)
                if p is None:
                    return 0.0
                x, y, z = p[0] - gx, p[1] - gy, p[2] - gz
                return scale * sqrt(x * x + y * y + z * z)

            labels, done = {start: (0.0, 0.0, 0, "", "")}, {}
            heap, best = [(0.0, start)], inf
            while heap:
                bound, node = pop(heap)
                if bound > best + slack:
                    break
                cost, length, edges, _, _ = labels[node]
                if node == goal or done.get(node) == (cost, length, edges):
                    continue
                done[node] = (cost, length, edges)
                if node in off and node not in out:
                    return False, None, None, None
                for dst, c, m, leg, segment in out.get(node, none):
                    if without is not None and (segment is None or segment == without):
                        continue
                    label, old = (cost + c, length + m, edges + 1, leg, node), labels.get(dst)
                    if old is None or label < old:
                        labels[dst] = label
                        if dst == goal:
                            best = label[0]
                        elif old is None or label[:3] < old[:3]:
                            push(heap, (label[0] + left(dst), dst))
                for dst, c, m, leg in own.get(node, none):
                    label, old = (cost + c, length + m, edges + 1, leg, node), labels.get(dst)
                    if old is None or label < old:
                        labels[dst] = label
                        if dst == goal:
                            best = label[0]
                        elif old is None or label[:3] < old[:3]:
                            push(heap, (label[0] + left(dst), dst))
            if goal not in labels:
                return True, None, None, None
            legs, node = [], goal
            while node != start:
                legs.append(labels[node][3])
                node = labels[node][4]
            return True, shown(labels[goal][0]), shown(labels[goal][1]), [x for x in reversed(legs) if x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tile, divided = None, Tile(), True
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            found = []
            i, rows = 0, batch.num_rows
            while i < rows:
                j, t, kind = i + 1, c["tile"][i], c["kind"][i]
                while j < rows and c["tile"][j] == t and c["kind"][j] == kind:
                    j += 1
                if t != number:
                    number, tile, divided = t, Tile(), False
                if kind == 0:
                    tile.load(zip(*(c[x][i:j] for x in ("node", "dst", "segment_id", "leg", "length_m", "cost", "node_lng", "node_lat", "dst_lng", "dst_lat", "tx", "ty")), strict=True))
                else:
                    if not divided:
                        tile.off -= tile.out.keys()
                        tile.divide()
                        divided = True
                    for k in range(i, j):
                        own: dict = {}
                        own_at, own_off = {}, set()
                        for e in c["own"][k] or none:
                            own.setdefault(e["node"], []).append((e["dst"], ordered(e["cost"]), ordered(e["length_m"]), e["leg"] or ""))
                            if e["known"] and e["dst"] not in tile.out:
                                own_at[e["dst"]] = vector(e["lng"], e["lat"])
                                if not within(e["lng"], e["lat"], c["tx"][k], c["ty"][k]):
                                    own_off.add(e["dst"])
                        outside = c["at_node"][k] and not within(c["node_lng"][k], c["node_lat"][k], c["tx"][k], c["ty"][k])
                        found.append((c["n"][k], c["leg"][k], *tile.search(
                            c["node"][k], c["dst"][k], c["segment_id"][k], c["cost"][k] or 0.0, vector(c["dst_lng"][k], c["dst_lat"][k]), outside, own, own_at, own_off)))
                i = j
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*found), schema, strict=True)], schema=schema)

    return run
