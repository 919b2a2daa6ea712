"""Connected components by contraction, with hubs split off, and the join that splits them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footscape.session import stored

#: A key is heavy when it holds at least this share of the rows, so there are at most so many heavy keys.
HEAVY_SHARE = 1 / 2000
#: Below so many rows a key is never heavy.
HEAVY_ROWS = 1000
#: When no more edges than this are left, one task settles them: a bound, whatever the size of the graph.
TAIL_EDGES = 4000


def heavy_keys(counts: DataFrame, key: str, count: str) -> DataFrame | None:
    """The keys that hold many rows, of a stored table of rows per key: at most 1 / HEAVY_SHARE, or None if there are none."""
    total, most = counts.agg(F.sum(count), F.max(count)).first()
    bar = max(HEAVY_ROWS, (total or 0) * HEAVY_SHARE)
    return counts.filter(F.col(count) >= bar).select(key) if (most or 0) >= bar else None


def lookup(rows: DataFrame, key: str, table: DataFrame, heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """`rows` joined with `table`, which has one row a `key`. Rows of heavy keys (a bounded list, or None) are joined where
    they are, by broadcast of these keys' entries; all others by a shuffle."""
    if heavy is None:
        return rows.join(table, key, how)
    few = F.broadcast(table.join(F.broadcast(heavy), key, "left_semi"))
    light = rows.join(F.broadcast(heavy), key, "left_anti").join(table, key, how)
    return light.unionByName(rows.join(F.broadcast(heavy), key, "left_semi").join(few, key, how))


def _jump(parents: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """`parents` (v, p, ...) with `above`, the parent's row (p, ...). `heavy`: the parents of many (x)."""
    up = parents.select(F.col("v").alias("x"), F.struct(*[c for c in parents.columns if c != "v"]).alias("above"))
    return lookup(parents.withColumn("x", F.col("p")), "x", up, heavy).drop("x")


def _many(parents: DataFrame) -> DataFrame | None:
    return heavy_keys(stored(parents.groupBy(F.col("p").alias("x")).agg(F.count(F.lit(1)).alias("c"))), "x", "c")


def contracted(edges: DataFrame, turn: int, *ids: str) -> tuple[DataFrame, DataFrame]:
    """(v, p, ids): the vertex that each vertex of `edges` (a, b, ids) becomes, and the edges (a, b, ids) that are left.

    Each vertex picks the neighbour that comes first in an order by hash, another one every turn. Picks lead, two steps
    on, to vertices no later in that order, so they form trees whose only cycles are two vertices that pick each other.
    Of these, the one with more edges is the root, so a hub takes all its leaves at once. A vertex whose root is more
    than two steps away stays what it is, with its edges, until the next turn. `ids` are those of the edge that a
    vertex has picked, and of the edges that are left the smallest ones.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *ids))
    order = F.struct(F.xxhash64("b", F.lit(turn)), F.col("b").alias("p"), *ids)
    picks = stored(both.groupBy(F.col("a").alias("v")).agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("c")).select("v", "o.p", "c", *[f"o.{i}" for i in ids]))
    heavy = heavy_keys(picks, "v", "c")
    # a vertex that many pick has as many edges
    met = _jump(picks, None if heavy is None else heavy.withColumnRenamed("v", "x"))
    rank = lambda c, v: F.struct(-c, F.xxhash64(v, F.lit(turn)), v)
    root = (F.col("above.p") == F.col("v")) & (rank(F.col("c"), F.col("v")) < rank(F.col("above.c"), F.col("p")))
    parents = stored(met.select("v", F.when(root, F.col("v")).otherwise(F.col("p")).alias("p"), *ids))
    parents = stored(_jump(parents, _many(parents)).select("v", F.col("above.p").alias("p"), *ids))
    parents = _jump(parents, _many(parents))
    parents = stored(parents.select("v", F.when(F.col("p") == F.col("above.p"), F.col("p")).otherwise(F.col("v")).alias("p"), *ids))
    at = lambda rows, c: lookup(rows.withColumnRenamed(c, "v"), "v", parents.select("v", "p"), heavy).drop("v").withColumnRenamed("p", c)
    left = at(at(edges, "a"), "b").filter(F.col("a") != F.col("b"))
    left = left.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(*[F.min(i).alias(i) for i in ids]) if ids else left.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    return parents, stored(left.withColumnRenamed("x", "a").withColumnRenamed("y", "b"))


def settled(edges: DataFrame, *ids: str) -> DataFrame:
    """(v, p, ids) for the last few edges (a, b, ids): each vertex's root, and the edge by which it was joined to others."""
    kinds = dict(edges.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}
        by: dict = {}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for f in frames:
            for a, b, *e in f.itertuples(index=False, name=None):
                root.setdefault(a, a)
                root.setdefault(b, b)
                a, b = find(a), find(b)
                if a != b:
                    root[b], by[b] = a, e
        yield pd.DataFrame([(v, find(v), *by.get(v, [None] * len(ids))) for v in root], columns=["v", "p", *ids])

    schema = ", ".join([f"v {kinds['a']}", f"p {kinds['a']}", *[f"{i} {kinds[i]}" for i in ids]])
    return stored(edges.select("a", "b", *ids).coalesce(1).mapInPandas(run, schema))


def contractions(live: DataFrame, *ids: str) -> Iterator[DataFrame]:
    """The tables (v, p, ids) of all turns, until no edge (a, b, ids) is left."""
    turn = 0
    while left := live.count():
        if left <= TAIL_EDGES:
            yield settled(live, *ids)
            return
        parents, live = contracted(live, turn, *ids)
        yield parents
        turn += 1


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with the lowest node as component, for edges (src, dst).

    Edges are contracted turn by turn until none is left, whatever their number; what has been settled leaves the loop, and
    a bounded rest is settled by one task.
    Then the trees of all turns are put together from the last to the first. Keys that hold many rows (a hub's edges, the
    vertices of a giant component) are joined by broadcast of these few keys, so no task gets all rows of one.
    A node that only has an edge with itself is its own component; edges with a null end are passed over.
    """
    pairs = stored(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL"))
    live = stored(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    turns = list(contractions(live))
    alone = pairs.filter("a = b").select(F.col("a").alias("node")).distinct()
    if not turns:
        return alone.withColumn("component", F.col("node"))
    final = turns[-1]
    for parents in reversed(turns[:-1]):
        counts = stored(parents.groupBy("p").agg(F.count(F.lit(1)).alias("c")))
        above = final.select(F.col("v").alias("p"), F.col("p").alias("root"))
        final = stored(lookup(parents, "p", above, heavy_keys(counts, "p", "c"), "left").select("v", F.coalesce("root", "p").alias("p")))
    lows = stored(final.groupBy("p").agg(F.min("v").alias("component"), F.count(F.lit(1)).alias("c")))
    found = lookup(final, "p", lows.select("p", "component"), heavy_keys(lows, "p", "c")).select(F.col("v").alias("node"), "component")
    return found.unionByName(alone.join(final.select(F.col("v").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component")))
