"""Bridges of a street network by labels of its cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footscape.operators.components import contractions, heavy_keys, lookup
from footscape.operators.ranking import ranked
from footscape.session import stored


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge_id of a spanning forest, (node, tree)) for edges (edge_id, src, dst): the edges by which vertices were contracted.

    Of edges between the same two vertices, the smallest id counts. `tree` names each component by one of its nodes.
    """
    live = stored(edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("edge_id").alias("e")))
    nodes = stored(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    forest, tree = None, nodes.withColumn("tree", F.col("node"))
    for parents in contractions(live, "e"):
        got = parents.filter("v <> p").select(F.col("e").alias("edge_id"))
        forest = got if forest is None else forest.unionByName(got)
        counts = stored(tree.groupBy("tree").agg(F.count(F.lit(1)).alias("c")))
        tree = stored(lookup(tree, "tree", parents.select(F.col("v").alias("tree"), "p"), heavy_keys(counts, "tree", "c"), "left").select("node", F.coalesce("p", "tree").alias("tree")))
    return (edges.select("edge_id").limit(0) if forest is None else stored(forest)), tree


def bridges(edges: DataFrame) -> DataFrame:
    """(edge_id): the edges (edge_id, src, dst) without which their ends are no longer connected. Ids are distinct.

    Every edge off a spanning forest gets a random label of 128 bits, derived from its id. A forest edge is a bridge exactly
    if no such edge crosses the cut that it makes, and then the labels met at the nodes on one side of it add up (XOR) to
    zero. The sides are read off a tour that walks every tree edge both ways: between an edge's two directions lie
    the steps out of the nodes of one side. Sums from each step to the tour's end come by pointer doubling, with as
    many joins as the logarithm of the tour, each on distinct keys. An edge that is no bridge is taken for one with
    probability 2 ** -128. Loops and the second of parallel edges are never bridges.
    """
    edges = stored(edges.select("edge_id", "src", "dst"))  # read five times below; what it is made of may be costly
    forest, tree = spanning_forest(edges)
    # steps are told apart by numbers, twice the edge's and its way, so that the rounds shuffle no ids; an edge given twice is walked once,
    # for tours end only in a forest
    tree_edges = stored(edges.join(forest, "edge_id", "left_semi").dropDuplicates(["edge_id"]).withColumn("step", F.monotonically_increasing_id() * 2))
    label = [F.xxhash64("edge_id", F.lit(s)) for s in (1, 2)]
    ends = edges.join(forest, "edge_id", "left_anti").select(F.explode(F.array("src", "dst")).alias("node"), label[0].alias("x1"), label[1].alias("x2"))
    own = ends.groupBy("node").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    # steps (node -> other); the next step after one that arrives is the one behind its way back, in the order around the node
    steps = tree_edges.select("edge_id", "step", F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(0).alias("way")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("way")))).alias("s")).select("edge_id", "step", "s.*")
    around = stored(ranked(steps, ["node"], ["edge_id", "way"]))
    first = around.select(F.col("node"), F.col("rank"), (F.col("step") + F.col("way")).alias("next"))
    follow = around.select((F.col("step") + 1 - F.col("way")).alias("at"), "node", ((F.col("rank") + 1) % F.col("n")).alias("rank"))
    roots = tree.filter("node = tree").select("node")
    start = around.filter("rank = 0").join(roots, "node", "left_semi").select((F.col("step") + F.col("way")).alias("next"), F.lit(True).alias("first"))
    steps = follow.join(first, ["node", "rank"]).select("at", "next")
    # each tour ends before its root's first step
    steps = steps.join(start, "next", "left").select("at", F.when(F.col("first").isNull(), F.col("next")).alias("next"))
    worth = around.filter("rank = 0").join(own, "node").select((F.col("step") + F.col("way")).alias("at"), "x1", "x2")
    steps = steps.join(worth, "at", "left").select("at", "next", F.coalesce("x1", F.lit(0)).alias("x1"), F.coalesce("x2", F.lit(0)).alias("x2"))
    each = steps = stored(steps)
    while not (far := steps.filter("next IS NOT NULL")).isEmpty():
        then = steps.select(F.col("at").alias("next"), F.col("next").alias("on"), F.col("x1").alias("y1"), F.col("x2").alias("y2"))
        moved = far.join(then, "next").select("at", F.col("on").alias("next"), F.col("x1").bitwiseXOR(F.col("y1")).alias("x1"), F.col("x2").bitwiseXOR(F.col("y2")).alias("x2"))
        steps = stored(moved.unionByName(steps.filter("next IS NULL")))
    # what lies behind a step is its sum without its own worth
    behind = steps.select("at", "x1", "x2").unionByName(each.select("at", "x1", "x2"))
    cut = behind.groupBy((F.col("at") - F.pmod("at", F.lit(2))).alias("step")).agg(F.bit_xor("x1").alias("c1"), F.bit_xor("x2").alias("c2"))
    return tree_edges.join(cut.filter("c1 = 0 AND c2 = 0").select("step"), "step", "left_semi").select("edge_id")
