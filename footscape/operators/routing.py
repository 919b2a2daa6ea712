"""Batch least-cost routing as DataFrame relaxation."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footscape import params as P
from footscape.functions import geo as G
from footscape.functions.numbers import half_up, half_up_int, lookup
from footscape.operators.components import connected_components
from footscape.operators.spatial import snap_points
from footscape.operators.tile_routes import TILE_DEGREES, answered
from footscape.session import cut, stored

VARIANTS = ["recommended", "balanced", "shortest"]


def barrier_set(edges: DataFrame) -> DataFrame:
    """Add `blocks`: barriers and hard blocks together."""
    none = F.array().cast("array<string>")
    return edges.withColumn("blocks", F.array_union(F.coalesce("barriers", none), F.coalesce("hard_blocks", none)))


def profiles(spark: SparkSession) -> DataFrame:
    """The cost profiles: each mobility profile with and without preference for verified data, and pure length."""
    rows = [(p, v) for p in P.PROFILES for v in (False, True)] + [(P.SHORTEST, False)]
    return spark.createDataFrame(rows, "profile string, prefer_verified boolean")


def edge_cost(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Price every edge for every wanted (profile, prefer_verified).

    `wanted` is one of the nine fixed combinations per row, so its size is bounded.
    Adds `forbidden`, `blocked_by`, `cost` (null when forbidden) and its parts.
    """
    e = barrier_set(edges).withColumns({
        "status": F.coalesce("status", F.lit("unverified")), "_len": F.greatest(F.lit(0.0), F.coalesce("length_m", F.lit(0.0)))})
    codes = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(v).alias("prefer_verified"))
                      for p in [*P.PROFILES, P.SHORTEST] for v in (False, True)])
    x = e.withColumn("_p", F.explode(codes)).withColumns({
        "profile": F.col("_p")["profile"], "prefer_verified": F.col("_p")["prefer_verified"]}).drop("_p")
    x = x.join(F.broadcast(wanted.distinct()), ["profile", "prefer_verified"], "left_semi")
    prof, status, blocks, length = F.col("profile"), F.col("status"), F.col("blocks"), F.col("_len")
    shortest = prof == P.SHORTEST

    def per_profile(fn) -> Column:
        out = None
        for p in P.PROFILES:
            out = F.when(prof == p, fn(p)) if out is None else out.when(prof == p, fn(p))
        return out

    mult = per_profile(lambda p: lookup(status, {k: v for k, v in P.STATUS_MULTIPLIER[p].items() if v is not None}))
    barred = per_profile(lambda p: F.array_intersect(F.array(*[F.lit(b) for b in P.FORBIDDEN[p]]).cast("array<string>"), blocks))
    blocked = F.when(shortest, F.array().cast("array<string>")).otherwise(F.concat(
        barred, F.when(mult.isNull(), F.array(F.concat(F.lit("status:"), status))).otherwise(F.array().cast("array<string>"))))

    def metres(p):
        terms = [F.when(F.array_contains(blocks, b), F.lit(float(m))).otherwise(F.lit(0.0)) for b, m in P.BARRIER_METRES[p].items()]
        return sum(terms[1:], terms[0])

    unknown = lookup(prof, P.UNKNOWN_RATE) * F.when(F.col("prefer_verified"), 2.0).otherwise(1.0)
    stale = F.when(F.col("freshness_state") == "stale", 1.0).when(F.col("freshness_state") == "none", 1.3).otherwise(0.0)
    x = x.withColumns({
        "blocked_by": blocked, "status_cost": F.when(shortest, length).otherwise(length * mult),
        "barrier_cost": F.when(shortest, 0.0).otherwise(per_profile(metres)),
        "unknown_cost": F.when(shortest | (status != "unverified"), 0.0).otherwise(length * unknown),
        "stale_cost": F.when(shortest, 0.0).otherwise(length * lookup(prof, P.STALE_RATE) * stale),
    }).withColumn("forbidden", F.size("blocked_by") > 0)
    total = F.col("status_cost") + F.col("barrier_cost") + F.col("unknown_cost") + F.col("stale_cost")
    return x.withColumn("cost", F.when(~F.col("forbidden"), total)).drop("_len")


#: Tables of labels that are kept apart before they are put together.
GENERATIONS = 12
#: Labels move on so many edges before they are compared that a round makes about so many of them, at three ways on a node; 3 edges at most, as longer ones make long plans.
LABELS_A_ROUND, MOST_EDGES = 1_000_000, 3


def _least(tables: list[DataFrame]) -> DataFrame:
    """The least label of each search and node."""
    all_ = functools.reduce(DataFrame.unionByName, tables)
    return all_.groupBy("search_id", "node").agg(F.min(F.struct("b", "prev", "arrived")).alias("m")).select("search_id", "node", "m.b", "m.prev", "m.arrived")


def least_cost_paths(searches: DataFrame, edges: DataFrame, nodes: DataFrame, extra: DataFrame | None = None, reachable: bool = False) -> DataFrame:
    """Least-cost paths for many searches at once.

    searches: (search_id, profile, prefer_verified, region_id, start, goal[, without][, goal_lng, goal_lat, start_at, goal_at]);
    `without` is a segment to leave out, `start_at` and `goal_at` are nodes of the network that stand for ends off it when
    components are compared.  edges: (segment_id, reversed, region_id, src, dst, length_m, profile,
    prefer_verified, cost), forbidden ones removed.  nodes: (node, lng, lat).  extra: an overlay of further edges of single
    searches (search_id, segment_id, reversed, src, dst, length_m, cost, span_m).  With `reachable` every goal is known to be.

    Searches are first tried within tiles of the map (`tile_routes.answered`), where one is settled if its path provably beats every way
    out of the tile. What no tile settles is relaxed in rounds (`_relaxed`), whatever its reach. Equal costs are settled by length,
    number of edges and last edge, so results repeat.
    Returns one row per search: found, cost, length_m, path (segment ids), legs (the same with a
    leading minus where a segment is walked backwards), and the reason where none is found.
    """
    for c, kind in (("without", "string"), ("goal_lng", "double"), ("goal_lat", "double"), ("start_at", "string"), ("goal_at", "string")):
        searches = searches if c in searches.columns else searches.withColumn(c, F.lit(None).cast(kind))
    graph = F.concat_ws("|", "region_id", "profile", "prefer_verified").alias("graph")
    at = lambda name: nodes.select(F.col("node").alias(name), F.col("lng").alias(f"{name}_lng"), F.col("lat").alias(f"{name}_lat"))
    leg = F.concat(F.when(F.col("reversed"), "-").otherwise(""), F.col("segment_id")).alias("leg")
    e = edges.select(graph, F.col("src").alias("node"), "dst", "segment_id", "length_m", "cost", leg)
    e = e.join(at("node"), "node").join(at("dst"), "dst")
    span = G.haversine(F.col("node_lng"), F.col("node_lat"), F.col("dst_lng"), F.col("dst_lat"))
    e = stored(e.withColumn("rate", F.when(span > 0, F.col("cost") / span)))
    s = searches.select("search_id", graph, "start", "goal", "without", "start_at", "goal_at", F.col("goal_lng").alias("_glng"), F.col("goal_lat").alias("_glat")).join(at("goal"), "goal", "left")
    s = s.withColumns({"goal_lng": F.coalesce("_glng", "goal_lng"), "goal_lat": F.coalesce("_glat", "goal_lat"), "start_at": F.coalesce("start_at", "start"), "goal_at": F.coalesce("goal_at", "goal")}).drop("_glng", "_glat")
    rates = e.select("graph", "rate")
    if extra is not None:
        extra = stored(extra.select("search_id", F.col("src").alias("node"), "dst", "segment_id", "length_m", "cost", leg, "span_m"))
        rates = rates.unionByName(extra.filter("span_m > 0").join(s.select("search_id", "graph"), "search_id").select("graph", (F.col("cost") / F.col("span_m")).alias("rate")))
    s = s.join(rates.groupBy("graph").agg((F.min("rate") * 0.999).alias("rate")), "graph", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    # where a search lies: between its ends, or at the one that is known; one without a known end has no edges anywhere
    s = s.join(at("start").withColumn("at_node", F.lit(True)), "start", "left").join(at("start_at"), "start_at", "left").withColumn("at_node", F.col("at_node").isNotNull())
    mid = {f"mid_{x}": F.coalesce((F.coalesce(f"start_{x}", f"start_at_{x}") + F.col(f"goal_{x}")) / 2, f"start_{x}", f"start_at_{x}", f"goal_{x}", F.lit(0.0)) for x in ("lng", "lat")}
    away = lambda x: F.abs(F.coalesce(f"start_{x}", f"start_at_{x}") - F.col(f"goal_{x}"))
    s = s.withColumns({**mid, "apart": F.coalesce(F.greatest(away("lng"), away("lat")), F.lit(0.0))}).drop("start_at_lng", "start_at_lat")
    if extra is None:
        s = s.withColumn("own", F.lit(None).cast("array<struct<node:string,dst:string,length_m:double,cost:double,leg:string,known:boolean,lng:double,lat:double>>"))
    else:
        lies = extra.join(at("dst").withColumn("known", F.lit(True)), "dst", "left")
        lies = lies.select("search_id", F.struct("node", "dst", "length_m", "cost", "leg", F.col("known").isNotNull().alias("known"), F.col("dst_lng").alias("lng"), F.col("dst_lat").alias("lat")).alias("x"))
        s = s.join(lies.groupBy("search_id").agg(F.collect_list("x").alias("own")), "search_id", "left")
    left = s = stored(s.withColumn("n", F.monotonically_increasing_id()))
    results = []
    for width in TILE_DEGREES:
        results.append(stored(answered(left, e, width)).filter("settled"))
        left = stored(left.join(results[-1].select("n"), "n", "left_anti"))
        if left.isEmpty():
            break
    else:
        results.append(_relaxed(left, e, extra, reachable))
    out = functools.reduce(DataFrame.unionByName, [x.select("search_id", "cost", "length_m", "legs") for x in results])
    return out.select(
        "search_id", F.col("legs").isNotNull().alias("found"), "cost", "length_m", "legs",
        F.transform("legs", lambda x: F.ltrim(x, F.lit("-"))).alias("path"), F.when(F.col("legs").isNull(), "no_path").alias("reason"))


def _relaxed(s: DataFrame, e: DataFrame, extra: DataFrame | None, reachable: bool) -> DataFrame:
    """(search_id, cost, length_m, legs) of searches by relaxation in rounds; tables as in `least_cost_paths`.

    Each round moves the frontier some edges on (one where it is large, up to MOST_EDGES where it is small): along the shared edges of its graph and along the search's own overlay. Only
    the frontier is shuffled. Labels of earlier rounds stay where they were written; a new label that one of them, or
    a cheaper arrival, beats is dropped by a join that sends the new labels to them. A label counts at least
    its cost plus the straight distance to the goal at the cheapest cost per metre of its graph.
    Rounds go on until no label improves.
    """
    # dealt out by graph and node once; rounds only read it
    e = stored(e.drop("node_lng", "node_lat", "rate").repartition("graph", "node").sortWithinPartitions("graph", "node"))
    s = s.select("search_id", "graph", "start", "goal", "without", "start_at", "goal_at", "goal_lng", "goal_lat", "rate")
    if reachable:
        s = stored(s.withColumn("_open", F.lit(True)))
    else:
        # a goal in another component is never reached: such searches would walk their whole component first
        name = lambda c: F.concat_ws("|", "graph", c)
        comp = stored(connected_components(e.select(name("node").alias("src"), name("dst").alias("dst"))))
        s = s.withColumns({"_a": name("start_at"), "_z": name("goal_at")})
        s = s.join(comp.select(F.col("node").alias("_a"), F.col("component").alias("_ca")), "_a", "left").join(
            comp.select(F.col("node").alias("_z"), F.col("component").alias("_cz")), "_z", "left")
        s = stored(s.withColumn("_open", (F.col("start") == F.col("goal")) | F.coalesce(F.col("_ca") == F.col("_cz"), F.lit(False))).drop("_a", "_z", "_ca", "_cz"))
    own = ["graph", "goal", "without", "rate", "goal_lng", "goal_lat"]  # of the search, carried by its frontier
    label = "struct<cost:double,len:double,edges:int,leg:string>"
    start = F.struct(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit("")).cast(label).alias("b")
    frontier = stored(s.filter("_open").select("search_id", F.col("start").alias("node"), start, F.lit(None).cast("string").alias("prev"), (F.col("start") == F.col("goal")).alias("arrived"), *own))
    settled = [frontier.drop(*own)]
    cols = ["search_id", *own, "bound"]

    def moved(labels: DataFrame) -> DataFrame:
        """Labels one edge on, of those that haven't arrived and that the cheapest arrival so far doesn't beat."""
        labels = labels.filter(F.col("node") != F.col("goal"))
        step = labels.join(e, ["graph", "node"]).filter((F.col("without").isNull() | (F.col("segment_id") != F.col("without"))) & ~F.col("dst").eqNullSafe(F.col("prev")))
        left = F.col("rate") * F.coalesce(G.haversine(F.col("dst_lng"), F.col("dst_lat"), F.col("goal_lng"), F.col("goal_lat")), F.lit(0.0))
        step = step.select(*cols, "node", "b", "dst", "leg", "length_m", "cost", left.alias("left"))
        if extra is not None:
            step = step.unionByName(labels.join(extra, ["search_id", "node"]).select(*cols, "node", "b", "dst", "leg", "length_m", "cost", F.lit(0.0).alias("left")))
        step = step.withColumn("cost", F.col("b")["cost"] + F.col("cost")).filter(F.col("bound").isNull() | (F.col("cost") + F.col("left") <= F.col("bound") + 1e-6))
        return step.select(*cols, F.col("dst").alias("node"), F.col("node").alias("prev"),
                           F.struct(F.col("cost"), F.col("b")["len"] + F.col("length_m"), F.col("b")["edges"] + 1, F.col("leg")).cast(label).alias("b"))

    while count := frontier.count():
        edges_on = max(1, min(MOST_EDGES, int(math.log(LABELS_A_ROUND / count, 3)))) if count < LABELS_A_ROUND else 1
        known = functools.reduce(DataFrame.unionByName, settled)
        # the cheapest arrival so far bounds every other label of the search
        best = known.filter("arrived").groupBy("search_id").agg(F.min("b.cost").alias("bound"))
        live = frontier.join(best, "search_id", "left").select(*cols, "node", "prev", "b").filter(F.col("bound").isNull() | (F.col("b")["cost"] <= F.col("bound")))
        steps = [moved(live)]
        for _ in range(edges_on - 1):
            steps.append(moved(steps[-1]))
        step = functools.reduce(DataFrame.unionByName, steps)
        new = stored(step.groupBy("search_id", "node").agg(F.min(F.struct("b", "prev")).alias("m"), F.first(F.struct(*own)).alias("s")).select(
            "search_id", "node", "m.b", "m.prev", (F.col("node") == F.col("s.goal")).alias("arrived"), "s.*"))
        old = known.select("search_id", "node", F.col("b").alias("old"))
        beaten = old.join(new.select("search_id", "node", "b"), ["search_id", "node"]).filter(F.col("old") <= F.col("b")).select("search_id", "node").distinct()
        frontier = stored(new.join(beaten, ["search_id", "node"], "left_anti"))
        settled.append(frontier.drop(*own))
        if len(settled) > GENERATIONS:
            settled = [stored(_least(settled))]
    labels = stored(_least(settled))
    arrived = labels.filter("arrived")
    paths = reconstruct_paths(arrived, labels)
    return s.join(paths, "search_id", "left").select("search_id", "cost", "length_m", "legs")


def reconstruct_paths(arrived: DataFrame, labels: DataFrame) -> DataFrame:
    """(search_id, cost, length_m, legs) of arrived labels, by pointer doubling.

    labels: (search_id, node, b, prev), each with the node before it.  Tables of the label 1, 2, 4, ... edges before each are made of
    the labels of found searches, until no label has one so far back; then, from the longest jump to the shortest, every
    label known to be on a path names the one that far before it. So joins are as many as the logarithm of the edges
    of the longest path.
    """
    own = labels.filter("prev IS NOT NULL").join(arrived.select("search_id").distinct(), "search_id", "left_semi")
    jumps = [stored(own.select("search_id", "node", F.col("prev").alias("far")))]
    while True:
        last = jumps[-1]
        twice = stored(last.join(last.select("search_id", F.col("node").alias("far"), F.col("far").alias("further")), ["search_id", "far"]).select("search_id", "node", F.col("further").alias("far")))
        if twice.isEmpty():
            break
        jumps.append(twice)
    on = arrived.select("search_id", "node", F.lit(0).alias("back"))
    for k in range(len(jumps) - 1, -1, -1):
        more = on.join(jumps[k], ["search_id", "node"]).select("search_id", F.col("far").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        on = stored(on.unionByName(more))
    legs = on.join(labels.select("search_id", "node", F.col("b")["leg"].alias("leg")), ["search_id", "node"]).filter("leg <> ''")
    legs = legs.groupBy("search_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "leg"))).alias("l")).select("search_id", F.col("l.leg").alias("legs"))
    ends = arrived.select("search_id", F.col("b")["cost"].alias("cost"), F.col("b")["len"].alias("length_m"))
    return ends.join(legs, "search_id", "left").withColumn("legs", F.coalesce("legs", F.array().cast("array<string>")))


def route_searches(requests: DataFrame) -> DataFrame:
    """The three compared variants of every request, as searches."""
    rows = F.array(
        F.struct(F.lit("recommended").alias("variant"), F.col("profile").alias("profile"), F.col("prefer_verified").alias("prefer_verified")),
        F.struct(F.lit("balanced").alias("variant"), F.lit("balanced").alias("profile"), F.lit(False).alias("prefer_verified")),
        F.struct(F.lit("shortest").alias("variant"), F.lit(P.SHORTEST).alias("profile"), F.lit(False).alias("prefer_verified")))
    return requests.select(
        "request_id", "region_id", F.col("origin_node").alias("start"), F.col("goal_node").alias("goal"), F.explode(rows).alias("v")).select(
        F.concat_ws("|", "request_id", "v.variant").alias("search_id"), "request_id", "region_id", "start", "goal", "v.*")


def virtual_endpoints(requests: DataFrame, edges: DataFrame, radius_m: float = P.SNAP_RADIUS_M) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapped requests, extra edges per request, requests off the network).

    The snapped edge is split at the foot point; the halves inherit its
    attributes.  When both ends fall on one edge they are also linked directly.
    `edges` holds each segment once, in its own direction; where requests have a region, only its edges count.
    Every extra edge has its own `leg_id`, and is `reversed` where it runs against its segment.
    """
    region = ["region_id"] if "region_id" in requests.columns else []
    sides = requests.select("request_id", *region, F.explode(F.array(
        F.struct(F.lit("origin").alias("side"), F.col("origin").alias("p")),
        F.struct(F.lit("destination").alias("side"), F.col("destination").alias("p")))).alias("s"))
    points = sides.select(F.concat_ws("|", "request_id", "s.side").alias("point_id"), "s.p.lng", "s.p.lat", *region)
    snaps = cut(snap_points(points, edges, radius_m, within=bool(region))).select(
        F.element_at(F.split("point_id", "\\|"), 1).alias("request_id"), F.element_at(F.split("point_id", "\\|"), 2).alias("side"),
        "dist", "segment_id", "idx", "t", "foot")
    attrs = edges.drop("length_m", "from_node", "to_node", "geometry")
    # edges grow with the network, whatever Spark expects of their size: they are not broadcast
    at = snaps.join(edges.select("segment_id", "from_node", "to_node", "geometry").hint("merge"), "segment_id")
    virtual = F.concat(F.lit("@"), F.col("request_id"), F.lit("|"), F.col("side"))
    head = F.concat(F.slice("geometry", 1, F.col("idx") + 1), F.array("foot"))
    tail = F.concat(F.array("foot"), F.slice("geometry", F.col("idx") + 2, F.greatest(F.size("geometry") - F.col("idx") - 1, F.lit(1))))

    def both_ways(src: Column, dst: Column, line: Column, suffix: str, owner: Column) -> list[Column]:
        tag = F.concat(F.lit(f"{suffix}@"), owner)
        return [F.struct(src.alias("src"), dst.alias("dst"), line.alias("geometry"), F.lit(False).alias("reversed"), F.lit(suffix).alias("suffix"), tag.alias("tag")),
                F.struct(dst.alias("src"), src.alias("dst"), F.reverse(line).alias("geometry"), F.lit(True).alias("reversed"), F.lit(suffix).alias("suffix"), tag.alias("tag"))]

    own = F.concat_ws("|", "request_id", "side")
    halves = at.select("request_id", "segment_id", F.explode(F.array(
        *both_ways(F.col("from_node"), virtual, head, "#a", own), *both_ways(virtual, F.col("to_node"), tail, "#b", own))).alias("h"))
    o = at.filter("side = 'origin'").select("request_id", "segment_id", "geometry", F.struct("idx", "t", "foot").alias("a"), virtual.alias("va"))
    d = at.filter("side = 'destination'").select("request_id", "segment_id", F.struct("idx", "t", "foot").alias("b"), virtual.alias("vb"))
    both = o.join(d.hint("merge"), ["request_id", "segment_id"])
    first, second = F.least("a", "b"), F.greatest("a", "b")
    middle = F.concat(F.array(first["foot"]), F.slice("geometry", first["idx"] + 2, F.greatest(second["idx"] - first["idx"], F.lit(0))), F.array(second["foot"]))
    forward = F.col("a") <= F.col("b")
    link = both.withColumn("m", middle).select("request_id", "segment_id", F.explode(F.array(*both_ways(
        F.when(forward, F.col("va")).otherwise(F.col("vb")), F.when(forward, F.col("vb")).otherwise(F.col("va")), F.col("m"), "#direct", F.col("request_id")))).alias("h"))
    extra = halves.unionByName(link).select("request_id", "segment_id", "h.*").join(attrs.hint("merge"), "segment_id").withColumns({
        "edge_id": F.concat("segment_id", "suffix"), "leg_id": F.concat("segment_id", "tag"), "length_m": G.line_length(F.col("geometry"))}).drop("suffix", "tag")
    side = lambda x, c: F.max(F.when(F.col("side") == x, F.col(c)))
    where = at.groupBy("request_id").agg(
        side("origin", "segment_id").alias("origin_segment"), side("destination", "segment_id").alias("destination_segment"), side("origin", "from_node").alias("start_at"),
        side("destination", "from_node").alias("goal_at"), side("destination", "foot").alias("goal_foot"), side("origin", "dist").alias("origin_m"), side("destination", "dist").alias("destination_m"))
    j = requests.drop("origin_node", "goal_node").join(where.hint("merge"), "request_id", "left")
    ok = F.col("origin_segment").isNotNull() & F.col("destination_segment").isNotNull()
    snapped = j.filter(ok).withColumns({
        "origin_node": F.concat(F.lit("@"), F.col("request_id"), F.lit("|origin")),
        "goal_node": F.concat(F.lit("@"), F.col("request_id"), F.lit("|destination"))})
    off = j.filter(~ok).select("request_id", F.when(F.col("origin_segment").isNull(), "origin_off_network").otherwise("destination_off_network").alias("reason"))
    return snapped, extra, off


def route_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per edge of each path (search_id, legs), in order and in travel direction."""
    steps = paths.select("search_id", F.posexplode("legs").alias("pos", "leg")).select(
        "search_id", "pos", F.ltrim("leg", F.lit("-")).alias("segment_id"), F.startswith("leg", F.lit("-")).alias("reversed"))
    return steps.join(edges, ["segment_id", "reversed"]).withColumn("status", F.coalesce("status", F.lit("unverified")))


def edge_status_metres(legs: DataFrame) -> DataFrame:
    """Metres per status, and stale metres, per route."""
    def metres(cond):
        return F.sum(F.when(cond, F.col("length_m")).otherwise(0.0))

    return legs.groupBy("search_id").agg(
        *[metres(F.col("status") == s).alias(f"{s}_m") for s in P.STATUSES],
        metres(F.col("freshness_state").isin("stale", "none")).alias("stale_m"), F.sum("length_m").alias("total_m"))


def route_barriers(legs: DataFrame) -> DataFrame:
    """Metres affected per barrier and route."""
    b = barrier_set(legs).select("search_id", "length_m", F.explode(F.array_distinct("blocks")).alias("barrier"))
    return b.groupBy("search_id", "barrier").agg(F.sum("length_m").alias("_m")).select(
        "search_id", "barrier", half_up_int(F.col("_m")).alias("metres"))


def route_summary(legs: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per found route; `routes` gives search_id, request_id, variant and profile.

    The score needs at least half of the metres assessed; extra distance is
    against the shortest variant of the same request.
    """
    scored = F.col("accessibility_score").isNotNull() & (F.col("status") != "unverified")
    trusted = F.col("evidence_confidence").isNotNull()
    sums = legs.groupBy("search_id").agg(
        F.sum(F.when(scored, F.col("accessibility_score") * F.col("length_m")).otherwise(0.0)).alias("_sw"),
        F.sum(F.when(scored, F.col("length_m")).otherwise(0.0)).alias("_sm"),
        F.sum(F.when(trusted, F.col("evidence_confidence") * F.col("length_m")).otherwise(0.0)).alias("_cw"),
        F.sum(F.when(trusted, F.col("length_m")).otherwise(0.0)).alias("_cm"))
    blocked = barrier_set(legs).select("search_id", F.explode("blocks").alias("b")).groupBy("search_id").agg(
        F.sort_array(F.collect_set("b")).alias("barriers"))  # bounded by the vocabulary
    none = F.array().cast("array<string>")
    r = routes.join(edge_status_metres(legs), "search_id").join(sums, "search_id").join(blocked, "search_id", "left").withColumn(
        "barriers", F.coalesce("barriers", none))
    short = r.filter("variant = 'shortest'").select("request_id", F.col("total_m").alias("_short"), F.col("barriers").alias("_sb"))
    r = r.join(short, "request_id", "left")
    total, share = F.col("total_m"), F.col("_sm") / F.col("total_m")
    unknown = F.when(total > 0, F.col("unverified_m") / total).otherwise(F.lit(0.0))
    r = r.withColumns({
        "distance_m": half_up_int(total),
        "accessibility_score": F.when((total > 0) & (share >= P.MIN_ASSESSED_SHARE) & (F.col("_sm") > 0), half_up_int(F.col("_sw") / F.col("_sm"))),
        "assessed_share": half_up(F.when(total > 0, share).otherwise(F.lit(0.0)), 3),
        "evidence_confidence": F.when(F.col("_cm") > 0, half_up_int(F.col("_cw") / F.col("_cm"))).otherwise(0),
        "unknown_ratio": half_up(unknown, 3), "unknown_percent": half_up_int(unknown * 100), "high_unknown": unknown >= P.HIGH_UNKNOWN,
        "extra_distance_m": half_up_int(total - F.col("_short")),
        "extra_distance_percent": F.when(F.col("_short") > 0, half_up_int((total - F.col("_short")) / F.col("_short") * 100)),
        "barriers_avoided": F.array_except(F.coalesce("_sb", none), F.col("barriers")),
    })
    return estimate_duration(r).drop("_sw", "_sm", "_cw", "_cm", "_short", "_sb")


def estimate_duration(routes: DataFrame) -> DataFrame:
    speed = lookup(F.col("profile"), P.SPEED_MPS, P.SPEED_MPS["balanced"])
    return routes.withColumn("duration_s", half_up_int(F.col("total_m") / speed))


def explain_route(summary: DataFrame) -> DataFrame:
    """Add `reasons`: ordered keys that explain a route."""
    c = F.col
    dist = c("distance_m")
    share = F.when(dist > 0, half_up(c("accessible_m")) / dist).otherwise(F.lit(0.0))
    items = [
        (c("variant") == "shortest", "shortest_only_distance"), (share >= 0.7, "mostly_assessed_accessible"),
        (F.size("barriers_avoided") > 0, "barriers_avoided"), (F.size("barriers") > 0, "barriers_remaining"),
        (c("high_unknown"), "high_unknown"), (~c("high_unknown") & (c("unknown_percent") > 0), "some_unknown"),
        (c("extra_distance_m") > 20, "extra_distance"),
        ((c("extra_distance_m") <= 20) & (c("variant") != "shortest"), "no_extra_distance"),
        (half_up(c("stale_m")) > 0, "stale_evidence"), (c("prefer_verified"), "prefer_verified"),
    ]
    return summary.withColumn("reasons", F.array_compact(F.array(*[F.when(x, F.lit(f"route.reason.{k}")) for x, k in items])))


def route_steps(legs: DataFrame) -> DataFrame:
    """Turn-by-turn steps: manoeuvre, street, metres, worst status, barriers; ends with an arrival row."""
    g = F.col("geometry")
    b = barrier_set(legs).withColumns({
        "_out": G.bearing(F.get(g, F.lit(0)), F.get(g, F.lit(1))), "_in": G.bearing(F.get(g, F.size(g) - 2), F.get(g, F.size(g) - 1))})
    w = Window.partitionBy("search_id").orderBy("pos")
    turn = half_up(G.signed_turn(F.lag("_in").over(w), F.col("_out")), 6)
    turn = F.when(turn >= 180, turn - 360).otherwise(turn)  # turning round counts as left
    side = F.when(turn > 0, "right").otherwise("left")
    move = (F.when(F.col("pos") == 0, F.lit("depart")).when(F.abs(turn) >= P.SHARP_TURN_DEG, F.concat(F.lit("sharp_"), side))
            .when(F.abs(turn) >= P.TURN_DEG, F.concat(F.lit("turn_"), side)).otherwise("continue"))
    b = b.withColumn("manoeuvre", move)
    new = (F.col("manoeuvre") != "continue") | ~F.col("street_name").eqNullSafe(F.lag("street_name").over(w))
    b = b.withColumn("_n", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = lookup(F.col("status"), {"accessible": 0, "partial": 1, "unverified": 2, "inaccessible": 3}, 2, "int")
    steps = b.groupBy("search_id", "_n").agg(
        F.min_by("manoeuvre", "pos").alias("manoeuvre"), F.min_by("street_name", "pos").alias("street_name"),
        half_up_int(F.sum("length_m")).alias("distance_m"), F.max_by("status", rank).alias("status"),
        F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("barriers"),
        F.min_by(F.get(g, F.lit(0)), "pos").alias("at"), F.max_by(F.get(g, F.size(g) - 1), "pos").alias("end_at"))
    last = steps.groupBy("search_id").agg((F.max("_n") + 1).alias("_n"), F.max_by("street_name", "_n").alias("street_name"), F.max_by("end_at", "_n").alias("at"))
    arrive = last.select("search_id", "_n", F.lit("arrive").alias("manoeuvre"), "street_name", F.lit(0).alias("distance_m"),
                         F.lit(None).cast("string").alias("status"), F.array().cast("array<string>").alias("barriers"), "at")
    return steps.drop("end_at").unionByName(arrive).withColumnRenamed("_n", "step")


def stitch_geometry(legs: DataFrame) -> DataFrame:
    """One polyline per route without repeated consecutive points."""
    lines = legs.groupBy("search_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "geometry"))), lambda x: x["geometry"])).alias("g"))
    return lines.select("search_id", F.filter("g", lambda p, i: (i == 0) | ~p.eqNullSafe(F.get("g", i - 1))).alias("geometry"))


def route_pieces(routes: DataFrame) -> DataFrame:
    """Straight pieces of route polylines with the metres left behind each."""
    p = routes.select("search_id", F.posexplode(G.pieces(F.col("geometry"))).alias("idx", "p")).select("search_id", "idx", "p.a", "p.b")
    p = p.withColumn("len", G.distance(F.col("a"), F.col("b")))
    after = Window.partitionBy("search_id").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    return p.withColumn("left_m", F.coalesce(F.sum("len").over(after), F.lit(0.0)))


def progress_on_route(pings: DataFrame, routes: DataFrame) -> DataFrame:
    """Per ping: metres off the route, off-route flag and metres remaining."""
    pieces = route_pieces(routes)
    kx, ky = G.scale(F.col("lat"))
    j = G.with_nearest(pings.withColumns({"kx": kx, "ky": ky}).join(pieces, "search_id"), F.col("lng"), F.col("lat"), F.col("a"), F.col("b"))
    foot = G.along(F.col("a"), F.col("b"), F.col("t"))
    j = j.withColumn("n", F.struct(F.col("dist").alias("d"), F.col("idx"), (G.distance(foot, F.col("b")) + F.col("left_m")).alias("rest")))
    return j.groupBy("ping_id", "search_id").agg(F.min("n").alias("n")).select(
        "ping_id", "search_id", F.col("n")["d"].alias("off_m"), (F.col("n")["d"] > P.OFF_ROUTE_M).alias("off_route"),
        half_up_int(F.col("n")["rest"]).alias("remaining_m"))
