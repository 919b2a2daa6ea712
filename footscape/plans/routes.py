"""Compared routes and detours for whole request tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footscape import params as P
from footscape.functions import geo as G
from footscape.functions.numbers import half_up, half_up_int
from footscape.operators import routing as R
from footscape.operators.bridges import bridges
from footscape.operators.components import connected_components
from footscape.operators.network import build_graph
from footscape.session import cut, stored


def priced_edges(edges: DataFrame, searches: DataFrame) -> DataFrame:
    """Usable edges for the (profile, preference) combinations that occur."""
    wanted = searches.select("profile", "prefer_verified").distinct()
    return R.edge_cost(edges, wanted).filter(~F.col("forbidden"))


def find_routes(segments: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(searches, paths, directed edges) between nodes, three variants per request."""
    nodes, edges = build_graph(segments)
    searches = R.route_searches(requests)
    return searches, stored(R.least_cost_paths(searches, priced_edges(edges, searches), nodes)), edges


def find_point_routes(segments: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(searches, paths, directed edges) between points (request_id, region_id, origin, destination, profile, prefer_verified).

    Both points are snapped to the region's network and their edges split, in an overlay of each request over the shared
    graph. Edges of the overlay are among the edges returned, under ids of their own. A request with
    a point off the network has no search of its own; its paths say which end it is.
    """
    nodes, edges = build_graph(segments)
    snapped, extra, off = R.virtual_endpoints(requests, segments.filter(F.size("geometry") >= 2))
    snapped, extra = stored(snapped), stored(extra)
    ends = snapped.select("request_id", "start_at", "goal_at", F.col("goal_foot")["lng"].alias("goal_lng"), F.col("goal_foot")["lat"].alias("goal_lat"))
    searches = stored(R.route_searches(snapped).join(ends, "request_id"))
    legs = extra.drop("segment_id", "edge_id").withColumnRenamed("leg_id", "segment_id")
    a, z = F.get("geometry", F.lit(0)), F.get("geometry", F.size("geometry") - 1)
    own = priced_edges(legs.withColumn("span_m", G.distance(a, z)), searches).join(searches.select("request_id", "search_id", "profile", "prefer_verified"), ["request_id", "profile", "prefer_verified"])
    paths = R.least_cost_paths(searches, priced_edges(edges, searches), nodes, own.select("search_id", "segment_id", "reversed", "src", "dst", "length_m", "cost", "span_m"))
    lost = R.route_searches(requests.drop("origin_node", "goal_node").join(off, "request_id", "left_semi").withColumns({"origin_node": F.lit(None).cast("string"), "goal_node": F.lit(None).cast("string")}))
    none = lost.join(off, "request_id").select("search_id", F.lit(False).alias("found"), "reason")
    return searches.select(*lost.columns).unionByName(lost), stored(paths.unionByName(none, allowMissingColumns=True)), edges.unionByName(legs.select(edges.columns))


def plan_routes(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request's three variants with summary, comparison and warning; requests between points or nodes."""
    return compare_routes(*(find_point_routes if "origin" in requests.columns else find_routes)(segments, requests))


def compare_routes(searches: DataFrame, paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Summary, comparison and warning from found paths; see `find_routes`."""
    j = searches.join(paths, "search_id")
    found = j.filter("found")
    legs = cut(R.route_edges(found.select("search_id", "legs"), edges))
    routes = found.select("search_id", "request_id", "variant", "profile", "prefer_verified", "cost", "path")
    summary = R.explain_route(R.route_summary(legs, routes))
    rec = j.filter("variant = 'recommended'").select("request_id", F.col("path").alias("_rp"), F.col("found").alias("_rf"))
    out = j.select("search_id", "request_id", "variant", "profile", "found", "reason",
                   F.col("path").alias("_path")).join(rec, "request_id")
    out = out.join(summary.drop("request_id", "variant", "profile", "path"), "search_id", "left")
    same = F.when(F.col("variant") != "recommended", F.col("_path").eqNullSafe(F.col("_rp")))
    has_short = F.max(F.when(F.col("variant") == "shortest", F.col("found").cast("int"))).alias("s")
    short = j.groupBy("request_id").agg(has_short)
    out = out.join(short, "request_id")
    warning = (F.when(~F.col("_rf") & (F.col("s") == 1), "no_accessible_route").when(~F.col("_rf"), "no_route")
               .when((F.col("variant") == "recommended") & F.col("high_unknown"), "high_unknown_coverage"))
    return out.withColumns({"same_as_recommended": same, "warning": warning, "route_cost": half_up_int(F.col("cost"))}).drop(
        "_path", "_rp", "_rf", "s")


def detour_ratio(segments: DataFrame, edges_from: DataFrame, profile: str = "wheelchair") -> DataFrame:
    """Length of the best way between a segment's ends without it, over its own length.

    Whether there is one is known beforehand: not where the ends lie in different components, or the segment is a bridge
    of the network that the profile can use. Only the others are searched, in one batch, so no search floods a component in vain.
    `reason` tells a missing alternative from an unusable length.
    """
    nodes, edges = build_graph(edges_from)
    searches = segments.select(
        F.col("segment_id").alias("search_id"), F.lit(profile).alias("profile"), F.lit(False).alias("prefer_verified"),
        "region_id", F.col("from_node").alias("start"), F.col("to_node").alias("goal"), F.col("segment_id").alias("without"))
    usable = stored(priced_edges(edges, searches))
    node = lambda c: F.concat_ws("|", "region_id", c)
    lines = stored(usable.filter("not reversed").select(F.col("segment_id").alias("edge_id"), node("src").alias("src"), node("dst").alias("dst")))
    comp = stored(connected_components(lines.select("src", "dst")))
    ends = segments.select("segment_id", node("from_node").alias("_a"), node("to_node").alias("_z"))
    for c in ("_a", "_z"):
        ends = ends.join(comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}c")), c, "left")
    around = ends.filter("_a = _z OR _ac = _zc").join(bridges(lines).withColumnRenamed("edge_id", "segment_id"), "segment_id", "left_anti").select(F.col("segment_id").alias("search_id"))
    searches = stored(searches.join(around, "search_id", "left_semi"))
    paths = R.least_cost_paths(searches, usable, nodes, reachable=True)
    j = segments.select("segment_id", F.col("length_m").alias("direct_m")).join(
        paths.select(F.col("search_id").alias("segment_id"), "found", F.col("length_m").alias("_d")), "segment_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return j.select(
        "segment_id", "direct_m", F.when(F.col("found"), half_up_int(F.col("_d"))).alias("detour_m"),
        F.when(F.col("found") & (F.col("direct_m") > 0), half_up(F.col("_d") / F.col("direct_m"), 2)).alias("ratio"),
        F.when(~F.col("found"), "no_alternative").alias("reason"))
