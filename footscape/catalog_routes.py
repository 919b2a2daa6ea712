"""Registered queries on routing, priority, coverage, validation, search and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from footscape import params as P
from footscape.catalog import assessed, joined, query, r, shared
from footscape.catalog_places import discovered
from footscape.functions import geo as G
from footscape.operators import municipal as M
from footscape.operators import network as N
from footscape.operators import routing as R
from footscape.plans import priorities as PP
from footscape.plans import routes as PR
from footscape.session import cut
from footscape.sources import driver_tables as D
from footscape.sources import exchange as X


# --- routing ---------------------------------------------------------------------
@query
def edge_costs(spark, sf):
    _, edges = N.build_graph(assessed(spark, sf))
    e = R.edge_cost(edges.filter(~F.col("reversed")), R.profiles(spark))
    return e.select("segment_id", "profile", "prefer_verified", "forbidden", r("cost", 2).alias("cost"), joined("blocked_by").alias("blocked_by"))


@shared
def found_routes(spark, sf):
    return PR.find_routes(assessed(spark, sf), D.route_requests(spark, sf))


@query
def least_cost_paths(spark, sf):
    _, paths, _ = found_routes(spark, sf)
    return paths.select("search_id", "found", r("cost", 2).alias("cost"), r("length_m", 1).alias("length_m"), "reason")


@shared
def point_routes(spark, sf):
    return PR.find_point_routes(assessed(spark, sf), D.point_requests(spark, sf))


@query
def planned_routes(spark, sf):
    """Routes between points of the map, off the network's nodes."""
    plan = PR.compare_routes(*point_routes(spark, sf))
    return plan.select(
        "search_id", "found", "reason", "distance_m", "duration_s", "accessibility_score", "assessed_share", "evidence_confidence",
        "unknown_percent", "high_unknown", "extra_distance_m", "same_as_recommended", "warning",
        joined("barriers").alias("barriers"), joined("barriers_avoided").alias("avoided"), F.array_join("reasons", ",").alias("reasons"))


@shared
def legs_of(spark, sf):
    _, paths, edges = point_routes(spark, sf)
    return cut(R.route_edges(paths.filter("found"), edges))


@query
def route_status_metres(spark, sf):
    m = R.edge_status_metres(legs_of(spark, sf))
    return m.select("search_id", *[r(c, 1).alias(c) for c in m.columns if c != "search_id"])


@query
def route_barrier_metres(spark, sf):
    return R.route_barriers(legs_of(spark, sf))


@query
def route_steps(spark, sf):
    s = R.route_steps(legs_of(spark, sf))
    return s.select("search_id", "step", "manoeuvre", "street_name", "distance_m", "status", joined("barriers").alias("barriers"))


@query
def route_lines(spark, sf):
    g = R.stitch_geometry(legs_of(spark, sf))
    return g.select("search_id", F.size("geometry").alias("points"), r(G.line_length(F.col("geometry")), 1).alias("length_m"))


@query
def route_progress(spark, sf):
    """Pings of every found route: beside each leg's start, some far off the route."""
    legs = legs_of(spark, sf)
    start = F.get("geometry", F.lit(0))
    pings = legs.select(F.concat_ws("|", "search_id", "pos").alias("ping_id"), "search_id", start["lng"].alias("lng"),
                        (start["lat"] + F.when(F.col("pos") % 4 == 3, 0.0009).otherwise(0.00001)).alias("lat"))
    p = R.progress_on_route(pings, R.stitch_geometry(legs))
    return p.select("ping_id", "off_route")


@query
def snapped_requests(spark, sf):
    snapped, extra, _ = R.virtual_endpoints(D.route_requests(spark, sf), D.segments(spark, sf).select(
        "segment_id", "region_id", "from_node", "to_node", "geometry", "length_m"))
    per = extra.groupBy("request_id").agg(F.count(F.lit(1)).alias("edges"), r(F.sum("length_m"), 1).alias("metres"))
    return snapped.join(per.hint("merge"), "request_id").select("request_id", "edges", "metres")


@shared
def detours(spark, sf):
    a = assessed(spark, sf)
    return cut(PR.detour_ratio(M.issue_worthy(a), a))


@query
def detour_ratio(spark, sf):
    return detours(spark, sf).select("segment_id", "detour_m", "ratio", "reason")


# --- priority ----------------------------------------------------------------------
def stored_issues(spark, sf):
    """An earlier queue: one issue per part, with workflow state."""
    k = F.col("p_partkey")
    return D.table(spark, sf, "part").select(
        F.concat(F.lit("issue_w"), k, F.lit("E")).alias("issue_id"), F.concat(F.lit("w"), k, F.lit("E")).alias("segment_id"),
        D.pick(k % 5, ["new", "assigned", "resolved", "in_progress", "verified"]).alias("status"),
        F.when(k % 4 == 0, 0.5).otherwise(0.0).alias("manual_boost"), F.when(k % 5 == 1, "roads").alias("assigned_department"))


@query
def issue_worthy(spark, sf):
    return M.issue_worthy(assessed(spark, sf)).select("segment_id", "status")


@query
def priority(spark, sf):
    p = PP.prioritise(assessed(spark, sf), D.pois(spark, sf), detours=detours(spark, sf))
    points = F.map_from_entries(F.transform("breakdown", lambda b: F.struct(b["key"], b["points"])))
    return p.select("segment_id", "priority_score", "priority_band", points["priority.severity"].alias("severity"),
                    points["priority.no_accessible_alternative"].alias("no_alternative"), points["priority.safety_impact"].alias("safety"))


@shared
def queue(spark, sf):
    """The stored queue carried over."""
    return cut(PP.prioritise(assessed(spark, sf), D.pois(spark, sf), stored_issues(spark, sf), detours=detours(spark, sf)))


@query
def issue_queue(spark, sf):
    return queue(spark, sf).select("issue_id", "workflow_status", "priority_score", "priority_band", "manual_boost", "assigned_department", "resolved_reason")


@query
def top_barriers(spark, sf):
    return M.top_barriers(queue(spark, sf)).select("issue_id", "priority_score", F.col("barrier").isNotNull().alias("has_barrier"))


@query
def open_critical_issues(spark, sf):
    return M.list_issues(queue(spark, sf), "new", "high", 50).select("issue_id", "priority_score")


def issue_patches(spark, sf):
    k = F.col("p_partkey")
    return D.table(spark, sf, "part").select(
        F.concat(F.lit("issue_w"), k, F.lit("E")).alias("issue_id"), D.pick(k % 3, ["assigned", "lost"]).alias("status"),
        F.when(k % 2 == 0, "parks").alias("assigned_department"), F.when(k % 7 == 0, k % 3 / 2.0).alias("manual_boost"),
        F.lit("note").alias("notes"), F.to_timestamp(F.lit("2024-01-05 00:00:00")).alias("patched_at"))


@query
def patched_issues(spark, sf):
    issues = stored_issues(spark, sf).withColumnRenamed("status", "workflow_status")
    out, _ = M.apply_issue_patches(issues, issue_patches(spark, sf))
    return out.select("issue_id", "workflow_status", "assigned_department", "manual_boost", "boost_changed")


@query
def boosted_issues(spark, sf):
    """Patched issues of the stored queue: a new boost gives a new score, breakdown and band."""
    out, _ = PP.patch_issues(queue(spark, sf), issue_patches(spark, sf), assessed(spark, sf), D.pois(spark, sf), detours(spark, sf))
    boost = F.filter("breakdown", lambda b: b["key"] == "priority.municipal_boost")
    return out.select("issue_id", "boost_changed", "manual_boost", "priority_score", "priority_band",
                      F.when(F.col("boost_changed"), F.coalesce(F.get(boost, F.lit(0))["points"], F.lit(0.0))).alias("boost_points"))


# --- coverage ------------------------------------------------------------------------
@query
def coverage_by_region(spark, sf):
    found = discovered(spark, sf).select("segment_id", F.col("imagery")["image_count"].alias("image_count"))
    return M.coverage(assessed(spark, sf).drop("image_count").join(found, "segment_id", "left"), all_regions=True)


@query
def coverage_export(spark, sf):
    return X.coverage_export_rows(M.coverage(assessed(spark, sf))).drop("ord")


@query
def region_overview(spark, sf):
    from footscape.operators.imagery import daily_usage

    o = M.overview(M.coverage(assessed(spark, sf)), D.reports(spark, sf), queue(spark, sf), daily_usage(D.analysis_calls(spark, sf)))
    return o.select("region_id", "segments", "assessed_pct", "pending_reports", "critical_issues", "calls_this_week")


@query
def stale_share(spark, sf):
    return M.stale_share(assessed(spark, sf))


# --- validation ----------------------------------------------------------------------
@query
def validation_metrics(spark, sf):
    return M.validation_metrics(D.labels(spark, sf, assessed(spark, sf))).select(
        "region_id", "samples", "classified", "declined", "agreed", "optimistic", "pessimistic", "sufficient", "agreement")


@query
def confusion_matrix(spark, sf):
    return M.confusion_matrix(D.labels(spark, sf, assessed(spark, sf)))


@query
def barrier_pr(spark, sf):
    return M.barrier_precision_recall(D.labels(spark, sf, assessed(spark, sf)))


@query
def unlabelled_targets(spark, sf):
    a = assessed(spark, sf)
    some = D.labels(spark, sf, a).filter(F.length("segment_id") % 2 == 0)
    return M.unlabelled_targets(a, some, 40).select("segment_id", "status", "evidence_confidence")


def event_log(spark, sf):
    """An assessment log: one row per event on the segment of its part."""
    e = F.col("event_id")
    n = D.table(spark, sf, "part").agg(F.max("p_partkey") + 1).scalar()
    return D.table(spark, sf, "events").withColumn("k", e % n).select(
        F.concat(F.lit("w"), F.col("k"), F.lit("E")).alias("segment_id"), F.col("ts").alias("assessed_at"),
        D.pick(F.floor(F.col("value")).cast("long") % 4, P.STATUSES).alias("status"), (e % 101).cast("int").alias("accessibility_score"),
        (e % 97).cast("int").alias("evidence_confidence"), F.array(F.lit("steps")).alias("barriers"), F.lit("1.1.0").alias("assessment_version"), "event_type", "user_id", "event_id")


@query
def assessment_changes(spark, sf):
    return M.assessment_changes(event_log(spark, sf)).select("event_id", "segment_id", "status_before", "status")


@query
def frozen_labels(spark, sf):
    log = event_log(spark, sf)
    labels = log.filter("event_type = 'click'").select(
        "segment_id", F.concat(F.lit("u"), F.col("user_id")).alias("labelled_by"), F.col("status").alias("true_status"),
        F.array(F.lit("steps"), F.lit("dragons")).alias("true_barriers"), (F.col("assessed_at") + F.expr("INTERVAL 1 HOUR")).alias("labelled_at"))
    f = M.freeze_labels(labels, log.filter("event_type <> 'click'"))
    return f.select("segment_id", "labelled_by", "true_status", joined("true_barriers").alias("true_barriers"), "predicted_status", "predicted_confidence")


# --- search --------------------------------------------------------------------------
@query
def street_index(spark, sf):
    return M.street_index(D.segments(spark, sf)).select("key", "segments", "street_name")


@query
def street_suggest(spark, sf):
    queries = D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("query_id"), F.lower(F.left("c_mktsegment", 1 + F.col("c_custkey").cast("int") % 3)).alias("query"))
    return M.suggest_streets(queries, M.prefix_index(M.street_index(D.segments(spark, sf)))).select("query_id", "key", "rank")


# --- projection ------------------------------------------------------------------------
@query
def measured_mix(spark, sf):
    return M.measured_mix(assessed(spark, sf)).select("status", r("share", 4).alias("share"))


@query
def projection(spark, sf):
    return M.coverage_projection(assessed(spark, sf)).select("segment_id", "status", "score", "simulated")


@query
def map_view(spark, sf):
    v = M.status_style(M.map_filter_view(M.coverage_projection(assessed(spark, sf)), recent=True))
    v = M.network_length_label(v)
    return v.groupBy("view", "status", "color", "glyph").agg(F.count(F.lit(1)).alias("n"), F.max("length_label").alias("longest"))


# --- state and workflow ------------------------------------------------------------------
@query
def refreshed_regions(spark, sf):
    moved, regions = PP.refresh_freshness(assessed(spark, sf), F.to_timestamp(F.lit("2002-09-01 00:00:00")))
    return moved.groupBy("region_id").agg(F.count_if("state_moved").alias("moved"))


@query
def cleared_overrides(spark, sf):
    s = D.segments(spark, sf)
    ids = s.filter(F.col("kind") == "footway").select("segment_id")
    return PP.clear_override(s, ids).select("segment_id", F.col("manual")["result"].alias("result"))


@query
def verification_checks(spark, sf):
    v = D.table(spark, sf, "events").select("event_id", D.pick(F.col("event_id") % 4, ["confirmed", "corrected", "needs_inspection", "maybe"]).alias("result"),
                                            F.when(F.col("event_id") % 8 < 4, "partial").alias("status"), F.left("props", F.col("event_id").cast("int") % 9).alias("notes"))
    return M.valid_overrides(v).select("event_id", "error")


def jobs(spark, sf):
    o = F.col("o_orderkey")
    return D.table(spark, sf, "orders").select(
        o.alias("job_id"), D.pick(o % 4, ["queued", "running", "completed", "failed"]).alias("status"), (o % 3).alias("error_count"),
        (o % 5).alias("succeeded"), F.when(o % 6 != 0, F.col("o_orderdate")).alias("started_at"), F.when(o % 7 != 0, F.col("o_orderdate")).alias("created_at"))


@query
def stale_jobs(spark, sf):
    return M.stale_jobs(jobs(spark, sf), F.to_timestamp(F.lit("1998-06-01 00:00:00"))).select("job_id", "status", "stale")


@query
def job_outcomes(spark, sf):
    return M.job_outcomes(jobs(spark, sf)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def audit_changes(spark, sf):
    old = jobs(spark, sf).select("job_id", "status", F.lit("x").alias("api_token"))
    new = M.stale_jobs(jobs(spark, sf), F.to_timestamp(F.lit("1998-06-01 00:00:00"))).select("job_id", "status", F.lit("y").alias("api_token"))
    a = M.audit_rows(old.filter("job_id % 10 > 0"), new.filter("job_id % 10 < 9"), "job_id", ["status", "api_token"], "system")
    return a.select(F.col("job_id"), F.col("previous")["status"].alias("before"), F.col("next")["status"].alias("after"),
                    F.map_contains_key("next", "api_token").alias("leaks"))


@query
def audit_redaction(spark, sf):
    """Nested values of an audit row: secrets inside go at every level, long texts and lists are cut."""
    o = F.col("o_orderkey")
    attempt = lambda i: F.create_map(F.lit("no"), (o + i).cast("string"), F.lit("authToken"), F.lit("t"))
    request = F.struct(F.repeat(F.concat(F.lit("order "), o), (o % 60 + 1).cast("int")).alias("note"), F.lit("s").alias("client_secret"),
                       F.transform(F.sequence(F.lit(1), F.lit(33)), attempt).alias("attempts"))
    log = D.table(spark, sf, "orders").select(o.alias("job_id"), F.struct(F.col("o_orderstatus").alias("status"), request.alias("request")).alias("previous"),
                                              F.struct(F.lit("done").alias("status"), F.lit("k").alias("apiKey")).alias("next"))
    a = M.redact_audit(log)
    first = F.get("previous.request.attempts", F.lit(0))
    return a.select("job_id", F.col("previous.request.note").alias("note"), F.size("previous.request.attempts").alias("attempts"),
                    F.array_join(F.map_keys(first), ",").alias("keys"), first["no"].alias("first_no"), F.to_json("next").alias("next"))


@query
def saved_places(spark, sf):
    e = D.table(spark, sf, "events").select("user_id", (F.col("event_id") % 400).alias("place_id"), F.col("ts").alias("saved_at"), "event_type")
    m = M.merge_saved(e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'view'").drop("event_type"), 10)
    return m.select("user_id", "place_id", "rn")


@query
def segment_details(spark, sf):
    from footscape.catalog import linked

    log = event_log(spark, sf).select("segment_id", F.col("status").alias("result"), F.col("assessed_at").alias("created_at"))
    a = assessed(spark, sf).select("segment_id", F.col("status").alias("assessed_status"))
    d = M.segment_detail(D.segments(spark, sf).select("segment_id"), a, linked(spark, sf), log)
    return d.select("segment_id", "assessed_status", F.coalesce(F.size("observations"), F.lit(0)).alias("observations"),
                    F.coalesce(F.size("events"), F.lit(0)).alias("events"), F.get("events", F.lit(0))["result"].alias("latest"))


@query
def region_catalogue(spark, sf):
    b = X.bundle_metadata(assessed(spark, sf)).select("region_id", F.when(F.col("segment_count") % 2 == 0, F.col("version")).alias("bundle_version"), "segment_count")
    return M.region_catalogue(b).select("region_id", "segment_count", "is_default")


@query
def bundle_metadata(spark, sf):
    old = D.table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("region_id"), (F.col("r_regionkey") + 3).alias("version")).filter("region_id <> 'r4'")
    return X.bundle_metadata(assessed(spark, sf), old)


@query
def issue_export(spark, sf):
    rows, cols = X.issue_export_rows(queue(spark, sf).filter("priority_score > 0"))
    return rows.select("segment_id", F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for n, c in cols if n in ("Priority", "Band", "Segment ID", "Accessible detour ratio", "Workflow status", "Assigned to")]).alias("line"))


@query
def report_export(spark, sf):
    rows, cols = X.report_export_rows(D.reports(spark, sf).withColumn("street_name", F.lit(None).cast("string")))
    keep = [(n, c) for n, c in cols if n not in ("Latitude", "Longitude")]
    return X.csv_lines(rows, keep)


@query
def geojson_statuses(spark, sf):
    f = X.geojson_features(assessed(spark, sf))
    return f.groupBy("region_id", F.get_json_object("feature", "$.properties.status").alias("status"),
                     F.get_json_object("feature", "$.geometry.type").alias("type")).agg(F.count(F.lit(1)).alias("features"))


@query
def parameter_checks(spark, sf):
    """Part rows as candidate parameter sets."""
    s, b = F.col("p_size"), F.substring("p_brand", 7, 2).cast("int")
    rows = D.table(spark, sf, "part").select(
        "p_partkey", (s * 2.2).alias("accessible_threshold"), (b * 3.0).alias("partial_threshold"), (s * 2.5).alias("min_confidence"),
        (b * 40.0).alias("recent_max_days"), (s * 25.0).alias("aging_max_days"), (b * 5.0).alias("weight_sum"), (s * 110.0).alias("max_analyses_per_day"))
    return P.validate_params(rows).select("p_partkey", F.size("errors").alias("errors"))
