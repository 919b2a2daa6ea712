"""Registered queries on reports, imagery and the network."""

from __future__ import annotations

from pyspark.sql import functions as F

from footscape.catalog import joined, query, r, shared
from footscape.functions import geo as G
from footscape.functions import text as X
from footscape.operators import imagery as I
from footscape.operators import municipal as M
from footscape.operators import network as N
from footscape.operators.bridges import bridges as find_bridges
from footscape.operators import reports as R
from footscape.operators import spatial as SP
from footscape.plans import network as PN
from footscape.plans import priorities as PP
from footscape.session import cut
from footscape.sources import driver_tables as D


# --- reports -------------------------------------------------------------------
@query
def open_reports(spark, sf):
    return R.filter_open_reports(D.reports(spark, sf), D.now_reports()).select("report_id", "status")


@query
def verified_reports(spark, sf):
    return R.filter_verified_reports(D.reports(spark, sf)).select("report_id", "segment_id")


@query
def report_checks(spark, sf):
    """Document texts as report descriptions, checked whole."""
    docs = D.table(spark, sf, "documents").select(
        F.col("doc_id"), F.col("text").alias("description"), F.when(F.col("doc_id") % 9 == 0, "nonsense").otherwise("steps").alias("category"),
        G.point(F.lit(32.4), (F.col("doc_id") % 120).cast("double")).alias("location"))
    return R.importable_reports(docs).select("doc_id", joined("errors").alias("errors"))


@query
def report_snap(spark, sf):
    edges = D.segments(spark, sf).withColumn("status", F.lit("unverified"))
    rep = D.reports(spark, sf).drop("segment_id")
    return R.match_reports(rep, edges).select(
        "report_id", F.col("segment_distance_m"), F.col("matched_segment").isNotNull().alias("matched"))


@query
def duplicate_reports(spark, sf):
    open_ = R.filter_open_reports(D.reports(spark, sf), D.now_reports())
    return R.duplicate_pairs(open_).select("report_id", "rank", "candidate_id", "score", "distance_m", "age_days")


@query
def geohash_cells(spark, sf):
    loc = F.col("location")
    return D.reports(spark, sf).select("report_id", G.geohash(loc["lng"], loc["lat"], 8).alias("geohash"),
                                       r(G.round_coord(loc["lng"]), 5).alias("lng"), r(G.round_coord(loc["lat"]), 5).alias("lat"))


@query
def reports_near_pois(spark, sf):
    pts = D.pois(spark, sf).select("poi_id", "lng", "lat")
    near = R.reports_near(pts, D.reports(spark, sf))
    return near.groupBy("poi_id").agg(F.count(F.lit(1)).alias("reports"))


@query
def newest_reports(spark, sf):
    return R.list_reports(D.reports(spark, sf), status="verified", size=60).select("report_id", "region_id", "created_at")


@query
def retention_due(spark, sf):
    return R.retention_due(D.reports(spark, sf), D.now_reports()).select("report_id", "photo_delete_after")


@query
def orphan_uploads(spark, sf):
    files = D.table(spark, sf, "events").select(
        F.concat(F.lit("reports/"), F.col("event_id"), F.lit(".jpg")).alias("path"), F.col("ts").alias("uploaded_at"))
    return R.orphan_uploads(files, D.reports(spark, sf), F.to_timestamp(F.lit("2024-01-20 00:00:00"))).select("path")


@query
def public_reports(spark, sf):
    return R.citizen_safe(D.reports(spark, sf)).select("report_id", "region_id", "category", "status", "has_photo")


def decisions(spark, sf):
    e = F.col("event_id")
    return D.table(spark, sf, "events").select(
        F.concat(F.lit("rep"), e).alias("report_id"),
        D.pick(e % 6, ["verify", "reject", "duplicate", "resolve", "needs_review", "shrug"]).alias("decision"),
        F.when(e % 12 == 2, F.concat(F.lit("rep"), e - 1)).alias("duplicate_of"), F.lit("rev1").alias("reviewer"),
        F.lit("seen").alias("notes"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("decided_at"))


@query
def reviewed_reports(spark, sf):
    updated, _, _ = R.review_reports(D.reports(spark, sf), decisions(spark, sf))
    return updated.select("report_id", "status", "duplicate_of", F.date_format("photo_delete_after", "yyyy-MM-dd").alias("delete_after"))


@query
def rejected_decisions(spark, sf):
    _, _, bad = R.review_reports(D.reports(spark, sf), decisions(spark, sf))
    return bad.select("report_id", "error")


# --- imagery ---------------------------------------------------------------------
@query
def usable_images(spark, sf):
    return I.filter_images(D.images(spark, sf), D.now_observations()).select("image_id")


@query
def images_near_segments(spark, sf):
    near = SP.images_near_segments(I.filter_images(D.images(spark, sf), D.now_observations()), D.segments(spark, sf))
    return near.groupBy("segment_id").agg(F.count(F.lit(1)).alias("frames"), r(F.min(F.col("near")["dist"]), 2).alias("nearest_m"))


@query
def frame_scores(spark, sf):
    return I.scored_frames(D.images(spark, sf), D.segments(spark, sf), D.now_observations()).select(
        "segment_id", "image_id", r("score", 3).alias("score"), r("direction", 3).alias("direction"), r("recency", 3).alias("recency"))


@shared
def discovered(spark, sf):
    return cut(PP.discover_imagery(D.segments(spark, sf), D.images(spark, sf), D.now_observations()))


@query
def frame_selection(spark, sf):
    s = discovered(spark, sf)
    return s.select("segment_id", F.col("imagery")["status"].alias("status"), F.array_join(
        F.transform(F.col("imagery")["selected"], lambda f: f["image_id"]), ",").alias("frames"))


@query
def pending_tasks(spark, sf):
    return I.best_pending_frame(discovered(spark, sf)).select("segment_id", "image_id", r("distance_m", 1).alias("distance_m"))


@query
def budget_admission(spark, sf):
    tasks = I.best_pending_frame(discovered(spark, sf))
    return I.budget_admission(tasks, 150).select("segment_id", "position", "admitted")


@query
def retired_frames(spark, sf):
    d = discovered(spark, sf)
    done = I.best_pending_frame(d).withColumn("sufficient", F.length("segment_id") % 2 == 0)
    out = I.retire_frames(d, done)
    sel = F.col("imagery")["selected"]
    return out.select("segment_id", F.size(F.filter(sel, lambda f: f["analysed"])).alias("analysed"),
                      F.size(F.filter(sel, lambda f: f["skipped"].isNotNull())).alias("skipped"))


@query
def analysis_estimate(spark, sf):
    left = I.daily_usage(D.analysis_calls(spark, sf)).agg(F.max_by("remaining", "day")).scalar()  # of the last day
    return I.analysis_estimate(discovered(spark, sf), left)


@query
def discovery_summary(spark, sf):
    return I.discovery_summary(discovered(spark, sf))


@query
def failure_runs(spark, sf):
    return I.consecutive_failures(D.analysis_calls(spark, sf))


@query
def daily_usage(spark, sf):
    return I.daily_usage(D.analysis_calls(spark, sf))


def usage_reserved(spark, sf):
    """Usage with what is reserved: a little more than has been called."""
    calls = D.analysis_calls(spark, sf)
    reserved = I.daily_usage(calls).select("day", (F.col("calls") + F.dayofmonth(F.to_date("day")) % 3).alias("reserved"))
    return I.daily_usage(calls, reservations=reserved)


@query
def usage_left(spark, sf):
    return usage_reserved(spark, sf)


@query
def usage_week(spark, sf):
    return I.usage_history(I.daily_usage(D.analysis_calls(spark, sf)), 7)


@query
def leaked_reservations(spark, sf):
    return I.leaked_reservations(usage_reserved(spark, sf)).select("day", "reserved", "leaked")


def frame_tasks(spark, sf):
    """One analysis task per frame and the segment next to it."""
    return D.images(spark, sf).select(F.col("image_id").alias("source_id"), F.concat(F.lit("w"), F.split("image_id", "-")[3], F.lit("E")).alias("segment_id"))


@query
def frames_to_analyse(spark, sf):
    return I.frames_without_observation(frame_tasks(spark, sf), D.observations(spark, sf)).select("source_id", "segment_id")


@query
def cached_links(spark, sf):
    return I.link_cached(D.observations(spark, sf), frame_tasks(spark, sf)).select("observation_id", joined("segment_ids").alias("segment_ids"))


@query
def relink_audit(spark, sf):
    sel = frame_tasks(spark, sf).select("segment_id", F.col("source_id").alias("image_id"), F.lit(True).alias("analysed"))
    obs = D.observations(spark, sf).filter("status <> 'superseded'")
    return I.relink_audit(sel, obs).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query
def observation_frames(spark, sf):
    o = F.split("observation_id", "-")
    obs = D.observations(spark, sf).select(
        "observation_id", F.when(o[1].cast("long") % 2 == 0, F.col("source_id")).otherwise("gone").alias("image_id"))
    pos = D.images(spark, sf).select(F.regexp_replace("image_id", "^img", "o").alias("observation_id"), "lng", "lat")
    frames = D.images(spark, sf).filter(~F.coalesce("is_pano", F.lit(False)))
    out = M.observation_image(obs.join(pos, "observation_id"), frames)
    return out.groupBy("matched_by").agg(F.count(F.lit(1)).alias("n"))


# --- text and identifiers ----------------------------------------------------------
@query
def analysis_keys(spark, sf):
    o = D.observations(spark, sf)
    return o.select(X.dedupe_key(F.col("source_type"), F.col("source_id"), F.lit("m1"), F.lit("1.0.0")).alias("dedupe_key"),
                    X.observation_id(F.col("source_type"), F.concat("source_id", F.lit("/x y")), F.lit("m1"), F.lit("1.0.0")).alias("doc_id"))


@query
def short_texts(spark, sf):
    t = X.short_text(F.col("text"), 120)
    return D.table(spark, sf, "documents").select("doc_id", F.length(t).alias("chars"), F.md5(t).alias("digest"))


@query
def page_image_ids(spark, sf):
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?pKey="), F.col("page_id"), F.lit("&focus=photo"))
    return D.table(spark, sf, "pages").select("page_id", X.image_id_from_url(url, "example.com").alias("image_id"))


@query
def hash_units(spark, sf):
    return D.segments(spark, sf).select("segment_id", r(X.hash_unit(F.col("segment_id")), 5).alias("unit"))


@query
def phonetic_keys(spark, sf):
    return D.segments(spark, sf).select("segment_id", X.phonetic_key(F.col("street_name")).alias("latin"),
                                        X.phonetic_key(F.col("street_name_el")).alias("greek"))


@query
def mixed_timestamps(spark, sf):
    e = D.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.unix_millis("ts")).alias("ms"),
        F.when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"),
        F.when(F.col("event_id") % 3 == 2, F.unix_seconds("ts")).alias("s"))
    return e.select("event_id", F.unix_seconds(X.to_timestamp_any(F.col("ms"), F.col("iso"), F.col("s"))).alias("epoch"))


@query
def day_keys(spark, sf):
    return D.table(spark, sf, "events").groupBy(X.day_key(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


# --- geometry ----------------------------------------------------------------------
@query
def segment_geometry(spark, sf):
    g = F.col("geometry")
    a, b = F.get(g, F.lit(0)), F.get(g, F.lit(1))
    m = G.line_midpoint(g)
    return D.segments(spark, sf).select(
        "segment_id", r(G.line_length(g), 3).alias("length_m"), r(m["lng"], 6).alias("mid_lng"), r(m["lat"], 6).alias("mid_lat"),
        r(G.bearing(a, b), 2).alias("bearing"), r(G.bearing_delta(G.bearing(a, b), F.lit(300.0)), 2).alias("delta"),
        r(G.signed_turn(F.lit(300.0), G.bearing(a, b)), 2).alias("turn"))


@query
def packed_geometry(spark, sf):
    from footscape.sources.exchange import pack_geometry, unpack_geometry

    s = pack_geometry(D.segments(spark, sf).select("segment_id", "geometry"))
    u = unpack_geometry(s)
    return u.select("segment_id", F.size("geometry").alias("points"), r(F.get("geometry", F.lit(1))["lng"], 6).alias("lng"))


def region_boxes(spark, sf):
    s = D.segments(spark, sf)
    return s.groupBy("region_id").agg(
        F.min(G.bbox(F.col("geometry"))["w"]).alias("w"), F.min(G.bbox(F.col("geometry"))["s"]).alias("s"),
        F.max(G.bbox(F.col("geometry"))["e"]).alias("e"), F.max(G.bbox(F.col("geometry"))["n"]).alias("n"),
    ).select("region_id", F.struct("w", "s", "e", "n").alias("bbox"))


@query
def region_areas(spark, sf):
    return SP.bbox_area_guard(region_boxes(spark, sf)).select("region_id", r("area_km2", 4).alias("area_km2"), "too_large")


@query
def points_in_regions(spark, sf):
    pts = D.reports(spark, sf).select("report_id", F.col("location")["lng"].alias("lng"), F.col("location")["lat"].alias("lat"))
    inside = SP.points_in_regions(pts, region_boxes(spark, sf).withColumnRenamed("region_id", "box_region"))
    return inside.groupBy("box_region").agg(F.count(F.lit(1)).alias("reports"))


@query
def tile_images(spark, sf):
    boxes = region_boxes(spark, sf)
    tiles = SP.tile_bbox(boxes, 0.0047).withColumn("tile_id", F.concat_ws("-", "region_id", "tile_x", "tile_y"))
    pts = D.images(spark, sf).select("image_id", (F.col("lng") + 0.0000017).alias("lng"), (F.col("lat") + 0.0000013).alias("lat"))
    return SP.tile_truncation(pts, tiles).select("tile_id", "images", "truncated")


@query
def segments_in_box(spark, sf):
    box = F.struct(F.lit(32.4051).alias("w"), F.lit(34.7533).alias("s"), F.lit(32.4093).alias("e"), F.lit(34.7581).alias("n"))
    return SP.segments_in_bbox(D.segments(spark, sf), box).groupBy("in_search_area").agg(F.count(F.lit(1)).alias("n"))


@query
def nearby_pois(spark, sf):
    return SP.nearby_pois(D.segments(spark, sf), D.pois(spark, sf)).select("segment_id", "poi_id", "class", "distance_m")


@query
def poi_pressure(spark, sf):
    return M.poi_pressure(SP.nearby_pois(D.segments(spark, sf), D.pois(spark, sf))).select("segment_id", r("poi_sum", 3).alias("poi_sum"), "poi_count")


# --- network -------------------------------------------------------------------------
@query
def network_segments(spark, sf):
    nodes, ways = D.ways(spark, sf)
    segments, _ = PN.build_network(nodes, ways)
    return segments.select("segment_id", "from_node", "to_node", r("length_m", 1).alias("length_m"), "kind")


@query
def junctions(spark, sf):
    nodes, ways = D.ways(spark, sf)
    v = N.junctions(N.way_nodes(PN.kept_ways(ways), nodes))
    return v.select("way_id", "pos", "node_id", "is_junction", "missing")


@query
def along_way(spark, sf):
    nodes, ways = D.ways(spark, sf)
    v = N.cumulative_length(N.way_nodes(ways, nodes).filter("not missing"))
    return v.select("way_id", "pos", r("along_m", 2).alias("along_m"))


@query
def network_stats(spark, sf):
    return N.network_stats(D.segments(spark, sf), "region_id").select("region_id", "segments", "nodes", "total_length_m", r("area_km2", 4).alias("area_km2"))


@query
def length_quantiles(spark, sf):
    return N.length_quantiles(D.segments(spark, sf), 50.0, "region_id")


def footpaths(spark, sf):
    return D.segments(spark, sf).filter(F.col("kind").isin("footway", "sidewalk", "crossing"))


def components_of(spark, sf):
    num = lambda c: F.substring(c, 2, 20).cast("long")
    return N.connected_components(footpaths(spark, sf).select(num("from_node").alias("src"), num("to_node").alias("dst")))


@query
def components(spark, sf):
    return components_of(spark, sf)


@query
def network_components(spark, sf):
    """Components of the whole network, every kind of way."""
    num = lambda c: F.substring(c, 2, 20).cast("long")
    return N.connected_components(D.segments(spark, sf).select(num("from_node").alias("src"), num("to_node").alias("dst")))


@query
def bridges(spark, sf):
    """Segments of the footpaths without which their ends are no longer connected."""
    return find_bridges(footpaths(spark, sf).select(F.col("segment_id").alias("edge_id"), F.col("from_node").alias("src"), F.col("to_node").alias("dst")))


@query
def connectivity(spark, sf):
    return N.connectivity_report(components_of(spark, sf))


@query
def graph_nodes(spark, sf):
    nodes, _ = N.build_graph(D.segments(spark, sf))
    return nodes.select("node", r("lng", 6).alias("lng"), r("lat", 6).alias("lat"))


def imports(spark, sf):
    """A second import that lost the segments of every seventh way and gained some."""
    old = D.segments(spark, sf)
    k = F.col("way_id")
    new = old.filter(k % 7 != 0).unionByName(old.filter(k % 11 == 0).withColumn("segment_id", F.concat("segment_id", F.lit("b"))))
    return old, new


@query
def stale_segments(spark, sf):
    return N.stale_segments(*imports(spark, sf)).select("segment_id")


@query
def import_diff(spark, sf):
    return N.import_diff(*imports(spark, sf)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query
def import_preserve(spark, sf):
    old, new = imports(spark, sf)
    kept = N.import_preserve(new.drop("manual"), old, ["manual"])
    return kept.select("segment_id", F.col("manual")["result"].alias("result"))
