"""Imagery discovery and the priority queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footscape import params as P
from footscape.operators import imagery as I
from footscape.operators import municipal as M
from footscape.operators import spatial as SP
from footscape.operators import tag_evidence as T
from footscape.operators.scoring import freshness_state
from footscape.plans.routes import detour_ratio

SELECTED = ("array<struct<choice:int,image_id:string,captured_at:timestamp,distance_m:double,compass_angle:double,"
            "sequence_id:string,selection_score:double,analysed:boolean,skipped:string>>")


def discover_imagery(segments: DataFrame, images: DataFrame, now: Column, box: Column | None = None,
                     params: P.Params = P.DEFAULT) -> DataFrame:
    """Search frames for every segment that needs a picture; adds `imagery`."""
    s = T.needs_visual_evidence(T.derive_tag_evidence(segments))
    s = SP.segments_in_bbox(s, box) if box is not None else s.withColumn("in_search_area", F.lit(True))
    wanted = s.filter("in_search_area and needs_visual").select("segment_id", "geometry")
    chosen = I.selected_array(I.select_frames(I.scored_frames(images, wanted, now), params.max_images_per_segment))
    j = s.join(chosen, "segment_id", "left")
    selected = F.coalesce("selected", F.array().cast(SELECTED))
    status = (F.when(~F.col("in_search_area"), "not_searched").when(~F.col("needs_visual"), "not_needed")
              .when(F.size(selected) > 0, "selected").otherwise("none_found"))
    return j.withColumn("imagery", F.struct(status.alias("status"), F.size(selected).alias("image_count"), selected.alias("selected"),
                                            F.col("not_needed_reason").alias("reason"))).select(
        *segments.columns, "in_search_area", "needs_visual", "imagery")


def prioritise(assessments: DataFrame, pois: DataFrame, stored: DataFrame | None = None,
               detours: DataFrame | None = None, params: P.Params = P.DEFAULT) -> DataFrame:
    """Issues with score, breakdown and band for every segment that is worth one.

    `detours` takes a stored `detour_ratio` result; without it the detours are searched here.
    """
    worthy = M.issue_worthy(assessments)
    pairs = SP.nearby_pois(worthy, pois)
    j = worthy.join(M.poi_pressure(pairs), "segment_id", "left").join(SP.nearest_pois(pairs), "segment_id", "left")
    d = detours if detours is not None else detour_ratio(worthy, assessments)
    j = j.join(d.select("segment_id", F.col("ratio").alias("detour_ratio"), "detour_m", F.col("reason").alias("detour_reason")), "segment_id", "left")
    j = M.issue_id(j)
    if stored is None:
        return M.priority_score(j.withColumn("manual_boost", F.lit(0.0)), params)
    boosts = stored.select("issue_id", "manual_boost")
    scored = M.priority_score(j.join(boosts, "issue_id", "left"), params)
    return M.issue_carry_over(scored, stored)


def patch_issues(issues: DataFrame, patches: DataFrame, assessments: DataFrame, pois: DataFrame, detours: DataFrame, params: P.Params = P.DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(patched issues, rejected patches): workflow changes of `apply_issue_patches`, and the score, breakdown and band of every issue
    whose boost changed, computed again from its assessment. Only the segments of such issues are scored."""
    out, rejected = M.apply_issue_patches(issues, patches)
    boosted = out.filter("boost_changed").select("segment_id", "issue_id", "manual_boost")
    worthy = assessments.join(boosted.select("segment_id"), "segment_id", "left_semi")
    again = prioritise(worthy, pois, boosted.select("issue_id", "segment_id", "manual_boost", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("assigned_department")), detours, params)
    fresh = again.select("issue_id", *[F.col(c).alias(f"_{c}") for c in ("priority_score", "priority_band", "breakdown")])
    j = out.join(fresh, "issue_id", "left")
    j = j.withColumns({c: F.when(F.col("boost_changed"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("priority_score", "priority_band", "breakdown")})
    return j.drop("_priority_score", "_priority_band", "_breakdown"), rejected


def refresh_freshness(assessments: DataFrame, now: Column, params: P.Params = P.DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(re-dated assessments with `state_moved`, regions that need a new assessment)."""
    old = assessments.withColumn("_before", F.col("freshness_state"))
    new = freshness_state(old, now, params).withColumn("state_moved", F.col("freshness_state") != F.col("_before")).drop("_before")
    return new, new.filter("state_moved").select("region_id").distinct()


def clear_override(segments: DataFrame, ids: DataFrame) -> DataFrame:
    """Segments with the manual verification of the listed ids removed; assess them again afterwards."""
    listed = ids.select("segment_id").distinct().withColumn("_clear", F.lit(True))
    j = segments.join(listed, "segment_id", "left")
    return j.withColumn("manual", F.when(F.col("_clear").isNull(), F.col("manual"))).drop("_clear")
