"""Registered queries: each reads the given tables whole and returns a flat DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footscape import params as P
from footscape.functions.numbers import half_up
from footscape.operators import observations as O
from footscape.operators import scoring as S
from footscape.operators import tag_evidence as T
from footscape.operators import ways as W
from footscape.plans import assess as A
from footscape.plans import incremental as IN
from footscape.sources import driver_tables as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def joined(c: str | Column, ordered: bool = True) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(c) if ordered else c, ",")


def r(c: str | Column, d: int = 3) -> Column:
    """Round for comparison; ties cannot matter at this precision."""
    return half_up(F.col(c) if isinstance(c, str) else c, d)


_SHARED: dict[tuple, object] = {}


def shared(fn):
    """Compute a stored table once per application and input folder.

    Assessments, selected frames and found routes are tables of the domain that many
    queries read; they are written out by a checkpoint and read again from there.
    """
    @wraps(fn)
    def inner(spark: SparkSession, sf: str):
        key = (fn.__name__, spark.sparkContext.applicationId, sf)
        if key not in _SHARED:
            _SHARED[key] = fn(spark, sf)
        return _SHARED[key]

    return inner


@shared
def assessed(spark: SparkSession, sf: str) -> DataFrame:
    return A.assess(D.segments(spark, sf), D.observations(spark, sf), D.reports(spark, sf), D.now_observations())


def linked(spark: SparkSession, sf: str) -> DataFrame:
    return O.observations_by_segment(O.filter_active(D.observations(spark, sf)))


# --- ways and tags -----------------------------------------------------------
@query
def pedestrian_ways(spark, sf):
    _, ways = D.ways(spark, sf)
    kept = W.drop_redundant_carriageways(W.classify_ways(W.filter_pedestrian_ways(ways)))
    return kept.select("way_id", "kind", "is_carriageway")


@query
def way_stats(spark, sf):
    return W.parse_stats(D.ways(spark, sf)[1], "region_id")


@query
def relevant_tags(spark, sf):
    ways = W.project_relevant_tags(D.ways(spark, sf)[1])
    return ways.select("way_id", F.array_join(F.array_sort(F.transform(
        F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("tags"))


@query
def way_names(spark, sf):
    ways = W.display_name(W.display_name(D.ways(spark, sf)[1], "en", "name_en"), "el", "name_el")
    return ways.select("way_id", "name_en", "name_el")


@query
def typed_tags(spark, sf):
    return T.type_tags(D.segments(spark, sf)).select(
        "segment_id", r("width_m", 4).alias("width_m"), r("kerb_height_m", 4).alias("kerb_height_m"),
        r("incline_pct", 4).alias("incline_pct"))


@query
def tag_evidence(spark, sf):
    return T.derive_tag_evidence(D.segments(spark, sf)).select(
        "segment_id", r("informativeness").alias("informativeness"), "decisive", joined("hard_blocks").alias("hard_blocks"),
        joined("known_tags").alias("known_tags"))


@query
def tag_evidence_items(spark, sf):
    e = T.explode_evidence(T.derive_tag_evidence(D.segments(spark, sf)))
    return e.groupBy("side", "id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("weight")).alias("weight"))


@query
def visual_evidence_needed(spark, sf):
    s = T.needs_visual_evidence(T.derive_tag_evidence(D.segments(spark, sf)))
    return s.select("segment_id", "needs_visual", F.col("not_needed_reason").alias("reason"))


# --- observations ------------------------------------------------------------
def raw_observations(spark, sf) -> DataFrame:
    """Landed JSON of the observations, with some values outside the vocabulary."""
    o = D.observations(spark, sf)
    v = F.col("observation")
    n = F.length("observation_id") + F.ascii(F.substring("observation_id", -1, 1))
    body = F.to_json(F.struct(
        F.when(n % 7 == 0, "excellent").otherwise(v["image_quality"]).alias("imageQuality"),
        F.struct(v["pedestrian_path"]["visible"].alias("visible"), v["pedestrian_path"]["condition"].alias("condition"))
        .alias("pedestrianPath"),
        F.when(n % 5 != 0, F.struct(v["curb_ramp"]["visible"].alias("visible"), v["curb_ramp"]["condition"].alias("condition")))
        .alias("curbRamp"),
        F.struct(v["stairs"]["visible"].alias("visible")).alias("stairs"),
        F.struct(F.when(v["surface"]["type"] == "other", "marble").otherwise(v["surface"]["type"]).alias("type"),
                 v["surface"]["condition"].alias("condition")).alias("surface"),
        F.struct(v["obstacle"]["visible"].alias("visible"), v["obstacle"]["severity"].alias("severity"),
                 F.concat(F.lit("  "), F.repeat(v["obstacle"]["description"], 12)).alias("description")).alias("obstacle"),
        F.struct(v["crossing"]["visible"].alias("visible"), F.array_append(v["crossing"]["accessible_features"], "teleporter")
                 .alias("accessibleFeatures")).alias("crossing"),
        F.struct(v["clear_passage"]["classification"].alias("classification")).alias("clearPassage"),
        F.array_join("observation.uncertain_findings", " ; ").alias("uncertainFindings")))
    from footscape.schemas import RAW_OBSERVATION
    return o.select("observation_id", F.from_json(body, RAW_OBSERVATION).alias("raw"))


@query
def validate_observations(spark, sf):
    return O.validate_observations(raw_observations(spark, sf)).select(
        "observation_id", "ok", F.size("errors").alias("n_errors"), joined("errors").alias("errors"))


@query
def normalise_observations(spark, sf):
    o = F.col("observation")
    return O.normalise_observations(raw_observations(spark, sf)).select(
        "observation_id", o["image_quality"].alias("quality"), o["curb_ramp"]["visible"].alias("ramp"),
        o["surface"]["type"].alias("surface"), F.array_join(o["crossing"]["accessible_features"], ",").alias("features"),
        F.length(o["obstacle"]["description"]).alias("description_chars"), F.size(o["uncertain_findings"]).alias("n_uncertain"))


@query
def reading_quality(spark, sf):
    return O.reading_sufficient(O.empty_observation(D.observations(spark, sf))).select("observation_id", "sufficient", "is_empty")


@query
def observations_newest(spark, sf):
    newest = O.observations_by_segment(O.filter_active(D.observations(spark, sf)), P.NEWEST_OBSERVATIONS)
    return newest.select("segment_id", "observation_id", "rn")


@query
def first_segment(spark, sf):
    return O.first_observation_segment(D.observations(spark, sf)).select("observation_id", "segment_id")


@query
def feature_votes(spark, sf):
    return O.votes_long(O.vote_features(linked(spark, sf))).filter("informative > 0").select(
        "segment_id", "path", "value", "support", "informative", r("agreement", 4).alias("agreement"), "tie")


@query
def vote_ranks(spark, sf):
    return O.rank_votes(linked(spark, sf)).select("segment_id", "path", "value", "support", "rank")


@query
def observation_agreement(spark, sf):
    return O.observation_agreement(O.vote_features(linked(spark, sf))).select(
        "segment_id", r("agreement", 4).alias("agreement"), r("conflict", 4).alias("conflict"), joined("contested").alias("contested"))


@query
def observation_summary(spark, sf):
    return O.observation_summary(O.vote_features(linked(spark, sf))).select(
        "segment_id", "observation_count", "informative_count", "source_label",
        F.array_join("image_qualities", ",").alias("qualities"), joined("uncertain_findings").alias("uncertain"))


@query
def crossing_features(spark, sf):
    return O.crossing_features(linked(spark, sf))


@query
def visual_evidence(spark, sf):
    v = O.visual_evidence(D.observations(spark, sf))

    def text(c):
        return joined(F.transform(c, lambda e: F.concat(
            e["id"], F.lit(":"), F.floor(e["weight"] * 1000 + 0.5).cast("string"))))

    return v.select("segment_id", text("visual_barriers").alias("barriers"), text("visual_positives").alias("positives"))


# --- assessment --------------------------------------------------------------
@query
def assess_status(spark, sf):
    return status_columns(assessed(spark, sf))


def status_columns(assessments: DataFrame) -> DataFrame:
    return assessments.select(
        "segment_id", "region_id", "status", "reason", "accessibility_score", "evidence_confidence", "freshness_state",
        "evidence_age_days", joined("barriers").alias("barriers"), joined("positive_features").alias("positives"),
        F.array_join("sources", ",").alias("sources"), "observation_count", "informative_count")


@query
def reassessed_observations(spark, sf):
    """Every ninth observation comes later: what it touches is assessed again, and all is as if it had been there."""
    obs, segments, reports, now = D.observations(spark, sf), D.segments(spark, sf), D.reports(spark, sf), D.now_observations()
    late = F.crc32("observation_id") % 9 == 0
    before = A.assess(segments, obs.filter(~late), reports, now)
    return status_columns(IN.replaced(before, IN.observation_batch(obs.filter(late), segments, obs, reports, now)))


@query
def reassessed_verifications(spark, sf):
    """Verifications come after an assessment without them; the segments they touch are assessed again."""
    obs, segments, reports, now = D.observations(spark, sf), D.segments(spark, sf), D.reports(spark, sf), D.now_observations()
    kind = segments.schema["manual"].dataType.simpleString()
    bare = segments.withColumn("manual", F.lit(None).cast(kind))
    before = A.assess(bare, obs, reports, now)
    events = segments.filter("manual IS NOT NULL").select("segment_id", "manual.result", "manual.status", F.lit("seen on the spot").alias("notes"), "manual.at")
    seen = segments.select("segment_id", F.coalesce("manual.status", F.lit("unverified")).alias("status"))  # what a confirmation confirmed
    _, fresh = IN.verification_batch(events, bare, obs, reports, seen, now)
    return status_columns(IN.replaced(before, fresh))


@query
def score_breakdown(spark, sf):
    return assessed(spark, sf).filter("accessibility_score is not null").select(
        "segment_id", "accessibility_score", "raw_score", "total_penalty", "total_bonus", "capped_bonus", "ceiling")


@query
def folded_evidence(spark, sf):
    df = A.assess_inputs(D.segments(spark, sf), D.observations(spark, sf), D.reports(spark, sf)).withColumn(
        "manually_verified", F.coalesce(F.col("manual")["at"].isNotNull(), F.lit(False)))
    df = S.dedupe_evidence(A.union_evidence(T.derive_tag_evidence(df)))

    def side(c, label):
        return df.select("segment_id", F.lit(label).alias("side"), F.explode_outer(c).alias("e")).filter("e is not null")

    rows = side("barriers_folded", "b").unionByName(side("positives_folded", "p"))
    return rows.select("segment_id", "side", "e.id", r("e.weight", 4).alias("weight"), joined("e.sources").alias("sources"))


@query
def confidence(spark, sf):
    parts = F.col("confidence_parts")
    points = F.map_from_entries(F.transform(parts, lambda p: F.struct(p["key"], p["points"])))
    a = assessed(spark, sf)
    zero = F.lit(0.0)
    return a.select(
        "segment_id", "evidence_confidence", "classifiable",
        F.coalesce(points["confidence.tag_metadata"], zero).alias("tag_points"),
        F.coalesce(points["confidence.analysed_imagery"], zero).alias("image_points"),
        F.coalesce(points["confidence.agreement"], zero).alias("agreement_points"),
        F.coalesce(points["confidence.conflict"], zero).alias("conflict_points"),
        F.coalesce(points["confidence.verified_reports"], zero).alias("report_points"))


@query
def freshness(spark, sf):
    s = D.segments(spark, sf).withColumn("verified_at", F.col("manual")["at"])
    f = S.is_stale(S.freshness_state(s, D.now_observations(), evidence_at="osm_ts", verified_at="verified_at"))
    return f.select("segment_id", "freshness_state", "age_days", "freshness_verified", "is_stale")


@query
def status_counts(spark, sf):
    return A.status_counts(assessed(spark, sf))


@query
def report_barriers(spark, sf):
    return A.report_barrier(D.reports(spark, sf)).select("report_id", "barrier")


@query
def reports_by_segment(spark, sf):
    return A.reports_by_segment(D.reports(spark, sf)).select(
        "segment_id", "verified_report_count", joined(F.transform("report_barriers", lambda b: b["id"])).alias("barriers"))
