"""Assessment: all evidence of every segment to score, confidence, freshness and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footscape import params as P
from footscape.functions.arrays import gather, optional
from footscape.functions.numbers import half_up, lookup
from footscape.operators.observations import visual_evidence
from footscape.operators.scoring import (
    classify_status, evidence_confidence, explain_score, freshness_state, score_segments, sorted_breakdown)
from footscape.operators.tag_evidence import EVIDENCE, derive_tag_evidence
from footscape.session import stored


def report_barrier(reports: DataFrame) -> DataFrame:
    """Add `barrier`: what a report category says; null for `other`."""
    return reports.withColumn("barrier", lookup(F.col("category"), P.CATEGORY_BARRIER, None, "string"))


def reports_by_segment(reports: DataFrame) -> DataFrame:
    """Verified reports per segment: count, newest verification and the barriers in first-report order.

    Reports are first reduced to one row per (segment, category): repeated reports
    of one kind weigh the same as a single one, so the fold needs only the first.
    """
    verified = reports.filter((F.col("status") == "verified") & F.col("segment_id").isNotNull())
    per_kind = report_barrier(verified).groupBy("segment_id", "barrier").agg(
        F.count(F.lit(1)).alias("n"), F.max("verified_at").alias("verified_at"),
        F.min(F.struct(F.coalesce("created_at", F.lit(0).cast("timestamp")).alias("t"), "report_id")).alias("first"))
    return per_kind.groupBy("segment_id").agg(
        F.sum("n").alias("verified_report_count"),
        F.max("verified_at").alias("last_report_at"),
        # one entry per barrier id: bounded by the vocabulary
        F.sort_array(F.collect_list(F.when(F.col("barrier").isNotNull(), F.struct("first", "barrier")))).alias("kinds"),
    ).select("segment_id", "verified_report_count", "last_report_at", F.transform("kinds", lambda k: F.struct(
        k["barrier"].alias("id"), F.lit("citizen").alias("source"),
        F.lit("reported by a resident and confirmed by a reviewer").alias("detail"),
        F.lit(P.REPORT_WEIGHT).alias("weight"))).cast(EVIDENCE).alias("report_barriers"))


def assess_inputs(segments: DataFrame, obs: DataFrame, reports: DataFrame,
                  limit: int | None = None) -> DataFrame:
    """Every segment with its reduced visual and report evidence.

    Both evidence sides are aggregated to one row per segment before the join.
    """
    return (segments
            .join(visual_evidence(obs, limit), "segment_id", "left")
            .join(reports_by_segment(reports), "segment_id", "left"))


def union_evidence(df: DataFrame) -> DataFrame:
    """Concatenate evidence in its fixed order: tags, images, then reports or the manual check."""
    none = F.array().cast(EVIDENCE)
    manual = F.when(F.col("manually_verified") & (F.col("manual")["status"] == "accessible"), F.array(F.struct(
        F.lit("manually_verified").alias("id"), F.lit("manual").alias("source"),
        F.lit("verified on site").alias("detail"), F.lit(1.0).alias("weight"))).cast(EVIDENCE))
    return df.withColumns({
        "barriers_in": F.concat("tag_barriers", F.coalesce("visual_barriers", none), F.coalesce("report_barriers", none)),
        "positives_in": F.concat("tag_positives", F.coalesce("visual_positives", none), F.coalesce(manual, none)),
    })


def provenance_sources(df: DataFrame) -> DataFrame:
    """Add `sources`: which kinds of evidence the assessment rests on, in fixed order."""
    c = F.col
    tags = (c("informativeness") > 0) | (F.size("tags") > 0)
    citizen = (F.coalesce(c("n_citizen"), F.lit(0)) > 0) | (c("verified_report_count") > 0)
    return df.withColumn("sources", gather([
        optional(tags, F.lit("osm")),
        optional(F.coalesce(c("n_mapillary"), F.lit(0)) > 0, F.lit("mapillary")),
        optional(citizen, F.lit("citizen")), optional(c("manually_verified"), F.lit("manual"))], "array<string>"))


def assess(segments: DataFrame, obs: DataFrame, reports: DataFrame, now: Column,
           params: P.Params = P.DEFAULT, materialise: bool = True) -> DataFrame:
    """One explainable assessment row per segment.

    The shuffles are: observations by segment (already cut to the newest few),
    reports by (segment, kind), and the segments themselves for the two joins.
    The result is a table that several later steps read, so it is written out
    once; this also keeps a later filter from being rewritten back through every
    scoring expression.
    """
    df = assess_inputs(segments, obs, reports)
    zero = F.lit(0)
    df = derive_tag_evidence(df).withColumns({
        "observation_count": F.coalesce("observation_count", zero),
        "informative_count": F.coalesce("informative_count", zero),
        "agreement": F.coalesce("agreement", F.lit(1.0)),
        "conflict": F.coalesce("conflict", F.lit(0.0)),
        "contested": F.coalesce("contested", F.array().cast("array<string>")),
        "uncertain_findings": F.coalesce("uncertain_findings", F.array().cast("array<string>")),
        "verified_report_count": F.coalesce("verified_report_count", zero),
        "manually_verified": F.coalesce(F.col("manual")["at"].isNotNull(), F.lit(False)),
    })
    df = union_evidence(df).withColumn("has_evidence", (
        (F.size("barriers_in") > 0) | (F.size("positives_in") > 0) | (F.col("informativeness") > 0)
        | (F.col("informative_count") > 0) | F.col("manually_verified")))
    df = sorted_breakdown(score_segments(df))
    scored = ["score", "raw_score", "ceiling", "ceiling_barrier"]
    df = df.withColumns({c: F.when(F.col("has_evidence"), F.col(c)) for c in scored})
    df = df.withColumns({
        "last_evidence_at": F.greatest("last_observed_at", "last_report_at", F.when(F.col("informativeness") > 0, F.col("osm_ts"))),
        "last_verified_at": F.when(F.col("manually_verified"), F.col("manual")["at"]),
        "override_status": F.when(F.coalesce(F.col("manual")["override"], F.lit(False)), F.col("manual")["status"]),
    })
    df = classify_status(evidence_confidence(freshness_state(df, now, params), params), params)
    df = provenance_sources(explain_score(df))
    out = df.select(
        *segments.columns,
        "status", "reason", F.col("score").alias("accessibility_score"), "evidence_confidence", "freshness_state",
        F.col("age_days").alias("evidence_age_days"), F.col("reference_at").alias("last_evidence_at"), "last_verified_at",
        "barriers", F.col("positives").alias("positive_features"), "hard_blocks", "sources", "observation_count",
        "informative_count", half_up(F.col("informativeness"), 2).alias("informativeness"), "known_tags",
        half_up(F.col("agreement"), 2).alias("agreement"), "contested", "uncertain_findings",
        "verified_report_count", "manually_verified", "decisive",
        F.lit(params.assessment_version).alias("assessment_version"),
        F.lit(params.analysis_version).alias("analysis_version"),
        now.alias("assessed_at"), "raw_score", "ceiling", "ceiling_barrier", "total_penalty", "total_bonus",
        "capped_bonus", "penalties", "bonuses", "resolved_conflicts", "confidence_parts", "classifiable", "explanation",
    )
    return stored(out) if materialise else out


def status_counts(assessments: DataFrame) -> DataFrame:
    return assessments.groupBy("region_id", "status").agg(
        F.count(F.lit(1)).alias("segments"), half_up(F.sum("length_m"), 1).alias("metres"))
