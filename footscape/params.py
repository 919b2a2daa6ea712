"""Fixed values and run-time tunables.

Everything here is a constant of the domain model.  `Params` is the bundle an
operator receives; `merge_params` applies the few overrides that may change at
run time and `validate_params` checks them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: vocabularies -------------------------------------------
STATUSES = ["accessible", "partial", "inaccessible", "unverified"]
ASSESSED = ["accessible", "partial", "inaccessible"]
BARRIERS = [
    "steps", "missing_curb_ramp", "high_kerb", "damaged_surface", "uneven_surface",
    "unsuitable_surface", "blocking_obstacle", "restricted_passage", "narrow_width",
    "steep_incline", "moderate_incline", "no_pedestrian_path", "crossing_without_ramp",
    "wheelchair_tagged_no",
]
REPORT_CATEGORIES = [
    "broken_pavement", "missing_curb_ramp", "steps", "blocked_sidewalk", "narrow_passage",
    "surface_problem", "crossing_problem", "temporary_obstruction", "other",
]
CLOSED_REPORT_STATUSES = ["rejected", "resolved", "withdrawn", "duplicate"]
ISSUE_STATUSES = ["new", "needs_review", "verified", "assigned", "in_progress", "resolved", "rejected"]
PROFILES = ["wheelchair", "reduced_mobility", "stroller", "balanced"]
SHORTEST = "__shortest__"

# --- fixed values: score ---------------------------------------------------
SCORE_BASE = 100
PENALTIES = {
    "steps": 45, "wheelchair_tagged_no": 35, "no_pedestrian_path": 30, "missing_curb_ramp": 25,
    "crossing_without_ramp": 22, "high_kerb": 20, "damaged_surface": 20, "blocking_obstacle": 20,
    "steep_incline": 20, "unsuitable_surface": 18, "restricted_passage": 15, "narrow_width": 15,
    "moderate_incline": 10, "uneven_surface": 10,
}
POSITIVES = {
    "wheelchair_tagged_yes": 10, "manually_verified": 10, "curb_ramp": 8, "flush_kerb": 8,
    "clear_path": 6, "good_paved_surface": 6, "accessible_crossing": 5, "ramp_present": 5,
    "tactile_paving": 4, "adequate_width": 4,
}
MAX_BONUS = 20
CEILINGS = {
    "wheelchair_tagged_no": 12, "steps": 18, "blocking_obstacle": 42, "no_pedestrian_path": 52,
    "missing_curb_ramp": 62, "crossing_without_ramp": 62, "steep_incline": 62, "high_kerb": 64,
    "narrow_width": 66, "damaged_surface": 70, "unsuitable_surface": 72, "restricted_passage": 74,
}
# A barrier and the positive that contradicts it; applied in this order.
CONTRADICTIONS = [
    ("missing_curb_ramp", "curb_ramp"), ("high_kerb", "flush_kerb"),
    ("narrow_width", "adequate_width"), ("no_pedestrian_path", "clear_path"),
    ("damaged_surface", "good_paved_surface"), ("unsuitable_surface", "good_paved_surface"),
    ("uneven_surface", "good_paved_surface"), ("blocking_obstacle", "clear_path"),
    ("crossing_without_ramp", "curb_ramp"), ("wheelchair_tagged_no", "wheelchair_tagged_yes"),
]
CORROBORATION = 0.15
SINGLE_OBSERVATION_WEIGHT = 0.6
REPORT_WEIGHT = 0.85
CATEGORY_BARRIER = {
    "broken_pavement": "damaged_surface", "missing_curb_ramp": "missing_curb_ramp",
    "steps": "steps", "blocked_sidewalk": "blocking_obstacle", "narrow_passage": "narrow_width",
    "surface_problem": "unsuitable_surface", "crossing_problem": "crossing_without_ramp",
    "temporary_obstruction": "blocking_obstacle",
}

# --- fixed values: confidence ----------------------------------------------
TAG_POINTS = 65
IMAGE_POINTS = {"good": 17, "medium": 11, "poor": 4}
COUNTED_IMAGES = 3
AGREEMENT_POINTS = 15
CONFLICT_POINTS = 20
REPORT_POINTS = 6
MAX_REPORT_POINTS = 12
DECISIVE_FLOOR = 70
MANUAL_FLOOR = 85
AGE_FACTOR = {"recent": 1.0, "aging": 0.9, "stale": 0.75, "none": 0.6}

# --- fixed values: imagery and analysis budget -----------------------------
IMAGE_RADIUS_M = 22.0
IMAGE_SPACING_M = 12.0
IMAGE_MAX_AGE_YEARS = 8
TILE_IMAGE_LIMIT = 2000
FAILURE_LIMIT = 5
NEWEST_OBSERVATIONS = 20
MAX_IMPORT_KM2 = 25.0
WELD_DISTANCE_M = 4.0

# --- fixed values: routing -------------------------------------------------
STATUS_MULTIPLIER = {  # None = forbidden
    "wheelchair": {"accessible": 1.0, "partial": 2.6, "inaccessible": None, "unverified": 2.2},
    "reduced_mobility": {"accessible": 1.0, "partial": 2.0, "inaccessible": 9.0, "unverified": 1.8},
    "stroller": {"accessible": 1.0, "partial": 1.8, "inaccessible": 7.0, "unverified": 1.6},
    "balanced": {"accessible": 1.0, "partial": 1.35, "inaccessible": 3.0, "unverified": 1.15},
}
FORBIDDEN = {"wheelchair": ["steps", "wheelchair_tagged_no"], "reduced_mobility": [], "stroller": [], "balanced": []}
BARRIER_METRES = {
    "wheelchair": {
        "missing_curb_ramp": 220, "crossing_without_ramp": 200, "high_kerb": 200,
        "blocking_obstacle": 260, "restricted_passage": 150, "narrow_width": 180,
        "damaged_surface": 140, "unsuitable_surface": 130, "steep_incline": 240,
        "moderate_incline": 60, "uneven_surface": 70, "no_pedestrian_path": 200,
    },
    "reduced_mobility": {
        "steps": 400, "missing_curb_ramp": 130, "crossing_without_ramp": 120, "high_kerb": 120,
        "blocking_obstacle": 170, "restricted_passage": 90, "narrow_width": 90,
        "damaged_surface": 120, "unsuitable_surface": 100, "steep_incline": 200,
        "moderate_incline": 55, "uneven_surface": 60, "no_pedestrian_path": 140,
    },
    "stroller": {
        "steps": 350, "missing_curb_ramp": 110, "crossing_without_ramp": 100, "high_kerb": 130,
        "blocking_obstacle": 150, "restricted_passage": 90, "narrow_width": 110,
        "damaged_surface": 100, "unsuitable_surface": 110, "steep_incline": 120,
        "moderate_incline": 35, "uneven_surface": 70, "no_pedestrian_path": 120,
    },
    "balanced": {
        "steps": 90, "missing_curb_ramp": 45, "crossing_without_ramp": 40, "high_kerb": 45,
        "blocking_obstacle": 70, "restricted_passage": 35, "narrow_width": 35,
        "damaged_surface": 45, "unsuitable_surface": 40, "steep_incline": 70,
        "moderate_incline": 20, "uneven_surface": 25, "no_pedestrian_path": 50,
    },
}
UNKNOWN_RATE = {"wheelchair": 0.55, "reduced_mobility": 0.4, "stroller": 0.3, "balanced": 0.12}
STALE_RATE = {"wheelchair": 0.25, "reduced_mobility": 0.2, "stroller": 0.15, "balanced": 0.06}
SPEED_MPS = {"wheelchair": 0.9, "reduced_mobility": 0.8, "stroller": 1.05, "balanced": 1.2}
SNAP_RADIUS_M = 250.0
REPORT_SNAP_M = 35.0
HIGH_UNKNOWN = 0.4
MIN_ASSESSED_SHARE = 0.5
TURN_DEG = 35.0
SHARP_TURN_DEG = 110.0
OFF_ROUTE_M = 35.0
ADVANCE_M = 18.0

# --- fixed values: priority ------------------------------------------------
BOOST_POINTS = 15
POI_RADIUS_M = 250.0
POI_WEIGHTS = {
    "hospital": 1.0, "clinic": 0.8, "doctors": 0.6, "pharmacy": 0.5, "school": 0.8,
    "kindergarten": 0.6, "university": 0.6, "townhall": 0.9, "government": 0.8,
    "social_facility": 0.9, "bus_station": 0.8, "bus_stop": 0.4, "post_office": 0.5,
    "library": 0.5, "community_centre": 0.5,
}
SAFETY_BARRIERS = ["no_pedestrian_path", "crossing_without_ramp", "blocking_obstacle", "missing_curb_ramp"]
FRESHNESS_FACTOR = {"recent": 1.0, "aging": 0.6, "stale": 0.25, "none": 0.0}

# --- fixed values: duplicates, retention -----------------------------------
DUPLICATE_RADIUS_M = 40.0
DUPLICATE_WINDOW_DAYS = 45.0
DUPLICATE_MIN = 0.6
DUPLICATE_TOP = 5
RELATED = {
    "broken_pavement": ["surface_problem"],
    "surface_problem": ["broken_pavement"],
    "blocked_sidewalk": ["temporary_obstruction", "narrow_passage"],
    "temporary_obstruction": ["blocked_sidewalk"],
    "narrow_passage": ["blocked_sidewalk"],
    "missing_curb_ramp": ["crossing_problem"],
    "crossing_problem": ["missing_curb_ramp"],
}
REJECTED_PHOTO_DAYS = 30
ORPHAN_HOURS = 24
STALE_JOB_MINUTES = 30

# --- fixed values: presentation --------------------------------------------
STATUS_STYLE = [
    ("accessible", "#18A66A", "●"), ("partial", "#F2B84B", "◐"),
    ("inaccessible", "#E55757", "■"), ("unverified", "#AAB3BC", "○"),
]
SCORE_BANDS = {"accessible": (80, 96), "partial": (52, 78), "inaccessible": (14, 48)}
FALLBACK_MIX = {"accessible": 0.34, "partial": 0.41, "inaccessible": 0.25}


@dataclass(frozen=True)
class Params:
    """Run-time tunables with their defaults."""

    accessible_threshold: int = 80
    partial_threshold: int = 50
    min_confidence: int = 45
    recent_max_days: int = 365
    aging_max_days: int = 1095
    max_images_per_segment: int = 3
    max_analyses_per_job: int = 200
    max_analyses_per_day: int = 3000
    max_segment_length_m: float = 50.0
    failure_limit: int = FAILURE_LIMIT
    informative_only: bool = False
    priority_weights: dict = field(default_factory=lambda: dict(
        severity=30, no_accessible_alternative=20, nearby_public_services=15, safety_impact=10,
        verified_reports=10, evidence_confidence=8, freshness=7))
    assessment_version: str = "1.1.0"
    analysis_version: str = "1.0.0"


DEFAULT = Params()
TUNABLE = [f.name for f in fields(Params) if not f.name.endswith("_version")]


def merge_params(overrides: dict[str, Any] | None, defaults: Params = DEFAULT) -> Params:
    """Apply the overrides that name a tunable and are not null; ignore the rest."""
    known = {k: v for k, v in (overrides or {}).items() if k in TUNABLE and v is not None}
    return replace(defaults, **known)


def params_frame(spark: SparkSession, params: Params = DEFAULT) -> DataFrame:
    """The parameters as a one-row DataFrame."""
    p = params
    return spark.range(1).select(
        F.lit(p.accessible_threshold).cast("double").alias("accessible_threshold"),
        F.lit(p.partial_threshold).cast("double").alias("partial_threshold"),
        F.lit(p.min_confidence).cast("double").alias("min_confidence"),
        F.lit(p.recent_max_days).cast("double").alias("recent_max_days"),
        F.lit(p.aging_max_days).cast("double").alias("aging_max_days"),
        F.lit(float(sum(p.priority_weights.values()))).alias("weight_sum"),
        F.lit(p.max_analyses_per_day).cast("double").alias("max_analyses_per_day"),
    )


def validate_params(params: DataFrame) -> DataFrame:
    """Add `errors`: one message per broken rule, for any number of parameter rows."""
    def pct(c):
        return F.col(c).between(0, 100)

    checks = [
        (~(pct("accessible_threshold") & pct("partial_threshold")), "thresholds out of range"),
        (F.col("partial_threshold") >= F.col("accessible_threshold"), "partial threshold not below accessible"),
        (~pct("min_confidence"), "minimum confidence out of range"),
        (F.col("recent_max_days") >= F.col("aging_max_days"), "freshness thresholds not increasing"),
        ((F.col("weight_sum") <= 0) | (F.col("weight_sum") > 100), "priority weights out of range"),
        (~F.col("max_analyses_per_day").between(0, 5000), "daily limit out of range"),
    ]
    return params.withColumn(
        "errors", F.array_compact(F.array(*[F.when(bad, F.lit(msg)) for bad, msg in checks])))
