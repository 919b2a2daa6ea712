"""Priority, coverage, validation, search, projection, jobs and audit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footscape import params as P
from footscape.functions.arrays import gather, optional
from footscape.functions.numbers import clamp, half_up, half_up_int, lookup
from footscape.functions.text import hash_unit, phonetic_key, short_text
from footscape.operators.observations import newest_n
from footscape.operators.spatial import split_hot
from footscape.session import cut


# --- priority ------------------------------------------------------------------
def issue_worthy(assessments: DataFrame) -> DataFrame:
    return assessments.filter((F.col("status") == "inaccessible") | ((F.col("status") == "partial") & (F.size("barriers") > 0)))


def poi_pressure(pairs: DataFrame, radius_m: float = P.POI_RADIUS_M) -> DataFrame:
    """Summed, distance-decayed weight of the services around each segment; combined before the shuffle."""
    w = lookup(F.col("class"), P.POI_WEIGHTS, 0.0)
    # whole millionths, so that the order of addition cannot matter
    part = F.floor(w * (1 - F.col("distance_m") / radius_m * 0.7) * 1e6 + 0.5)
    return pairs.filter(F.col("distance_m") <= radius_m).groupBy("segment_id").agg(
        (F.sum(part) / 1e6).alias("poi_sum"), F.count(F.lit(1)).alias("poi_count"))


def priority_score(issues: DataFrame, params: P.Params = P.DEFAULT) -> DataFrame:
    """Seven weighted factors and the municipal boost; adds `breakdown`, `priority_score`, `priority_band`.

    Needs status, accessibility_score, evidence_confidence, freshness_state, barriers, kind,
    detour_ratio, poi_sum, verified_report_count, manual_boost.
    """
    c = F.col
    w = params.priority_weights
    unknown = (c("status") == "unverified") | c("accessibility_score").isNull()
    safety = F.arrays_overlap(F.col("barriers"), F.array(*[F.lit(b) for b in P.SAFETY_BARRIERS]))
    ratio = c("detour_ratio")
    factors = {
        "severity": F.when(unknown, 0.0).otherwise((F.lit(100.0) - c("accessibility_score")) / 100.0),
        "no_accessible_alternative": F.when(ratio.isNull(), 1.0).when(ratio <= 1.05, 0.0).otherwise(F.least(F.lit(1.0), ratio - 1)),
        "nearby_public_services": F.lit(1.0) - F.exp(-F.coalesce("poi_sum", F.lit(0.0)) / 1.5),
        "safety_impact": F.when(safety & c("kind").isin("crossing", "road_walkable"), 1.0).when(safety, 0.6)
        .when(c("kind") == "crossing", 0.35).otherwise(0.0),
        "verified_reports": F.least(F.lit(1.0), F.coalesce("verified_report_count", F.lit(0)) / 3.0),
        "evidence_confidence": F.coalesce("evidence_confidence", F.lit(0)) / 100.0,
        "freshness": lookup(c("freshness_state"), P.FRESHNESS_FACTOR, 0.0),
    }
    df = issues.withColumns({f"_{k}": clamp(v, 0, 1) for k, v in factors.items()})
    df = df.withColumn("_boost", clamp(F.coalesce("manual_boost", F.lit(0.0)), 0, 1) * float(P.BOOST_POINTS))
    rows = [F.struct(F.lit(f"priority.{k}").alias("key"), half_up(c(f"_{k}"), 3).alias("factor"),
                     half_up(c(f"_{k}") * float(w[k]), 1).alias("points"), F.lit(float(w[k])).alias("max")) for k in factors]
    boost = F.struct(F.lit("priority.municipal_boost").alias("key"), half_up(c("_boost") / P.BOOST_POINTS, 3).alias("factor"),
                     half_up(c("_boost"), 1).alias("points"), F.lit(float(P.BOOST_POINTS)).alias("max"))
    kind = "array<struct<key:string,factor:double,points:double,max:double>>"
    total = F.lit(0.0)
    for k in factors:
        total = total + c(f"_{k}") * float(w[k])
    df = df.withColumns({
        "breakdown": F.concat(F.array(*rows).cast(kind), optional(c("_boost") > 0, boost).cast(kind)),
        "priority_score": half_up_int(clamp(half_up(total + c("_boost")), 0, 100))})
    return priority_band(df).drop(*[f"_{k}" for k in factors], "_boost")


def priority_band(df: DataFrame) -> DataFrame:
    s = F.col("priority_score")
    return df.withColumn("priority_band", F.when(s >= 75, "critical").when(s >= 55, "high").when(s >= 35, "medium").otherwise("low"))


def issue_id(df: DataFrame) -> DataFrame:
    return df.withColumn("issue_id", F.concat_ws("_", F.lit("issue"), "segment_id"))


def issue_carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """Keep workflow state of stored issues; a resolved one reopens, one no longer worthy is resolved with score 0."""
    state = old.select("issue_id", F.col("status").alias("_status"), F.col("manual_boost").alias("_boost"),
                       F.col("assigned_department").alias("_dept"), F.col("segment_id").alias("_segment"), F.lit(True).alias("_old"))
    j = new.drop("manual_boost", "assigned_department").withColumn("_new", F.lit(True)).join(state, "issue_id", "full")
    gone = F.col("_new").isNull()
    out = j.withColumns({
        "segment_id": F.coalesce("segment_id", "_segment"),
        "workflow_status": F.when(gone, "resolved").when(F.col("_old").isNull() | (F.col("_status") == "resolved"), "new").otherwise(F.col("_status")),
        "manual_boost": F.coalesce("_boost", F.lit(0.0)), "assigned_department": F.col("_dept"),
        "priority_score": F.when(gone, 0).otherwise(F.col("priority_score")),
        "resolved_reason": F.when(gone, "evidence_no_longer_shows_barrier"),
    })
    return priority_band(out).drop("_status", "_boost", "_dept", "_segment", "_old", "_new")


def apply_issue_patches(issues: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patched issues with `boost_changed`, rejected patches).  The latest valid patch per issue wins."""
    bad = (F.when(F.col("status").isNotNull() & ~F.col("status").isin(P.ISSUE_STATUSES), "unknown status")
           .when(F.col("manual_boost").isNotNull() & ~F.col("manual_boost").between(0, 1), "boost out of range"))
    checked = patches.withColumn("error", bad)
    latest = checked.filter("error is null").groupBy("issue_id").agg(
        F.max_by(F.struct("status", "assigned_department", "manual_boost", "notes"), "patched_at").alias("p"))
    p = F.col("p")
    out = issues.join(latest, "issue_id", "left").withColumns({
        "workflow_status": F.coalesce(p["status"], F.col("workflow_status")),
        "assigned_department": F.coalesce(F.left(p["assigned_department"], F.lit(120)), F.col("assigned_department")),
        "boost_changed": p["manual_boost"].isNotNull(), "manual_boost": F.coalesce(p["manual_boost"], F.col("manual_boost")),
        "notes": F.left(p["notes"], F.lit(1000))}).drop("p")
    return out, checked.filter("error is not null")


def top_barriers(issues: DataFrame, n: int = 4) -> DataFrame:
    """Open issues with the highest score and their first barrier."""
    open_ = issues.filter(~F.col("workflow_status").isin("resolved", "rejected") & (F.col("priority_score") > 0))
    return open_.orderBy(F.desc("priority_score"), "issue_id").limit(n).withColumn("barrier", F.get("barriers", F.lit(0)))


def list_issues(issues: DataFrame, status: str | None = None, band: str | None = None, n: int = 100) -> DataFrame:
    df = issues
    if status is not None:
        df = df.filter(F.col("workflow_status") == status)
    if band is not None:
        df = df.filter(F.col("priority_band") == band)
    return df.orderBy(F.desc("priority_score"), "issue_id").limit(n)


# --- coverage ------------------------------------------------------------------
def coverage(segments: DataFrame, all_regions: bool = False) -> DataFrame:
    """Metres, counts and shares per region in one pass; with `all_regions` also a total row.

    Source classes exclude each other: a manual check counts before imagery, imagery before tags alone.
    """
    c = F.col
    status = F.coalesce("status", F.lit("unverified"))
    has = {s: F.coalesce(F.array_contains("sources", s), F.lit(False)) for s in ("manual", "mapillary", "osm")}
    classes = {
        "assessed": status != "unverified", "unknown": status == "unverified",
        **{s: status == s for s in P.ASSESSED},
        "manually_verified": has["manual"], "image_assessed": ~has["manual"] & has["mapillary"],
        "tags_only": ~has["manual"] & ~has["mapillary"] & has["osm"] & (status != "unverified"),
        "stale": F.coalesce(c("freshness_state") == "stale", F.lit(False)),
    }
    length = F.coalesce("length_m", F.lit(0.0))
    grouped = segments.rollup("region_id") if all_regions else segments.groupBy("region_id")
    imagery = F.count_if(c("image_count") > 0) if "image_count" in segments.columns else F.lit(0)
    agg = grouped.agg(
        F.sum(length).alias("_total"), F.count(F.lit(1)).alias("segments"),
        *[F.sum(F.when(k, length).otherwise(0.0)).alias(f"_{n}") for n, k in classes.items()],
        *[F.count_if(k).alias(f"{n}_segments") for n, k in classes.items()],
        imagery.alias("with_imagery"), F.count_if("needs_inspection").alias("needs_inspection"))
    out = agg.select("region_id", "segments", half_up(c("_total")).alias("total_m"),
                     *[half_up(c(f"_{n}")).alias(f"{n}_m") for n in classes], *[f"{n}_segments" for n in classes],
                     *[F.when(c("_total") > 0, half_up(c(f"_{n}") / c("_total") * 100, 1)).otherwise(0.0).alias(f"{n}_pct") for n in classes],
                     "with_imagery", "needs_inspection")
    return out.withColumn("region_id", F.coalesce("region_id", F.lit("all"))) if all_regions else out


def overview(cov: DataFrame, reports: DataFrame, issues: DataFrame, usage: DataFrame) -> DataFrame:
    """Coverage per region with pending reports, critical issues and the last week's calls."""
    pending = reports.filter("status = 'pending'").groupBy("region_id").agg(F.count(F.lit(1)).alias("pending_reports"))
    critical = issues.filter("priority_score >= 75").groupBy("region_id").agg(F.count(F.lit(1)).alias("critical_issues"))
    week = usage.orderBy(F.desc("day")).limit(7).agg(F.sum("calls")).scalar()
    out = cov.join(pending, "region_id", "left").join(critical, "region_id", "left")
    return out.withColumns({"pending_reports": F.coalesce("pending_reports", F.lit(0)),
                            "critical_issues": F.coalesce("critical_issues", F.lit(0)), "calls_this_week": F.coalesce(week, F.lit(0))})


def stale_share(segments: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Stale segments per region and whether their share calls for a new survey."""
    s = segments.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(F.col("freshness_state").isin("stale", "none")).alias("stale"))
    return s.withColumn("share", half_up(F.col("stale") / F.col("segments"), 3)).withColumn("flagged", F.col("stale") / F.col("segments") > threshold)


# --- validation ----------------------------------------------------------------
def validation_metrics(labels: DataFrame) -> DataFrame:
    """Agreement and error direction per region; a missing prediction counts as unverified."""
    rank = {"accessible": 3, "partial": 2, "inaccessible": 1}
    p, t = lookup(F.col("predicted_status"), rank, 0, "int"), lookup(F.col("true_status"), rank, 0, "int")
    classified = F.coalesce(F.col("predicted_status") != "unverified", F.lit(False))
    m = labels.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(classified).alias("classified"),
        F.count_if(classified & (F.col("predicted_status") == F.col("true_status"))).alias("agreed"),
        F.count_if(classified & (p > t)).alias("optimistic"), F.count_if(classified & (p < t)).alias("pessimistic"))
    return m.withColumns({
        "declined": F.col("samples") - F.col("classified"), "sufficient": F.col("classified") >= 30,
        "agreement": F.when(F.col("classified") > 0, half_up(F.col("agreed") / F.col("classified"), 3)),
        "caveat": F.when(F.col("classified") < 30, "sample_below_30")})


def confusion_matrix(labels: DataFrame) -> DataFrame:
    """True by predicted status; all columns are present."""
    p = labels.filter(F.col("true_status").isin(P.ASSESSED)).withColumn("_p", F.coalesce("predicted_status", F.lit("unverified")))
    counts = p.groupBy("true_status").pivot("_p", P.STATUSES).count().fillna(0)
    full = labels.sparkSession.createDataFrame([(s,) for s in P.ASSESSED], "true_status string")
    return full.join(counts, "true_status", "left").fillna(0)


def barrier_precision_recall(labels: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    t, p = F.coalesce("true_barriers", none), F.coalesce("predicted_barriers", none)
    rows = labels.select(F.explode(F.array_union(t, p)).alias("barrier"), t.alias("t"), p.alias("p"))
    in_t, in_p = F.array_contains("t", F.col("barrier")), F.array_contains("p", F.col("barrier"))
    m = rows.groupBy("barrier").agg(F.count_if(in_t & in_p).alias("tp"), F.count_if(in_p & ~in_t).alias("fp"), F.count_if(in_t & ~in_p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return m.withColumns({"precision": F.when(tp + fp > 0, half_up(tp / (tp + fp), 3)), "recall": F.when(tp + fn > 0, half_up(tp / (tp + fn), 3))})


def freeze_labels(labels: DataFrame, log: DataFrame) -> DataFrame:
    """Attach what was believed when the label was given: the newest log row at or before it.

    labels: (segment_id, labelled_by, true_status, true_barriers, labelled_at).  Only assessed
    states are valid truths; unknown barriers are dropped; one row per segment and labeller.
    """
    ok = labels.filter(F.col("true_status").isin(P.ASSESSED)).withColumn(
        "true_barriers", F.array_intersect("true_barriers", F.array(*[F.lit(b) for b in P.BARRIERS])))
    last = ok.groupBy("segment_id", "labelled_by").agg(F.max_by(F.struct("true_status", "true_barriers", "labelled_at"), "labelled_at").alias("l"))
    last = last.select("segment_id", "labelled_by", "l.*")
    # union and carry forward: one row per event instead of one per label and log pair
    w = Window.partitionBy("segment_id").orderBy("ts", "_is_label").rowsBetween(Window.unboundedPreceding, 0)
    state = F.struct("status", "accessibility_score", "evidence_confidence", "barriers", "assessment_version")
    events = log.select("segment_id", F.col("assessed_at").alias("ts"), F.lit(0).alias("_is_label"), state.alias("s"), F.lit(None).cast(
        last.schema["true_status"].dataType).alias("labelled_by"), F.lit(None).cast("string").alias("true_status"), F.lit(None).cast("array<string>").alias("true_barriers"))
    marks = last.select("segment_id", F.col("labelled_at").alias("ts"), F.lit(1).alias("_is_label"), F.lit(None).cast(
        events.schema["s"].dataType).alias("s"), "labelled_by", "true_status", "true_barriers")
    seen = events.unionByName(marks).withColumn("_s", F.last("s", ignorenulls=True).over(w)).filter("_is_label = 1")
    return seen.select("segment_id", "labelled_by", "true_status", "true_barriers", F.col("ts").alias("labelled_at"),
                       F.col("_s")["status"].alias("predicted_status"), F.col("_s")["accessibility_score"].alias("predicted_score"),
                       F.col("_s")["evidence_confidence"].alias("predicted_confidence"), F.col("_s")["barriers"].alias("predicted_barriers"),
                       F.col("_s")["assessment_version"].alias("assessment_version"))


def unlabelled_targets(assessments: DataFrame, labels: DataFrame, n: int = 20) -> DataFrame:
    """Classified segments without a label, least confident first."""
    return assessments.filter(F.col("status") != "unverified").join(labels.select("segment_id"), "segment_id", "left_anti").orderBy(
        "evidence_confidence", "segment_id").limit(n)


# --- search --------------------------------------------------------------------
def street_index(segments: DataFrame) -> DataFrame:
    """One row per phonetic street key: names, segments and a representative point."""
    name = F.coalesce(F.nullif(F.col("street_name_el"), F.lit("")), F.nullif(F.col("street_name"), F.lit("")))
    mid = F.get("geometry", F.floor(F.size("geometry") / F.lit(2)).cast("int"))
    s = segments.withColumn("key", phonetic_key(name)).filter(F.col("key") != "")
    return s.groupBy("key").agg(
        F.count(F.lit(1)).alias("segments"),
        F.min_by(F.struct("street_name", "street_name_el", mid["lng"].alias("lng"), mid["lat"].alias("lat")), "segment_id").alias("f")).select(
        "key", "segments", "f.*")


def prefix_index(index: DataFrame, k: int = 6) -> DataFrame:
    """(qk, rank, key, segments, names): for every start of a street's name, or of a word of it, the k streets with most segments.

    Starts that all streets share keep k rows only, and these are chosen in each task before rows are dealt out.
    """
    names = index.select("key", "segments", "street_name", "street_name_el", F.explode(F.array_distinct(F.array(
        phonetic_key(F.col("street_name")), phonetic_key(F.col("street_name_el"))))).alias("nk")).filter("nk != ''")
    # the whole key by prefix, every word alone
    starts = F.array_distinct(F.concat(F.array("nk"), F.split("nk", " ")))
    w = names.select("key", "segments", "street_name", "street_name_el", F.explode(starts).alias("w"))
    pre = w.withColumn("qk", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda n: F.left("w", n)))).drop("w").dropDuplicates(["key", "qk"])
    return newest_n(pre, ["qk"], [F.desc("segments"), F.asc("key")], k, "rank")


def suggest_streets(queries: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Streets whose name, or a word of it, starts like the query; most segments first. `prefixes`: see `prefix_index`; a query
    meets only the rows of its answer."""
    q = queries.filter(F.length(F.trim("query")) >= 2).withColumn("qk", phonetic_key(F.trim("query"))).filter(F.col("qk") != "")
    q, pre = split_hot(q, prefixes, ["qk"])
    return q.join(pre, ["qk", "_salt"]).drop("_salt", "qk")


# --- projection ------------------------------------------------------------------
def measured_mix(segments: DataFrame) -> DataFrame:
    """Share of each assessed status; the fixed mix while fewer than 30 are measured."""
    counts = segments.agg(*[F.count_if(F.col("status") == s).alias(s) for s in P.ASSESSED])
    total = sum([F.col(s) for s in P.ASSESSED[1:]], F.col(P.ASSESSED[0]))
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("status"),
                              F.when(total < 30, F.lit(P.FALLBACK_MIX[s])).otherwise(F.col(s) / total).alias("share")) for i, s in enumerate(P.ASSESSED)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def coverage_projection(segments: DataFrame) -> DataFrame:
    """Fill unverified segments from the measured mix by a hash of the id; `simulated` marks them.

    Never feed the result to routing.
    """
    mix = cut(measured_mix(segments))
    share = {s: mix.filter(F.col("status") == s).select("share").scalar() for s in P.ASSESSED}
    roll = hash_unit(F.col("segment_id"))
    status = F.when(roll < share["accessible"], "accessible").when(roll < share["accessible"] + share["partial"], "partial").otherwise("inaccessible")
    df = segments.withColumn("simulated", F.col("status") == "unverified").withColumn("_s", F.when(F.col("simulated"), status).otherwise(F.col("status")))
    spread = hash_unit(F.concat("segment_id", F.lit(":score")))
    low = lookup(F.col("_s"), {k: v[0] for k, v in P.SCORE_BANDS.items()})
    high = lookup(F.col("_s"), {k: v[1] for k, v in P.SCORE_BANDS.items()})
    return df.withColumns({"status": F.col("_s"), "score": F.when(F.col("simulated"), half_up_int(low + spread * (high - low)))
                           .otherwise(F.col("accessibility_score"))}).drop("_s")


# --- assessments over time ---------------------------------------------------------
def assessment_changes(log: DataFrame) -> DataFrame:
    """History rows: where the status differs from the segment's previous one."""
    w = Window.partitionBy("segment_id").orderBy("assessed_at")
    return log.withColumn("status_before", F.lag("status").over(w)).filter(~F.col("status").eqNullSafe(F.col("status_before")))


# --- jobs and audit ------------------------------------------------------------------
def job_outcomes(jobs: DataFrame) -> DataFrame:
    """Add `outcome`: failed when nothing succeeded, partial on some errors, else completed."""
    return jobs.withColumn("outcome", F.when((F.col("error_count") > 0) & (F.col("succeeded") == 0), "failed")
                           .when(F.col("error_count") > 0, "partial").otherwise("completed"))


def stale_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Running or queued jobs silent for half an hour become failed; undated ones count as live."""
    since = F.coalesce("started_at", "created_at")
    dead = F.col("status").isin("queued", "running") & F.coalesce(since <= now - F.make_dt_interval(mins=F.lit(P.STALE_JOB_MINUTES)), F.lit(False))
    return jobs.withColumns({"stale": dead, "status": F.when(dead, "failed").otherwise(F.col("status"))})


SECRET = "(?i)token|secret|password|authorization|apikey"


def redact(c: Column, kind: T.DataType, depth: int = 0) -> Column:
    """A value of any type without what stands under secret names, at every level: at most 40 fields or entries, 30 elements,
    400 characters; what lies deeper than four levels is cut off."""
    if depth > 4:
        return F.when(c.isNotNull(), F.lit("[truncated]"))
    if isinstance(kind, T.StringType):
        return F.when(F.length(c) > 400, F.concat(F.left(c, F.lit(399)), F.lit("…"))).otherwise(c)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(F.slice(c, 1, 30), lambda v: redact(v, kind.elementType, depth + 1))
    if isinstance(kind, T.MapType):
        clean = F.map_filter(c, lambda k, v: ~k.cast("string").rlike(SECRET))
        first = F.map_from_entries(F.slice(F.map_entries(clean), 1, 40))
        return F.transform_values(first, lambda k, v: redact(v, kind.valueType, depth + 1))
    if isinstance(kind, T.StructType):
        fields = [f for f in kind.fields if not re.search(SECRET, f.name)][:40]
        return F.when(c.isNotNull(), F.struct(*[redact(c[f.name], f.dataType, depth + 1).alias(f.name) for f in fields]) if fields else F.lit(None))
    return c.cast("string")


def redact_audit(audit: DataFrame, columns: tuple[str, ...] = ("previous", "next")) -> DataFrame:
    return audit.withColumns({c: redact(F.col(c), audit.schema[c].dataType) for c in columns})


def audit_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str], actor: str) -> DataFrame:
    """One redacted row per changed record with its previous and next values."""
    def values(df, name):
        m = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns]),
                                        lambda e: e["v"].isNotNull()))
        return df.select(key, m.alias(name), F.to_json(F.struct(*columns)).alias(f"_{name}"))

    j = values(before, "previous").join(values(after, "next"), key, "full")
    changed = j.filter(~F.col("_previous").eqNullSafe(F.col("_next"))).drop("_previous", "_next")
    return redact_audit(changed).withColumns({"actor": F.lit(actor), "target_id": F.col(key)})


def region_catalogue(regions: DataFrame) -> DataFrame:
    """Regions with `is_default`: the first with a published bundle, else the first."""
    first = regions.agg(F.min(F.struct(F.col("bundle_version").isNull().alias("u"), F.col("region_id").alias("id")))["id"]).scalar()
    return regions.withColumn("is_default", F.col("region_id") == first)


def valid_overrides(verifications: DataFrame) -> DataFrame:
    """Add `error` for verifications that break a rule; a correction needs a status and a reason."""
    fix = F.col("result") == "corrected"
    return verifications.withColumn("error", F.when(~F.coalesce(F.col("result").isin("confirmed", "corrected", "needs_inspection"), F.lit(False)), "unknown result")
                                    .when(fix & ~F.coalesce(F.col("status").isin(P.STATUSES), F.lit(False)), "correction without status")
                                    .when(fix & (F.length(F.trim(F.coalesce("notes", F.lit("")))) < 5), "correction without reason"))


def map_filter_view(segments: DataFrame, status: list[str] | None = None, verified: bool = False, recent: bool = False,
                    wheelchair: bool = False) -> DataFrame:
    """Segments passing the chosen chips, with `view`: assessed, unknown or projected."""
    df = segments
    if status:
        df = df.filter(F.col("status").isin(status))
    if verified:
        df = df.filter("manually_verified")
    if recent:
        df = df.filter("freshness_state = 'recent'")
    if wheelchair:
        df = df.filter("status = 'accessible'")
    simulated = F.col("simulated") if "simulated" in segments.columns else F.lit(False)
    return df.withColumn("view", F.when(simulated, "projected").when(F.col("status") == "unverified", "unknown").otherwise("assessed"))


def status_style(df: DataFrame) -> DataFrame:
    """Add the legend colour and glyph of the status."""
    return df.withColumns({"color": lookup(F.col("status"), {s: c for s, c, _ in P.STATUS_STYLE}, None, "string"),
                           "glyph": lookup(F.col("status"), {s: g for s, _, g in P.STATUS_STYLE}, None, "string")})


def network_length_label(df: DataFrame, metres: str = "length_m", column: str = "length_label") -> DataFrame:
    m = F.col(metres)
    km = F.regexp_replace(F.format_number(m / 1000, 1), r"\.0$", "")
    return df.withColumn(column, F.when(m.isNull(), "—").when(m < 1000, F.concat(F.format_number(half_up(m), 0), F.lit(" m")))
                         .otherwise(F.concat(km, F.lit(" km"))))


def merge_saved(local: DataFrame, account: DataFrame, n: int = 100) -> DataFrame:
    """Union of two saved lists per user, newest first, one row per place, at most n."""
    both = local.unionByName(account).groupBy("user_id", "place_id").agg(F.max("saved_at").alias("saved_at"))
    return newest_n(both, ["user_id"], [F.desc("saved_at"), F.asc("place_id")], n)


def segment_detail(segments: DataFrame, assessments: DataFrame, linked_obs: DataFrame, events: DataFrame) -> DataFrame:
    """One nested row per segment: assessment, the 12 newest observations, the 10 newest events."""
    o = newest_n(linked_obs, ["segment_id"], [F.desc_nulls_last("captured_at"), F.asc("observation_id")], 12, "_rn").groupBy("segment_id").agg(
        F.sort_array(F.collect_list(F.struct("_rn", "observation_id", "captured_at", "source_type"))).alias("observations"))
    e = newest_n(events, ["segment_id"], [F.desc("created_at")], 10, "_rn").groupBy("segment_id").agg(
        F.sort_array(F.collect_list(F.struct("_rn", "result", "created_at"))).alias("events"))
    return segments.join(assessments, "segment_id", "left").join(o, "segment_id", "left").join(e, "segment_id", "left")


def observation_image(obs: DataFrame, images: DataFrame, radius_m: float = 50.0) -> DataFrame:
    """The frame behind each observation: by id, else the nearest one within the radius."""
    from footscape.functions import geo as G
    from footscape.operators.spatial import shape_cells, grid_cells

    ids = images.select(F.col("image_id").alias("_hit"))
    j = obs.join(ids, obs["image_id"] == ids["_hit"], "left")
    missing = j.filter(F.col("_hit").isNull() & F.col("lng").isNotNull()).select("observation_id", "lng", "lat")
    deg = 0.001
    around = shape_cells(missing.withColumn("geometry", F.array(G.point(F.col("lng"), F.col("lat")))).drop("lng", "lat")
                         .withColumn("p", F.get("geometry", F.lit(0))), deg, radius_m).drop("geometry")
    big, small = split_hot(grid_cells(images.select("image_id", "lng", "lat"), deg), around, ["cx", "cy"])
    d = G.haversine(F.col("lng"), F.col("lat"), F.col("p")["lng"], F.col("p")["lat"])
    near = big.join(small, ["cx", "cy", "_salt"]).withColumn("d", d).filter(F.col("d") <= radius_m).groupBy("observation_id").agg(
        F.min(F.struct("d", "image_id")).alias("n"))
    return j.join(near, "observation_id", "left").withColumn("image_id", F.coalesce("_hit", F.col("n")["image_id"])).withColumn(
        "matched_by", F.when(F.col("_hit").isNotNull(), "id").when(F.col("n").isNotNull(), "distance")).drop("_hit", "n")
