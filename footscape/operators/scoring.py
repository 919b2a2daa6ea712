"""Evidence folding, score, confidence, freshness and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footscape import params as P
from footscape.functions.arrays import gather, optional
from footscape.functions.numbers import clamp, half_up, half_up_int, lookup

FOLDED = "array<struct<id:string,sources:array<string>,details:array<string>,weight:double>>"


def fold_evidence(items: Column) -> Column:
    """Fold an ordered evidence array to one entry per id.

    The first item sets the weight; each later one takes the larger weight and
    adds the corroboration bonus when more than one source has been seen so far.
    """
    kind = "struct<id:string,sources:array<string>,details:array<string>,weight:double>"
    none = F.array().cast("array<string>")

    def fold(id_: Column) -> Column:
        # one pass over the items, whose entry is built once: nothing in a lambda is shared, so each mention is computed again
        start = F.struct(id_.alias("id"), none.alias("sources"), none.alias("details"), F.lit(None).cast("double").alias("weight")).cast(kind)

        def step(acc, e):
            sources = F.array_union(acc["sources"], optional(e["source"].isNotNull(), e["source"]))
            mine = clamp(e["weight"], 0, 1)
            bonus = F.when(F.size(sources) > 1, F.lit(P.CORROBORATION)).otherwise(F.lit(0.0))
            w = F.when(acc["weight"].isNull(), mine).otherwise(F.least(F.lit(1.0), F.greatest(acc["weight"], mine) + bonus))
            return F.when(e["id"] == id_, F.struct(
                id_.alias("id"), sources.alias("sources"), F.array_union(acc["details"], optional(e["detail"].isNotNull(), e["detail"])).alias("details"),
                w.alias("weight")).cast(kind)).otherwise(acc)

        return F.aggregate(items, start, step, lambda acc: F.struct(
            acc["id"].alias("id"), acc["sources"].alias("sources"), acc["details"].alias("details"), F.coalesce(acc["weight"], F.lit(0.0)).alias("weight")))

    ids = F.array_distinct(F.transform(items, lambda e: e["id"]))
    return F.transform(ids, fold).cast(FOLDED)


def dedupe_evidence(df: DataFrame) -> DataFrame:
    """`barriers_in`, `positives_in` (ordered evidence) to `barriers_folded`, `positives_folded`."""
    return df.withColumns({"barriers_folded": fold_evidence(F.col("barriers_in")),
                           "positives_folded": fold_evidence(F.col("positives_in"))})


def resolve_contradictions(df: DataFrame) -> DataFrame:
    """Add `resolved_conflicts`, `barriers_kept` and `positives_kept` to folded evidence.

    The pairs are applied in order, so an entry dropped by one pair no longer
    takes part in a later one; a barrier wins a tie.
    """
    def weights(c):
        return F.map_from_entries(F.transform(c, lambda e: F.struct(e["id"], e["weight"])))

    df = df.withColumns({"_b": weights("barriers_folded"), "_p": weights("positives_folded")})
    alive = {i: F.col("_b")[i] for i, _ in P.CONTRADICTIONS} | {i: F.col("_p")[i] for _, i in P.CONTRADICTIONS}
    conflicts = []
    for b, p in P.CONTRADICTIONS:
        bw, pw = alive[b], alive[p]
        barrier_wins = F.coalesce(bw >= pw, F.lit(False))
        positive_wins = F.coalesce(bw < pw, F.lit(False))
        conflicts.append(optional(barrier_wins | positive_wins, F.struct(
            F.when(barrier_wins, b).otherwise(p).alias("kept"), F.when(barrier_wins, p).otherwise(b).alias("dropped"))))
        alive[p] = F.when(~barrier_wins, pw)
        alive[b] = F.when(~positive_wins, bw)
    df = df.withColumn("resolved_conflicts", gather(conflicts, "array<struct<kept:string,dropped:string>>"))
    df = df.withColumn("_dropped", F.transform("resolved_conflicts", lambda c: c["dropped"]))
    return df.withColumns({
        "barriers_kept": F.filter("barriers_folded", lambda e: ~F.array_contains(F.col("_dropped"), e["id"])),
        "positives_kept": F.filter("positives_folded", lambda e: ~F.array_contains(F.col("_dropped"), e["id"])),
    }).drop("_b", "_p", "_dropped")


def score_segments(df: DataFrame) -> DataFrame:
    """Score with its itemised breakdown; needs `barriers_in` and `positives_in`."""
    out = resolve_contradictions(dedupe_evidence(df))

    def itemised(kept, table):
        priced = F.transform(kept, lambda e: F.struct(
            e["id"].alias("id"), half_up(lookup(e["id"], table) * e["weight"], 1).alias("points"),
            e["sources"].alias("sources"), e["details"].alias("details"), e["weight"].alias("weight")))
        return F.filter(priced, lambda e: e["points"] > 0)

    def total(items):
        # points are multiples of 0.1: added as whole tenths, so the order of addition cannot matter
        return F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, e: acc + F.floor(e["points"] * 10 + 0.5)) / F.lit(10.0)

    ceilings = F.array_min(F.filter(F.transform("barriers_kept", lambda e, i: F.struct(
        (F.lit(100.0) - (F.lit(100.0) - lookup(e["id"], P.CEILINGS)) * e["weight"]).alias("c"), i.alias("i"),
        e["id"].alias("id"))), lambda s: s["c"].isNotNull()))
    out = out.withColumns({
        "penalties": itemised("barriers_kept", P.PENALTIES),
        "bonuses": itemised("positives_kept", P.POSITIVES),
        "_ceiling": ceilings,
        "barriers": F.transform("barriers_kept", lambda e: e["id"]),
        "positives": F.transform("positives_kept", lambda e: e["id"]),
    })
    out = out.withColumns({"total_penalty": total("penalties"), "total_bonus": total("bonuses")})
    capped = F.least(F.col("total_bonus"), F.lit(float(P.MAX_BONUS)))
    raw = half_up_int(clamp(half_up(F.lit(float(P.SCORE_BASE)) - F.col("total_penalty") + capped), 0, 100))
    top = F.least(F.lit(100.0), F.coalesce(F.col("_ceiling")["c"], F.lit(100.0)))
    score = half_up_int(clamp(half_up(F.least(raw.cast("double"), top)), 0, 100))
    return out.withColumns({
        "capped_bonus": capped, "raw_score": raw, "score": score,
        "ceiling": F.when(top < 100, half_up_int(top)),
        "ceiling_barrier": F.when(score < raw, F.col("_ceiling")["id"]),
    }).drop("_ceiling")


def sorted_breakdown(df: DataFrame) -> DataFrame:
    """Sort `penalties` and `bonuses` by points, largest first, keeping evidence order among equals."""
    def by_points(c):
        keyed = F.transform(F.col(c), lambda e, i: F.struct((-e["points"]).alias("k"), i.alias("i"), e.alias("e")))
        return F.transform(F.array_sort(keyed), lambda r: r["e"])

    return df.withColumns({"penalties": by_points("penalties"), "bonuses": by_points("bonuses")})


def explain_score(df: DataFrame) -> DataFrame:
    """Add `explanation`: base, ceiling, signed items, whether the bonus was capped, total."""
    def items(c, prefix, sign):
        return F.transform(F.col(c), lambda e: F.struct(
            F.concat(F.lit(prefix), e["id"]).alias("key"), (e["points"] * sign).alias("points"),
            e["sources"].alias("sources"), e["details"].alias("details")))

    ceiling = F.when(F.col("ceiling_barrier").isNotNull(), F.struct(
        F.concat(F.lit("ceiling."), F.col("ceiling_barrier")).alias("key"), F.col("ceiling").alias("value"),
        F.col("raw_score").alias("from")))
    return df.withColumn("explanation", F.when(F.col("score").isNotNull(), F.struct(
        F.lit(P.SCORE_BASE).alias("base"), ceiling.alias("ceiling"),
        items("penalties", "barrier.", -1).alias("subtractions"),
        items("bonuses", "positive.", 1).alias("additions"),
        (F.col("total_bonus") > F.col("capped_bonus")).alias("bonus_capped"),
        F.col("score").alias("total"))))


def freshness_state(df: DataFrame, now: Column, params: P.Params = P.DEFAULT,
                    evidence_at: str = "last_evidence_at", verified_at: str = "last_verified_at") -> DataFrame:
    """Add `freshness_state`, `age_days`, `reference_at` and `freshness_verified`."""
    e, v = F.col(evidence_at), F.col(verified_at)
    ref = F.greatest(e, v)
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(ref)) / F.lit(86400000000.0))
    state = (F.when(ref.isNull(), "none").when(days <= params.recent_max_days, "recent")
             .when(days <= params.aging_max_days, "aging").otherwise("stale"))
    return df.withColumns({
        "freshness_state": state, "age_days": F.when(ref.isNotNull(), half_up_int(days)), "reference_at": ref,
        "freshness_verified": v.isNotNull() & (e.isNull() | (v >= e)),
    })


def is_stale(df: DataFrame) -> DataFrame:
    return df.withColumn("is_stale", F.col("freshness_state").isin("stale", "none"))


def evidence_confidence(df: DataFrame, params: P.Params = P.DEFAULT) -> DataFrame:
    """Add `evidence_confidence`, `confidence_parts` and `classifiable`."""
    tags = half_up(F.lit(float(P.TAG_POINTS)) * clamp(F.col("informativeness"), 0, 1), 1)
    qualities = F.col("informative_qualities" if params.informative_only else "image_qualities")
    per_image = [F.coalesce(lookup(F.get(qualities, F.lit(i)), P.IMAGE_POINTS, 0.0), F.lit(0.0))
                 for i in range(P.COUNTED_IMAGES)]
    images = half_up(sum(per_image[1:], per_image[0]), 1)
    several = F.col("informative_count") >= 2
    agree = F.when(several, half_up(F.lit(float(P.AGREEMENT_POINTS)) * clamp(F.col("agreement"), 0, 1), 1)).otherwise(F.lit(0.0))
    conflict = F.when(several, -half_up(F.lit(float(P.CONFLICT_POINTS)) * clamp(F.col("conflict"), 0, 1), 1)).otherwise(F.lit(0.0))
    reports = F.least(F.col("verified_report_count") * F.lit(float(P.REPORT_POINTS)), F.lit(float(P.MAX_REPORT_POINTS)))
    c = F.col
    df = df.withColumns({"_tags": tags, "_images": images, "_agree": agree, "_conflict": conflict, "_reports": reports,
                         "_factor": lookup(c("freshness_state"), P.AGE_FACTOR, 1.0)})
    sub = c("_tags") + c("_images") + c("_agree") + c("_conflict") + c("_reports")
    aged = sub * c("_factor")
    clamped = clamp(aged, 0, 100)
    floored = F.when(c("decisive"), F.greatest(clamped, F.lit(float(P.DECISIVE_FLOOR)))).otherwise(clamped)
    final = F.when(c("manually_verified"), F.greatest(floored, F.lit(float(P.MANUAL_FLOOR)))).otherwise(floored)

    def part(key, value, cond):
        return optional(cond, F.struct(F.lit(f"confidence.{key}").alias("key"), value.alias("points")))

    parts = gather([
        part("tag_metadata", c("_tags"), c("_tags") > 0),
        part("analysed_imagery", c("_images"), c("_images") > 0),
        part("agreement", c("_agree"), c("_agree") > 0),
        part("conflict", c("_conflict"), c("_conflict") < 0),
        part("verified_reports", c("_reports"), c("_reports") > 0),
        part("freshness_discount", half_up(aged - sub, 1), c("_factor") != 1),
        part("decisive_tags", half_up(floored - clamped, 1), floored > clamped),
        part("manual_verification", half_up(final - floored, 1), final > floored)],
        "array<struct<key:string,points:double>>")
    return df.withColumns({
        "evidence_confidence": half_up_int(final), "confidence_parts": parts,
        "classifiable": half_up_int(final) >= params.min_confidence,
    }).drop("_tags", "_images", "_agree", "_conflict", "_reports", "_factor")


def classify_status(df: DataFrame, params: P.Params = P.DEFAULT) -> DataFrame:
    """Add `status` and `reason`: override, then evidence, then the confidence gate, then the score band."""
    override = F.when(F.col("override_status").isin(P.STATUSES), F.col("override_status"))
    none = ~F.coalesce(F.col("has_evidence"), F.lit(True)) | F.col("score").isNull()
    low = F.coalesce(F.col("evidence_confidence"), F.lit(0)) < params.min_confidence
    band = (F.when(F.col("score") >= params.accessible_threshold, "accessible")
            .when(F.col("score") >= params.partial_threshold, "partial").otherwise("inaccessible"))
    return df.withColumns({
        "status": F.when(override.isNotNull(), override).when(none | low, "unverified").otherwise(band),
        "reason": F.when(override.isNotNull(), "manual_override").when(none, "no_evidence")
        .when(low, "insufficient_evidence").otherwise("score_band"),
    })
