"""Structured image observations: validation, normalisation, voting and visual evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footscape import params as P
from footscape.functions.arrays import gather, optional
from footscape.functions.text import short_text
from footscape.operators.tag_evidence import EVIDENCE
from footscape.schemas import OBSERVATION

# --- fixed values: observation vocabulary ----------------------------------
VISIBILITY = ["yes", "no", "not_visible", "unknown"]
ENUMS = {
    "image_quality": ["good", "medium", "poor"],
    "pedestrian_path.visible": VISIBILITY,
    "pedestrian_path.condition": ["clear", "restricted", "blocked", "unknown"],
    "curb_ramp.visible": VISIBILITY,
    "curb_ramp.condition": ["usable", "damaged", "unknown"],
    "stairs.visible": VISIBILITY,
    "surface.type": ["paved", "paving_stones", "gravel", "dirt", "other", "unknown"],
    "surface.condition": ["good", "uneven", "damaged", "unknown"],
    "obstacle.visible": VISIBILITY,
    "obstacle.severity": ["none", "minor", "moderate", "blocking", "unknown"],
    "crossing.visible": VISIBILITY,
    "clear_passage.classification": ["clear", "restricted", "blocked", "unknown"],
}
CROSSING_FEATURES = [
    "marked_crossing", "traffic_signals", "tactile_paving", "dropped_kerb", "refuge_island", "audible_signal"]
NON_INFORMATIVE = ["unknown", "not_visible"]
# Voted paths with their values, worst first; the order settles ties.
WORST_FIRST = {
    "pedestrian_path.visible": ["no", "yes"],
    "pedestrian_path.condition": ["blocked", "restricted", "clear"],
    "curb_ramp.visible": ["no", "yes"],
    "stairs.visible": ["yes", "no"],
    "surface.type": ["dirt", "gravel", "other", "paving_stones", "paved"],
    "surface.condition": ["damaged", "uneven", "good"],
    "obstacle.severity": ["blocking", "moderate", "minor", "none"],
    "clear_passage.classification": ["blocked", "restricted", "clear"],
    "curb_ramp.condition": ["damaged", "usable"],
}
AGREEMENT_PATHS = [p for p in WORST_FIRST if p != "curb_ramp.condition"]

# landed JSON name of every checked path
RAW_NAMES = {
    "image_quality": "imageQuality", "pedestrian_path.visible": "pedestrianPath.visible",
    "pedestrian_path.condition": "pedestrianPath.condition", "curb_ramp.visible": "curbRamp.visible",
    "curb_ramp.condition": "curbRamp.condition", "stairs.visible": "stairs.visible",
    "surface.type": "surface.type", "surface.condition": "surface.condition",
    "obstacle.visible": "obstacle.visible", "obstacle.severity": "obstacle.severity",
    "crossing.visible": "crossing.visible", "clear_passage.classification": "clearPassage.classification",
}


def _is_array(text: Column) -> Column:
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v[0]").isNotNull()
                      | F.regexp_replace(text, r"\s", "").eqNullSafe("[]"), F.lit(False)) \
        & text.startswith("[")


def validate_observations(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `errors` (array of strings) and `ok` for a landed observation struct.

    A missing sub-object gives one error; otherwise every enum path is checked.
    """
    o = F.col(raw)
    checks = []
    for path, allowed in ENUMS.items():
        name = RAW_NAMES[path]
        head = name.split(".")[0]
        value = o[head] if "." not in name else o[head][name.split(".")[1]]
        bad = ~F.coalesce(value.isin(allowed), F.lit(False))
        if "." in name:
            first = path == next(p for p in ENUMS if RAW_NAMES[p].split(".")[0] == head)
            if first:
                checks.append(F.when(o[head].isNull(), F.lit(f"{head}: missing")))
            bad = bad & o[head].isNotNull()
        checks.append(F.when(bad, F.concat(F.lit(f"{name}: unexpected "), F.coalesce(value, F.lit("null")))))
        if path == "crossing.visible":
            feats = o["crossing"]["accessibleFeatures"]
            checks.append(F.when(feats.isNotNull() & ~_is_array(feats), F.lit("crossing.accessibleFeatures: expected array")))
    found = o["uncertainFindings"]
    checks.append(F.when(found.isNotNull() & ~_is_array(found), F.lit("uncertainFindings: expected array")))
    errors = F.when(o.isNull(), F.array(F.lit("observation must be an object"))).otherwise(F.array_compact(F.array(*checks)))
    return df.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0)


def normalise_observations(df: DataFrame, raw: str = "raw", out: str = "observation") -> DataFrame:
    """Clamp a landed observation struct to the vocabulary; unknown values become `unknown`."""
    o = F.col(raw)

    def pick(path: str, fallback: str = "unknown") -> Column:
        name = RAW_NAMES[path].split(".")
        value = o[name[0]] if len(name) == 1 else o[name[0]][name[1]]
        return F.when(value.isin(ENUMS[path]), value).otherwise(F.lit(fallback))

    def strings(text: Column) -> Column:
        return F.coalesce(F.when(_is_array(text), F.from_json(text, "array<string>")), F.array().cast("array<string>"))

    feats = F.array_distinct(F.filter(strings(o["crossing"]["accessibleFeatures"]), lambda f: f.isin(CROSSING_FEATURES)))
    uncertain = F.slice(F.filter(F.transform(strings(o["uncertainFindings"]), lambda f: short_text(f, 120)),
                                 lambda f: f != ""), 1, 6)
    value = F.struct(
        pick("image_quality", "poor").alias("image_quality"),
        F.struct(pick("pedestrian_path.visible").alias("visible"), pick("pedestrian_path.condition").alias("condition"))
        .alias("pedestrian_path"),
        F.struct(pick("curb_ramp.visible").alias("visible"), pick("curb_ramp.condition").alias("condition")).alias("curb_ramp"),
        F.struct(pick("stairs.visible").alias("visible")).alias("stairs"),
        F.struct(pick("surface.type").alias("type"), pick("surface.condition").alias("condition")).alias("surface"),
        F.struct(pick("obstacle.visible").alias("visible"), pick("obstacle.severity").alias("severity"),
                 short_text(o["obstacle"]["description"], 140).alias("description")).alias("obstacle"),
        F.struct(pick("crossing.visible").alias("visible"), feats.alias("accessible_features")).alias("crossing"),
        F.struct(pick("clear_passage.classification").alias("classification")).alias("clear_passage"),
        uncertain.alias("uncertain_findings"),
        short_text(o["notes"], 240).alias("notes"),
    )
    return df.withColumn(out, value.cast(OBSERVATION))


def says_something(value: Column) -> Column:
    return value.isNotNull() & ~value.isin(NON_INFORMATIVE)


def is_empty(o: Column) -> Column:
    """True when nothing informative was reported (ramp condition does not count)."""
    paths = [p for p in ENUMS if p not in ("image_quality", "curb_ramp.condition")]
    told = F.lit(False)
    for p in paths:
        told = told | says_something(_read(o, p))
    feats = o["crossing"]["accessible_features"]
    return F.coalesce(~(told | F.coalesce(F.size(feats) > 0, F.lit(False))), F.lit(True))


def empty_observation(df: DataFrame) -> DataFrame:
    return df.withColumn("is_empty", is_empty(F.col("observation")))


def reading_sufficient(df: DataFrame) -> DataFrame:
    """Add `sufficient`: not poor, path looked at, at most two uncertain findings."""
    o = F.col("observation")
    return df.withColumn("sufficient", o.isNotNull() & F.coalesce(
        (o["image_quality"] != "poor") & ~o["pedestrian_path"]["visible"].eqNullSafe("not_visible")
        & (F.coalesce(F.array_size(o["uncertain_findings"]), F.lit(0)) <= 2), F.lit(False)))


def filter_active(obs: DataFrame) -> DataFrame:
    return obs.filter(F.col("status") == "active")


def _read(o: Column, path: str) -> Column:
    for part in path.split("."):
        o = o[part]
    return o


def newest_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows per key in the given order, numbered from 1.

    `row_number() <= n` lets Spark cut every map-side group to n rows before the
    shuffle, so a hot key never arrives whole at one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("captured_at"), F.asc("observation_id")]


def observations_by_segment(obs: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per (segment, observation); with a `limit`, so many per segment, newest capture first, numbered in `rn`."""
    long = obs.withColumn("segment_id", F.explode(F.array_distinct("segment_ids"))).drop("segment_ids")
    return long if limit is None else newest_n(long, ["segment_id"], newest_first(), limit)


def _newest_notes(linked: DataFrame) -> DataFrame:
    """Per segment, the lists that depend on order: qualities of the newest images (all, and those that tell something),
    the newest obstacle text and the first eight findings. Each is cut to its length before rows gather by segment."""
    o = F.col("observation")
    base = linked.select("segment_id", "captured_at", "observation_id", o["image_quality"].alias("q"), (~is_empty(o)).alias("told"),
                         F.trim(o["obstacle"]["description"]).alias("d"), o["uncertain_findings"].alias("u"))
    newest = F.struct(F.col("captured_at").isNull().alias("undated"), (-F.unix_micros("captured_at")).alias("age"), "observation_id")
    images = newest_n(base, ["segment_id", "told"], newest_first(), P.COUNTED_IMAGES).groupBy("segment_id").agg(
        F.sort_array(F.collect_list(F.struct(newest.alias("at"), "q", "told"))).alias("images"))
    texts = newest_n(base.filter(F.col("d") != ""), ["segment_id"], newest_first(), 1).select("segment_id", F.col("d").alias("obstacle_text"))
    said = base.select("segment_id", newest.alias("at"), F.posexplode("u").alias("pos", "finding")).groupBy("segment_id", "finding").agg(
        F.min(F.struct("at", "pos")).alias("first"))
    findings = newest_n(said, ["segment_id"], [F.asc("first")], 8).groupBy("segment_id").agg(
        F.sort_array(F.collect_list(F.struct("first", "finding"))).alias("said"))
    return (images.join(texts, "segment_id", "left").join(findings, "segment_id", "left").select(
        "segment_id", F.slice(F.transform("images", lambda r: r["q"]), 1, P.COUNTED_IMAGES).alias("image_qualities"),
        F.transform(F.filter("images", lambda r: r["told"]), lambda r: r["q"]).alias("informative_qualities"), "obstacle_text",
        F.coalesce(F.transform("said", lambda r: r["finding"]), F.array().cast("array<string>")).alias("uncertain_findings")))


def first_observation_segment(obs: DataFrame) -> DataFrame:
    """Add `segment_id`: the first linked segment."""
    return obs.withColumn("segment_id", F.get("segment_ids", F.lit(0)))


def column_of(path: str) -> str:
    return path.replace(".", "_")


def vote_features(linked: DataFrame) -> DataFrame:
    """One row per segment with a vote struct per path, plus the observation summary.

    Input: `observations_by_segment`.  Every (path, value) pair is a conditional
    count, so the whole vote is one hash aggregation with map-side combine, by segment and
    source type, whose few rows per segment are added up; the least source type comes from these, since a
    minimum of texts beside the counts would have every observation sorted.  The
    winner is then the largest (count, -worst-first rank).
    """
    o = F.col("observation")
    counts = {f"n__{column_of(path)}__{v}": F.count_if(_read(o, path) == v) for path, values in WORST_FIRST.items() for v in values}
    counts |= {f"f__{f}": F.count_if(F.array_contains(o["crossing"]["accessible_features"], f)) for f in CROSSING_FEATURES}
    per_source = linked.groupBy("segment_id", "source_type").agg(
        *[c.alias(n) for n, c in counts.items()],
        F.count(F.lit(1)).alias("observation_count"),
        F.count_if(~is_empty(o)).alias("informative_count"),
        F.max(F.coalesce("captured_at", "analysed_at")).alias("last_observed_at"))
    of_type = lambda t: F.sum(F.when(F.col("source_type") == t, F.col("observation_count")).otherwise(0))
    counted = per_source.groupBy("segment_id").agg(
        *[F.sum(n).alias(n) for n in counts],
        F.sum("observation_count").alias("observation_count"),
        F.sum("informative_count").alias("informative_count"),
        of_type("mapillary").alias("n_mapillary"),
        of_type("citizen").alias("n_citizen"),
        F.count("source_type").alias("n_source_types"),
        F.min("source_type").alias("any_source_type"),
        F.max("last_observed_at").alias("last_observed_at"),
    )
    votes = {}
    for path, values in WORST_FIRST.items():
        name = column_of(path)
        ns = [F.col(f"n__{name}__{v}") for v in values]
        informative = sum(ns[1:], ns[0])
        top = F.greatest(*ns)
        winner = None
        for v, n in zip(values, ns):
            hit = (n == top)
            winner = F.when(hit, F.lit(v)) if winner is None else winner.when(hit, F.lit(v))
        tied = sum([F.when(n == top, 1).otherwise(0) for n in ns[1:]], F.when(ns[0] == top, 1).otherwise(0)) > 1
        votes[f"v_{name}"] = F.struct(
            F.when(informative > 0, winner).alias("value"),
            F.when(informative > 0, top).otherwise(F.lit(0)).alias("support"),
            informative.alias("informative"),
            F.when(informative > 0, top / informative).otherwise(F.lit(0.0)).alias("agreement"),
            ((informative > 0) & tied).alias("tie"),
        )
    keep = [c for c in counted.columns if not c.startswith("n__")]
    return counted.select(*keep, *[c.alias(n) for n, c in votes.items()]).join(_newest_notes(linked), "segment_id", "left")


def votes_long(votes: DataFrame) -> DataFrame:
    """One row per (segment, path)."""
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"v_{column_of(p)}").alias("v")) for p in WORST_FIRST])
    return votes.select("segment_id", F.explode(rows).alias("r")).select("segment_id", "r.path", "r.v.*")


def rank_votes(linked: DataFrame) -> DataFrame:
    """Every (segment, path, value) count with its rank: most votes first, then worst first."""
    o = F.col("observation")
    cells = F.array(*[F.struct(
        F.lit(p).alias("path"), _read(o, p).alias("value"),
        F.coalesce(F.array_position(F.array(*[F.lit(v) for v in vs]), _read(o, p)), F.lit(0)).alias("worst"))
        for p, vs in WORST_FIRST.items()])
    counts = (linked.select("segment_id", F.explode(cells).alias("c")).select("segment_id", "c.*")
              .filter(says_something(F.col("value"))).groupBy("segment_id", "path", "value", "worst")
              .agg(F.count(F.lit(1)).alias("support")))
    w = Window.partitionBy("segment_id", "path").orderBy(F.desc("support"), F.asc("worst"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).drop("worst")


def observation_agreement(votes: DataFrame) -> DataFrame:
    """Add `agreement`, `conflict` and `contested`: mean over the paths with two or more informative votes."""
    total, n = F.lit(0.0), F.lit(0)
    contested = []
    for p in AGREEMENT_PATHS:
        v = F.col(f"v_{column_of(p)}")
        counted = v["informative"] >= 2
        total = total + F.when(counted, v["agreement"]).otherwise(F.lit(0.0))
        n = n + F.when(counted, 1).otherwise(0)
        contested.append(optional(counted & (v["agreement"] < 1), F.lit(p)))
    agreement = F.when(n > 0, total / n).otherwise(F.lit(1.0))
    return votes.withColumns({
        "agreement": agreement,
        "conflict": F.when(n > 0, F.lit(1.0) - agreement).otherwise(F.lit(0.0)),
        "contested": gather(contested, "array<string>"),
    })


def observation_summary(votes: DataFrame) -> DataFrame:
    """Add `source_label`: the single source type, or `visual` when there are several."""
    return votes.withColumn("source_label", F.when(F.col("n_source_types") == 1, F.col("any_source_type")).otherwise("visual"))


def crossing_features(linked: DataFrame) -> DataFrame:
    """Support count per (segment, crossing feature)."""
    feats = F.explode(F.col("observation")["crossing"]["accessible_features"])
    return linked.select("segment_id", feats.alias("feature")).groupBy("segment_id", "feature").agg(
        F.count(F.lit(1)).alias("support"))


def derive_visual_evidence(votes: DataFrame) -> DataFrame:
    """Add `visual_barriers` and `visual_positives` from the votes; needs `source_label`."""
    def vote(path):
        return F.col(f"v_{column_of(path)}")

    def scale(v):
        return (F.when(v["informative"] == 0, F.lit(0.0))
                .when(v["informative"] == 1, F.lit(P.SINGLE_OBSERVATION_WEIGHT)).otherwise(v["agreement"]))

    def item(cond, id_, weight, detail):
        d = detail if isinstance(detail, Column) else F.lit(detail)
        return optional(cond, F.struct(F.lit(id_).alias("id"), F.col("source_label").alias("source"),
                                       d.alias("detail"), weight.alias("weight")))

    seen, cond = vote("pedestrian_path.visible"), vote("pedestrian_path.condition")
    ramp, ramp_cond, stairs = vote("curb_ramp.visible"), vote("curb_ramp.condition"), vote("stairs.visible")
    stype, scond = vote("surface.type"), vote("surface.condition")
    sev, passage = vote("obstacle.severity"), vote("clear_passage.classification")

    def eq(v, value):
        return v["value"].eqNullSafe(value)

    damaged = eq(ramp, "yes") & eq(ramp_cond, "damaged")
    barriers = [
        item(eq(seen, "no"), "no_pedestrian_path", scale(seen), "path:none"),
        item(eq(cond, "blocked"), "blocking_obstacle", scale(cond), "path:blocked"),
        item(eq(cond, "restricted"), "restricted_passage", scale(cond), "path:restricted"),
        item(eq(ramp, "no"), "missing_curb_ramp", scale(ramp), "ramp:none"),
        item(damaged, "missing_curb_ramp", scale(ramp_cond) * F.lit(0.6), "ramp:damaged"),
        item(eq(stairs, "yes"), "steps", scale(stairs), "steps:present"),
        item(eq(scond, "damaged"), "damaged_surface", scale(scond), "surface:damaged"),
        item(eq(scond, "uneven"), "uneven_surface", scale(scond), "surface:uneven"),
        item(eq(stype, "gravel") | eq(stype, "dirt"), "unsuitable_surface", scale(stype),
             F.concat(F.lit("surface:"), stype["value"])),
        item(eq(sev, "blocking"), "blocking_obstacle", scale(sev),
             F.coalesce("obstacle_text", F.lit("obstacle:blocking"))),
        item(eq(sev, "moderate"), "restricted_passage", scale(sev),
             F.coalesce("obstacle_text", F.lit("obstacle:moderate"))),
        item(eq(passage, "blocked") & ~eq(sev, "blocking"), "blocking_obstacle", scale(passage), "passage:blocked"),
        item(eq(passage, "restricted") & ~eq(sev, "moderate") & ~eq(sev, "blocking"), "restricted_passage",
             scale(passage), "passage:restricted"),
    ]
    feature_weight = (F.when(F.col("informative_count") == 0, F.lit(0.0))
                      .when(F.col("informative_count") == 1, F.lit(P.SINGLE_OBSERVATION_WEIGHT)).otherwise(F.lit(1.0)))
    infrastructure = (F.col("f__traffic_signals") + F.col("f__marked_crossing")
                      + F.col("f__audible_signal") + F.col("f__refuge_island")) > 0
    # The combined crossing item looks at the marked-crossing support only for its
    # label; its weight is the same as for the other features.
    positives = [
        item(eq(cond, "clear") & eq(seen, "yes"), "clear_path", scale(cond), "path:clear"),
        item(eq(ramp, "yes") & ~damaged, "curb_ramp", scale(ramp), "ramp:present"),
        item(eq(scond, "good") & (eq(stype, "paved") | eq(stype, "paving_stones")), "good_paved_surface",
             scale(scond), "surface:good_paved"),
        item(F.col("f__tactile_paving") > 0, "tactile_paving", feature_weight, "crossing:tactile_paving"),
        item(F.col("f__dropped_kerb") > 0, "curb_ramp", feature_weight, "crossing:dropped_kerb"),
        item(infrastructure, "accessible_crossing", feature_weight, "crossing:infrastructure"),
    ]
    return votes.withColumns({
        "visual_barriers": gather(barriers, EVIDENCE),
        "visual_positives": gather(positives, EVIDENCE),
    })


def visual_evidence(obs: DataFrame, limit: int | None = None) -> DataFrame:
    """Active observations to one evidence row per segment."""
    votes = vote_features(observations_by_segment(filter_active(obs), limit))
    return derive_visual_evidence(observation_summary(observation_agreement(votes)))
