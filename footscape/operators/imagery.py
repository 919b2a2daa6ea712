"""Street-level frames: filtering, scoring, selection, analysis tasks and budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footscape import params as P
from footscape.functions import geo as G
from footscape.functions.numbers import clamp, half_up
from footscape.operators.spatial import images_near_segments
from footscape.session import cut, stored

YEAR_DAYS = 365.25


def filter_images(images: DataFrame, now: Column) -> DataFrame:
    """Drop panoramas and frames over eight years old (undated stay); one row per id."""
    oldest = now - F.make_dt_interval(hours=F.lit(int(P.IMAGE_MAX_AGE_YEARS * YEAR_DAYS * 24)))
    keep = ~F.coalesce("is_pano", F.lit(False)) & (F.col("captured_at").isNull() | (F.col("captured_at") >= oldest))
    return images.filter(keep).dropDuplicates(["image_id"])


def image_score(pairs: DataFrame, now: Column) -> DataFrame:
    """Add `score`, its four parts and `distance_m` to frame and segment pairs."""
    near = F.col("near")
    delta = G.bearing_delta(F.col("compass_angle"), near["bearing"])
    direction = F.when(F.col("compass_angle").isNull() | (near["a"] == near["b"]), F.lit(0.5)).otherwise(
        F.lit(1.0) - F.lit(0.35) * (F.least(delta, F.lit(180.0) - delta) / 90.0))
    years = (F.unix_micros(now) - F.unix_micros("captured_at")) / F.lit(YEAR_DAYS * 86400e6)
    recency = (F.when(F.col("captured_at").isNull(), F.lit(0.3)).when(years <= 1, F.lit(1.0))
               .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - (years - 1) / 7)))
    quality = F.when(F.col("quality_score").isNull(), F.lit(0.6)).otherwise(clamp(F.col("quality_score"), 0, 1))
    out = pairs.withColumns({"proximity": F.lit(1.0) - near["dist"] / P.IMAGE_RADIUS_M, "recency": recency,
                             "direction": direction, "quality": quality})
    total = 0.35 * F.col("proximity") + 0.30 * F.col("recency") + 0.20 * F.col("direction") + 0.15 * F.col("quality")
    return out.withColumns({"score": half_up(total, 4), "distance_m": half_up(near["dist"], 1)})


def scored_frames(images: DataFrame, segments: DataFrame, now: Column) -> DataFrame:
    """Usable frames near each segment, scored."""
    return image_score(images_near_segments(filter_images(images, now), segments), now).select(
        "segment_id", "image_id", "lng", "lat", "captured_at", "compass_angle", "sequence_id", "score", "distance_m",
        "proximity", "recency", "direction", "quality")


def select_frames(scored: DataFrame, max_frames: int = 3, spacing_m: float = P.IMAGE_SPACING_M) -> DataFrame:
    """Greedy choice per segment: best frame first, all at least `spacing_m` apart, new sequences preferred.

    One round picks one frame for every segment with two maxima, so a segment
    with very many frames is reduced before the shuffle and never collected.
    The result has `choice` from 1.
    """
    frame = F.struct("score", F.col("image_id"), "lng", "lat", "sequence_id", "distance_m", "captured_at", "compass_angle")
    # the largest table of all: as parquet, compressed by column; a checkpoint holds plain rows
    pool = stored(scored.select("segment_id", frame.alias("f")))
    chosen = None
    for n in range(1, max_frames + 1):
        if chosen is None:
            open_ = pool.withColumn("fresh", F.lit(True))
        else:
            so_far = chosen.groupBy("segment_id").agg(F.collect_list("f").alias("taken"))  # at most max_frames
            j = pool.join(so_far, "segment_id")
            # the few taken ones one by one, which stays inside code generation
            far, used, f = F.lit(True), F.lit(False), F.col("f")
            for i in range(n - 1):
                c = F.get("taken", F.lit(i))
                apart = (c["image_id"] != f["image_id"]) & (G.haversine(c["lng"], c["lat"], f["lng"], f["lat"]) >= spacing_m)
                far = far & (c.isNull() | apart)
                used = used | F.coalesce(c["sequence_id"] == f["sequence_id"], F.lit(False))
            open_ = j.filter(far).withColumn("fresh", ~used).drop("taken")
        # fresh sequences first, then the best score, then the lowest id
        rank = F.struct((~F.col("fresh")).alias("late"), (-F.col("f")["score"]).alias("s"), F.col("f")["image_id"].alias("i"))
        picked = open_.groupBy("segment_id").agg(F.min_by("f", rank).alias("f")).withColumn("choice", F.lit(n))
        chosen = stored(picked if chosen is None else chosen.unionByName(picked))
    return chosen.select("segment_id", "choice", "f.*")


def selected_array(selection: DataFrame) -> DataFrame:
    """One row per segment with the chosen frames as an array (at most a few)."""
    item = F.struct("choice", "image_id", "captured_at", "distance_m", "compass_angle", "sequence_id",
                    F.col("score").alias("selection_score"), F.lit(False).alias("analysed"), F.lit(None).cast("string").alias("skipped"))
    return selection.groupBy("segment_id").agg(F.sort_array(F.collect_list(item)).alias("selected"))


def best_pending_frame(segments: DataFrame) -> DataFrame:
    """One analysis task per segment: its closest frame not analysed yet; needs `imagery`."""
    pending = F.filter(F.col("imagery")["selected"], lambda f: ~f["analysed"])
    key = F.transform(pending, lambda f, i: F.struct(F.coalesce(f["distance_m"], F.lit(999.0)).alias("d"), i.alias("i"),
                                                     f["image_id"].alias("image_id"), f["distance_m"].alias("distance_m")))
    return (segments.filter(F.col("imagery")["status"].isin("selected", "analysed")).withColumn("best", F.array_min(key))
            .filter(F.col("best").isNotNull())
            .select("segment_id", "region_id", F.col("best")["image_id"].alias("image_id"), F.col("best")["distance_m"].alias("distance_m")))


def retire_frames(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Mark analysed frames; a sufficient reading retires the segment's other frames with a reason."""
    per_segment = results.groupBy("segment_id").agg(
        F.collect_set("image_id").alias("_done"), F.bool_or("sufficient").alias("_enough"))  # at most the frames of a segment
    j = segments.join(per_segment, "segment_id", "left")

    def mark(f):
        done = F.coalesce(F.array_contains("_done", f["image_id"]), F.lit(False))
        retired = F.coalesce(F.col("_enough"), F.lit(False)) & ~done & ~f["analysed"]
        return f.withField("analysed", f["analysed"] | done | retired).withField(
            "skipped", F.when(retired, F.lit("first reading was sufficient")).otherwise(f["skipped"]))

    return j.withColumn("imagery", F.col("imagery").withField("selected", F.transform(F.col("imagery")["selected"], mark))).drop("_done", "_enough")


def running_rank(df: DataFrame, order: list[str], partitions: int = 64) -> DataFrame:
    """Add `position`, the global 1-based rank in the given order, without a single-task window.

    Rows are range-partitioned; each range numbers its own rows and adds the sizes
    of the ranges before it.
    """
    ranged = cut(df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(before), "_p").withColumn("position", local + F.col("_before")).drop("_p", "_before")


def budget_admission(tasks: DataFrame, remaining_today: int, params: P.Params = P.DEFAULT) -> DataFrame:
    """Add `position` and `admitted`: nearest first until the job or day limit is spent."""
    limit = max(0, min(params.max_analyses_per_job, remaining_today))
    ranked = running_rank(tasks.withColumn("_d", F.coalesce("distance_m", F.lit(999.0))), ["_d", "segment_id"])
    return ranked.drop("_d").withColumn("admitted", F.col("position") <= limit)


def consecutive_failures(calls: DataFrame, key: str = "job_id", limit: int = P.FAILURE_LIMIT) -> DataFrame:
    """Per job: longest run of failures, and whether the breaker trips: on so many failures before anything has succeeded.

    A cached answer neither counts nor ends a run.
    """
    live = calls.filter(F.col("outcome") != "cached")
    w = Window.partitionBy(key).orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    runs = live.withColumn("island", F.sum(F.when(F.col("outcome") != "failed", 1).otherwise(0)).over(w))
    lengths = runs.groupBy(key, "island").agg(F.count_if(F.col("outcome") == "failed").alias("failures"))
    return lengths.groupBy(key).agg(
        F.max("failures").alias("longest_run"), (F.coalesce(F.max(F.when(F.col("island") == 0, F.col("failures"))), F.lit(0)) >= limit).alias("tripped"))


def daily_usage(calls: DataFrame, daily_limit: int = P.DEFAULT.max_analyses_per_day, reservations: DataFrame | None = None) -> DataFrame:
    """Per UTC day: calls, cached, failed, what is left of the limit. With `reservations` (day, reserved) what is reserved
    counts, whether or not it has been called."""
    if reservations is not None:
        days = daily_usage(calls, daily_limit).join(reservations.groupBy("day").agg(F.sum("reserved").alias("reserved")), "day", "full")
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("calls", "cached", "failed", "reserved")}
        return days.withColumns(zero).withColumn("remaining", F.greatest(F.lit(0), F.lit(daily_limit) - F.col("reserved")))
    return calls.groupBy(F.window("ts", "1 day")["start"].alias("day_start")).agg(
        F.count_if(F.col("outcome") != "cached").alias("calls"),
        F.count_if(F.col("outcome") == "cached").alias("cached"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    ).select(F.date_format("day_start", "yyyy-MM-dd").alias("day"), "calls", "cached", "failed",
             F.greatest(F.lit(0), F.lit(daily_limit) - F.col("calls")).alias("remaining"))


def leaked_reservations(usage: DataFrame) -> DataFrame:
    """Add `leaked`: reserved calls that were never made; needs `reserved`."""
    return usage.withColumn("leaked", F.greatest(F.lit(0), F.col("reserved") - F.col("calls")))


def usage_history(usage: DataFrame, n: int = 7) -> DataFrame:
    return usage.orderBy(F.desc("day")).limit(min(n, 60))


def analysis_estimate(segments: DataFrame, remaining_today: int | Column, params: P.Params = P.DEFAULT) -> DataFrame:
    """Per region: segments and frames still pending, expected and largest number of calls."""
    pending = F.size(F.filter(F.col("imagery")["selected"], lambda f: ~f["analysed"]))
    open_ = segments.filter(F.col("imagery")["status"].isin("selected", "analysed")).withColumn("_n", pending).filter(F.col("_n") > 0)
    cap = F.least(F.lit(params.max_analyses_per_job), remaining_today if isinstance(remaining_today, Column) else F.lit(remaining_today)).cast("bigint")
    return open_.groupBy("region_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("_n").alias("frames")).withColumns({
        "expected_calls": F.least(F.col("segments"), cap), "max_calls": F.least(F.col("frames"), cap)})


def discovery_summary(segments: DataFrame) -> DataFrame:
    """Per region: searched, with imagery, settled by tags, outside, and the share with imagery."""
    c = F.col("imagery")["status"]
    return segments.groupBy("region_id").agg(
        F.count_if("in_search_area").alias("searched"), F.count_if(F.col("in_search_area") & (c == "selected")).alias("with_imagery"),
        F.count_if(F.col("in_search_area") & (c == "not_needed")).alias("settled"),
        F.count_if(~F.col("in_search_area")).alias("outside"),
        F.sum(F.col("imagery")["image_count"]).alias("frames_selected"),
    ).withColumn("coverage_ratio", F.when(F.col("searched") > 0, half_up(F.col("with_imagery") / F.col("searched"), 3)).otherwise(F.lit(0.0)))


def frames_without_observation(tasks: DataFrame, obs: DataFrame, key: str = "source_id") -> DataFrame:
    """Tasks whose frame has no usable observation yet."""
    return tasks.join(obs.filter(F.col("status") != "failed").select(key), key, "left_anti")


def link_cached(obs: DataFrame, tasks: DataFrame, key: str = "source_id") -> DataFrame:
    """Add the segments of tasks that hit a stored observation to its `segment_ids`."""
    wanted = tasks.groupBy(key).agg(F.collect_set("segment_id").alias("_more"))  # segments around one frame
    j = obs.join(wanted, key, "left")
    more = F.when(F.col("status") != "failed", F.col("_more"))
    return j.withColumn("segment_ids", F.array_union("segment_ids", F.coalesce(more, F.array().cast("array<string>")))).drop("_more")


def relink_audit(selected: DataFrame, obs: DataFrame) -> DataFrame:
    """Analysed frames whose observation does not list the segment.

    `selected`: (segment_id, image_id, analysed); `obs`: (source_id, segment_ids).
    """
    done = selected.filter("analysed").select("segment_id", F.col("image_id").alias("source_id"))
    links = obs.select("source_id", F.explode("segment_ids").alias("segment_id"), F.lit(True).alias("linked"))
    known = obs.select("source_id").distinct().withColumn("known", F.lit(True))
    j = done.join(links, ["source_id", "segment_id"], "left").join(known, "source_id", "left")
    return j.select("segment_id", "source_id", F.when(F.col("linked"), "linked").when(F.col("known"), "unlinked").otherwise("no_observation").alias("state"))
