"""Domain tables derived from the generic star-schema tables.

A synthetic street grid is laid over the part keys: part k stands at column
k % 40 and row k div 40, and owns one segment to the east and one to the north.
Line items become observations and street-level images, events become resident
reports and analysis calls, suppliers become public services, and customers
become route requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footscape.functions.geo import point
from footscape.operators.ways import classify_ways

COLUMNS = 40
STEP = 0.0004
LNG0, LAT0 = 32.40, 34.75
SPREAD = {"part", "lineitem", "events", "customer"}
#: A file of more bytes has several row groups.
SPREAD_BYTES = 128 << 20
NOW_OBSERVATIONS = "2001-12-01 00:00:00"
NOW_REPORTS = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a table; a small file is spread over the cores.

    The test files hold one row group each, so a scan would be one task.  A larger file
    or a table of many files has several splits and is left as it is, not shuffled whole.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    wide = name in SPREAD and is_small(df)
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
    return df.repartition(spark.sparkContext.defaultParallelism) if wide else df


def is_small(df: DataFrame) -> bool:
    """Whether a table is a single file of no more than SPREAD_BYTES."""
    size = df.select("_metadata.file_size").first() if len(df.inputFiles()) == 1 else None
    return size is not None and size[0] <= SPREAD_BYTES


def now_observations() -> Column:
    return F.to_timestamp(F.lit(NOW_OBSERVATIONS))


def now_reports() -> Column:
    return F.to_timestamp(F.lit(NOW_REPORTS))


def grid_x(k: Column) -> Column:
    return k % COLUMNS


def grid_y(k: Column) -> Column:
    return F.floor(k / F.lit(float(COLUMNS)))


def grid_region(k: Column) -> Column:
    return F.concat(F.lit("r"), F.floor(k / F.lit(400.0)) % 5)


def grid_lng(x: Column) -> Column:
    return F.lit(LNG0) + x * F.lit(STEP)


def grid_lat(y: Column) -> Column:
    return F.lit(LAT0) + y * F.lit(STEP)


def pick(n: Column, values: list[str | None]) -> Column:
    """values[n] as a CASE; out of range is null."""
    out = None
    for i, v in enumerate(values):
        if v is None:
            continue
        out = F.when(n == i, F.lit(v)) if out is None else out.when(n == i, F.lit(v))
    return out


def _tags(b: Column, size: Column, ptype: Column, d: Column) -> dict[str, Column]:
    """The tag set of a grid segment, from brand number, size, type and direction."""
    highway = (
        F.when(size % 17 == 0, "steps").when(b == 25, "trunk")
        .otherwise(F.when(ptype == "STANDARD", "footway").when(ptype == "MEDIUM", "footway")
                   .when(ptype == "PROMO", "residential").when(ptype == "SMALL", "path")
                   .when(ptype == "LARGE", "pedestrian").otherwise("service")))
    is_road = F.lower(ptype)
    foot = (ptype.isin("STANDARD", "MEDIUM")) & (size % 17 != 0) & (b != 25)
    footway = F.when(foot, pick(size % 4, ["sidewalk", "crossing"]))
    return {
        "highway": highway,
        "footway": footway,
        "surface": F.when(b <= 5, "asphalt").when(b <= 8, "paving_stones").when(b <= 11, "gravel")
                    .when(b <= 13, "cobblestone").when(b == 14, "Concrete"),
        "smoothness": pick(size % 10, [None, "bad", "good", "intermediate", "very_bad"]),
        "width": pick(b % 6, ["0.8", "1.1 m", "150 cm", "5 ft", "wide"]),
        "est_width": F.when(size % 8 == 0, "1.0"),
        "kerb": pick((b + size) % 7, ["lowered", "raised", "flush", "no"]),
        "kerb:height": pick((b + size) % 9, ["3 cm", "0.12"]),
        "incline": pick(size % 12, ["10%", "-6%", "3°", "up", "7"]),
        "tactile_paving": pick(b % 8, ["yes", "no"]),
        "wheelchair": pick((size + b + d) % 13, ["no", "yes", "limited"]),
        "crossing": F.when(foot & (size % 4 == 1), pick(b % 3, ["zebra", "traffic_signals", "unmarked"])),
        "ramp": F.when(size % 19 == 0, "yes"),
        "ramp:wheelchair": F.when(size == 34, "yes"),
        "barrier": F.when(b == 7, "bollard").when((b == 17) & (d == 1), "gate").when((b == 19) & (size > 40), "fence"),
        "sidewalk": F.when(is_road == "promo", pick(b % 4, ["no", "both", "left"])),
        "sidewalk:left": F.when(is_road == "economy", pick(b % 5, ["no", "yes", "separate"])),
        "sidewalk:right": F.when(is_road == "economy", pick(b % 5, ["no", None, "separate"])),
        "foot": F.when(b == 23, "no"),
        "access": F.when(b == 22, "private"),
        "service": F.when((is_road == "economy") & (size % 3 == 0), "driveway"),
    }


def tag_map(columns: dict[str, Column]) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in columns.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


LATIN, GREEK = "abdegiklmnoprstuvxz", "αβδεγικλμνοπρστυβξζ"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segments per part: east to (x+1, y) and north to (x, y+1), where that node exists."""
    part = table(spark, sf_dir, "part")
    last = part.agg(F.max("p_partkey")).scalar()
    k = F.col("p_partkey")
    d = F.col("d")
    b = F.substring("p_brand", 7, 2).cast("int")
    x, y = grid_x(k), grid_y(k)
    x2, y2 = x + (1 - d), y + d
    to_key = k + F.when(d == 0, 1).otherwise(COLUMNS)
    size = F.col("p_size")
    rows = (
        part.withColumn("last_key", last)
        .withColumn("d", F.explode(F.array(F.lit(0), F.lit(1))))
        .filter(F.when(d == 0, x < COLUMNS - 1).otherwise(k + COLUMNS <= F.col("last_key")))
    )
    manual = F.when(size % 23 == 0, F.struct(
        pick(b % 3, ["confirmed", "corrected", "needs_inspection"]).alias("result"),
        (b % 3 == 1).alias("override"),
        F.when(b % 3 == 0, "accessible").when(b % 3 == 1, pick(b % 4, ["accessible", "partial", "inaccessible", "unverified"]))
        .alias("status"),
        F.to_timestamp(F.lit("2001-06-01 00:00:00")).alias("at"),
        F.lit("checked on site").alias("notes")))
    tags = _tags(b, size, F.col("p_type"), d)
    return classify_ways(rows.select(
        grid_region(k).alias("region_id"),
        F.concat(F.lit("w"), k, F.when(d == 0, "E").otherwise("N")).alias("segment_id"),
        k.alias("way_id"),
        b.alias("osm_version"),
        F.when(size % 5 != 0, F.to_timestamp(F.lit("1997-01-01 00:00:00"))
               + F.make_dt_interval((size * 37 + b * 11).cast("int"))).alias("osm_ts"),
        F.concat(F.lit("n"), k).alias("from_node"),
        F.concat(F.lit("n"), to_key).alias("to_node"),
        F.array(point(grid_lng(x), grid_lat(y)), point(grid_lng(x2), grid_lat(y2))).alias("geometry"),
        point(grid_lng((x + x2) / 2.0), grid_lat((y + y2) / 2.0)).alias("centre"),
        (size + 20 + d * 7).cast("double").alias("length_m"),
        F.col("p_name").alias("street_name"),
        F.when(size % 2 == 0, F.translate("p_name", LATIN, GREEK)).alias("street_name_el"),
        tag_map(tags).alias("tags"),
        manual.alias("manual"),
        ((size % 23 == 0) & (b % 3 == 2)).alias("needs_inspection"),
    ))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One structured image observation per line item."""
    q = F.floor("l_quantity").cast("long")
    disc = F.floor(F.col("l_discount") * 100 + 0.5).cast("long")
    tax = F.floor(F.col("l_tax") * 100 + 0.5).cast("long")
    o, ln, s, k = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    own = F.concat(F.lit("w"), k, F.when(o % 2 == 0, "E").otherwise("N"))
    other = F.concat(F.lit("w"), k, F.when(o % 2 == 0, "N").otherwise("E"))
    severity = pick((k + ln) % 5, ["none", "minor", "moderate", "blocking", "unknown"])
    observation = F.struct(
        F.when(F.col("l_returnflag") == "R", "good").when(F.col("l_returnflag") == "A", "medium")
        .otherwise("poor").alias("image_quality"),
        F.struct(pick(ln, [None, "yes", "yes", "yes", "no", "not_visible", "unknown", "yes"]).alias("visible"),
                 pick(q % 4, ["clear", "restricted", "blocked", "unknown"]).alias("condition")).alias("pedestrian_path"),
        F.struct(pick(s % 4, ["yes", "no", "not_visible", "unknown"]).alias("visible"),
                 pick(s % 3, ["usable", "damaged", "unknown"]).alias("condition")).alias("curb_ramp"),
        F.struct(F.when(disc == 10, "yes").when(disc <= 3, "no").otherwise("unknown").alias("visible")).alias("stairs"),
        F.struct(pick(o % 6, ["paved", "paving_stones", "gravel", "dirt", "other", "unknown"]).alias("type"),
                 pick(tax % 4, ["good", "uneven", "damaged", "unknown"]).alias("condition")).alias("surface"),
        F.struct(F.when((k + ln) % 5 == 0, "no").otherwise("yes").alias("visible"), severity.alias("severity"),
                 F.when((k + ln) % 5 == 3, "parked scooter").otherwise("").alias("description")).alias("obstacle"),
        F.struct(F.when(s % 5 < 3, "yes").otherwise("not_visible").alias("visible"),
                 F.when(s % 5 == 0, F.array(F.lit("marked_crossing"), F.lit("tactile_paving")))
                 .when(s % 5 == 1, F.array(F.lit("dropped_kerb")))
                 .when(s % 5 == 2, F.array(F.lit("traffic_signals")))
                 .otherwise(F.array().cast("array<string>")).alias("accessible_features")).alias("crossing"),
        F.struct(pick((q + s) % 4, ["clear", "restricted", "blocked", "unknown"]).alias("classification")).alias("clear_passage"),
        F.array_compact(F.array(F.when(ln == 7, "low light"), F.when(q > 45, "glare"), F.when(disc == 0, "partly hidden")))
        .alias("uncertain_findings"),
        F.lit("").alias("notes"),
    )
    return table(spark, sf_dir, "lineitem").select(
        _item_id("o").alias("observation_id"),
        F.when(s % 4 == 0, F.array(own, other)).otherwise(F.array(own)).alias("segment_ids"),
        grid_region(k).alias("region_id"),
        F.when((F.col("l_linestatus") == "F") & (s % 10 == 0), "citizen").otherwise("mapillary").alias("source_type"),
        _item_id("img").alias("source_id"),
        observation.alias("observation"),
        F.when(q != 1, F.col("l_shipdate")).alias("captured_at"),
        (F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("analysed_at"),
        F.when(q == 13, "failed").when(q == 14, "superseded").otherwise("active").alias("status"),
    )


def _item_id(prefix: str) -> Column:
    return F.concat_ws("-", F.lit(prefix), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One street-level frame per line item, a few metres from its part's node."""
    q = F.floor("l_quantity").cast("long")
    disc = F.floor(F.col("l_discount") * 100 + 0.5).cast("long")
    tax = F.floor(F.col("l_tax") * 100 + 0.5).cast("long")
    s, k = F.col("l_suppkey"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        _item_id("img").alias("image_id"),
        grid_region(k).alias("region_id"),
        (grid_lng(grid_x(k)) + (q % 10) * F.lit(0.00004)).alias("lng"),
        (grid_lat(grid_y(k)) + ((disc % 7) - 3) * F.lit(0.00004) + (q % 3) * F.lit(0.000007)).alias("lat"),
        F.when(q != 1, F.col("l_shipdate")).alias("captured_at"),
        F.when(q % 9 != 0, ((q * 7) % 360).cast("double")).alias("compass_angle"),
        (s % 20 == 0).alias("is_pano"),
        F.when(tax != 0, disc / F.lit(10.0)).alias("quality_score"),
        F.when(s % 11 != 0, F.concat(F.lit("seq"), s)).alias("sequence_id"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resident report per event, close to the node event_id modulo the grid size."""
    events = table(spark, sf_dir, "events")
    keys = table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).scalar()
    e = F.col("event_id")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    k = e % F.col("n_keys")
    lng = grid_lng(grid_x(k)) + (cents % 10) * F.lit(0.00004)
    lat = grid_lat(grid_y(k)) + (cents % 37) * F.lit(0.00001)
    categories = [
        "broken_pavement", "missing_curb_ramp", "steps", "blocked_sidewalk", "narrow_passage",
        "surface_problem", "crossing_problem", "temporary_obstruction", "other"]
    return events.withColumn("n_keys", keys).select(
        F.concat(F.lit("rep"), e).alias("report_id"),
        grid_region(k).alias("region_id"),
        pick(F.when(F.col("event_type") == "view", cents % 9).otherwise(e % 9), categories).alias("category"),
        F.col("props").alias("description"),
        point(lng, lat).alias("location"),
        F.concat(F.lit("w"), k, F.when(e % 3 == 0, "N").otherwise("E")).alias("segment_id"),
        F.when(e % 4 == 0, F.concat(F.lit("reports/"), e, F.lit(".jpg"))).alias("photo_path"),
        (e % 4 == 0).alias("has_photo"),
        F.concat(F.lit("u"), F.col("user_id")).alias("reporter_uid"),
        pick(e % 7, ["pending", "pending", "needs_review", "verified", "verified", "rejected", "resolved"]).alias("status"),
        F.when(e % 50 != 0, F.col("ts")).alias("created_at"),
        F.when((e % 7).isin(3, 4), F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("verified_at"),
        F.when(e % 7 >= 3, F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("reviewed_at"),
        F.when(e % 7 == 5, F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("photo_delete_after"),
        F.when(e % 7 == 4, "works").alias("assigned_to"),
    )


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One public service per supplier."""
    s = F.col("s_suppkey")
    k = s * 20 + F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("poi"), s).alias("poi_id"),
        grid_region(k).alias("region_id"),
        pick(F.col("s_nationkey") % 15, [
            "hospital", "clinic", "doctors", "pharmacy", "school", "kindergarten", "university", "townhall",
            "government", "social_facility", "bus_station", "bus_stop", "post_office", "library",
            "community_centre"]).alias("class"),
        F.col("s_name").alias("name"),
        (grid_lng(grid_x(k)) + F.lit(0.0001)).alias("lng"),
        (grid_lat(grid_y(k)) + F.lit(0.00005)).alias("lat"),
    )


def analysis_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis call per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"),
        F.col("ts"),
        F.concat(F.lit("img"), F.col("user_id")).alias("source_id"),
        F.concat(F.lit("job"), F.floor(F.col("event_id") / F.lit(100.0))).alias("job_id"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "cached")
        .otherwise("ok").alias("outcome"),
    )


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per customer: from the customer's node to one a few blocks away."""
    customer = table(spark, sf_dir, "customer")
    part = table(spark, sf_dir, "part").select("p_partkey").hint("merge")  # grows with the map: not broadcast
    k = F.col("c_custkey")
    x, y = grid_x(k), grid_y(k)
    dx = F.col("c_nationkey") % 4 + 1
    dy = k % 3
    x2 = F.when(x + dx < COLUMNS, x + dx).otherwise(x - dx)
    goal = (y + dy) * COLUMNS + x2
    return (
        customer.withColumn("goal_key", goal)
        .join(part, F.col("goal_key") == F.col("p_partkey"), "left_semi")
        .select(
            F.concat(F.lit("req"), k).alias("request_id"),
            grid_region(k).alias("region_id"),
            F.concat(F.lit("n"), k).alias("origin_node"),
            F.concat(F.lit("n"), F.col("goal_key")).alias("goal_node"),
            F.when(F.col("c_mktsegment") == "BUILDING", "wheelchair")
            .when(F.col("c_mktsegment") == "FURNITURE", "reduced_mobility")
            .when(F.col("c_mktsegment") == "MACHINERY", "stroller").otherwise("balanced").alias("profile"),
            (F.col("c_acctbal") > 5000).alias("prefer_verified"),
            point(grid_lng(x) + F.lit(0.00011), grid_lat(y) + F.lit(0.00003)).alias("origin"),
            point(grid_lng(x2) - F.lit(0.00007), grid_lat(y + dy) + F.lit(0.00002)).alias("destination"),
        ))


def point_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trips between points; some start or end off the network, some within one street segment."""
    k = F.substring("request_id", 4, 20).cast("long")
    o, d = F.col("origin"), F.col("destination")
    far = lambda n: F.when(k % n == 0, 0.5).otherwise(0.0)
    return route_requests(spark, sf_dir).select(
        "request_id", "region_id", "profile", "prefer_verified", point(o["lng"] + far(29), o["lat"]).alias("origin"),
        F.when(k % 11 == 0, point(o["lng"] + F.lit(0.0001), o["lat"])).otherwise(point(d["lng"] + far(31), d["lat"])).alias("destination"))


def ways(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(raw_nodes, ways): part k is a way of three nodes k, k+1, k+41 with a little noise."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    b = F.substring("p_brand", 7, 2).cast("int")
    nodes = part.select(
        grid_region(k).alias("region_id"), k.alias("node_id"),
        grid_lng(grid_x(k)).alias("lng"), grid_lat(grid_y(k)).alias("lat"))
    tags = _tags(b, F.col("p_size"), F.col("p_type"), F.lit(0))
    tags["name"] = F.col("p_name")
    tags["name:el"] = F.when(F.col("p_size") % 2 == 0, F.translate("p_name", LATIN, GREEK))
    tags["postal_code"] = F.lit("8042")
    out = part.select(
        grid_region(k).alias("region_id"), k.alias("way_id"), b.alias("version"),
        F.to_timestamp(F.lit("2001-01-01 00:00:00")).alias("ts"),
        F.when(F.col("p_size") % 4 == 0, F.array(k, k + 1, k + 2)).otherwise(F.array(k, k + 1, k + 41)).alias("nodes"),
        tag_map(tags).alias("tags"))
    return nodes, out


def labels(spark: SparkSession, sf_dir: str, assessments: DataFrame) -> DataFrame:
    """One ground-truth label per part, on its east segment."""
    part = table(spark, sf_dir, "part")
    b = F.substring("p_brand", 7, 2).cast("int")
    truth = part.select(
        F.concat(F.lit("w"), F.col("p_partkey"), F.lit("E")).alias("segment_id"),
        pick(b % 3, ["accessible", "partial", "inaccessible"]).alias("true_status"),
        F.array_compact(F.array(
            F.when(b % 4 == 0, "steps"), F.when(b % 5 == 0, "narrow_width"), F.when(b % 7 == 0, "high_kerb")))
        .alias("true_barriers"))
    return truth.join(assessments, "segment_id").select(
        "segment_id", "region_id", "true_status", "true_barriers",
        F.col("status").alias("predicted_status"),
        F.col("accessibility_score").alias("predicted_score"),
        F.col("evidence_confidence").alias("predicted_confidence"),
        F.col("barriers").alias("predicted_barriers"))
