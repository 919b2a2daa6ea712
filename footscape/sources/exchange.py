"""Readers of landed files and writers of published ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footscape import schemas as SC
from footscape.functions.geo import point
from footscape.functions.numbers import half_up
from footscape.operators.ways import tag
from footscape.session import stored

# --- fixed values: public-service classes, first match wins ------------------
POI_RULES = [
    ("hospital", {"amenity": ["hospital"], "healthcare": ["hospital"]}),
    ("clinic", {"amenity": ["clinic"], "healthcare": ["clinic"]}),
    ("doctors", {"amenity": ["doctors"], "healthcare": ["doctor"]}),
    ("pharmacy", {"amenity": ["pharmacy"], "healthcare": ["pharmacy"]}),
    ("school", {"amenity": ["school"]}),
    ("kindergarten", {"amenity": ["kindergarten"]}),
    ("university", {"amenity": ["university", "college"]}),
    ("townhall", {"amenity": ["townhall"]}),
    ("government", {"office": ["government"], "amenity": ["public_building"]}),
    ("social_facility", {"amenity": ["social_facility"]}),
    ("bus_station", {"amenity": ["bus_station"]}),
    ("bus_stop", {"highway": ["bus_stop"], "public_transport": ["platform", "stop_position"]}),
    ("post_office", {"amenity": ["post_office"]}),
    ("library", {"amenity": ["library"]}),
    ("community_centre", {"amenity": ["community_centre"]}),
]


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(SC.OSM_FILE).option("multiLine", True).json(path)
    return df.select(F.explode("elements").alias("e")).select("e.*")


def read_osm(spark: SparkSession, path: str, region_id: str) -> tuple[DataFrame, DataFrame]:
    """(raw_nodes, ways) of an extract; ways without a node list are dropped."""
    e = read_elements(spark, path).withColumn("region_id", F.lit(region_id))
    nodes = e.filter("type = 'node'").select("region_id", F.col("id").alias("node_id"), F.col("lon").alias("lng"), "lat", "tags")
    ways = e.filter("type = 'way' and nodes is not null").select(
        "region_id", F.col("id").alias("way_id"), "version", F.try_to_timestamp("timestamp").alias("ts"), "nodes",
        F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"))
    return nodes, ways


def classify_poi(df: DataFrame) -> DataFrame:
    """Add `class`: the public service an element offers, or null."""
    out = None
    for name, rules in POI_RULES:
        cond = None
        for key, values in rules.items():
            hit = F.coalesce(tag(key).isin(values), F.lit(False))
            cond = hit if cond is None else cond | hit
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return df.withColumn("class", out)


def read_pois(spark: SparkSession, path: str, region_id: str) -> DataFrame:
    e = classify_poi(read_elements(spark, path))
    return e.select(
        F.concat("type", "id").alias("poi_id"), F.lit(region_id).alias("region_id"), "class",
        F.coalesce(tag("name"), tag("name:en"), tag("name:el")).alias("name"),
        F.coalesce("lon", F.col("center")["lon"]).alias("lng"), F.coalesce("lat", F.col("center")["lat"]).alias("lat"),
    ).filter("class is not null and lng is not null and lat is not null")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image metadata: computed geometry and compass preferred, numbers or null."""
    df = spark.read.schema(SC.IMAGE_FILE).json(path)
    coords = F.coalesce(F.col("computed_geometry")["coordinates"], F.col("geometry")["coordinates"])

    def number(c):
        return F.col(c).try_cast("double")

    return df.select(
        F.col("id").alias("image_id"), F.get(coords, F.lit(0)).alias("lng"), F.get(coords, F.lit(1)).alias("lat"),
        F.timestamp_millis(F.col("captured_at").try_cast("bigint")).alias("captured_at"),
        F.coalesce(number("computed_compass_angle"), number("compass_angle")).alias("compass_angle"),
        F.coalesce("is_pano", F.lit(False)).alias("is_pano"), "camera_type", number("width").alias("width"),
        number("height").alias("height"), number("quality_score").alias("quality_score"), F.col("sequence").alias("sequence_id"),
    ).filter("image_id is not null and lng is not null and lat is not null")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Landed structured outputs, one JSON record per line, with the observation parsed leniently into `raw`."""
    lines = spark.read.text(path)
    body = F.get_json_object("value", "$.observation")
    return lines.select(
        *[F.get_json_object("value", f"$.{k}").alias(n) for k, n in (
            ("observationId", "observation_id"), ("regionId", "region_id"), ("sourceType", "source_type"), ("sourceId", "source_id"))],
        F.from_json(F.get_json_object("value", "$.segmentIds"), "array<string>").alias("segment_ids"),
        F.try_to_timestamp(F.get_json_object("value", "$.capturedAt")).alias("captured_at"),
        F.coalesce(F.get_json_object("value", "$.status"), F.lit("active")).alias("status"),
        F.when(body.startswith("{"), F.from_json(body, SC.RAW_OBSERVATION)).alias("raw"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled samples from a bare array or from an object with `samples`."""
    df = spark.read.schema(SC.LABEL_FILE).option("multiLine", True).json(path)
    names = [f.name for f in SC.LABEL.fields]
    bare = F.array(F.struct(*names))
    rows = df.select(F.explode(F.coalesce("samples", bare)).alias("s"), F.col("regionId").alias("_region"))
    return rows.select(
        F.col("s.segmentId").alias("segment_id"), F.coalesce("s.regionId", "_region").alias("region_id"),
        F.col("s.trueStatus").alias("true_status"), F.col("s.trueBarriers").alias("true_barriers"),
        F.col("s.predictedStatus").alias("predicted_status"), F.col("s.predictedScore").alias("predicted_score"),
        F.col("s.predictedConfidence").alias("predicted_confidence"), F.col("s.predictedBarriers").alias("predicted_barriers"),
        F.col("s.assessmentVersion").alias("assessment_version")).filter("segment_id is not null")


# --- geometry interchange -----------------------------------------------------------
def pack_geometry(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Polyline to one flat array of numbers; a flat column is left as it is."""
    if dict(df.dtypes)[column] == "array<double>":
        return df
    return df.withColumn(column, F.flatten(F.transform(column, lambda p: F.array(p["lng"], p["lat"]))))


def unpack_geometry(df: DataFrame, column: str = "geometry") -> DataFrame:
    """The reverse of `pack_geometry`."""
    if dict(df.dtypes)[column] != "array<double>":
        return df
    c = F.col(column)
    n = F.floor(F.size(c) / F.lit(2)).cast("int")
    line = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(F.get(c, i * 2), F.get(c, i * 2 + 1))))
    return df.withColumn(column, line)


# --- writers ------------------------------------------------------------------------
#: Parts of the index of keys beside a keyed table.
KEY_BUCKETS = 64


def _winners(df: DataFrame, keys: list[str], newest: str | None) -> DataFrame:
    """One row a key: that with the largest `newest`, and of equal ones that with the largest digest, so that a repeat gives the same."""
    row = F.struct(*df.columns)
    order = F.struct(*([F.col(newest)] if newest else []), F.xxhash64(*df.columns))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_upsert(df: DataFrame, path: str, keys: list[str], partition: str = "region_id", newest: str | None = None) -> None:
    """Idempotent keyed write to a Parquet table: same ids replace, none are duplicated, also where an id moves to another partition.

    An index beside the table (`_keys`, in KEY_BUCKETS parts by digest of the key) knows each key's partition. Only parts of
    it that the new rows touch are read, and only partitions that have one of their keys or get one are read and
    replaced; one that is left without rows is removed. Merged rows are stored first, since a
    table cannot be read and replaced in one job; a write that is repeated after a failure gives the same table.
    """
    spark = df.sparkSession
    new = stored(_winners(df, keys, newest))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int").alias("bucket")
    own = new.select(*keys, F.col(partition).alias("_part"), bucket)
    index = f"{path}/_keys"
    merged, places = new, own
    if _there(spark, path):
        known = spark.read.parquet(index) if _there(spark, index) else spark.read.parquet(path).select(*keys, F.col(partition).alias("_part"), bucket)
        known = known.join(own.select("bucket").distinct(), "bucket", "left_semi")
        moved = known.join(new.select(*keys), keys, "left_semi").select("_part")
        touched = stored(moved.unionByName(own.select("_part")).distinct())
        table = spark.read.parquet(path)
        old = table.join(touched, table[partition].eqNullSafe(touched["_part"]), "left_semi").join(new.select(*keys), keys, "left_anti")
        merged = stored(old.unionByName(new, allowMissingColumns=True))
        places = stored(known.join(new.select(*keys), keys, "left_anti").select(*own.columns).unionByName(own))
        empty = touched.join(merged.select(F.col(partition).alias("_part")).distinct(), "_part", "left_anti").filter("_part IS NOT NULL")
        for r in empty.collect():  # partitions of the table, one row each
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={r['_part']}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    places.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(index)


def csv_field(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(df: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_field(c) for _, c in columns]).alias("value"))


def export_csv(df: DataFrame, columns: list[tuple[str, Column]], path: str) -> None:
    """RFC 4180 text: byte-order mark, header, CRLF, null as empty.

    Parts are written in parallel in row order; part 0 of the listing is the
    header, so concatenating the parts gives the file.
    """
    quote = '"'

    def escape(s):
        return f'"{s.replace(quote, quote * 2)}"' if any(x in s for x in ',"\n\r') else s

    spark = df.sparkSession
    header = spark.range(1, numPartitions=1).select(F.lit("﻿" + ",".join(escape(n) for n, _ in columns)).alias("value"))
    body = csv_lines(df, columns)
    header.unionByName(body).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def issue_export_rows(issues: DataFrame, limit: int | None = None) -> tuple[DataFrame, list[tuple[str, Column]]]:
    c = F.col
    services = F.array_join(F.transform(F.coalesce("nearby_pois", F.array().cast("array<struct<class:string,name:string,distance_m:int>>")),
                                        lambda p: F.concat(p["class"], F.lit(" ("), p["distance_m"], F.lit("m)"))), "; ")
    columns = [
        ("Priority", c("priority_score")), ("Band", c("priority_band")), ("Segment ID", c("segment_id")), ("Street", c("street_name")),
        ("Street (EL)", c("street_name_el")), ("Latitude", c("centre")["lat"]), ("Longitude", c("centre")["lng"]),
        ("Accessibility status", c("status")), ("Accessibility score", c("accessibility_score")),
        ("Evidence confidence", c("evidence_confidence")), ("Evidence freshness", c("freshness_state")),
        ("Barriers", F.array_join("barriers", "; ")), ("Confirmed resident reports", c("verified_report_count")),
        ("Accessible detour ratio", F.coalesce(c("detour_ratio").cast("string"), F.lit("none found"))), ("Nearby public services", services),
        ("Workflow status", c("workflow_status")), ("Assigned to", c("assigned_department"))]
    rows = issues.orderBy(F.desc("priority_score"), "segment_id")
    return rows if limit is None else rows.limit(limit), columns


def report_export_rows(reports: DataFrame, limit: int | None = None) -> tuple[DataFrame, list[tuple[str, Column]]]:
    c = F.col
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    columns = [
        ("Report ID", c("report_id")), ("Submitted", F.date_format("created_at", iso)), ("Category", c("category")), ("Status", c("status")),
        ("Latitude", c("location")["lat"]), ("Longitude", c("location")["lng"]), ("Street", c("street_name")), ("Segment ID", c("segment_id")),
        ("Description", c("description")), ("Has photo", F.when(c("has_photo"), "yes").otherwise("no")),
        ("Reviewed", F.date_format("reviewed_at", iso)), ("Assigned to", c("assigned_to"))]
    rows = reports.orderBy(F.desc_nulls_last("created_at"), "report_id")
    return rows if limit is None else rows.limit(limit), columns


def coverage_export_rows(cov: DataFrame) -> DataFrame:
    """Ten measures per region from a coverage row: metres and percent of the network."""
    rows = [("Total pedestrian network", "total_m", None), ("Assessed", "assessed_m", "assessed_pct"),
            ("Unknown (insufficient evidence)", "unknown_m", "unknown_pct"), ("Manually verified", "manually_verified_m", "manually_verified_pct"),
            ("Assessed from imagery", "image_assessed_m", "image_assessed_pct"), ("Map tags only", "tags_only_m", "tags_only_pct"),
            ("Stale evidence", "stale_m", "stale_pct"), ("Classified accessible", "accessible_m", "accessible_pct"),
            ("Classified partial", "partial_m", "partial_pct"), ("Classified inaccessible", "inaccessible_m", "inaccessible_pct")]
    items = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("measure"), F.col(m).alias("metres"),
                               (F.col(p) if p else F.lit(100.0)).alias("percent")) for i, (n, m, p) in enumerate(rows)])
    return cov.select("region_id", F.explode(items).alias("r")).select("region_id", "r.*")


def geojson_features(segments: DataFrame) -> DataFrame:
    """One JSON feature per segment, arrays joined for spreadsheets and GIS tools."""
    coords = F.transform("geometry", lambda p: F.array(p["lng"], p["lat"]))
    text = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ")
    props = F.struct(
        F.col("segment_id").alias("segmentId"), F.col("way_id").alias("osmWayId"), "kind", F.col("street_name").alias("street"),
        F.col("length_m").alias("lengthMeters"), F.coalesce("status", F.lit("unverified")).alias("status"),
        F.col("accessibility_score").alias("accessibilityScore"), F.col("evidence_confidence").alias("evidenceConfidence"),
        F.col("freshness_state").alias("freshness"), text("barriers").alias("barriers"), text("positive_features").alias("positives"),
        text("sources").alias("sources"), F.col("manually_verified").alias("manuallyVerified"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("segment_id").alias("id"),
                       F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"), props.alias("properties"))
    return segments.filter(F.size("geometry") >= 2).select("region_id", "segment_id", F.to_json(feature).alias("feature"))


def export_geojson(segments: DataFrame, path: str, collection: bool = False) -> None:
    """Features by region, one text file per partition: a feature a line, or with `collection` a FeatureCollection a file.

    Files of a collection are written by ranges of segment ids within a region; each is a document of its own, so no
    task has to hold or wait for a whole region.
    """
    rows = geojson_features(segments)
    if not collection:
        rows.select("region_id", F.col("feature").alias("value")).write.mode("overwrite").partitionBy("region_id").text(path)
        return
    parted = stored(rows.repartitionByRange("region_id", "segment_id").sortWithinPartitions("region_id", "segment_id").withColumn("_part", F.spark_partition_id()))
    place = Window.partitionBy("region_id", "_part")
    lines = parted.withColumns({"_n": F.row_number().over(place.orderBy("segment_id")), "_c": F.count(F.lit(1)).over(place)})
    head = F.when(F.col("_n") == 1, '{"type":"FeatureCollection","features":[').otherwise("")
    lines = lines.withColumn("value", F.concat(head, "feature", F.when(F.col("_n") == F.col("_c"), "]}").otherwise(",")))
    lines.repartition("region_id", "_part").sortWithinPartitions("region_id", "_part", "_n").select(
        "region_id", "_part", "value").write.mode("overwrite").partitionBy("region_id", "_part").text(path)


def bundle_features(segments: DataFrame) -> DataFrame:
    """The compact feature rows of the public map bundle."""
    none = F.array().cast("array<string>")
    return segments.filter(F.size("geometry") >= 2).select(
        "region_id", F.col("segment_id").alias("id"), "geometry", F.coalesce("status", F.lit("unverified")).alias("status"),
        F.col("accessibility_score").alias("score"), F.coalesce("evidence_confidence", F.lit(0)).alias("confidence"),
        F.coalesce("freshness_state", F.lit("none")).alias("freshness"), F.coalesce("barriers", none).alias("barriers"),
        F.coalesce("positive_features", none).alias("positives"), F.coalesce("sources", none).alias("sources"), "kind",
        F.col("street_name").alias("name"), F.col("street_name_el").alias("name_el"), half_up(F.coalesce("length_m", F.lit(0.0))).cast("int").alias("len"),
        F.col("manually_verified").alias("verified"), (F.coalesce("image_count", F.lit(0)) if "image_count" in segments.columns else F.lit(0)).alias("images"))


def bundle_metadata(segments: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Per region: next version, feature count, metres and status counts."""
    s = segments.filter(F.size("geometry") >= 2).withColumn("_s", F.coalesce("status", F.lit("unverified")))
    from footscape import params as P

    m = s.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("segment_count"), half_up(F.sum("length_m")).alias("total_length_m"),
        *[F.count_if(F.col("_s") == x).alias(f"n_{x}") for x in P.STATUSES])
    if versions is None:
        return m.withColumn("version", F.lit(1))
    last = versions.groupBy("region_id").agg(F.max("version").alias("_v"))
    return m.join(last, "region_id", "left").withColumn("version", F.coalesce("_v", F.lit(0)) + 1).drop("_v")


def publish_bundle(segments: DataFrame, path: str, versions: DataFrame | None = None) -> DataFrame:
    """Write features by region and version, and return (and write) the new versions' metadata. `versions` are those published
    before; a publication that is repeated with the same ones replaces its own features and metadata."""
    meta = stored(bundle_metadata(segments, versions))
    put = lambda df, where: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region_id", "version").parquet(f"{path}/{where}")
    put(bundle_features(segments).join(meta.select("region_id", "version"), "region_id"), "features")
    put(meta, "versions")
    return meta


def publish_graph(segments: DataFrame, path: str, version: int) -> DataFrame:
    """Write versioned edge and node tables; returns their statistics."""
    from footscape.operators.network import build_graph

    nodes, edges = build_graph(segments)
    edges.write.mode("overwrite").partitionBy("region_id").parquet(f"{path}/v={version}/edges")
    nodes.write.mode("overwrite").parquet(f"{path}/v={version}/nodes")
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("nodes"), half_up(F.sum("length_m") / 2).alias("total_length_m"))
