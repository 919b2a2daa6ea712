"""Explicit schemas of the landed files and the main tables; nothing is inferred."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType())])
TAGS = T.MapType(T.StringType(), T.StringType())

OSM_ELEMENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("nodes", T.ArrayType(T.LongType())),
    T.StructField("center", T.StructType([
        T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])),
    T.StructField("tags", TAGS),
])
OSM_FILE = T.StructType([T.StructField("elements", T.ArrayType(OSM_ELEMENT))])

IMAGE_FILE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("computed_geometry", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])),
    T.StructField("geometry", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])),
    T.StructField("captured_at", T.StringType()),
    T.StructField("computed_compass_angle", T.StringType()),
    T.StructField("compass_angle", T.StringType()),
    T.StructField("is_pano", T.BooleanType()),
    T.StructField("camera_type", T.StringType()),
    T.StructField("width", T.StringType()),
    T.StructField("height", T.StringType()),
    T.StructField("quality_score", T.StringType()),
    T.StructField("sequence", T.StringType()),
])

# Leaves that may hold a wrong type are landed as JSON text and checked later,
# so that one bad field never nulls the record.
RAW_OBSERVATION = (
    "struct<imageQuality:string,"
    "pedestrianPath:struct<visible:string,condition:string>,"
    "curbRamp:struct<visible:string,condition:string>,"
    "stairs:struct<visible:string>,"
    "surface:struct<type:string,condition:string>,"
    "obstacle:struct<visible:string,severity:string,description:string>,"
    "crossing:struct<visible:string,accessibleFeatures:string>,"
    "clearPassage:struct<classification:string>,"
    "uncertainFindings:string,notes:string>"
)
OBSERVATION = (
    "struct<image_quality:string,"
    "pedestrian_path:struct<visible:string,condition:string>,"
    "curb_ramp:struct<visible:string,condition:string>,"
    "stairs:struct<visible:string>,"
    "surface:struct<type:string,condition:string>,"
    "obstacle:struct<visible:string,severity:string,description:string>,"
    "crossing:struct<visible:string,accessible_features:array<string>>,"
    "clear_passage:struct<classification:string>,"
    "uncertain_findings:array<string>,notes:string>"
)

LABEL = T.StructType([
    T.StructField("segmentId", T.StringType()),
    T.StructField("regionId", T.StringType()),
    T.StructField("trueStatus", T.StringType()),
    T.StructField("trueBarriers", T.ArrayType(T.StringType())),
    T.StructField("predictedStatus", T.StringType()),
    T.StructField("predictedScore", T.IntegerType()),
    T.StructField("predictedConfidence", T.IntegerType()),
    T.StructField("predictedBarriers", T.ArrayType(T.StringType())),
    T.StructField("assessmentVersion", T.StringType()),
])
LABEL_FILE = T.StructType([T.StructField("samples", T.ArrayType(LABEL))] + LABEL.fields)

REPORT = T.StructType([
    T.StructField("report_id", T.StringType()),
    T.StructField("region_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("location", POINT),
    T.StructField("segment_id", T.StringType()),
    T.StructField("photo_path", T.StringType()),
    T.StructField("reporter_uid", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("verified_at", T.TimestampType()),
])
PING = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("route_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
])
