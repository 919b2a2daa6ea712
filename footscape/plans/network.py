"""Build a network from an extract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footscape import params as P
from footscape.functions import geo as G
from footscape.functions.numbers import half_up
from footscape.operators import network as N
from footscape.operators import ways as W


def kept_ways(ways: DataFrame) -> DataFrame:
    return W.drop_redundant_carriageways(W.classify_ways(W.filter_pedestrian_ways(ways)))


def build_network(raw_nodes: DataFrame, ways: DataFrame, params: P.Params = P.DEFAULT,
                  weld_m: float = P.WELD_DISTANCE_M) -> tuple[DataFrame, DataFrame]:
    """(segments, nodes).  Shuffles: by node for coordinates and uses, by cell for welding, by way for splitting.

    Both sides of its joins grow with the extract, and what Spark expects of their size is taken from compressed files,
    far below that of rows with tags: without a hint they would be broadcast through the driver.
    """
    kept = kept_ways(ways)
    vertices = N.junctions(N.way_nodes(kept, raw_nodes))
    parts = N.split_by_length(N.junction_split(vertices), params.max_segment_length_m)
    weld = N.weld_endpoints(vertices, weld_m)
    info = W.display_name(W.display_name(W.project_relevant_tags(kept), "en", "street_name"), "el", "street_name_el").select(
        "region_id", "way_id", F.col("version").alias("osm_version"), F.col("ts").alias("osm_ts"), "tags", "kind", "side", "is_carriageway",
        "street_name", "street_name_el")

    def welded(col, name):
        return weld.select("region_id", F.col("node_id").alias(col), F.col("welded_id").alias(f"_{name}")).hint("merge")

    out = parts.join(welded("from_osm", "f"), ["region_id", "from_osm"], "left").join(welded("to_osm", "t"), ["region_id", "to_osm"], "left")
    out = out.withColumns({
        "from_node": F.concat(F.lit("n"), F.coalesce("_f", "from_osm")), "to_node": F.concat(F.lit("n"), F.coalesce("_t", "to_osm"))})
    out = out.filter((F.col("from_node") != F.col("to_node")) & (F.col("_len") >= 0.5)).join(info.hint("merge"), ["region_id", "way_id"])
    segments = out.select(
        "region_id", F.concat(F.lit("w"), F.concat_ws("_", "way_id", "from_osm", "to_osm")).alias("segment_id"), "way_id", "osm_version",
        "osm_ts", "from_node", "to_node", "from_osm", "to_osm", "geometry", G.line_midpoint(F.col("geometry")).alias("centre"),
        half_up(F.col("_len"), 1).alias("length_m"), "kind", "side", "is_carriageway", "street_name", "street_name_el", "tags")
    ends = segments.select("region_id", F.explode(F.array(
        F.struct(F.col("from_node").alias("node_id"), F.col("from_osm").alias("osm_id"), F.get("geometry", F.lit(0)).alias("p")),
        F.struct(F.col("to_node").alias("node_id"), F.col("to_osm").alias("osm_id"), F.get("geometry", F.size("geometry") - 1).alias("p"))))
        .alias("e"), "segment_id")
    nodes = ends.groupBy("region_id", F.col("e")["node_id"].alias("node_id")).agg(
        F.min(F.struct("segment_id", "e")).alias("m")).select(
        "region_id", "node_id", F.col("m")["e"]["osm_id"].alias("osm_id"), F.col("m")["e"]["p"]["lng"].alias("lng"),
        F.col("m")["e"]["p"]["lat"].alias("lat"))
    return segments, nodes
