"""Way filters, classification and tag projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footscape.functions.text import phonetic_key  # noqa: F401  (re-exported for name work)

# --- fixed values: tag vocabularies ----------------------------------------
PEDESTRIAN = ["footway", "path", "pedestrian", "steps", "living_street", "track", "corridor"]
WALKABLE_ROADS = ["residential", "unclassified", "service", "tertiary", "secondary", "primary", "road"]
EXCLUDED = [
    "motorway", "motorway_link", "trunk", "trunk_link", "construction", "proposed", "raceway",
    "bus_guideway", "escape",
]
TRUTHY = ["yes", "designated", "permissive", "official", "true", "1"]
FALSY = ["no", "private", "false", "0"]
RELEVANT_KEYS = [
    "highway", "footway", "foot", "access", "wheelchair", "surface", "smoothness", "width", "est_width",
    "kerb", "kerb:height", "incline", "tactile_paving", "ramp", "ramp:wheelchair", "barrier", "crossing",
    "crossing:markings", "crossing:signals", "sidewalk", "sidewalk:left", "sidewalk:right", "sidewalk:side",
    "step_count", "handrail", "lit", "name", "name:en", "name:el", "covered", "segregated", "bicycle",
    "service", "oneway", "layer", "bridge", "tunnel",
]


def tag(name: str, tags: Column | None = None) -> Column:
    return (F.col("tags") if tags is None else tags)[name]


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin(TRUTHY), F.lit(False))


def falsy(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin(FALSY), F.lit(False))


def is_any(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(values), F.lit(False))


def walkable() -> Column:
    """True for ways a pedestrian may use."""
    hw, foot, access = tag("highway"), tag("foot"), tag("access")
    return (
        is_any(hw, PEDESTRIAN + WALKABLE_ROADS)
        & ~is_any(hw, EXCLUDED)
        & ~falsy(foot)
        & ~(is_any(access, FALSY) & ~truthy(foot))
    )


def way_kind() -> Column:
    hw, footway = tag("highway"), tag("footway")
    return (
        F.when(hw == "steps", "steps").when(hw == "pedestrian", "pedestrian_street")
        .when(hw == "corridor", "corridor")
        .when((hw == "footway") & (footway == "crossing"), "crossing")
        .when((hw == "footway") & (footway == "sidewalk"), "sidewalk")
        .when(hw == "footway", "footway").when(hw.isin("path", "track"), "path")
        .otherwise("road_walkable")
    )


def way_side() -> Column:
    def marked(v):
        return F.coalesce(tag("sidewalk:side") == v, F.lit(False)) | F.coalesce(tag("side") == v, F.lit(False))

    return F.when(tag("footway") == "sidewalk", F.when(marked("right"), "right").when(marked("left"), "left"))


def sidewalks_mapped_apart() -> Column:
    both = (tag("sidewalk:left") == "separate") & (tag("sidewalk:right") == "separate")
    return F.coalesce(tag("sidewalk") == "separate", F.lit(False)) | F.coalesce(both, F.lit(False))


def classify_ways(ways: DataFrame) -> DataFrame:
    """Add `kind`, `side` and `is_carriageway`."""
    return ways.withColumns({
        "kind": way_kind(), "side": way_side(), "is_carriageway": way_kind() == "road_walkable"})


def filter_pedestrian_ways(ways: DataFrame) -> DataFrame:
    return ways.filter(walkable())


def drop_redundant_carriageways(ways: DataFrame) -> DataFrame:
    """Drop roads whose sidewalks are drawn as ways of their own; needs classified ways."""
    return ways.filter(~(F.col("is_carriageway") & sidewalks_mapped_apart()))


def parse_stats(ways: DataFrame, *keys: str) -> DataFrame:
    """Received, kept and skipped ways in one pass, optionally per key."""
    redundant = walkable() & (way_kind() == "road_walkable") & sidewalks_mapped_apart()
    return ways.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ways_received"),
        F.count_if(walkable() & ~redundant).alias("ways_kept"),
        F.count_if(~walkable()).alias("skipped_non_pedestrian"),
        F.count_if(redundant).alias("skipped_redundant_carriageway"),
    )


def project_relevant_tags(ways: DataFrame) -> DataFrame:
    """Keep only the tag keys the engine reads."""
    return ways.withColumn("tags", F.map_filter(
        "tags", lambda k, v: k.isin(RELEVANT_KEYS) & v.isNotNull()))


def display_name(ways: DataFrame, locale: str = "en", column: str = "display_name") -> DataFrame:
    order = ["name:el", "name", "name:en"] if locale == "el" else ["name:en", "name", "name:el"]
    return ways.withColumn(column, F.coalesce(*[F.nullif(tag(k), F.lit("")) for k in order]))
